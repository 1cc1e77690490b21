"""Token counts of documents in flat token files, found by a vectorised scan for the end-of-document id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobatlas.llm.common import lists, read_table, save, text_bytes
from jobatlas.llm.packing import default_vocabulary, word_tokenizer
from jobatlas.llm.shared_files import new_folder, open_output, read_range
from jobatlas.llm.word_batches import Words, slices

#: Bytes of a token, tokens after which a task begins another file, tokens of a block that is scanned at once.
WIDTH, FILE_TOKENS, BLOCK_TOKENS = 2, 64 << 20, 1 << 20
#: Separator: the largest 16-bit number, which is no id of the vocabulary, so every token of a text is kept.
END = 65535
#: Documents of one manifest row.
MANIFEST_DOCS = 4096


def _ids(tokenizer, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """16-bit ids of each text of a batch (doc_id, body), END after each."""
    end = np.array([END], dtype="<u4").tobytes()
    for part in slices(batch, "body"):
        flat, ends = Words(part.column("body")).gather(tokenizer.words.__getitem__, end)
        yield from np.split(flat.view("<u4").astype("<u2"), ends[:-1] // 4)


def write_token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the tokens of ``docs`` (doc_id, text, ...) end to end, END after each document.

    Returns the manifest (file, first, doc_ids, tokens): which documents, from ordinal ``first`` on, lie in which file.
    The files hold 16-bit little-endian ids and nothing else.
    """
    folder, path = new_folder(docs.sparkSession, "tokens"), vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        out, uri, size, first, ids, written = None, "", 0, 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([written], pa.int64())],
                ["file", "first", "doc_ids", "tokens"],
            )

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), _ids(tokenizer, batch), strict=True):
                if out is None:
                    uri, size, first = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    out = open_output(uri)
                out.write(own.tobytes())
                size, written = size + len(own), written + len(own)
                ids.append(key)
                if len(ids) >= MANIFEST_DOCS or size >= FILE_TOKENS:
                    if size >= FILE_TOKENS:
                        out.close()
                        out = None
                    yield row()
                    first, ids, written = first + len(ids), [], 0
        if out is not None:
            out.close()
        if ids:
            yield row()

    return save(docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, "file string, first long, doc_ids array<long>, tokens long"))


def scan_separators(files: DataFrame, block_tokens: int = BLOCK_TOKENS, end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat files (file, tokens): tokens before its END.

    Blocks are scanned apart; a running scan over the few block rows of a file carries the last END before each block,
    so that a document's length is whole wherever blocks cut it.  Tokens after the last END are no document.
    """
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens).cast("long"))).alias("at")).where("tokens > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(read_range(uri, at * WIDTH, block_tokens * WIDTH), dtype="<u2")
                ends = np.flatnonzero(data == end) + at
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([at], pa.int64()), lists([ends.astype(np.int64)], pa.int64())], ["file", "at", "ends"])

    found = save(blocks.repartition("file", "at").mapInArrow(run, "file string, at long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "ends",
        F.coalesce(F.last(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1), ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"),
    )
    each = stitched.select("file", "done", "carry", "ends", F.posexplode("ends").alias("i", "last"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1))
    return each.select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("last") - start - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text, ...), counted in flat token files alone.

    Null and empty texts have no token; null and repeated ids are counted row by row; an empty table gives no row.
    """
    manifest = write_token_files(docs, vocabulary)
    files = manifest.groupBy("file").agg(F.sum("tokens").alias("tokens"))
    named = manifest.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return scan_separators(files).join(named, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_token_counts(spark, sf_dir) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(read_table(spark, sf_dir, "documents"))
