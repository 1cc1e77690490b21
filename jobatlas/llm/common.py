"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobatlas.session import ensure_checkpoint_dir

MASK = (1 << 64) - 1
#: Odd base of the polynomial hashes, its inverse modulo 2**64, and one random odd code per byte value.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODES = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
FOLDED_CODES = BYTE_CODES[_FOLDED]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def text_key() -> Column:
    """64-bit hash of the text's bytes."""
    return F.xxhash64(text_bytes())


def row_key(key: Column | None = None) -> Column:
    """64-bit hash of id and text (or of the id and the given text key); null ids are told apart by their texts."""
    return F.xxhash64(F.col("doc_id"), text_key() if key is None else key)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids get null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


#: Folders of saved tables that still stand, in the order they were written.
_standing: list[str] = []


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    _standing.append(path)
    return out


def release_earlier(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the saved tables that still stand and that ``docs`` does not read: a stage begins on written documents.

    Results of earlier operators that have not been written yet can't be read after it.
    """
    names = docs.inputFiles()
    _delete(spark, *[path for path in _standing if not any(f"/{path.rpartition('/')[2]}/" in name for name in names)])


def _delete(spark: SparkSession, *paths: str) -> None:
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if text in _standing:
            _standing.remove(text)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Let Spark drop shuffle files of finished steps, whose results stand in written tables.

    ``tables`` are saved tables that nothing later reads; they are deleted.
    """
    _delete(spark, *(t.saved_path for t in tables))
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.java.lang.System.gc()


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``function`` to every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base (``up``) or of its inverse (``down``)."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(4096, 1 << max(1, n - 1).bit_length())
        have = np.full(size, BASE if kind == "up" else BASE_INVERSE, dtype=np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(data: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """Polynomial prefix sums: element i covers the first i bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * powers("up", len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), independent of where they stand."""
    inverse = powers("down", len(prefix))
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64)))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z taken as a-z."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    word = np.empty(len(data) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~IS_SPACE[data]
    steps = np.diff(word)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    return span_hashes(prefix_hashes(data, FOLDED_CODES), starts, ends)


def ordered_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of aligned sequences of hashes, position by position."""
    out = np.full(len(columns[0]), np.uint64(len(columns)), dtype=np.uint64)
    for x in columns:
        out = mix(out * BASE + x)
    return out


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list column out of one array per row."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


class Memo(dict):
    """Memory of a pure function of one key, in two generations, so that it stays bounded and keeps frequent keys."""

    def __init__(self, function: Callable, limit: int = 250_000) -> None:
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
