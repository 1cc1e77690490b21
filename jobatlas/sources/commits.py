"""Tables in versions: data in folders of their own, one small commit file per version.

``<path>/_data/<name>`` holds the files of a version, ``<path>/_commits/<number>`` its name.  A commit file is made with
create-if-absent, so of two writers one gets the number and the other takes the next.  A file without its closing line
is no commit: its writer has not finished, or never will.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

DIGITS = 12
#: Last line of a complete commit file.
END = "end"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of the last change in ms) of the entries of a folder; none if it is not there."""
    make, store = _store(spark, path)
    if not store.exists(make(path)):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in store.listStatus(make(path))]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name, _ in _listed(spark, f"{path}/_commits") if name.isdigit())


def _name_of(spark: SparkSession, path: str, number: int) -> str | None:
    """Data folder that a commit file names, if the file is complete."""
    make, store = _store(spark, path)
    jvm = spark.sparkContext._jvm
    stream = store.open(make(f"{path}/_commits/{number:0{DIGITS}d}"))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    lines = text.split("\n")
    return lines[0] if len(lines) > 1 and lines[1] == END else None


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    return [n for n in _numbers(spark, path) if _name_of(spark, path, n) is not None]


def current_folder(spark: SparkSession, path: str, version: int | None = None) -> str:
    """Data folder of the newest committed version, or of the given one."""
    for number in reversed(_numbers(spark, path)):
        if version is None or number == version:
            name = _name_of(spark, path, number)
            if name is not None:
                return f"{path}/_data/{name}"
    raise FileNotFoundError(f"no committed version of {path}")


def read_current(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The table as of its newest commit when this is called, or as of the given version."""
    return spark.read.format(fmt).load(current_folder(spark, path, version))


def commit(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> str:
    """Write ``df`` as a new version and commit it; returns its data folder.

    A writer that fails before the commit leaves an unread folder behind and changes nothing.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*partition_by).format(fmt).save(f"{path}/_data/{name}")
    make, store = _store(spark, path)
    number = max(_numbers(spark, path), default=0)
    while True:
        number += 1
        target = make(f"{path}/_commits/{number:0{DIGITS}d}")
        try:
            stream = store.create(target, False)
        except Py4JJavaError:
            if not store.exists(target):
                raise
            continue
        try:
            stream.write(bytearray(f"{name}\n{END}\n".encode()))
        finally:
            stream.close()
        return f"{path}/_data/{name}"


def expire(spark: SparkSession, path: str, older_than_ms: int, now_ms: int) -> list[int]:
    """Remove versions whose successor was committed before ``now_ms - older_than_ms``; returns their numbers.

    The newest version always stays.  Folders that no commit names are removed at the same age, so one that is being
    written stays as long as it is younger.
    """
    make, store = _store(spark, path)
    times = {int(name): at for name, at in _listed(spark, f"{path}/_commits") if name.isdigit()}
    kept = versions(spark, path)
    limit = now_ms - older_than_ms
    gone = [n for n, successor in zip(kept, kept[1:], strict=False) if times[successor] < limit]
    names = {_name_of(spark, path, n) for n in kept if n not in gone}
    for number in gone:
        store.delete(make(f"{path}/_commits/{number:0{DIGITS}d}"), False)
    for name, at in _listed(spark, f"{path}/_data"):
        if name not in names and at < limit:
            store.delete(make(f"{path}/_data/{name}"), True)
    return gone
