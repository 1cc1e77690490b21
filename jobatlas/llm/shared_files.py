"""Plain files in the shared checkpoint folder, written and read by tasks.

A file's name holds the task attempt; only files named in a committed manifest table are read, so a repeated or lost
task leaves at most an unread file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from jobatlas.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, purpose: str) -> str:
    """URI of a fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def open_output(uri: str):
    """Stream to a new file of any store that Arrow knows."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_stream(uri: str):
    """Sequential stream of a file's bytes as they are."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def read_range(uri: str, start: int, size: int) -> bytes:
    """``size`` bytes from ``start`` on."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)
