"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
driver and executors share, so a lost executor never loses them.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, return.
WORD_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary one is set only where none is named and executors share this machine's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="hyperpanel-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage durably: later stages reread the table, also after executors
    are lost.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a unique number for each row, stored, so that all readers see the same numbers."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read, under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without making Python strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def long_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, is null) of a long column."""
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def row_slices(batch: pa.RecordBatch, text_index: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows that hold about ``most_bytes`` of text (a longer row stands alone)."""
    offsets, _ = utf8_buffers(batch.column(text_index))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    trim()


def trim() -> None:
    """Give memory that a worker has freed back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def local_path(uri: str) -> str | None:
    """Path of a ``file:`` URI, None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_store(uri: str):
    """(pyarrow filesystem, path) for a URI of the shared store: local, HDFS, S3 or GCS."""
    from pyarrow import fs

    local = local_path(uri)
    if local is not None:
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: Iterator[bytes]) -> int:
    """Write a file as a whole or not at all: into a sibling name, then moved."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    size = 0
    with store.open_output_stream(f"{path}.writing") as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(f"{path}.writing", path)
    return size
