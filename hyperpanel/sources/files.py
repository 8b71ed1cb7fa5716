"""Files of fixed-size records read by byte ranges, files written by tasks part by part, and numbering of lines.

Bytes are read and written through pyarrow's file systems (local, HDFS, S3, GCS);
listings come from Spark. A range is at most ``STEP`` bytes, so files of any size
are read by many tasks. A task writes its part under a hidden name and moves it
when it is whole: a task that is repeated replaces its own part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a task reads at once.
STEP = 16 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a path on this machine."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where none is named, a temporary one if executors share this machine's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="hyperpanel-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, at = located(path)
    store.create_dir(at, recursive=True)
    return path


def head(path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file."""
    store, at = located(path)
    with store.open_input_stream(at) as f:
        return f.read(n)


def read_records(spark: SparkSession, path: str, record: int, decode: Callable[[int, bytes], pa.RecordBatch], schema: str, header: int = 0, rows: int | None = None, exact: bool = True) -> DataFrame:
    """What ``decode(first, bytes)`` makes of runs of records of ``record`` bytes behind a header.

    ``path`` may name several files: their records count on in order of names.
    ``rows`` is how many records are asked for; others than that are an error, or
    with ``exact`` False only fewer are. Sizes come from the listing.
    """
    listed = sorted((r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())  # a row a file
    files, first = [], 0
    for name, length in listed:
        n, rest = divmod(max(length - header, 0), record)
        if length < header or (exact and rest):
            raise ValueError(f"{name}: {length} bytes are no whole records of {record} bytes")
        files.append((name, first, n))
        first += n
    if rows is not None and (first < rows or (exact and first != rows)):
        raise ValueError(f"expected {rows * record} bytes, found {first * record}")
    limit = first if rows is None else rows
    step = max(STEP // record, 1)
    runs = spark.createDataFrame([(name, a, min(n, limit - a)) for name, a, n in files if n and a < limit], "name string, first long, n long")
    runs = runs.select("name", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("at"))
    runs = runs.select("name", (F.col("first") + F.col("at")).alias("first"), (F.col("at") * record + header).alias("at"), (F.least(F.col("n") - F.col("at"), F.lit(step)) * record).alias("size"))
    count = sum(-(-min(n, limit - a) // step) for _, a, n in files if n and a < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, at = located(r["name"])
                with store.open_input_file(at) as f:
                    data = f.read_at(r["size"], r["at"])
                if len(data) != r["size"]:
                    raise ValueError(f"{r['name']}: {r['size']} bytes expected at {r['at']}")
                yield decode(r["first"], data)

    return runs.repartition(max(min(count, 10_000), 1), "name", "at").mapInArrow(run, schema)


def write_parts(rows: DataFrame, path: str, by: list[str], encode: Callable[[pa.RecordBatch], bytes], first: bytes = b"", within: list[str] | None = None) -> None:
    """``encode`` of all rows in order of ``by`` (and ``within``) as files head, part-00000, ...; joined they are one file that starts with ``first``."""
    store, at = located(path)
    store.create_dir(at, recursive=True)
    if first:
        with store.open_output_stream(f"{at}/head") as f:
            f.write(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, place = located(path)
        hidden, n = f"{place}/.part-{part:05d}-{uuid.uuid4().hex}", 0
        with own.open_output_stream(hidden) as f:
            for batch in batches:
                if batch.num_rows:
                    n += f.write(encode(batch))
        if n:
            own.move(hidden, f"{place}/part-{part:05d}")
        else:
            own.delete_file(hidden)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["bytes"])

    rows.repartitionByRange(*by).sortWithinPartitions(*by, *(within or [])).mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()  # one number


def join_parts(path: str, file: str) -> None:
    """Copies what :func:`write_parts` wrote into one file, block by block."""
    (store, at), (to, place) = located(path), located(file)
    with to.open_output_stream(place) as out:
        for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda i: i.base_name):
            if info.base_name == "head" or info.base_name.startswith("part-"):
                with store.open_input_stream(info.path) as f:
                    while block := f.read(8 << 20):
                        out.write(block)


def write_lines(rows: DataFrame, column: str, by: list[str], path: str, first: str = "") -> None:
    """A column of texts as the lines of one file, in order of ``by``; ``first`` goes before them."""
    write_parts(rows.select(*by, F.col(column).alias("__line")), path + ".parts", by, lambda b: "".join(f"{x}\n" for x in b.column("__line").to_pylist()).encode(), first.encode())
    join_parts(path + ".parts", path)


def numbered(rows: DataFrame, at: str = "at", start: int = 0, part: str | None = None) -> DataFrame:
    """``rows`` with id: their place in order of ``at`` (monotonically_increasing_id), counted within partitions; only a row a partition is broadcast."""
    keyed = rows.withColumn("__part", F.shiftright(F.col(at), 33) if part is None else F.col(part))
    sizes = keyed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(at))
    return keyed.withColumn("__place", place).join(F.broadcast(offsets), "__part").withColumn("id", (F.col("__before") + F.col("__place") - 1 + start).cast("long")).drop("__part", "__place", "__before")


def numbered_by(rows: DataFrame, *by: str | Column) -> DataFrame:
    """``rows`` with id: their place in the order of ``by``, which should tell rows apart.

    Sorted rows are stored first: ranges are drawn from a sample, so a plan that sorts twice need not cut twice alike.
    """
    spark = rows.sparkSession
    path = folder(spark, "sorted")
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return numbered(spark.read.parquet(path), "__at").drop("__at")


def floats(column: pa.Array) -> np.ndarray:
    """All numbers of a column of arrays."""
    return column.flatten().to_numpy(zero_copy_only=False)
