"""Binary files of vectors, matrices, images and volumes, read and written by Spark tasks.

Files of fixed-size records are read by byte ranges (:mod:`.files`), whatever
their size. Sparse matrices and lists have rows of any length and no index: such a
file is decoded in one task through Spark (``binaryFile``).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from decode(content.as_py())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _points(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1).astype(np.float64)))], names=["id", "features"])


POINTS = "id long, features array<double>"


def read_matrix(spark: SparkSession, path: str, n: int, dims: int) -> DataFrame:
    """POINTS of a row-major float32 file (or several, in order of names) of exactly n x dims numbers."""

    def decode(first: int, data: bytes) -> pa.RecordBatch:
        matrix = np.frombuffer(data, "<f4").reshape(-1, dims)
        return _points(np.arange(first, first + len(matrix)), matrix)

    return files.read_records(spark, path, 4 * dims, decode, POINTS, rows=n)


def read_embedding(spark: SparkSession, path: str) -> DataFrame:
    """id, y of a file of two-dimensional float32 positions; their number follows from its size."""

    def decode(first: int, data: bytes) -> pa.RecordBatch:
        matrix = np.frombuffer(data, "<f4").reshape(-1, 2)
        return _points(np.arange(first, first + len(matrix)), matrix)

    return files.read_records(spark, path, 8, decode, POINTS, exact=False).withColumnRenamed("features", "y")


def read_distance_matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """i, j, d2 of an n x n float32 file of distances, squared."""
    cells = read_matrix(spark, path, n, n).select(F.col("id").alias("i"), F.posexplode("features").alias("j", "d"))
    return cells.select("i", F.col("j").cast("long").alias("j"), (F.col("d") * F.col("d")).alias("d2"))


def _labels(spark: SparkSession, path: str, n: int, label_type: str, header: int = 0) -> DataFrame:
    def decode(first: int, data: bytes) -> pa.RecordBatch:
        values = np.frombuffer(data, label_type)
        values = (values + 0.0001).astype(np.int64) if label_type.endswith("f4") else values.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values.astype(np.int32))], names=["id", "label"])

    return files.read_records(spark, path, np.dtype(label_type).itemsize, decode, "id long, label int", header, n, exact=False)


def read_labelled_matrix(spark: SparkSession, data: str, labels: str, n: int, dims: int, label_type: str = "u1") -> DataFrame:
    """POINTS with label: a float32 matrix and a file of labels (u1, or f4 rounded down after 0.0001 is added)."""
    return read_matrix(spark, data, n, dims).join(_labels(spark, labels, n, label_type), "id")


def read_idx(spark: SparkSession, images: str, labels: str, n: int, select: int | None = None) -> DataFrame:
    """id, features (255 - pixel), label, flags of IDX images; rows with label 1 come first, in their order, and the chosen label is selected."""
    _, _, rows, columns = struct.unpack(">4i", files.head(images, 16))

    def pixels(first: int, data: bytes) -> pa.RecordBatch:
        matrix = np.frombuffer(data, np.uint8).reshape(-1, rows * columns)
        return _points(np.arange(first, first + len(matrix)), 255.0 - matrix)

    found = files.read_records(spark, images, rows * columns, pixels, POINTS, 16, n, exact=False).join(_labels(spark, labels, n, "u1", 8), "id")
    placed = files.numbered_by(found.withColumnRenamed("id", "place").withColumn("later", F.col("label") != 1), "later", "place")
    return placed.select("id", "features", "label", F.when(F.col("label") == (select if select is not None else -1), 1).otherwise(0).alias("flags"))


def write_matrix(points: DataFrame, path: str, column: str = "features", by: str = "id", kind: str = "f4", first: bytes = b"") -> None:
    """Row-major numbers (float32) in order of ids, as a folder of parts that the readers take; joined they are one file."""
    files.write_parts(points.select(by, column), path, [by], lambda b: files.floats(b.column(1)).astype(f"<{kind}").tobytes(), first)


def write_vector(values: DataFrame, path: str, column: str = "v", by: str = "id", kind: str = "f4", counted: bool = True) -> None:
    """One file of a count (uint32; left out unless ``counted``) and the values of a column in order of ids."""
    rows = values.select(by, F.array(column).alias("v"))
    write_matrix(rows, path + ".parts", "v", by, kind, struct.pack("<I", rows.count()) if counted else b"")
    files.join_parts(path + ".parts", path)


def write_idx(points: DataFrame, images: str, labels: str, rows: int, columns: int) -> None:
    """IDX files of points (id, features: pixels 0 to 255, label)."""
    n = points.count()
    write_matrix(points, images + ".parts", kind="u1", first=struct.pack(">4i", 2051, n, rows, columns))
    write_matrix(points.select("id", F.array("label").alias("v")), labels + ".parts", "v", kind="u1", first=struct.pack(">2i", 2049, n))
    for file in (images, labels):
        files.join_parts(file + ".parts", file)


VOLUME = "id long, x int, y int, z int, features array<double>"


def read_volume(spark: SparkSession, path: str, dims: list[int] | None = None) -> DataFrame:
    """VOLUME of a file of points in space: n, d and six limits (int32), then x, y, z (int32) and d float32 each; only ``dims`` if given."""
    n, d = struct.unpack("<2i", files.head(path, 8))
    kind = np.dtype([("xyz", "<i4", 3), ("v", "<f4", d)])

    def decode(first: int, data: bytes) -> pa.RecordBatch:
        rows = np.frombuffer(data, kind)
        points = _points(np.arange(first, first + len(rows)), rows["v"] if dims is None else rows["v"][:, dims])
        xyz = [pa.array(np.ascontiguousarray(rows["xyz"][:, k])) for k in range(3)]
        return pa.RecordBatch.from_arrays([points.column(0), *xyz, points.column(1)], names=["id", "x", "y", "z", "features"])

    return files.read_records(spark, path, kind.itemsize, decode, VOLUME, 32, n, exact=False)


def write_volume(voxels: DataFrame, path: str) -> None:
    """One volume file of VOLUME rows, in order of ids."""
    limits = [f(c) for c in "xyz" for f in (F.min, F.max)]
    n, d, *box = voxels.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(0)), *limits).first()

    def encode(batch: pa.RecordBatch) -> bytes:
        rows = np.zeros(batch.num_rows, np.dtype([("xyz", "<i4", 3), ("v", "<f4", d)]))
        for k in range(3):
            rows["xyz"][:, k] = batch.column(k + 1).to_numpy()
        rows["v"] = files.floats(batch.column(4)).reshape(-1, d)
        return rows.tobytes()

    files.write_parts(voxels.select("id", "x", "y", "z", "features"), path + ".parts", ["id"], encode, struct.pack("<8i", n, d, *(v or 0 for v in box)))
    files.join_parts(path + ".parts", path)


def volume_bytes(xyz: np.ndarray, values: np.ndarray) -> bytes:
    low, high = xyz.min(0), xyz.max(0)
    rows = np.zeros(len(xyz), np.dtype([("xyz", "<i4", 3), ("v", "<f4", values.shape[1])]))
    rows["xyz"], rows["v"] = xyz, values
    return struct.pack("<8i", len(xyz), values.shape[1], low[0], high[0], low[1], high[1], low[2], high[2]) + rows.tobytes()


def cube_to_volume(cube: DataFrame, channels: int) -> tuple[DataFrame, DataFrame]:
    """(VOLUME; one row: zeros, saturated) of a cube (row, column, features), thinned to evenly spaced channels; shares of zeros and of the top value."""
    n = F.size("features")
    thin = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.element_at("features", (F.floor(n / F.lit(float(channels)) * c) + 1).cast("int")))
    part = cube.select("row", "column", thin.alias("features"))
    cells = part.select(F.explode("features").alias("v"))
    top = cells.agg(F.max("v").alias("top"))  # one row
    shares = cells.crossJoin(F.broadcast(top)).agg(F.avg((F.col("v") == 0).cast("double")).alias("zeros"), F.avg((F.col("v") == F.col("top")).cast("double")).alias("saturated"))
    placed = files.numbered_by(part, "row", "column")
    return placed.select("id", F.col("column").cast("int").alias("x"), F.col("row").cast("int").alias("y"), F.lit(0).alias("z"), "features"), shares


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """i, j, w of a sparse matrix file: number of rows, then for each its number of entries and (uint32 id, float32 value)."""

    def decode(data: bytes) -> Iterator[pa.RecordBatch]:
        rows = struct.unpack_from("<I", data)[0]
        at, i, j, w = 4, [], [], []
        for row in range(rows):
            n = struct.unpack_from("<I", data, at)[0]
            part = np.frombuffer(data, np.dtype([("j", "<u4"), ("w", "<f4")]), n, at + 4)
            at += 4 + 8 * n
            i.append(np.full(n, row))
            j.append(part["j"])
            w.append(part["w"])
        join = lambda x, t: pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))
        yield pa.RecordBatch.from_arrays([join(i, np.int64), join(j, np.int64), join(w, np.float64)], names=["i", "j", "w"])

    return _decoded(spark, path, decode, "i long, j long, w double")


def sparse_bytes(edges: DataFrame, rows: int) -> bytes:
    """The same file, for exchange with other tools: built on the driver, so for matrices that fit it."""
    table = edges.orderBy("i", "j").select("i", "j", "w").toArrow()
    i, j, w = (table.column(c).to_numpy() for c in ("i", "j", "w"))
    ends = np.searchsorted(i, np.arange(rows + 1))
    out = [struct.pack("<I", rows)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        part = np.zeros(b - a, np.dtype([("j", "<u4"), ("w", "<f4")]))
        part["j"], part["w"] = j[a:b], w[a:b]
        out += [struct.pack("<I", b - a), part.tobytes()]
    return b"".join(out)


def read_vector(spark: SparkSession, path: str, kind: str = "f4") -> DataFrame:
    """id, v of a vector file: a count (uint32), then values of ``kind`` (f4, u4, i4)."""

    def decode(first: int, data: bytes) -> pa.RecordBatch:
        values = np.frombuffer(data, f"<{kind}").astype(float)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values)], names=["id", "v"])

    n = struct.unpack("<I", files.head(path, 4))[0]
    return files.read_records(spark, path, 4, decode, "id long, v double", 4, n, exact=False)


def _listed(rows: DataFrame, n: int, values: list[str]) -> DataFrame:
    """at, kind, values: a row that counts its entries for each of ``n`` lists, then these (i, j, ...); numbers beyond the lists are an error."""
    inside = F.when((F.col("i") >= 0) & (F.col("i") < n), F.col("i")).otherwise(F.raise_error(F.lit(f"a row beyond {n}")).cast("long"))
    rows = rows.select(inside.alias("i"), "j", *values)
    counts = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    heads = rows.sparkSession.range(n).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.lit(0).alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("j"), *(F.lit(0.0).alias(v) for v in values))
    return heads.unionByName(rows.select("i", F.lit(1).alias("kind"), F.col("j").cast("long").alias("j"), *values))


def write_sparse(edges: DataFrame, rows: int, path: str) -> None:
    """One sparse matrix file of edges i, j, w; entries are sorted and counted by tasks, no row of the matrix is held whole."""

    def encode(batch: pa.RecordBatch) -> bytes:
        cells = np.zeros(batch.num_rows, np.dtype([("j", "<u4"), ("w", "<f4")]))
        cells["j"], cells["w"] = batch.column("j").to_numpy(), batch.column("w").to_numpy()
        keep = np.ones((batch.num_rows, 8), bool)
        keep[batch.column("kind").to_numpy() == 0, 4:] = False
        return cells.view(np.uint8).reshape(-1, 8)[keep].tobytes()

    files.write_parts(_listed(edges.select("i", "j", F.col("w").cast("double").alias("w")), rows, ["w"]), path + ".parts", ["i"], encode, struct.pack("<I", rows), within=["kind", "j"])
    files.join_parts(path + ".parts", path)


def write_nested(membership: DataFrame, rows: int, path: str) -> None:
    """One file of lists, in the layout of :func:`read_nested`: membership (a: number of a list, b: member), members sorted."""
    listed = _listed(membership.select(F.col("a").alias("i"), F.col("b").alias("j")), rows, [])
    files.write_parts(listed, path + ".parts", ["i"], lambda b: b.column("j").to_numpy().astype("<u4").tobytes(), struct.pack("<I", rows), within=["kind", "j"])
    files.join_parts(path + ".parts", path)


def vector_bytes(values: np.ndarray, kind: str = "f4") -> bytes:
    return struct.pack("<I", len(values)) + values.astype(f"<{kind}").tobytes()


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """id, members of a file of lists: a count, then for each its length and uint32 members."""

    def decode(data: bytes) -> Iterator[pa.RecordBatch]:
        n, at, out = struct.unpack_from("<I", data)[0], 4, []
        for _ in range(n):
            size = struct.unpack_from("<I", data, at)[0]
            out.append(np.frombuffer(data, "<u4", size, at + 4).astype(np.int64))
            at += 4 + 4 * size
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(out, pa.list_(pa.int64()))], names=["id", "members"])

    return _decoded(spark, path, decode, "id long, members array<long>")


def nested_bytes(lists: list[list[int]]) -> bytes:
    return struct.pack("<I", len(lists)) + b"".join(struct.pack(f"<I{len(x)}I", len(x), *x) for x in lists)


def matrix_bytes(points: DataFrame, column: str = "features") -> bytes:
    """Row-major float32 in order of ids, for exchange with other tools (on the driver)."""
    table = points.orderBy("id").select(column).toArrow()
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()


def pixels_as_points(pixels: DataFrame, keep: Column) -> DataFrame:
    """POINTS with features row and column of the pixels (row, column, colours) that ``keep`` (a test of the colours) chooses, numbered row by row."""
    chosen = files.numbered_by(pixels.filter(keep).select("row", "column"), "row", "column")
    return chosen.select("id", F.array(F.col("row").cast("double"), F.col("column").cast("double")).alias("features"))


def read_named_matrix(spark: SparkSession, data: str, names: str, n: int, dims: int) -> DataFrame:
    """POINTS with path and label: a float32 matrix beside a CSV with the header 'path,label', row by row."""
    rows = spark.read.csv(names, header=True).select(F.monotonically_increasing_id().alias("at"), "path", "label")
    rows = files.numbered(rows).select("id", "path", "label")
    return read_matrix(spark, data, n, dims).join(rows, "id")


def read_labelled_volume(spark: SparkSession, path: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """(VOLUME, dims: dim, path, label): a volume and a CSV that names its dimensions in order."""
    rows = spark.read.csv(labels, header=True).select(F.monotonically_increasing_id().alias("at"), "path", "label")
    return read_volume(spark, path), files.numbered(rows).select(F.col("id").cast("int").alias("dim"), "path", "label")


def read_image_list(spark: SparkSession, listing: str, data: str) -> DataFrame:
    """POINTS with path: a list of paths (its first line is their number) and a float32 matrix of as many rows."""
    lines = spark.read.text(listing).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("path")).filter("path <> ''")
    numbered = files.numbered(lines, start=-1).select("id", "path")
    n = int(numbered.filter("id = -1").first().path)

    size = spark.read.format("binaryFile").load(data).agg(F.sum("length")).first()[0] or 0
    return read_matrix(spark, data, n, max(size // max(4 * n, 1), 1)).join(numbered.filter(F.col("id").between(0, n - 1)), "id")
