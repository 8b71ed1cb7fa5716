"""Panel data: gathering, profiles, normalisation and remapping of points.

Aggregates run over the long form (id, dim, x) and are partial before the
shuffle, so a profile moves one row for each dimension and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import is_set, to_cells


# --- rows and columns -------------------------------------------------------


def gather(points: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the given ids in that order, repeats kept; ``pos`` is the place in the list."""
    wanted = points.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(int(i)).cast("long") for i in ids))).alias("pos", "id"))
    return points.join(F.broadcast(wanted), "id")  # the list is a literal of the plan


def subset_dimensions(points: DataFrame, dims: list[int]) -> DataFrame:
    """Only the given dimensions, in the given order."""
    return points.withColumn("features", F.array(*(F.col("features")[d] for d in dims)))


def cell(points: DataFrame, point: int, dim: int) -> DataFrame:
    return points.filter(F.col("id") == point).select("id", F.element_at("features", dim + 1).alias("x"))


def with_property(points: DataFrame, name: str, value: float = 0.0) -> DataFrame:
    if name in points.columns:
        raise ValueError(f"property exists: {name}")
    return points.withColumn(name, F.lit(float(value)))


def property_of(points: DataFrame, name: str) -> Column:
    if name not in points.columns:
        raise KeyError(name)
    return F.col(name)


def without_property(points: DataFrame, name: str) -> DataFrame:
    property_of(points, name)
    return points.drop(name)


def append(points: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return points.unionByName(more, allowMissingColumns=True)


# --- profiles ---------------------------------------------------------------


def selected(points: DataFrame) -> DataFrame:
    return points.filter(is_set(F.col("flags")))


def mean(points: DataFrame, weight: str | None = None) -> DataFrame:
    """dim, mean; weighted by a column if named."""
    if weight is None:
        return to_cells(points).groupBy("dim").agg(F.avg("x").alias("mean"))
    return to_cells(points, weight).groupBy("dim").agg((F.sum(F.col(weight) * F.col("x")) / F.sum(weight)).alias("mean"))


def selection_mean(points: DataFrame, weight: str | None = None) -> DataFrame:
    return mean(selected(points), weight)


def weighted_stddev(points: DataFrame, weight: str, means: DataFrame) -> DataFrame:
    """dim, stddev: population deviation around the given means."""
    gap = F.col("x") - F.col("mean")
    return to_cells(points, weight).join(F.broadcast(means), "dim").groupBy("dim").agg(F.sqrt(F.sum(F.col(weight) * gap * gap) / F.sum(weight)).alias("stddev"))  # means: a row a dimension


def extent(points: DataFrame) -> DataFrame:
    return to_cells(points).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def sparsity(points: DataFrame) -> DataFrame:
    """One row: the share of cells that are exactly zero."""
    zero = F.aggregate("features", F.lit(0).cast("long"), lambda n, x: n + F.when(x == 0, 1).otherwise(0).cast("long"))
    return points.agg((F.sum(zero) / F.sum(F.size("features"))).alias("sparsity"))


def selection_profile(points: DataFrame) -> DataFrame:
    """dim, lo, hi, mean, stddev (population) of selected points; no rows if none is."""
    return to_cells(selected(points)).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("stddev"))


def heatmap_profile(points: DataFrame) -> DataFrame:
    """dim, mean, stddev, hi of selected points, where hi starts at 0."""
    return to_cells(selected(points)).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("stddev"), F.greatest(F.lit(0.0), F.max("x")).alias("hi"))


def histogram(values: DataFrame, column: str, lo: float, hi: float, buckets: int) -> DataFrame:
    """bucket, lo, hi, cnt for every bucket; values outside are ignored, ``hi`` itself is in the last."""
    x = F.col(column)
    place = F.least(F.floor((x - lo) / (hi - lo) * buckets), F.lit(buckets - 1)).cast("int")
    counts = values.filter((x >= lo) & (x <= hi)).groupBy(place.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))
    every = values.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    step = (hi - lo) / buckets
    return every.join(counts, "bucket", "left").select("bucket", (F.lit(lo) + F.col("bucket") * step).alias("lo"), (F.lit(lo) + (F.col("bucket") + 1) * step).alias("hi"), F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def vector_stats(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum(column).alias("total"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stddev"), F.count(column).alias("n"))


def count_of(values: DataFrame, column: str, value: float) -> DataFrame:
    return values.agg(F.count(F.when(F.col(column) == value, 1)).alias("n"))


def sparse_stats(edges: DataFrame, rows: int) -> DataFrame:
    """Rows, entries, sparsity and length of the rows of a sparse matrix with ``rows`` rows."""
    lengths = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    total, squares = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))
    mean_ = total / rows
    return lengths.agg(F.lit(rows).cast("long").alias("n_rows"), total.alias("n_entries"), (1.0 - total / float(rows * rows)).alias("sparsity"), mean_.alias("mean_length"), F.sqrt(squares / rows - mean_ * mean_).alias("stddev_length"))


# --- normalisation ----------------------------------------------------------


def _packed(stats: DataFrame, *columns: str) -> DataFrame:
    """One row with an array for each column, in order of dimensions."""
    rows = F.array_sort(F.collect_list(F.struct("dim", *columns)))

    def values(column: str) -> Column:
        return F.transform("s", lambda r: r[column]).alias(f"_{column}")

    return stats.agg(rows.alias("s")).select(*map(values, columns))


def _rescaled(points: DataFrame, stats: DataFrame, a: str, b: str, by) -> DataFrame:
    """Features through ``by(x, a, b)`` of each dimension's statistics (one row, sent to every task)."""
    packed = _packed(stats, a, b)
    return points.crossJoin(F.broadcast(packed)).withColumn("features", F.zip_with("features", F.arrays_zip(f"_{a}", f"_{b}"), lambda x, s: by(x, s[f"_{a}"], s[f"_{b}"]))).drop(f"_{a}", f"_{b}")


def zscore(points: DataFrame) -> DataFrame:
    """Population deviation; a constant dimension is only centred."""
    stats = to_cells(points).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("stddev"))
    return _rescaled(points, stats, "mean", "stddev", lambda x, m, s: (x - m) / F.when(s == 0, 1.0).otherwise(s))


def minmax(points: DataFrame, keep_constant: bool = False) -> DataFrame:
    """To [0, 1]; a constant dimension becomes 0.5, or stays if asked."""

    def by(x: Column, lo: Column, hi: Column) -> Column:
        return F.when(hi == lo, x if keep_constant else F.lit(0.5)).otherwise((x - lo) / (hi - lo))

    return _rescaled(points, extent(points), "lo", "hi", by)


def transpose(points: DataFrame) -> DataFrame:
    """Dimensions as points: id (dimension), features in order of point ids."""
    row = F.array_sort(F.collect_list(F.struct("id", "x")))
    return to_cells(points).groupBy(F.col("dim").cast("long").alias("id")).agg(F.transform(row, lambda c: c["x"]).alias("features"))


# --- layouts (embedding: id, y) ---------------------------------------------


def bbox(embedding: DataFrame, offset: float = 0.0, squared: bool = True) -> DataFrame:
    """dim, lo, hi; padded by offset/2 of the extent on each side and then made square around the centre."""
    box = embedding.select(F.posexplode("y").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    if offset <= 0:
        return box
    pad = (F.col("hi") - F.col("lo")) * offset / 2
    box = box.select("dim", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))
    if not squared:
        return box
    widest = F.max(F.col("hi") - F.col("lo")).over(Window.partitionBy())  # a row a dimension
    half, centre = widest / 2 / (1 - offset), (F.col("lo") + F.col("hi")) / 2
    return box.withColumn("half", half).select("dim", (centre - F.col("half")).alias("lo"), (centre + F.col("half")).alias("hi"))


def _over_box(embedding: DataFrame, by) -> DataFrame:
    packed = _packed(bbox(embedding), "lo", "hi")
    return embedding.crossJoin(F.broadcast(packed)).withColumn("y", by(F.col("y"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _centred(y: Column, lo: Column, hi: Column) -> Column:
    return F.zip_with(y, F.zip_with(lo, hi, lambda a, b: (a + b) / 2), lambda v, m: v - m)


def zero_centre(embedding: DataFrame) -> DataFrame:
    """Moved so that the middle of the bounding box is the origin."""
    return _over_box(embedding, _centred)


def scale_to(embedding: DataFrame, diameter: float, *, smaller: bool) -> DataFrame:
    """Centred and scaled so that the first axis spans ``diameter``, only if it spans less (``smaller``) or more."""

    def by(y: Column, lo: Column, hi: Column) -> Column:
        span = hi[0] - lo[0]
        due = (span < diameter) if smaller else (span > diameter)
        return F.when(due & (span > 0), F.transform(_centred(y, lo, hi), lambda v: v * (diameter / span))).otherwise(y)

    return _over_box(embedding, by)


def remap_vertical(embedding: DataFrame, limits: tuple[float, float, float, float]) -> DataFrame:
    """One dimension onto a vertical line in the middle of (x lo, x hi, y lo, y hi)."""
    x0, x1, y0, y1 = limits
    return _over_box(embedding, lambda y, lo, hi: F.array(F.lit((x0 + x1) / 2), F.lit(y0) + F.when(hi[0] == lo[0], 0.0).otherwise((y[0] - lo[0]) / (hi[0] - lo[0])) * (y1 - y0)))


def remap_box(embedding: DataFrame, limits: tuple[float, float, float, float], fix_aspect: bool = True) -> DataFrame:
    """Two dimensions into a box; with the aspect kept, the shorter axis is centred."""
    low, span = limits[::2], (limits[1] - limits[0], limits[3] - limits[2])

    def by(y: Column, lo: Column, hi: Column) -> Column:
        ex = [hi[k] - lo[k] for k in (0, 1)]
        most = F.greatest(*ex)
        out = []
        for k in (0, 1):
            if fix_aspect:
                unit = (y[k] - lo[k]) / most + (1.0 - ex[k] / most) / 2
            else:
                unit = F.when(ex[k] == 0, 0.5).otherwise((y[k] - lo[k]) / ex[k])
            out.append(F.lit(float(low[k])) + unit * span[k])
        return F.array(*out)

    return _over_box(embedding, by)
