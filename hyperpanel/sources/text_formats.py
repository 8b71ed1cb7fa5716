"""Text formats: delimited vectors, the DY format, labels and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import numbered


def dy_rows(points: DataFrame, label: str) -> DataFrame:
    """id, line of the DY format: P<id>;values;label.0."""
    return points.select("id", F.concat_ws(";", F.concat(F.lit("P"), F.col("id").cast("string")), F.concat_ws(";", F.transform("features", lambda v: v.cast("string"))), F.concat(F.col(label).cast("string"), F.lit(".0"))).alias("line"))


def dy_header(n: int, dims: int) -> str:
    return "\n".join(["DY", str(n), str(dims), ";".join(f"D{k}" for k in range(dims))])


def write_dy(points: DataFrame, label: str, path: str) -> None:
    """Rows in order of ids as text; the header is the first line of the first part."""
    n, dims = points.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    head = points.sparkSession.createDataFrame([(-1, dy_header(n, dims))], "id long, line string")
    head.unionByName(dy_rows(points, label)).orderBy("id").select("line").write.text(path)


def ragged(lines: DataFrame, separator: str) -> DataFrame:
    """columns, n: how many lines have each number of columns."""
    return lines.groupBy(F.size(F.split("value", f"\\Q{separator}\\E")).alias("columns")).agg(F.count(F.lit(1)).alias("n"))


def read_vectors(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """id (by place in the file), features of a file with one vector a line."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split("value", f"\\Q{separator}\\E").cast("array<double>").alias("features"))
    return numbered(rows).select("id", "features")


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, label, pivot of lines 'x y label pivot'; labels become numbers by first appearance."""
    part = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), part[0].cast("double").alias("x"), part[1].cast("double").alias("y"), part[2].alias("name"), part[3].cast("int").alias("pivot"))
    first = rows.groupBy("name").agg(F.min("at").alias("first")).select("name", (F.row_number().over(Window.orderBy("first")) - 1).alias("label"))
    return numbered(rows).join(first, "name").select("id", "x", "y", "label", "pivot")


def read_followers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership: a target, b follower; targets: name, number; followers: name, number) of a folder with a file for each target."""
    rows = spark.read.text(f"{folder}/*.txt").select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)[.]txt$", 1).alias("target"), F.trim("value").alias("follower"), F.monotonically_increasing_id().alias("at")).filter("follower <> ''")
    number = lambda c: rows.groupBy(F.col(c).alias("name")).agg(F.min("at").alias("first")).select("name", (F.row_number().over(Window.orderBy("first", "name")) - 1).cast("long").alias("number"))
    targets, followers = number("target"), number("follower")
    members = rows.join(targets.select(F.col("name").alias("target"), F.col("number").alias("a")), "target").join(followers.select(F.col("name").alias("follower"), F.col("number").alias("b")), "follower").select("a", "b").distinct()
    return members, targets, followers


def read_colours(spark: SparkSession, path: str, n: int) -> DataFrame:
    """id, r, g, b of a CSV of numbers to 255, row-major; at most ``n`` colours."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.split("value", ",")).alias("k", "v"))
    cells = numbered(rows.filter("trim(v) <> ''").withColumn("at", F.struct("at", "k")).withColumn("part", F.shiftright("at.at", 33)), part="part").select(F.col("id").alias("place"), (F.trim("v").cast("double") / 255).alias("v"))
    third = F.call_function("div", F.col("place"), F.lit(3))
    return cells.filter(F.col("place") < 3 * n).groupBy(third.cast("long").alias("id")).agg(*(F.max(F.when(F.col("place") % 3 == k, F.col("v"))).alias(c) for k, c in enumerate("rgb")))


def read_lines_as_texts(spark: SparkSession, path: str) -> DataFrame:
    """text: a list of texts to select."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter("text <> ''")


def write_selected_texts(points: DataFrame, path: str) -> None:
    points.filter(F.col("flags").bitwiseAND(1) == 1).select("text").write.text(path)


def columns_to_zscores(lines: DataFrame) -> DataFrame:
    """id, features: many one-line CSVs (column: number of the file, value: its line) as columns, z-scored with 1e-6 under the root."""
    cells = lines.select("column", F.posexplode(F.split("value", ",").cast("array<double>")).alias("id", "x"))
    own = Window.partitionBy("column")
    z = (F.col("x") - F.avg("x").over(own)) / F.sqrt(F.avg(F.col("x") * F.col("x")).over(own) - F.avg("x").over(own) * F.avg("x").over(own) + 1e-6)
    return cells.withColumn("x", z).groupBy(F.col("id").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "x"))), lambda c: c["x"]).alias("features"))


def export_analysis(embedding: DataFrame, parents: DataFrame, parent: int | None, path: str) -> None:
    """info (parent, size), embedding (x, y, w, id) and parent selection of an analysis, as CSV."""
    spark = embedding.sparkSession
    spark.createDataFrame([(parent, embedding.count())], "parent long, size long").coalesce(1).write.csv(f"{path}/info", header=True)
    embedding.select(F.col("y")[0].alias("x"), F.col("y")[1].alias("y"), "w", "id").write.csv(f"{path}/embedding", header=True)
    parents.write.csv(f"{path}/parent_selection", header=True)
