"""Parquet folders for what an analysis keeps: graphs, hierarchies, sessions; and sampled test data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators.hsne import Hierarchy, Scale

PARTS = ("landmarks", "transition", "aoi")
#: Version of a stored hierarchy's layout; others are refused.
VERSION = "0.0"


def save_hierarchy(h: Hierarchy, path: str) -> None:
    """landmarks, transition and aoi, each one table partitioned by scale."""
    for part in PARTS:
        rows = None
        for k, scale in enumerate(h.scales):
            df = getattr(scale, part)
            if df is not None:
                df = df.withColumn("scale", F.lit(k))
                rows = df if rows is None else rows.unionByName(df)
        if rows is not None:
            rows.write.mode("overwrite").partitionBy("scale").parquet(f"{path}/{part}")
    spark = h.scales[0].landmarks.sparkSession
    spark.createDataFrame([(VERSION,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version")


def load_hierarchy(spark: SparkSession, path: str, weights: bool = False) -> Hierarchy:
    """What :func:`save_hierarchy` stored; another version is an error, and points weigh 1 again unless ``weights``."""
    found = spark.read.parquet(f"{path}/version").first()[0]
    if found != VERSION:
        raise ValueError(f"a hierarchy of version {found}, not {VERSION}")
    landmarks, transition = (spark.read.parquet(f"{path}/{p}") for p in PARTS[:2])
    top = landmarks.agg(F.max("scale")).first()[0]
    aoi = spark.read.parquet(f"{path}/aoi") if top else None
    if not weights:
        landmarks = landmarks.withColumn("weight", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("weight")))
    at = lambda df, k: df.filter(F.col("scale") == k).drop("scale")
    return Hierarchy([Scale(at(landmarks, k), at(transition, k), at(aoi, k) if k else None) for k in range(top + 1)])


def save_session(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables of a session, replacing what the folder holds."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_session(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def cached(spark: SparkSession, path: str, parameters: dict, build) -> DataFrame:
    """The table that ``build()`` gives, kept in a folder named after the parameters and read from there next time."""
    key = json.dumps(parameters, sort_keys=True)
    where = f"{path}/{_name(key)}"
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def _name(key: str) -> str:
    import hashlib

    return hashlib.sha256(key.encode()).hexdigest()[:24]


def spheres(spark: SparkSession, n_spheres: int = 5, n_points: int = 1000, dims: int = 10, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """id, features, label: points around random centres, each at a random direction and distance."""
    rows = spark.range(n_spheres * n_points).select("id", F.call_function("div", F.col("id"), F.lit(n_points)).cast("int").alias("label"))
    centre = [rng.uniform(seed, F.col("label") * dims + d, 7) * radius * n_spheres for d in range(dims)]
    way = [rng.normal_pair(seed + 1 + d, F.col("id"))[0] for d in range(dims)]
    rows = rows.select("id", "label", F.array(*centre).alias("c"), F.array(*way).alias("v"), (rng.uniform(seed, F.col("id"), 3) * radius).alias("u"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("id", F.zip_with("c", "v", lambda c, v: c + v / norm * F.col("u")).alias("features"), "label")


def noisy_line(spark: SparkSession, n: int, dims: int = 10, seed: int = 0) -> DataFrame:
    """id, features: half of the points along the diagonal, half between them with noise."""
    base = F.col("id") % (n // 2)
    noise = [F.when(F.col("id") >= n // 2, 0.5 + rng.normal_pair(seed + d, F.col("id"))[0] * 0.1).otherwise(0.0) for d in range(dims)]
    return spark.range(n // 2 * 2).select("id", F.array(*(base + x for x in noise)).alias("features"))
