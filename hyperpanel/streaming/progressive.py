"""Progressive embedding: a run that advances in steps, as a generator or driven by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import knn as nn
from ..operators.analysis import interpolate
from ..operators.embedding import Parameters, _local, iterate, progressive


def generate(embedding: DataFrame, edges: DataFrame, p: Parameters = Parameters(), iterations: int = 1000, every: int = 50) -> Iterator[tuple[int, pd.DataFrame]]:
    """(iteration, positions) every so many iterations."""
    return progressive(embedding, edges, p, iterations, every)


class Stepper:
    """Optimiser state that each batch of a stream advances; positions are written as one table an iteration."""

    def __init__(self, embedding: DataFrame, edges: DataFrame, path: str, p: Parameters = Parameters(), steps_a_batch: int = 10):
        self.state, self.i, self.j, self.w, _ = _local(embedding, edges, None)
        self.path, self.p, self.steps = path, p, steps_a_batch

    def __call__(self, batch: DataFrame, number: int) -> None:
        for _ in range(self.steps):
            self.state = iterate(self.state, self.i, self.j, self.w, self.p)
        rows = [(int(k), [float(v) for v in y], self.state.t) for k, y in zip(self.state.ids, self.state.y, strict=True)]
        batch.sparkSession.createDataFrame(rows, "id long, y array<double>, iteration int").write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def drive(ticks: DataFrame, stepper: Stepper) -> StreamingQuery:
    """Run the stepper on every batch of a streaming frame of ticks (a rate source, say)."""
    return ticks.writeStream.foreachBatch(stepper).start()


def place_new(new: DataFrame, points: DataFrame, embedding: DataFrame, k: int = 5) -> DataFrame:
    """id, y of new points (id, features): weighted means of the positions of their nearest known points."""
    from pyspark.sql import functions as F

    near = nn.ranked(nn.radius(points, new, float("inf")), k)
    return interpolate(embedding, near.select(F.col("i").alias("id"), F.col("j").alias("lm"), (1 / (1 + F.col("d2"))).alias("p")))
