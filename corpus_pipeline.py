"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Stages decide row by row: null and repeated ids
are treated like any others, and rows of one id may go or stay each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperpanel.llm import common, decontaminate, ngram_join, packing, pii, toxicity
from hyperpanel.llm.langid import fold
from hyperpanel.llm.tokens import public_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    labels = common.read_table(spark, sf_dir, "labels").filter(fold() != 0)
    return toxicity.keep(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at five-word Jaccard 0.8: that with the smallest id, a null one last."""
    row = common.fresh_name(docs, "row")
    keyed = common.numbered(docs, row)
    found = ngram_join.jaccard_components(keyed, k=5, threshold=80, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"))).alias("least")
    first = found.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(least).select(F.col("least.row").alias(row))
    return keyed.join(first, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep(docs, common.read_table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; their length follows."""
    replaced = common.fresh_name(docs, "replaced")
    out = pii.pseudonymise(docs, "demonstration key", count_col=replaced)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(replaced) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens; the encoder's table is small, as the workers hold what earlier stages left."""
    return packing.digest(packing.pack(docs, public_vocabulary(), end_id=1, most_units=250_000))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: The stages learn, cluster and encode: no SQL expresses them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored in the shared folder for the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialize(docs, name)
    return docs
