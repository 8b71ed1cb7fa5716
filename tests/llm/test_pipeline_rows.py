"""The pipeline decides row by row: null and repeated ids, clashing columns."""

from pyspark.sql import functions as F

import corpus_pipeline
from hyperpanel.llm import common, decontaminate

DATA = "/root/testdata/sf0.001"
A, B = ("".join(f"{c}{k} " for k in range(60)) for c in "ab")
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies_go_row_by_row(spark):
    rows = [(1, A), (1, B), (2, A + "more"), (None, B + "again"), (None, A), (None, "a text of its own"), (None, None), (3, ""), (3, ""), (4, "alpha beta"), (4, "gamma delta")]
    got = rows_of(STAGES["ngram_jaccard_join"](spark, frame(spark, rows).repartition(3), DATA))
    assert got == sorted([(1, A), (1, B), (None, "a text of its own"), (None, None), (3, ""), (3, ""), (4, "alpha beta"), (4, "gamma delta")], key=str)
    got = rows_of(STAGES["ngram_jaccard_join"](spark, frame(spark, [(None, A), (9, A + "x"), (8, A), (8, A)]), DATA))
    assert got == [(8, A)]


def test_leaks_go_row_by_row(spark):
    item = common.read_table(spark, DATA, "benchmark").filter("length(text) > 100").orderBy("item_id").first().text
    rows = [(1, f"{A} {item} {B}"), (1, B), (None, f"{item}"), (None, A), (2, None), (3, "")]
    got = rows_of(STAGES["benchmark_decontamination"](spark, frame(spark, rows), DATA))
    assert got == sorted([(1, B), (None, A), (2, None), (3, "")], key=str)
    items = common.read_table(spark, DATA, "benchmark")
    assert rows_of(decontaminate.keep(frame(spark, rows), items, most_words=2000)) == got


def test_stages_keep_clashing_columns(spark):
    docs = frame(spark, [(1, A + "mail me.now@host.example"), (2, B), (None, None)])
    extra = ["row", "replaced", "__found", "component_id", "start", "n_replaced", "Label"]
    docs = docs.withColumns({c: F.lit("own") for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) == 3 and all(r[c] == "own" for r in got for c in extra), name


def test_whole_run_against_stages_by_hand(spark):
    """What run() packs is what the filters keep, each held against the plain operators."""
    packed = {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()}
    docs = common.read_table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DATA), name)
    assert packed == {r.doc_id for r in docs.select("doc_id").collect()}
