"""Ids against a fresh tokenizer of the library; repeated rows, long texts and clashing columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hyperpanel.llm import common, packing, token_files, tokens

PATH = tokens.public_vocabulary()
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


PARTS = [*"ab stmdrvel' ,.\n\t\r'S19é¿×÷\u0085\x00\x1fÿ中<|> ", END, "'s", "'re", "  ", "\n\n", "\U0001f600"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=24).map("".join)), min_size=1, max_size=4))
def test_ids_are_the_library_s(texts):
    library = Tokenizer.from_file(PATH)
    table = tokens.unit_table(PATH)
    ids, at = table.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(library, t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("astmdrvel' ,.\n\t19éÿ"), max_size=40), min_size=1, max_size=4))
def test_cut_texts_equal_the_library(texts):
    library = Tokenizer.from_file(PATH)
    ids, at = tokens.unit_table(PATH, 50).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(library, t)


def test_long_pieces_are_not_kept(library):
    table = tokens.UnitTable(PATH)
    texts = ["x" * 5000 + str(k) for k in range(20)] + ["", None, "word"]
    ids, at = table.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(library, t) for t in texts]
    assert all(len(p) <= tokens.LONG for p in table.index)


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_both_queries_keep_added_tokens(spark, library):
    texts = [f"one {END}two", END, f"{END}{END} \n{END}", "plain text", None, ""]
    docs = rows_of(spark, texts)
    manifest = token_files.write_token_files(docs, PATH, common.new_path(spark, "t"), end_id=2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(manifest).collect()}
    assert got == {k: [*ids_of(library, t), 2] for k, t in enumerate(texts)}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs, PATH, end_id=1).collect()}
    assert got == {k: [*ids_of(library, t), 1] for k, t in enumerate(texts)}


def test_equal_rows_are_spread_over_groups(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"))
    pieces = packing.digest(packing.pack(docs, PATH, end_id=1)).select("sequence_id").toArrow().column(0).to_numpy() >> 32
    sizes = Counter(pieces.tolist())
    assert len(pieces) == 20_000 and len(sizes) == 20 and max(sizes.values()) < 1400


def test_long_documents_are_spread_over_groups(spark, library):
    docs = rows_of(spark, ["a very long text, " * 40_000, "short"])
    found = packing.pack(docs, PATH, end_id=1, group_docs=16).collect()
    groups = defaultdict(int)
    for r in found:
        groups[r.sequence_id >> 32] += r.length
    assert len(groups) > 5
    long = sorted((r for r in found if r.doc_id == 0), key=lambda r: r.start)
    assert b"".join(r.ids for r in long) == np.array([*ids_of(library, "a very long text, " * 40_000), 1], "<u4").tobytes()
    assert [r.start for r in long] == [2048 * k for k in range(len(long))]


def test_equal_ids_are_cut_into_shards(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCS", 100)
    texts = [f"text {k % 7} of one id" for k in range(1000)]
    docs = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string").repartition(8)
    manifest = token_files.write_token_files(docs, PATH, common.new_path(spark, "t"), end_id=2)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 3 and max(sizes) < 500
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*ids_of(library, t), 2] for t in sorted(texts)]


def test_packing_ignores_other_columns(odd, corpus, library):
    pieces = packing.digest(packing.pack(odd, PATH, end_id=1)).collect()
    whole = Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces if r.doc_tokens <= 2048)
    want = Counter()
    for i, t, *_ in corpus:
        ids = [*ids_of(library, t), 1]
        if len(ids) <= 2048:
            want[i, 0, zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert whole == want


def test_query_ids_equal_the_library(spark, library):
    from hyperpanel.llm.queries import queries

    docs = {r.doc_id: r.text for r in common.read_table(spark, "/root/testdata/sf0.001", "documents").collect()}
    start = 0
    rows = sorted(queries()["op1_token_files"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = np.array([*ids_of(library, docs[r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in queries()["op7_packing"](spark, "/root/testdata/sf0.001").collect():
        ids = np.array([*ids_of(library, docs[r.doc_id]), 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
