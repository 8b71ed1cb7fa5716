"""Media, archives, pseudonyms, decontamination, languages, toxicity and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hyperpanel.llm import common, decontaminate, langid, media, pii, toxicity, warc
from hyperpanel.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"

# --- media ------------------------------------------------------------------


def test_netpbm_kinds():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # note\n4 3\n255\n" + " ".join(map(str, range(12))).encode()) == grey).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P6 1 1 255\n" + bytes([1, 2, 3])).tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n" + bytes([1, 2])).tolist() == [[258]]


def test_bmp_round_trip():
    grey = np.random.default_rng(1).integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(grey)) == grey).all()


def test_area_resize_is_a_mean():
    image = np.random.default_rng(2).uniform(size=(8, 12))
    assert np.allclose(media.area_resize(image, 4, 3), image.reshape(4, 2, 3, 4).mean((1, 3)))
    assert np.isclose(media.area_resize(image, 3, 5).mean(), image.mean())


def test_tiles_round_trip():
    image = np.random.default_rng(3).integers(0, 256, (50, 30, 3), dtype=np.uint8)
    assert (media.from_tiles(media.to_tiles(image, 24), 50, 30) == image).all()


def test_media_rows(spark, docs, corpus, none):
    stored = media.tile_media(media.text_media(docs), "id", "media")
    got = media.read_tiles(stored).collect()
    assert len(got) == len(corpus)
    fill = lambda t: (t or "").encode() + b"\xff" * (max(1, -(-len((t or "").encode()) // 576)) * 576 - len((t or "").encode()))
    assert sorted(r.samples for r in got) == sorted(fill(t) for _, t, *_ in corpus)
    bad = spark.createDataFrame([(1, b"no image"), (2, None), (3, b"P5 2 2 255\n\x00")], "id long, media binary")
    rows = {r.id: r for r in media.tile_media(bad, "id", "media").collect()}
    assert rows[1].error and rows[1].npy is None and rows[2].error is None and rows[3].error
    assert media.read_tiles(media.tile_media(media.text_media(none), "id", "media")).count() == 0


# --- archives ---------------------------------------------------------------


def record(i, url, s, kind, etag=None, modified=None, digest=None, headers=None, payload=None):
    return (i, url, s, kind, etag, modified, digest, headers, payload)


def test_revisits(spark):
    rows = [
        record(1, "http://WWW.a.org:80/x/?b=2&a=1&utm_source=q#f", 10, "response", '"e1"', headers={"Content-Type": "t", "ETag": "old"}, payload="one"),
        record(2, "https://a.org/x?a=1&b=2", 20, "revisit", 'W/"e1"', headers={"etag": "new", "Content-Length": "0"}),
        record(3, "https://a.org/x?a=1&b=2", 30, "response", '"e2"', payload="two"),
        record(4, "https://a.org/x?a=1&b=2", 30, "revisit", '"e1"'),
        record(5, "https://a.org/x?a=1&b=2", 5, "revisit", '"e1"'),
        record(6, "https://a.org/x?a=1&b=2", 40, "revisit"),
        record(7, None, 40, "revisit", '"e2"'),
        record(8, "https://a.org/x?a=1&b=2", None, "revisit", '"e2"'),
        record(9, "https://a.org/x?a=1&b=2", 500_000, "revisit", '"e2"'),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, type string, etag string, last_modified string, digest string, headers map<string,string>, payload string").withColumn("date", F.timestamp_seconds("s")).withColumn("base", F.lit(1)).withColumn("day", F.lit(2))
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert {k: (r.status, r.base_id, r.payload) for k, r in got.items()} == {
        2: ("resolved", 1, "one"), 4: ("changed", None, None), 5: ("no_response", None, None), 6: ("no_validator", None, None),
        7: ("no_key", None, None), 8: ("no_key", None, None), 9: ("resolved", 3, "two"),
    }
    assert got[2].headers == {"Content-Type": "t", "etag": "new"}
    assert warc.resolve(df.limit(0)).count() == 0


# --- pseudonyms -------------------------------------------------------------


def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark, odd, none, corpus):
    text = "und.34@mail7.example.com +1 (017) 555-7713 97.51.17.173 4845168114407329 4845-1681-1440-7329 29.02.1984 1984-02-29 123-45-6789."
    clean = 'token = "04dbebab91ab8568" 1985-02-29 4845168114407320 999.1.1.1 666-12-1234 x4845168114407329 2024-13-01 '
    df = spark.createDataFrame([(1, text), (2, text), (3, clean), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert got[1].text == got[2].text and got[1].n_replaced == 8
    assert got[3].text == clean and got[3].n_replaced == 0 and got[4].text is None and got[5].text == ""
    parts = got[1].text.split(" ")
    assert re.fullmatch(r"[a-z]{3}[.]\d\d@mail7[.]example[.]com", parts[0]) and not set(parts) & (set(text.split(" ")) - {"+1"})
    assert luhn(parts[5]) and parts[6].replace("-", "") == parts[5]
    d, m, y = parts[7].split(".")
    assert parts[8] == f"{y}-{m}-{d}"
    assert pii.pseudonymise(df, "other").filter("doc_id = 1").first().text != got[1].text
    assert pii.pseudonymise(none, "k").count() == 0
    out = pii.pseudonymise(odd, "k", count_col="n")
    assert out.columns == [*odd.columns, "n"] and out.count() == len(corpus)


def test_feistel_is_a_permutation(spark):
    got = spark.range(189 * 773).select(pii.feistel(F.col("id"), F.lit(189), F.lit(773), "k", F.lit("t")).alias("v"))
    row = got.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(row) == (146_097, 0, 146_096)


# --- decontamination --------------------------------------------------------


def test_leaks_equal_brute_force(spark, none):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 40))).capitalize() + ". " + " ".join(rng.choice(vocabulary) for _ in range(6)) + ".") for k in range(80)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 700))]
        if d % 3 == 0:
            words = items[d][1].replace("\n", " ").split(" ")
            if d % 2:
                words[rng.randrange(len(words))] = "other"
            at = rng.randrange(len(body))
            body[at:at] = words
        docs.append((d, " ".join(body)))
    docs += [(70, None), (71, ""), (0, docs[0][1])]
    word = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t in docs:
        w = word(t)
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, x in items:
            v = word(x)
            if len(v) >= 5:
                own = [tuple(v[k : k + 5]) for k in range(len(v) - 4)]
                if sum(s in have for s in own) >= 0.8 * len(own) - 1e-9:
                    want.add((d, i))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, i).collect()}
    assert got == want and len(want) >= 10
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, i, most_words=500).collect()} == want
    assert decontaminate.find_leaks(none, i).count() == 0 and decontaminate.find_leaks(d, i.limit(0)).count() == 0


# --- languages and toxicity -------------------------------------------------


def test_languages(spark, docs, odd, none, corpus):
    langs, logp = langid.learn(docs.filter(langid.fold() != 0))
    assert {"en", "de"} <= set(langs)
    got = langid.predict(odd, langs, logp).collect()
    assert len(got) == len(corpus)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (200, 201, 202))
    truth = {i: lang for i, t, lang, *_ in corpus if i is not None and i < 120 and len((t or "").split()) > 5}
    assert np.mean([by[i].lang_pred == lang for i, lang in truth.items()]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(none, langs, logp).count() == 0
    empty = langid.learn(none)
    assert {r.lang_pred for r in langid.predict(docs, *empty).collect()} == {"und"}


def test_mixture_finds_both_languages(docs, corpus):
    langs, logp = langid.learn(docs)
    de = " ".join(t for i, t, lang, *_ in corpus[:30] if lang == "de")
    en = " ".join(t for i, t, lang, *_ in corpus[:9] if lang == "en")
    best, score = langid.infer([f"{de} {en}", de], logp)
    assert langs[best[0]] == "de" and 0.4 < score[0] < 0.98 and score[1] > 0.98


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (common.read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out")
    row = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("predicted") * F.col("toxic")) / F.sum("toxic")).alias("recall")).first()
    assert row.n > 500 and row.right > 0.96 and row.recall > 0.75
    assert docs.count() == toxicity.query(spark, "/root/testdata/sf0.1").count()


def test_toxicity_edges(spark, odd, docs, none, corpus):
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 100, 3)] + [(200, 1), (201, None)], "doc_id long, toxic int")
    classifier = toxicity.train(odd, labels)
    got = toxicity.score(odd, classifier).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.keep(odd, classifier).columns == odd.columns
    without = toxicity.train(docs, labels.limit(0))
    text = spark.createDataFrame([(1, "you stupid idiot, pathetic loser"), (2, "a quiet river"), (3, None)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(text, without).collect()}
    assert s[1] > s[2] == s[3]
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


# --- registry and pipeline ---------------------------------------------------


def test_sql_of_archives(spark):
    from compare import assert_same

    assert_same(spark, queries()["op3_warc_revisits"], oracle_sql()["op3_warc_revisits"])


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_covers_its_table(spark, name):
    table = {"op3_warc_revisits": "pages"}.get(name, "documents")
    df = queries()[name](spark, DATA)
    n = df.count()
    if name not in ("op3_warc_revisits", "op6_decontamination", "op7_packing"):
        assert n == common.read_table(spark, DATA, table).count()
    else:
        assert n > 0


def test_media_query_keeps_every_text(spark):
    row = queries()["op4_media_tiles"](spark, DATA).filter("doc_id = 1").first()
    text = common.read_table(spark, DATA, "documents").filter("doc_id = 1").first().text.encode()
    payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
    assert (row.n_bytes, row.payload_sha256) == (len(text), hashlib.sha256(payload).hexdigest())


def test_pipeline(spark, docs, none, tmp_path):
    kept = common.read_table(spark, DATA, "documents")
    n = kept.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, kept, DATA), name)
        if name != "packing":
            assert out.columns == kept.columns and out.count() <= n
            n = out.count()
            kept = out
    assert n > 100 and corpus_pipeline.run(spark, DATA).count() == out.count()
    for name, stage in corpus_pipeline.STAGES:  # nulls, repeated rows and empty tables
        assert stage(spark, none, DATA).count() == 0
        assert stage(spark, docs, DATA).count() > 0
