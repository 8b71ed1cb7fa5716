"""Language sets may hold every learned language."""

import random

from hyperpanel.llm import langid

LETTERS = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))


def test_mixture_of_six_languages(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, LETTERS[k % 6], 200), f"l{k % 6}") for k in range(60)]
    langs, logp = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(words(rng, letters, 60) for letters in LETTERS)
    _, score = langid.infer([mixed, rows[0][1]], logp)
    assert abs(score[0] - 1 / 6) < 0.02 and score[1] > 0.99
    docs = spark.createDataFrame([(1, mixed), (2, rows[0][1]), (3, "?")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs, langs, logp).collect()}
    assert set(got[1].proportions) == set(langs) and abs(sum(got[1].proportions.values()) - 1) < 1e-3
    assert got[2].lang_pred == "l0" and set(got[2].proportions) == {"l0"}
    assert got[3].lang_pred == "und" and got[3].score == 0 and not got[3].proportions
