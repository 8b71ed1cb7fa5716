import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of house river stone light green table winter".split(), "de": "der und von haus fluss stein licht gruen tisch zeit".split()}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "er", "ly", str(rng.randrange(50))]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, long and repeated texts, near copies and shared passages."""
    rng = random.Random(7)
    rows, shared = [], prose(rng, 60)
    for k in range(120):
        lang = "en" if k % 3 else "de"
        rows.append((k, prose(rng, rng.randrange(1, 150), lang), lang, f"src{k % 4}", None))
    for k in range(120, 140):  # copies, near copies, passages
        base = rows[k - 120][1]
        words = base.split()
        if k % 3 == 0:
            text = base
        elif k % 3 == 1 and len(words) > 30:
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        else:
            text = f"{base}\n{shared}\t{prose(rng, 20)}"
        rows.append((k, text, "en", None, 3))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n\t ", "en", "s", 4), (203, "word", "en", "s", 4), (204, "two words", None, "s", 9), (204, "two words", None, "s", 9), (None, "no id here at all", "en", "s", 5), (None, None, None, None, None)]
    rows.append((205, prose(rng, 30_000), "en", "s", 1))
    rows.append((206, "é ü ß 中文 \u0085   tab\tend  two  spaces \U0001f600", "fr", "s", 1))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """More columns, with the names of outputs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("start", "ids", "score", "component_id", "n_words", "item_id", "grp", "n_replaced", "chunk", "held_out")})
