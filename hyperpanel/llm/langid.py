"""Language identification as mixture inference (operator 8).

Character trigram models of the languages are counted over all training rows.
A document is taken as a mixture: expectation-maximisation estimates its
language proportions from the trigram likelihoods of its words, and among the
nested sets of its likeliest languages the one with the best penalised
likelihood (half a log of the number of words for every further proportion) is
kept. Sets grow to all learned languages; a document's search ends before only
where the likelihood of any mixture, bounded from above, cannot make up for the
penalty. The prediction is the largest proportion of the chosen set.

Predictions read the text alone. Models are bounded: languages x 65,536
trigram classes; more than ``MOST_LANGUAGES`` is refused.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as are all texts where nothing could be learned; a row with null ``doc_id`` is
predicted, not learned from, and counts as not held out; repeated rows are
predicted each by itself; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES = 1 << 16
MOST_LANGUAGES = 512
STEPS, MORE_STEPS = 8, 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram class of every letter, first letter of every word, text of every word); case is folded and other characters are edges."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    letter = _letters()[codes]
    before, after = np.zeros_like(codes), np.zeros_like(codes)
    before[1:], after[:-1] = np.where(letter[:-1], codes[:-1], 0), np.where(letter[1:], codes[1:], 0)
    inner = bounds[(bounds > 0) & (bounds < len(codes))]
    before[inner], after[inner - 1] = 0, 0
    at = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        h = (before[at] * np.uint32(0x9E3779B1) + codes[at]) * np.uint32(0x85EBCA77) + after[at]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    words = np.flatnonzero(before[at] == 0)
    return (h >> np.uint32(16)).astype(np.int64), words, np.searchsorted(bounds, at[words], "right") - 1


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities) from all given rows with a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in common.row_slices(whole, 1, 1 << 20):
                langs = np.array(batch.column(0).to_pylist(), object)
                classes, words, of = trigrams(batch.column(1).to_pylist())
                if not len(words):
                    continue
                owner = langs[np.repeat(of, np.diff(np.append(words, len(classes))))]
                for lang in set(langs):
                    totals[lang] = totals.get(lang, 0) + np.bincount(classes[owner == lang], minlength=CLASSES)
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(total[seen])], names=["lang", "class", "n"])

    found = rows.mapInArrow(count, "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((len(langs), CLASSES), 0.5)
    row = {lang: k for k, lang in enumerate(langs)}
    np.add.at(counts, ([row[x] for x in found.column("lang").to_pylist()], found.column("class").to_numpy()), found.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(like: np.ndarray, of: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of every document by EM over words x languages likelihoods, from ``start`` proportions."""
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    owner = np.cumsum(np.diff(of, prepend=of[0]) != 0)
    n = np.diff(np.append(firsts, len(of)))[:, None].astype(np.float32)
    share = start
    for _ in range(steps):
        joint = like * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, firsts) / n
    total = np.log((like * share[owner]).sum(axis=1))
    return share, np.add.reduceat(total, firsts, dtype=np.float64)


def most(like: np.ndarray, of: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What the log likelihood of no mixture exceeds, for every document: it is concave, so the slopes at ``share`` bound it."""
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    owner = np.cumsum(np.diff(of, prepend=of[0]) != 0)
    n = np.diff(np.append(firsts, len(of)))
    mix = (like * share[owner]).sum(axis=1, keepdims=True) + np.float32(1e-30)
    slopes = np.add.reduceat(like / mix, firsts, dtype=np.float64) / n[:, None]
    return np.add.reduceat(np.log(mix[:, 0]), firsts, dtype=np.float64) + n * np.log(np.maximum(slopes.max(axis=1), 1)) + 1e-5 * n


def proportions(texts: list[str | None], logp: np.ndarray) -> np.ndarray:
    """Proportion of every language in every text, 0 outside the chosen set; rows of texts without a letter are 0."""
    out = np.zeros((len(texts), len(logp)))
    classes, words, of = trigrams(texts)
    if not len(words) or not len(logp):
        return out
    log = np.stack([np.add.reduceat(row[classes], words) for row in logp], axis=1)
    top = log.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(log - top, -60)).astype(np.float32)
    docs = np.unique(of)
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    owner = np.cumsum(np.diff(of, prepend=of[0]) != 0)
    n_words = np.diff(np.append(firsts, len(of)))
    langs = len(logp)
    share, _ = mixtures(like, of, np.full((len(docs), langs), 1 / langs, np.float32), STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    single = np.add.reduceat(np.log(np.maximum(like, 1e-26)), firsts, dtype=np.float64)
    kept = (rank == 0).astype(np.float32)
    value = np.take_along_axis(single, order[:, :1], axis=1)[:, 0]
    bound = most(like + np.float32(1e-26), of, share)
    for k in range(2, langs + 1):
        penalty = 0.5 * (k - 1) * np.log(np.maximum(2, n_words))
        open_ = np.flatnonzero(bound - penalty > value)
        if not len(open_):
            break
        words_of = np.isin(owner, open_)
        start = np.where(rank[open_] < k, np.maximum(share[open_], 1e-4), 0)
        start /= start.sum(axis=1, keepdims=True)
        part, ll = mixtures(like[words_of] + np.float32(1e-26), of[words_of], start.astype(np.float32), MORE_STEPS)
        gain = ll - penalty[open_]
        better = gain > value[open_]
        kept[open_[better]], value[open_[better]] = part[better], gain[better]
    out[docs] = np.clip(kept, 0, 1)
    return out


def top(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language's number or -1, proportion) of every row."""
    if not shares.shape[1]:
        return np.full(len(shares), -1), np.zeros(len(shares))
    score = shares.max(axis=1, initial=0)
    return np.where(score > 0, shares.argmax(axis=1), -1), score


def infer(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language's number or -1, proportion) of every text."""
    return top(proportions(texts, logp))


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and proportions (of the languages of the chosen set) of every row."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))  # at most MOST_LANGUAGES x CLASSES x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for whole in batches:
            for batch in common.row_slices(whole, 1, 1 << 20):
                shares = proportions(batch.column(1).to_pylist(), table)
                best, score = top(shares)
                row, lang = np.nonzero(shares)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(shares)))]).astype(np.int32)
                sets = pa.MapArray.from_arrays(pa.array(ends), pa.array([names[x] for x in lang], pa.string()), pa.array(shares[row, lang]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[b] if b >= 0 else "und" for b in best], pa.string()), pa.array(score), sets], names=["doc_id", "lang_pred", "score", "proportions"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8 over all documents."""
    docs = common.read_table(spark, sf_dir, "documents")
    langs, logp = learn(docs.filter(fold() != 0))
    return predict(docs, langs, logp).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
