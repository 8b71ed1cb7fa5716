"""Toxicity by weak supervision (operator 10).

1. A lexicon is built: a short list of insults, and terms (words and 6-byte
   pieces of words, hashed) whose z-score over labelled training rows (all of
   them, or about ``SAMPLE`` ids chosen by a hash where there are more) is high
   and that fire on few clean ones. Its entries are voters for the toxic class;
   a few patterns vote too, for no class beforehand. Labels choose the voters,
   their side and the class balance, nothing else.
2. One pass over all documents gives the patterns of votes that occur and how
   often each does. Voters that nearly repeat another one are dropped.
3. A generative label model explains these patterns: a voter fires at one rate on
   toxic and at another on clean texts. Expectation-maximisation over the votes
   of all documents estimates the rates; no label is read. All lexicon voters
   start from the same precision. Voters that fire together within a class more
   often than their rates explain are correlated: they share their evidence,
   and the rates are estimated once more.
4. A linear classifier (logistic regression over the terms and patterns) is
   trained on the posterior labels of about ``SAMPLE`` rows that are not held
   out, labelled or not, by L-BFGS on gradients that executors add up.

Only texts enter a score. What comes to the driver is bounded: terms by
``TERMS``, moments by ``CANDIDATES`` squared, sums by the voters or terms for
each task; no features of documents do.

Defined results: null and empty texts get the classifier's score of no term; if
no labelled training row exists, or none of one class, all scores come from the
seed words alone; ids whose labels disagree count by their majority, and not at
all on a tie; a row with null ``doc_id`` is scored, not learned from, and counts
as not held out; repeated rows are scored each by itself; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .langid import fold
from .textstats import Words, mix, spans_hash, _base

#: Seed lexicon of plain insults.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "garbage", "hate", "ugly", "filth", "vermin")
PIECE = 6
BUCKETS = 1 << 22
#: Bounds: terms of the classifier, candidate voters, voters, and sampled rows to train on.
TERMS, CANDIDATES, VOTERS, SAMPLE = 2048, 256, 96, 60_000
#: Shares of characters above which a pattern voter fires.
PATTERNS = {"shouts": 0.5, "marks": 0.02, "symbols": 0.05}
#: Share of toxic rows among the training rows where a mined voter fires, at least; the precision that all lexicon voters start from.
PRECISION = 0.8
#: Iterations of each of two rounds, and the correlation within a class from which voters share evidence.
ITERATIONS, CORRELATED = 15, 0.3
RIDGE = 0.1
#: Log-odds of a seed word, used only where no labelled row is given.
SEED_WEIGHT = 4.0
SLICE = 1 << 20


def terms_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every piece of a word, repeats included; words are runs of letters and bytes above 127."""
    letter = np.zeros(256, bool)
    letter[list(range(97, 123)) + list(range(128, 256))] = True
    spaced = np.where(letter[data], data, 32).astype(np.uint8)
    words = Words(offsets, spaced)
    h = words.hashes(6)
    doc, bucket = [words.doc], [h & np.uint64(BUCKETS - 1)]
    n = len(spaced) - PIECE + 1
    if n > 0:
        value = _base(7)[spaced]
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            for k in range(PIECE):
                total = total * np.uint64(0x9E3779B97F4A7C15) + value[k : k + n]
        length = words.end - words.start
        long = length >= PIECE
        count = (length - PIECE + 1)[long]
        ends = np.cumsum(count)
        at = np.repeat(words.start[long] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        doc.append(np.repeat(words.doc[long], count))
        bucket.append(mix(total[at]) & np.uint64(BUCKETS - 1))
    return np.concatenate(doc), np.concatenate(bucket).astype(np.int64)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts with case folded."""
    return common.utf8_buffers(pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.string()))


def patterns(column: pa.Array) -> np.ndarray:
    """texts x patterns: is the share of capitals, exclamation marks or other symbols high."""
    offsets, data = common.utf8_buffers(column)
    capital = (data >= 65) & (data <= 90)
    small = (data >= 97) & (data <= 122)
    mark = data == 33
    symbol = np.isin(data, np.frombuffer(b"#$%&*@^~<>|{}", np.uint8))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    n = np.maximum(1, np.diff(offsets))
    letters = np.maximum(1, total(capital) + total(small))
    return np.stack([(total(capital) / letters > PATTERNS["shouts"]) & (n > 20), total(mark) / n > PATTERNS["marks"], total(symbol) / n > PATTERNS["symbols"]], axis=1)


def word_buckets(words: tuple[str, ...]) -> np.ndarray:
    """Buckets of given words, as :func:`terms_of` makes them."""
    if not words:
        return np.zeros(0, np.int64)
    offsets, data = common.utf8_buffers(pa.array(words))
    starts, ends = offsets[:-1], offsets[1:]
    return (spans_hash(_base(6)[data], starts, ends, 6) & np.uint64(BUCKETS - 1)).astype(np.int64)


def fired(column: pa.Array, terms: np.ndarray) -> np.ndarray:
    """texts x (terms, patterns) that occur; ``terms`` are sorted buckets."""
    offsets, data = lowered(column)
    doc, bucket = terms_of(offsets, data)
    place = np.minimum(np.searchsorted(terms, bucket), max(0, len(terms) - 1))
    out = np.zeros((len(column), len(terms) + len(PATTERNS)), np.float32)
    if len(terms):
        hit = terms[place] == bucket
        out[doc[hit], place[hit]] = 1
    out[:, len(terms) :] = patterns(column)
    return out


def mine_terms(labelled: DataFrame, always: np.ndarray, most: int = TERMS) -> tuple[dict[int, tuple[float, int, int]], int, int]:
    """({term: (z-score, toxic rows, clean rows)}, toxic rows, clean rows) over all rows (text, toxic): the best terms and those of ``always``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: np.zeros(BUCKETS, np.int32), 1: np.zeros(BUCKETS, np.int32)}
        rows = {0: 0, 1: 0}
        for whole in batches:
            for batch in common.row_slices(whole, 0, SLICE):
                doc, bucket = terms_of(*lowered(batch.column(0)))
                toxic = batch.column(1).to_numpy(zero_copy_only=False)
                one = np.unique(doc * BUCKETS + bucket)
                for y in seen:
                    rows[y] += int((toxic == y).sum())
                    at, n = np.unique(one[toxic[one // BUCKETS] == y] % BUCKETS, return_counts=True)
                    seen[y][at] += n.astype(np.int32)
        at = np.flatnonzero(seen[0] + seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[1][at], rows[1]).astype(np.int64)), pa.array(np.append(seen[0][at], rows[0]).astype(np.int64))], names=["term", "n1", "n0"])

    counts = common.materialize(labelled.mapInArrow(count, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "terms")
    total = counts.filter("term = -1").first()
    n1, n0 = (total.n1, total.n0) if total else (0, 0)
    if not n1 or not n0:
        return {}, n1, n0
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
    z = (p1 - p0) / F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    scored = counts.filter("term >= 0").withColumn("z", z)
    best = scored.filter("n1 >= 3 AND z > 2.5").orderBy(F.desc("z"), "term").limit(most).collect()  # at most TERMS rows
    given = scored.filter(F.col("term").isin(always.tolist())).collect()
    return {r.term: (r.z, r.n1, r.n0) for r in [*best, *given]}, n1, n0


def vote_patterns(docs: DataFrame, candidates: np.ndarray) -> DataFrame:
    """pattern (bits of the candidates that fire, pattern voters last), n: how many of all texts have it; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.row_slices(whole, 0, SLICE):
                bits, n = np.unique(np.packbits(fired(batch.column(0), candidates) > 0, axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    found = docs.select("text").mapInArrow(count, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return common.materialize(found, "votes")


def _votes(batch: pa.RecordBatch, columns: np.ndarray, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(patterns x columns, how often each occurs) of a batch of patterns."""
    raw, n = batch.column(0), batch.column(1).to_numpy()
    for s in range(0, len(n), step):
        bits = np.frombuffer(b"".join(raw.slice(s, step).to_pylist()), np.uint8).reshape(len(n[s : s + step]), -1)
        yield np.unpackbits(bits, axis=1)[:, columns].astype(float), n[s : s + step].astype(float)


def sums(patterns: DataFrame, columns: np.ndarray, of: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of the arrays (``width`` numbers) that ``of`` gives for votes and their numbers; one array a task comes to the driver."""
    return _summed(patterns, lambda batch: sum((of(v, n) for v, n in _votes(batch, columns)), np.zeros(width)), width)


def _summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["task", "sums"])

    parts = sorted((r.task, bytes(r.sums)) for r in rows.mapInArrow(run, "task long, sums binary").collect())
    return sum((np.frombuffer(x) for _, x in parts), np.zeros(width))


def cells(patterns: DataFrame, columns: np.ndarray, of: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int) -> np.ndarray:
    """The same for many numbers: they are added up by a shuffle, and only the totals come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in batches:
            for v, n in _votes(batch, columns):
                total += of(v, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["cell", "x"])

    found = patterns.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(count)
    out[found.column("cell").to_numpy()] = found.column("x").to_numpy()
    return out


def moments(patterns: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """(how often each two candidates fire together, rows) over all texts."""
    found = cells(patterns, np.arange(width), lambda v, n: np.append(((v * n[:, None]).T @ v).reshape(-1), n.sum()), width * width + 1)
    return found[:-1].reshape(width, width), int(found[-1])


@dataclass
class LabelModel:
    """Voters (columns of :func:`fired`), their rates of firing on either class, and the correlations of those that repeat each other.

    The evidence of a voter that fires is divided among it and the correlated
    ones beside it, that of a silent one among those that are expected there.
    """

    voters: np.ndarray
    balance: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    shared: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class, given texts x voters."""
        fire, quiet = np.log(self.on_toxic / self.on_clean), np.log((1 - self.on_toxic) / (1 - self.on_clean))
        silence = quiet / (1 + self.shared @ self.on_toxic)
        odds = np.log(self.balance / (1 - self.balance)) + silence.sum() + (votes * (fire / (1 + votes @ self.shared) - silence)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def choose_voters(both: np.ndarray, rows: int, score: np.ndarray, most: int = VOTERS) -> np.ndarray:
    """The best candidates by ``score`` of which no two fire nearly together (phi above 0.8)."""
    p = np.diag(both) / max(1, rows)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = (both / max(1, rows) - np.outer(p, p)) / np.outer(spread, spread)
    chosen: list[int] = []
    for k in np.argsort(-score, kind="stable"):
        if len(chosen) < most and both[k, k] >= 3 and p[k] < 0.5 and (not chosen or phi[k, chosen].max() < 0.8):
            chosen.append(int(k))
    return np.array(sorted(chosen), np.int64)


def fit_label_model(patterns: DataFrame, voters: np.ndarray, lexicon: np.ndarray, balance: float, rate: np.ndarray, iterations: int = ITERATIONS, least: float = CORRELATED) -> LabelModel:
    """Label model of the voters by expectation-maximisation over all patterns, without labels.

    ``lexicon`` says which voters start as voters for the toxic class, ``rate``
    how often each fires; ``balance`` stays.
    """
    m = len(voters)
    high = np.where(lexicon, PRECISION * rate / balance, rate)
    low = np.where(lexicon, (1 - PRECISION) * rate / (1 - balance), rate)
    model = LabelModel(voters, balance, np.clip(high, 1e-4, 0.95), np.clip(low, 1e-6, 0.9), np.zeros((m, m)))
    if not m:
        return model

    def expected(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        g = model.posterior(votes) * n
        return np.concatenate([[g.sum(), n.sum()], g @ votes, n @ votes])

    def together(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        g = model.posterior(votes) * n
        return np.concatenate([((votes * x[:, None]).T @ votes).reshape(-1) for x in (g, n - g)] + [[g.sum(), n.sum() - g.sum()]])

    for turn in range(2):
        for _ in range(iterations):
            toxic, rows, *fires = np.split(sums(patterns, voters, expected, 2 + 2 * m), [1, 2, 2 + m])
            was = model.on_toxic
            high = (fires[0] + 0.5 * rate) / (toxic + 0.5)
            low = (fires[1] - fires[0] + 0.5 * rate) / (rows - toxic + 0.5)
            model = LabelModel(voters, balance, np.clip(high, 1e-6, 0.99), np.clip(low, 1e-6, 0.99), model.shared)
            if np.abs(model.on_toxic - was).max() < 1e-4:
                break
        if not turn:
            found = cells(patterns, voters, together, 2 * m * m + 2)
            shared = np.zeros((m, m))
            for both, rows, a in zip(found[: 2 * m * m].reshape(2, m, m), found[2 * m * m :], (model.on_toxic, model.on_clean), strict=True):
                cov = both / max(rows, 1) - np.outer(a, a)
                spread = np.sqrt(a * (1 - a))
                phi = cov / np.maximum(np.outer(spread, spread), 1e-9)
                sure = cov * rows > 6 * np.sqrt(np.maximum(np.outer(a, a) * rows, 1))
                shared = np.maximum(shared, np.where(sure & (phi > least), np.minimum(phi, 1), 0))
            np.fill_diagonal(shared, 0)
            if not shared.any():
                break
            model = LabelModel(voters, balance, model.on_toxic, model.on_clean, shared)
    return model


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 40, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Weights after at most ``steps`` steps of L-BFGS with backtracking; ``loss`` gives value and gradient."""
    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    scale = max(1.0, float(np.abs(gradient).max()))
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance * scale:
            break
        way, turns = -gradient, []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            way = way - a * y
            turns.append(a)
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / scale)
        for (s, y), a in zip(past, reversed(turns), strict=True):
            way = way + (a - y @ way / (s @ y)) * s
        size, slope = 1.0, gradient @ way
        for _ in range(12):
            new = w + size * way
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (new_gradient - gradient) @ (new - w) > 1e-12:
            past = [*past[1 - memory :], (new - w, new_gradient - gradient)]
        w, value, gradient = new, new_value, new_gradient
    return w


def logistic(rows: DataFrame, width: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression on stored rows (features: packed bits, posterior: soft labels)."""

    def part(w: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(width + 2)
        raw, y = batch.column(0), batch.column(1).to_numpy()
        for s in range(0, len(y), 2048):
            x = np.unpackbits(np.frombuffer(b"".join(raw.slice(s, 2048).to_pylist()), np.uint8).reshape(len(y[s : s + 2048]), -1), axis=1)
            row, column = np.nonzero(x[:, :width])
            odds = np.bincount(row, w[column], len(x)) + w[-1]
            rest = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[s : s + 2048]
            total[:width] += np.bincount(column, rest[row], width)
            total[width:] += rest.sum(), (np.logaddexp(0, odds) - y[s : s + 2048] * odds).sum()
        return total

    penalty = np.append(np.full(width, ridge), 1e-6)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = _summed(rows, lambda batch: part(w, batch), width + 2)
        return float(found[-1] + (penalty * w * w).sum() / 2), found[:-1] + penalty * w

    mean = rows.agg(F.avg("posterior")).first()[0]
    return lbfgs(loss, np.append(np.zeros(width), np.log((mean + 1e-6) / (1 - mean + 1e-6))))


@dataclass
class Classifier:
    terms: np.ndarray
    weights: np.ndarray
    label_model: LabelModel

    def score(self, column: pa.Array) -> np.ndarray:
        odds = fired(column, self.terms) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[str, ...] = SEEDS, sample: int = SAMPLE, held_out: Column | None = None) -> Classifier:
    """Classifier from all ``docs`` (their texts) and the ``labels`` (doc_id, toxic) of rows to learn from; it is not fitted on rows that ``held_out`` marks."""
    rows = common.id_and_text(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.avg("toxic").alias("share")).filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("toxic"))
    part = min(1.0, sample / max(1, known.count()))
    if part < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    training = rows.join(F.broadcast(known), "doc_id").filter("text IS NOT NULL").select("text", "toxic")  # about ``sample`` ids at most
    seed = word_buckets(seeds)
    found, n1, n0 = mine_terms(training, seed)
    balance = min(max((n1 or 0) / max(1, (n1 or 0) + (n0 or 0)), 0.005), 0.5)
    mined = np.array(sorted(found, key=lambda t: (-found[t][0], t)), np.int64)
    precise = np.array([t for t in mined if found[t][1] >= PRECISION * (found[t][1] + found[t][2])], np.int64)
    candidates = np.unique(np.concatenate([seed, precise[:CANDIDATES]]))
    patterns = vote_patterns(rows, candidates)
    both, total = moments(patterns, len(candidates) + len(PATTERNS))
    voters = choose_voters(both, total, np.array([found[int(c)][0] if int(c) in found else 1.0 for c in candidates] + [0.5] * len(PATTERNS)))
    model = fit_label_model(patterns, voters, voters < len(candidates), balance, np.diag(both)[voters] / max(1, total))
    common.drop_table(docs.sparkSession, patterns)

    terms = np.unique(np.concatenate([candidates, mined]))
    at = np.searchsorted(terms, candidates)
    columns = np.concatenate([at, len(terms) + np.arange(len(PATTERNS))])[voters].astype(np.int64)
    width = len(terms) + len(PATTERNS)
    if not n1 or not n0:
        weights = np.zeros(width + 1)
        weights[np.searchsorted(terms, np.unique(seed))] = SEED_WEIGHT
        weights[-1] = -SEED_WEIGHT
        return Classifier(terms, weights, model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.row_slices(whole, 0, SLICE):
                f = fired(batch.column(0), terms)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.packbits(f > 0, axis=1)], pa.binary()), pa.array(model.posterior(f[:, columns]))], names=["features", "posterior"])

    own = docs if held_out is None else docs.filter(~F.coalesce(held_out, F.lit(False)))
    chosen = common.id_and_text(own, id_col, text_col).filter("doc_id IS NOT NULL AND text IS NOT NULL").filter(F.rand(7) < min(1.0, sample / max(1, total))).select("text")
    fitted = common.materialize(chosen.mapInArrow(features, "features binary, posterior double"), "features")
    classifier = Classifier(terms, logistic(fitted, width) if fitted.limit(1).count() else np.zeros(width + 1), model)
    common.drop_table(docs.sparkSession, fitted)
    return classifier


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # at most TERMS + CANDIDATES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.row_slices(whole, 1, SLICE):
                s = model.value.score(batch.column(1)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, classifier: Classifier, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that score below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.row_slices(whole, at, SLICE):
                yield batch.filter(pa.array(model.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10 over all documents."""
    docs = common.read_table(spark, sf_dir, "documents")
    classifier = train(docs, common.read_table(spark, sf_dir, "labels").filter(fold() != 0), held_out=fold() == 0)
    return score(docs, classifier).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
