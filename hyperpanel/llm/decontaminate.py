"""Benchmark decontamination by BM25 retrieval with block-max bounds (operator 6).

The items of a test set make an inverted index with the largest impact of each
term over all items and over each block of 64 items. Every training document is
cut into overlapping passages, each of which is a query, and all items whose
score reaches their threshold are retrieved:

1. (WAND) a passage whose terms' largest impacts together stay below the
   threshold is skipped;
2. (block-max) so is a block of items whose block maxima stay below it;
3. the items of the remaining blocks are scored in full.

Impacts are divided by the item's own threshold: the least score that a passage
can have which holds the share ``CONTAINED`` of the item's five-word shingles.
So the threshold is 1 for all, and retrieval loses no passage that verification
would accept. Verification asks for that share of shingles, and for the words of
the question (all sentences but the last) and of the answer (the last one).

An index is bounded by ``MOST_WORDS`` words of items; a larger test set is taken
in blocks of items, one pass over the documents for each.

Defined results: null, empty and wordless texts and items match nothing; rows
with equal ids are reported once for each id and item, by the best passage, and
so are null ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textstats import Words

SHINGLE = 5
CONTAINED = 0.8
QUESTION_WORDS, ANSWER_WORDS = 0.7, 0.5
K1, B = 1.2, 0.75
BLOCK = 64
STRIDE = 128
MOST_WORDS = 4_000_000
SLICE = 1 << 20
SCHEMA = "doc_id long, item_id long, first_word long, bm25 double, contained double, question_overlap double, answer_overlap double"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: list[str | None]) -> Words:
    """Words of letters and digits with case folded."""
    offsets, data = common.utf8_buffers(pa.array([t.lower() if t else "" for t in texts], pa.string()))
    return Words(offsets, np.where(_LETTER[data], data, 32).astype(np.uint8))


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Index:
    items: np.ndarray
    terms: np.ndarray  # sorted word hashes
    most: np.ndarray  # largest impact of each term
    block_at: np.ndarray  # term -> its (block, maximum) pairs
    blocks: np.ndarray
    block_most: np.ndarray
    post_at: np.ndarray  # (term, block) pair -> its postings
    posts: np.ndarray
    impacts: np.ndarray
    shingles: list[np.ndarray]
    sizes: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    stride: int
    thresholds: np.ndarray


def _shingles(words: Words, h: np.ndarray, a: int, b: int, wide: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of words a to b-1 (of all of them, if fewer)."""
    if b - a >= SHINGLE:
        return wide[a : b - SHINGLE + 1]
    return words.windows(h[a:b], b - a, 8) if b > a else np.zeros(0, np.uint64)


def build_index(rows: list[tuple[int, str]]) -> Index:
    """Index of (item_id, text) rows; items without words are left out."""
    rows = sorted((i, t) for i, t in rows if t)
    words = words_of([t for _, t in rows])
    full = np.flatnonzero(np.diff(words.first) > 0)
    rows = [rows[k] for k in full]
    words = words_of([t for _, t in rows])
    h = words.hashes()
    wide = words.windows(h, SHINGLE, 8)
    n, size = len(rows), np.diff(words.first)
    terms, code = np.unique(h, return_inverse=True)
    pair, tf = np.unique(code * max(1, n) + words.doc, return_counts=True)
    term, item = pair // max(1, n), pair % max(1, n)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(1e-9, size.mean() if n else 1)))
    shingles = [_shingles(words, h, a, b, wide) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    threshold = np.zeros(n)
    order = np.lexsort((-impact, item))
    at = np.searchsorted(item[order], np.arange(n + 1))
    for k in range(n):
        missing = int((1 - CONTAINED) * len(shingles[k]) + 1e-9)
        threshold[k] = max(1e-6, impact[order[at[k] : at[k + 1]]][missing:].sum() * (1 - 1e-9))
    impact = impact / threshold[item]
    block = item // BLOCK
    key = term * (n // BLOCK + 1) + block
    post_at = np.flatnonzero(np.diff(key, prepend=-1))
    block_most = np.maximum.reduceat(impact, post_at) if len(impact) else impact
    pair_term = term[post_at]
    block_at = np.searchsorted(pair_term, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(block_most, block_at[:-1]) if len(terms) else np.zeros(0)
    parts = [question_and_answer(t) for _, t in rows]
    sides = [[np.unique(w.hashes()[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)] for w in (words_of([p[s] for p in parts]) for s in (0, 1))]
    return Index(
        np.array([i for i, _ in rows], np.int64), terms, most, block_at, block[post_at], block_most, np.append(post_at, len(impact)), item, impact,
        shingles, size, sides[0], sides[1], max(STRIDE, int(size.max()) if n else 0), threshold,
    )


def _gather(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``which``, place) of all places from at[w] to at[w + 1] - 1."""
    first, count = at[which], at[which + 1] - at[which]
    ends = np.cumsum(count)
    return np.repeat(np.arange(len(which)), count), np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all scores of 1 and more, given the distinct terms of each passage."""
    bound = np.bincount(passage, index.most[term], passages)
    open_ = bound[passage] >= 1
    passage, term = passage[open_], term[open_]
    row, pair = _gather(index.block_at, term)
    n_blocks = len(index.items) // BLOCK + 1
    cell, inverse = np.unique(passage[row] * n_blocks + index.blocks[pair], return_inverse=True)
    keep = (np.bincount(inverse, index.block_most[pair], len(cell)) >= 1)[inverse]
    row, pair = row[keep], pair[keep]
    place, post = _gather(index.post_at, pair)
    cell, inverse = np.unique(passage[row][place] * len(index.items) + index.posts[post], return_inverse=True)
    total = np.bincount(inverse, index.impacts[post], len(cell))
    found = total >= 1
    return cell[found] // max(1, len(index.items)), cell[found] % max(1, len(index.items)), total[found]


def _search(index: Index, batch: pa.RecordBatch) -> Iterator[tuple]:
    words = words_of(batch.column(1).to_pylist())
    n, h, stride = np.diff(words.first), words.hashes(), index.stride
    place = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    at = np.flatnonzero(index.terms[place] == h)
    last = np.maximum(0, -(-n // stride) - 2)
    base = np.concatenate([[0], np.cumsum(last + 1)])
    doc, k = words.doc[at], (at - words.first[words.doc[at]]) // stride
    own = base[doc] + np.minimum(k, last[doc])
    both = (k > 0) & (k <= last[doc])
    width = len(index.terms)
    key = np.unique(np.concatenate([own * width + place[at], (own[both] - 1) * width + place[at][both]]))
    passage, item, score = retrieve(index, key // width, key % width, int(base[-1]))
    wide = words.windows(h, SHINGLE, 8)
    best: dict[tuple[int, int], tuple] = {}
    for p, i, s in zip(passage, item, score, strict=True):
        d = int(np.searchsorted(base, p, "right")) - 1
        a = int(words.first[d] + (p - base[d]) * stride)
        b = int(min(words.first[d + 1], a + 2 * stride) if p < base[d + 1] - 1 else words.first[d + 1])
        want = index.shingles[i]
        if index.sizes[i] >= SHINGLE:
            have = wide[a : max(a, b - SHINGLE + 1)]
        else:
            have = words.windows(h[a:b], int(index.sizes[i]), 8)
        contained = float(np.isin(want, have).mean())
        if contained < CONTAINED - 1e-9:
            continue
        question, answer = (float(np.isin(x[i], h[a:b]).mean()) if len(x[i]) else 1.0 for x in (index.question, index.answer))
        if question < QUESTION_WORDS or answer < ANSWER_WORDS:
            continue
        row = (a - int(words.first[d]), float(s * index.thresholds[i]), contained, question, answer)
        if (d, i) not in best or (row[2], row[1]) > (best[d, i][2], best[d, i][1]):
            best[d, i] = row
    ids = batch.column(0).to_pylist()
    for (d, i), row in best.items():
        yield (ids[d], int(index.items[i]), *row)


def indexes(items: DataFrame, most_words: int = MOST_WORDS) -> Iterator[Index]:
    """Indexes of the test items (item_id, text), each of about ``most_words`` words."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = tests.agg(F.sum(F.size(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")))).first()[0] or 0
    parts = max(1, -(-total // most_words))
    for part in range(parts):
        block = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about most_words words
        yield build_index([(r.item_id, r.text) for r in block])


def keep(docs: DataFrame, items: DataFrame, *, text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no test item; decided row by row, without a shuffle."""
    at, spark = docs.columns.index(text_col), docs.sparkSession
    for own in indexes(items, most_words):
        index = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in common.row_slices(whole, at, SLICE):
                    held = np.zeros(batch.num_rows, bool)
                    if len(index.value.items):
                        texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
                        held[[hit[0] for hit in _search(index.value, texts)]] = True
                    yield batch.filter(pa.array(~held))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """SCHEMA: every document and test item (item_id, text) that it holds."""
    spark = docs.sparkSession
    rows = common.id_and_text(docs, id_col, text_col)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 4
    found = None
    for own in indexes(items, most_words):
        index = spark.sparkContext.broadcast(own)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in common.row_slices(whole, 1, SLICE) if len(index.value.items) else ():
                    if hits := list(_search(index.value, batch)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), kinds, strict=True)], names=names)

        hits = rows.mapInArrow(search, SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("contained", "bm25", (-F.col("first_word")).alias("before"), "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.before")).alias("first_word"), "best.bm25", "best.contained", "best.question_overlap", "best.answer_overlap")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6: all documents against all benchmark items."""
    found = find_leaks(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
    rounded = [F.round(c, 6).alias(c) for c in ("bm25", "contained", "question_overlap", "answer_overlap")]
    return found.select("doc_id", "item_id", "first_word", *rounded)
