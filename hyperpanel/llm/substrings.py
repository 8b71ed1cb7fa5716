"""Exact repeats of passages by fixed-block anchors (operator 9).

A window of 13 words holds a whole block of 7 words that starts at a multiple
of 7. So the aligned blocks of all documents are indexed, and every rolling
window of 7 words of every document probes them (an aligned block is itself one
of these windows, so index and probes travel together). A place is an anchor if
its 7 words are an aligned block of some document and stand in another one too.
Hits are then extended: of the windows of 13 words around anchors, and of no
others, each one's smallest document is found exactly, by a hash of 96 bits. A
window whose smallest document is not its own is a repeat; overlapping
repeats join into maximal ones.

No pairs of documents are made: a passage in a third of all documents costs one
entry for each chunk of documents (see :mod:`census`).

Defined results: null text has no words; a row with null ``doc_id`` is returned
whole and makes nothing a repeat; rows with equal ids never make each other
repeats; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import census, common
from .textstats import Words

WINDOW = 13
SCHEMA = "doc_id long, n_words long, n_removed long, kept string, repeats array<long>"


def _anchors(chunk: census.Chunk, words: Words, block: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(start of each rolling block in order of (bucket, key), first of each run, bucket and key of each run)."""
    at = np.flatnonzero(words.fits(block) & ~chunk.null[words.doc[: max(0, len(words.doc) - block + 1)]])
    h = words.windows(words.hashes(0), block, 2)[at]
    bucket, key = census.bucket_of(h, buckets), h & census.KEY_MASK
    order, firsts = census.runs(bucket, key)
    return at[order], firsts, bucket[order][firsts], key[order][firsts]


def _windows(chunk: census.Chunk, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, start) of all windows of documents with ids."""
    at = np.flatnonzero(words.fits(window) & ~chunk.null[words.doc[: max(0, len(words.doc) - window + 1)]])
    return words.windows(words.hashes(0), window, 3)[at], (words.windows(words.hashes(1), window, 4)[at] >> np.uint64(32)).astype(np.uint32), at


def _window_rows(h: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    parts = [(h, "<u8"), (check, "<u4"), (doc, "<i8")]
    return np.concatenate([np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), -1) for x, kind in parts], axis=1)


def _field(rows: np.ndarray, a: int, b: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(rows[:, a:b]).view(kind).reshape(-1)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words of repeats: doc_id, n_words, n_removed, kept, repeats.

    ``repeats`` lists first word and word after the last of each maximal repeat.
    """
    block = (window + 1) // 2
    chunks, buckets = census.chunk_table(docs, id_col, text_col)

    def probe(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = census.Chunk(row)
        words = Words(chunk.offsets, chunk.data)
        at, firsts, bucket, key = _anchors(chunk, words, block, buckets)
        if not len(at):
            return
        doc = words.doc[at]
        aligned = ((at - words.first[doc]) % block == 0).astype(np.uint8)
        many = np.minimum.reduceat(doc, firsts) != np.maximum.reduceat(doc, firsts)
        yield census.deal(chunk.id, bucket, census.four_bytes(key, np.maximum.reduceat(aligned, firsts) | many.astype(np.uint8) << 1))

    def hits(rows: np.ndarray) -> tuple[np.ndarray, None]:
        key, flags = census.key_and_flags(rows)
        order, firsts = census.runs(key)
        n = census.sizes(firsts, len(key))
        seen = np.bitwise_or.reduceat(flags[order], firsts)
        return np.sort(order[np.repeat((seen & 1 > 0) & ((n > 1) | (seen & 2 > 0)), n)]), None

    anchored = common.materialize(census.meet(census.ask(chunks, probe), 4, hits), "anchors")

    def candidates(chunk: census.Chunk, words: Words, anchors: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """(hash, check, start, bucket, order, first of each run) of the windows around anchors, runs in the order of buckets."""
        h, check, start = _windows(chunk, words, window)
        marks = np.zeros(len(words.doc) + window + 1, np.int64)
        if anchors and len(h):
            at, firsts, bucket, _ = _anchors(chunk, words, block, buckets)
            holds, _ = census.replied(anchors, bucket)
            marks[at[np.repeat(holds, census.sizes(firsts, len(at)))]] = 1
        total = np.concatenate([[0], np.cumsum(marks)])
        near = total[start + window - block + 1] - total[start] > 0
        h, check, start = h[near], check[near], start[near]
        bucket = census.bucket_of(h, buckets)
        order, firsts = census.runs(bucket, h, check)
        return h, check, start, bucket[order][firsts], order, firsts

    def extend(chunk: census.Chunk, anchors: dict[int, bytes]) -> pa.Table:
        words = Words(chunk.offsets, chunk.data)
        h, check, start, bucket, order, firsts = candidates(chunk, words, anchors)
        if not len(h):
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        least = np.minimum.reduceat(chunk.ids[words.doc[start]][order], firsts)
        return pa.Table.from_batches([census.deal(chunk.id, bucket, _window_rows(h[order][firsts], check[order][firsts], least))])

    def later(rows: np.ndarray) -> tuple[np.ndarray, None]:
        doc = _field(rows, 12, 20, "<i8")
        order, firsts = census.runs(_field(rows, 0, 8, "<u8"), _field(rows, 8, 12, "<u4"))
        return np.sort(order[doc[order] > np.repeat(np.minimum.reduceat(doc[order], firsts), census.sizes(firsts, len(rows)))]), None

    repeated = common.materialize(census.meet(census.answer(chunks, [anchored], extend, "bucket long, chunk long, data binary"), 20, later), "repeats")

    def cut(chunk: census.Chunk, anchors: dict[int, bytes], repeats: dict[int, bytes]) -> pa.Table:
        words = Words(chunk.offsets, chunk.data)
        h, _, start, bucket, order, firsts = candidates(chunk, words, anchors)
        again = np.zeros(len(h), bool)
        if len(h):
            doc, n = chunk.ids[words.doc[start]][order], census.sizes(firsts, len(h))
            elsewhere, _ = census.replied(repeats, bucket)
            again[order] = np.repeat(elsewhere, n) | (doc > np.repeat(np.minimum.reduceat(doc, firsts), n))
        return _without(chunk, words, start[again], window)

    return census.answer(chunks, [anchored, repeated], cut, SCHEMA)


def _without(chunk: census.Chunk, words: Words, starts: np.ndarray, window: int) -> pa.Table:
    """The chunk's documents without the words that the given windows cover."""
    n = len(words.doc)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    gone = np.cumsum(edge)[:n] > 0
    # each kept word with one separator after it, made a space
    first, lengths = words.start[~gone], (words.end - words.start)[~gone] + 1
    ends = np.cumsum(lengths)
    source = np.append(chunk.data, np.uint8(32))
    text = source[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    text[ends - 1] = 32
    docs = len(chunk.ids)
    size = np.bincount(words.doc[~gone], lengths, docs).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    kept = [text[a : max(a, b - 1)].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    n_words = np.diff(words.first)
    n_removed = np.bincount(words.doc[gone], minlength=docs)
    before = np.concatenate([[False], gone[:-1]]) if n else gone
    new_doc = np.concatenate([[True], words.doc[1:] != words.doc[:-1]]) if n else gone
    opens = np.flatnonzero(gone & (~before | new_doc))
    after = np.concatenate([gone[1:], [False]]) if n else gone
    last = np.concatenate([words.doc[1:] != words.doc[:-1], [True]]) if n else gone
    closes = np.flatnonzero(gone & (~after | last)) + 1
    spans: list[list[int]] = [[] for _ in range(docs)]
    for a, b in zip(opens, closes, strict=True):
        d = int(words.doc[a])
        spans[d] += [int(a - words.first[d]), int(b - words.first[d])]
    return pa.table({
        "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.null), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "kept": pa.array(kept, pa.string()), "repeats": pa.array(spans, pa.list_(pa.int64())),
    })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9 over all documents."""
    return remove_repeats(common.read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
