"""A census of hashed items over all documents, without a row for every item.

Documents are first packed into chunks of a few MB, stored as a table in the
shared folder, so every later pass sees the same chunks. A pass gives, for each
chunk, its distinct hashed items with a few bytes of statistics; they are dealt
by hash into buckets as packed arrays (one row for a chunk and bucket, not for
an item), met in the buckets, and the verdict on each item is sent back to the
chunks that asked: a bit for each entry, in the order in which it was asked. An
item that stands in a third of all documents costs each chunk one entry, and its
bucket one entry a chunk. Chunks and buckets grow with the text (see
:func:`extents`), so that rows keep many entries and a hot item's entries stay
within what a bucket holds: at 100 TB there are six million chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk's texts, least and most.
CHUNK_BYTES, MOST_CHUNK_BYTES = 1 << 20, 16 << 20
#: Entries that one bucket should hold, least and most, and entries that a row (chunk and bucket) should have.
BUCKET_ENTRIES, MOST_BUCKET_ENTRIES, ROW_ENTRIES = 1_000_000, 4_000_000, 256
ENTRY_BYTES = 6.5
#: An item is its bucket and 30 bits of its hash. With a million entries in a bucket one item in a thousand meets
#: another one's key, with four million four; callers use verdicts only to find candidates.
KEY_BITS = np.uint64(30)
KEY_MASK = np.uint64((1 << 30) - 1)
CHUNK_SCHEMA = "chunk long, n_bytes long, ids binary, nulls binary, offsets binary, data binary"
REPLY_SCHEMA = "chunk long, bucket long, data binary"


class Chunk:
    """Documents of a chunk row: ``ids``, ``null`` (is the id null), ``offsets`` and ``data`` of their texts."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.null = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        size = int(self.offsets[-1])
        self.data = np.frombuffer(pa.decompress(row["data"], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def extents(n_bytes: int) -> tuple[int, int]:
    """(bytes of a chunk, number of buckets) for texts of ``n_bytes``: chunks grow first, then buckets."""
    chunk = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, int(n_bytes * ROW_ENTRIES / BUCKET_ENTRIES)))
    held = min(MOST_BUCKET_ENTRIES, max(BUCKET_ENTRIES, int(n_bytes * ROW_ENTRIES / chunk)))
    return chunk, max(1, round(n_bytes / ENTRY_BYTES / held))


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(table of packed documents, number of buckets); a text longer than a chunk has one of its own."""
    rows = common.id_and_text(docs, id_col, text_col)
    most_bytes, buckets = extents(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count
            ids, nulls, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            row = {"chunk": base + count, "n_bytes": size, "ids": ids.tobytes(), "nulls": nulls.astype(np.uint8).tobytes(), "offsets": offsets.tobytes(), "data": pa.compress(data.tobytes(), codec="zstd", asbytes=True) if size else b""}
            held, size, count = [], 0, count + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "offsets", "data"))]))

        for whole in batches:
            for batch in common.row_slices(whole, 1, most_bytes // 2):
                ids, null = common.long_buffers(batch.column(0))
                offsets, data = common.utf8_buffers(batch.column(1))
                held.append((ids, null, np.diff(offsets), data))
                size += len(data)
                if size >= most_bytes or sum(len(h[0]) for h in held) >= 60_000:
                    yield flush()
        if held:
            yield flush()

    return common.materialize(rows.mapInArrow(pack, CHUNK_SCHEMA), "chunks"), buckets


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> KEY_BITS) % np.uint64(buckets)


def four_bytes(h: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Rows of four bytes: the key of each hash and two bits."""
    return ((h & KEY_MASK) << np.uint64(2) | flags.astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)


def key_and_flags(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry = np.ascontiguousarray(rows[:, :4]).view("<u4").reshape(-1)
    return entry >> np.uint32(2), (entry & np.uint32(3)).astype(np.uint8)


def packed(rows: np.ndarray) -> bytes:
    """Bytes plane by plane, which lets the shuffle's compression drop the planes of zeros."""
    return np.ascontiguousarray(rows.T).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T


def deal(chunk: int, bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One record a bucket of packed entries (``rows`` holds the bytes of each); ``bucket`` is sorted."""
    firsts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    ends = np.append(firsts, len(bucket))[1:]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[firsts].astype(np.int64)), pa.array(np.full(len(firsts), chunk, np.int64)), pa.array([packed(rows[a:b]) for a, b in zip(firsts, ends, strict=True)], pa.binary())],
        names=["bucket", "chunk", "data"],
    )


def ask(source: DataFrame, entries: Callable[[dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    """bucket, chunk, data from every row of ``source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from entries(batch.slice(k, 1).to_pylist()[0])
            common.trim()

    return source.mapInArrow(run, "bucket long, chunk long, data binary")


def meet(asked: DataFrame, width: int, judge: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """Replies (chunk, bucket, data) of every bucket.

    ``judge(rows)`` sees all entries of a bucket and says which ones hold, in
    ascending order, with bytes to send for each of these or None.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(x, width) for x in table.column("data").to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        which, more = judge(np.concatenate(parts))
        holds = np.zeros(ends[-1], bool)
        holds[which] = True
        cuts = np.searchsorted(which, np.concatenate([[0], ends]))
        out = [None if a == b else np.packbits(holds[end - len(p) : end]).tobytes() + (b"" if more is None else packed(more[a:b])) for p, end, a, b in zip(parts, ends, cuts[:-1], cuts[1:], strict=True)]
        answered = pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})
        return answered.filter(answered.column("data").is_valid())

    return asked.groupBy("bucket").applyInArrow(run, REPLY_SCHEMA)


def replied(said: dict[int, bytes], bucket: np.ndarray, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(does each entry hold, bytes sent for those) of entries asked in the order of ``bucket``."""
    holds, more = np.zeros(len(bucket), bool), [np.zeros((0, width), np.uint8)]
    firsts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    for a, b in zip(firsts, np.append(firsts, len(bucket))[1:], strict=True):
        data = said.get(int(bucket[a]))
        if data is None:
            continue
        size = -(-int(b - a) // 8)
        holds[a:b] = np.unpackbits(np.frombuffer(data, np.uint8, size), count=int(b - a)).astype(bool)
        if width:
            more.append(unpacked(data[size:], width))
    return holds, np.concatenate(more)


def answer(chunks: DataFrame, replies: list[DataFrame], use: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``use(chunk, {bucket: data}, ...)`` for every chunk, with what was sent to it in each of ``replies``."""
    tagged, rounds = None, len(replies)
    for k, sent in enumerate(replies):
        own = sent.select(F.lit(k).alias("round"), "chunk", "bucket", "data")
        tagged = own if tagged is None else tagged.unionByName(own)

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        said: list[dict[int, bytes]] = [{} for _ in range(rounds)]
        if got.num_rows:
            for k, bucket, data in zip(*(got.column(c).to_pylist() for c in ("round", "bucket", "data")), strict=True):
                said[k][bucket] = data
        out = pa.concat_tables([use(Chunk(row), *said) for row in own.to_pylist()])
        common.trim()
        return out

    return chunks.groupBy("chunk").cogroup(tagged.groupBy("chunk")).applyInArrow(run, schema)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first place of each run of equal keys in that order)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def sizes(firsts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(firsts, n))
