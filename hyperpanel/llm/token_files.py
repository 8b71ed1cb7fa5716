"""Token-id files: patched frame-of-reference blocks (operator 1).

A shard file holds the ids of consecutive documents as one stream, cut into
blocks of 128 values. A block stores its minimum, packs ``value - minimum`` at
the width that a percentile of the block's values needs, and keeps what is wider
in an exception list. Layout, all little-endian::

    magic "PFR1" | u32 block size | blocks | footer | u64 footer start | magic
    block  : packed bits | exception positions (u8) | exception values (u32)
    footer : u64 n_ids, u64 n_docs, u64 n_blocks
             | block starts (u64) | block minima (u32) | widths (u8) | exception counts (u8)
             | doc ids (i64) | doc id is null (u8) | doc lengths (u64)

The index of block starts lets a reader seek to any id. Documents are dealt out
by ranges of ``doc_id``; shards are numbered in that order, so a shard's first
global id is the number of ids in all shards before it. The number of shards
follows from the bytes and rows of all texts, so a shard and its indexes stay
bounded; equal ids are cut apart by the start of their texts, equal rows by the
partition that they come from.

Defined results: null text is empty and holds the end id alone; a null
``doc_id`` is kept and comes first; equal ids stand in the order of their
texts; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encode_column

MAGIC = b"PFR1"
BLOCK = 128
#: Share of a block's values that its packed width must hold; the rest are exceptions.
PERCENTILE = 0.9
#: Ids that a writer gathers before it packs them.
AT_ONCE = BLOCK * 2048
#: A shard holds about so many bytes of text and so many documents, at most; smaller inputs get as many shards as shuffles have partitions, but none for less than LEAST_BYTES.
SHARD_BYTES, SHARD_DOCS, LEAST_BYTES = 256 << 20, 2_000_000, 4 << 20
#: Characters of a text that part equal ids.
PREFIX = 32


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(block bytes, minima, widths, exception counts); a short last block is filled with its last id."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return [], np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    rows = np.pad(ids.astype(np.uint32), (0, count * BLOCK - len(ids)), "edge").reshape(count, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    need = _widths(rest)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(need, at, axis=1)[:, at]
    odd = need > width[:, None]
    packed = np.where(odd, 0, rest)
    parts: list[bytes] = [b""] * count
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            unit = np.dtype("<u2" if w <= 16 else "<u4")
            bits = np.unpackbits(packed[which].astype(unit).view(np.uint8).reshape(len(which), BLOCK, unit.itemsize), axis=2, count=int(w), bitorder="little")
            raw = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
            for k, row in zip(which, raw, strict=True):
                parts[k] = row.tobytes()
    odds = odd.sum(axis=1)
    where, values = np.nonzero(odd)[1].astype(np.uint8).tobytes(), rest[odd].astype("<u4").tobytes()
    ends = np.cumsum(odds).tolist()
    for k in np.flatnonzero(odds):
        first, last = ends[k] - int(odds[k]), ends[k]
        parts[k] += where[first:last] + values[4 * first : 4 * last]
    odds = odds.astype(np.uint8)
    return parts, low, width, odds


class ShardWriter:
    """Streams documents into one shard; holds AT_ONCE ids and the indexes."""

    def __init__(self) -> None:
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.at = len(MAGIC) + 4
        self.index: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[int, bool, int]] = []

    def head(self) -> bytes:
        return MAGIC + struct.pack("<I", BLOCK)

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        return self._flush(self.waiting // BLOCK * BLOCK) if self.waiting >= AT_ONCE else b""

    def _flush(self, upto: int) -> bytes:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.pending])
        parts, low, width, odds = pack_blocks(ids[:upto])
        self.pending, self.waiting = [ids[upto:]], len(ids) - upto
        sizes = np.fromiter(map(len, parts), np.uint64, len(parts))
        self.index.append((self.at + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(parts) else sizes, low, width, odds))
        self.at += int(sizes.sum())
        return b"".join(parts)

    def close(self) -> bytes:
        body = self._flush(self.waiting)
        starts, low, width, odds = (np.concatenate(x) for x in zip(*self.index, strict=True))
        doc_ids, null, lengths = (np.array(x) for x in zip(*self.docs, strict=True)) if self.docs else (np.zeros(0),) * 3
        foot = struct.pack("<QQQ", self.n_ids, len(self.docs), len(starts))
        for column, kind in ((starts, "<u8"), (low, "<u4"), (width, "u1"), (odds, "u1"), (doc_ids, "<i8"), (null, "u1"), (lengths, "<u8")):
            foot += column.astype(kind).tobytes()
        return body + foot + struct.pack("<Q", self.at) + MAGIC


class ShardReader:
    """Random access to the ids of a shard, through any seekable binary file."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 12)
        tail = file.read(12)
        start = struct.unpack("<Q", tail[:8])[0]
        file.seek(0)
        if tail[8:] != MAGIC or file.read(8) != MAGIC + struct.pack("<I", BLOCK):
            raise ValueError("not a PFR1 shard")
        file.seek(start)
        foot = file.read(size - 12 - start)
        self.n_ids, n_docs, n_blocks = struct.unpack("<QQQ", foot[:24])
        at = 24

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(foot, kind, n, at)
            at += out.nbytes
            return out

        self.starts, self.low, self.width, self.odds = column("<u8", n_blocks), column("<u4", n_blocks), column("u1", n_blocks), column("u1", n_blocks)
        self.doc_ids, self.null, self.lengths = column("<i8", n_docs), column("u1", n_docs).astype(bool), column("<u8", n_docs).astype(np.int64)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.end = start

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last - 1``."""
        if first >= last:
            return np.zeros(0, np.uint32)
        begin, end = int(self.starts[first]), int(self.starts[last]) if last < len(self.starts) else self.end
        self.file.seek(begin)
        raw = np.frombuffer(self.file.read(end - begin), np.uint8)
        out = np.zeros((last - first, BLOCK), np.uint32)
        width, at = self.width[first:last], self.starts[first:last].astype(np.int64) - begin
        for w in np.unique(width):
            which = np.flatnonzero(width == w)
            if w:
                span = np.arange(BLOCK * int(w) // 8)
                bits = np.unpackbits(raw[at[which][:, None] + span], axis=1, bitorder="little").reshape(len(which), BLOCK, w)
                unit = np.dtype("<u2" if w <= 16 else "<u4")
                full = np.zeros((len(which), BLOCK, 8 * unit.itemsize), np.uint8)
                full[:, :, :w] = bits
                out[which] = np.packbits(full, axis=2, bitorder="little").reshape(-1).view(unit).reshape(len(which), BLOCK)
        for k in np.flatnonzero(self.odds[first:last]):
            n, where = int(self.odds[first + k]), int(at[k]) + BLOCK * int(width[k]) // 8
            out[k, raw[where : where + n]] = raw[where + n : where + 5 * n].copy().view("<u4")
        return (out + self.low[first:last, None]).reshape(-1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop - 1`` of the shard."""
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray]]:
        """(number in the shard, ids) of every document, decoding about ``at_once`` ids at a time."""
        k = 0
        while k < len(self.lengths):
            stop = max(k + 1, int(np.searchsorted(self.doc_starts, self.doc_starts[k] + at_once, "right")) - 1)
            ids = self.ids(int(self.doc_starts[k]), int(self.doc_starts[stop]))
            for d in range(k, stop):
                yield d, ids[self.doc_starts[d] - self.doc_starts[k] : self.doc_starts[d + 1] - self.doc_starts[k]]
            k = stop


def write_token_files(docs: DataFrame, tokenizer: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``path`` (a shared store) and return their manifest.

    One row a shard: shard (its number), path, n_docs, n_ids, first_id (ids in
    all shards before it), n_bytes. Every attempt of a task writes a file of its
    own and only that of the attempt which Spark accepts enters the manifest, so
    lost executors and repeated tasks do no harm.
    """
    spark = docs.sparkSession
    rows = common.id_and_text(docs, id_col, text_col)
    n_docs, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes or 0) // LEAST_BYTES))
    count = max(1, spread, -(-(n_bytes or 0) // SHARD_BYTES), -(-n_docs // SHARD_DOCS))
    rows = rows.repartitionByRange(count, "doc_id", F.substring("text", 1, PREFIX), F.spark_partition_id()).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, n_bytes = TaskContext.get().partitionId(), ShardWriter(), 0
        uri = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.pfr"

        def parts() -> Iterator[bytes]:
            yield writer.head()
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for k, ids in encode_column(tokenizer, batch.column(1), end_id):
                    if part := writer.add(doc_ids[k], ids):
                        yield part
                common.trim()
            yield writer.close()

        n_bytes = common.write_file(uri, parts())
        if writer.docs:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": uri, "n_docs": len(writer.docs), "n_ids": writer.n_ids, "n_bytes": n_bytes}])

    schema = "shard long, path string, n_docs long, n_ids long, n_bytes long"
    shards = sorted(rows.mapInArrow(write, schema).collect())  # a row a shard file, not a document
    out, first = [], 0
    for s in shards:
        out.append((*s, first))
        first += s.n_ids
    return spark.createDataFrame(out, f"{schema}, first_id long").repartition(max(1, len(out)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (global), n_tokens, ids (binary: little-endian unsigned 32-bit), read from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = common.open_store(row["path"])
                with store.open_input_file(path) as file:
                    shard = ShardReader(file)
                    held: list[tuple] = []
                    size = 0
                    for d, ids in shard.documents():
                        held.append((None if shard.null[d] else int(shard.doc_ids[d]), row["first_id"] + int(shard.doc_starts[d]), len(ids), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size >= AT_ONCE:
                            yield _columns(held)
                            held, size = [], 0
                    if held:
                        yield _columns(held)

    return manifest.select("path", "first_id").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1 over all documents: the digest of what the shard files hold."""
    from .tokens import public_vocabulary

    manifest = write_token_files(common.read_table(spark, sf_dir, "documents"), public_vocabulary(), common.new_path(spark, "tokens"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
