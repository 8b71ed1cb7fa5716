"""Sequence packing: first-fit decreasing in randomised groups (operator 7).

Every document is encoded with its end id and cut into full sequences and one
shorter rest. Pieces are dealt at random (a keyed hash) into groups; each group
packs its rests by first-fit decreasing on its own, finding the first bin with
room in a tournament tree of bin capacities (each inner node holds the larger of
its children), so a piece costs O(log bins). Full sequences stand alone.

Groups are independent and bounded, whatever the size of the corpus: their
number follows from the rows (about ``group_docs`` rests a group) and from the
bytes of all texts (at most about 4 KB of text for each of these), the full
sequences of a long document are dealt one by one, and equal rows by their
partition and their number there. The only shuffle moves each id once, into its
sequence. A sequence's id is the group's number times 2^32 plus its number there.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` is
kept; repeated rows are packed each by itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import MOST_UNITS, encode_column

LENGTH = 2048
GROUP_DOCS = 1024
#: Bytes of text for each rest of a group, on average, at most.
DOC_BYTES = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Tournament tree over the free room of bins; finds the first bin with enough."""

    def __init__(self, bins: int, room: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.best = [room] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room before) of the first bin with ``need`` free; takes it."""
        node, best = 1, self.best
        while node < self.size:
            node *= 2
            if best[node] < need:
                node += 1
        room = best[node]
        best[node] = room - need
        bin_ = node - self.size
        node //= 2
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
            node //= 2
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; longer ones first, ties in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = CapacityTree(len(lengths), room)
    for k in np.argsort(-lengths, kind="stable"):
        bins[k], free = tree.place(int(lengths[k]))
        offsets[k] = room - free
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", most_units: int = MOST_UNITS) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset there (``PIECES``); ``most_units`` bounds the encoder's table in each worker."""
    rows = common.id_and_text(docs, id_col, text_col)
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n_rows // group_docs), -(-(n_bytes or 0) // (group_docs * DOC_BYTES)))
    kinds = {"doc_id": pa.int64(), "grp": pa.int64(), "start": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seen = TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for batch in common.row_slices(whole, 1, 8 << 20):
                doc_ids = batch.column(0).to_pylist()
                out: list[tuple] = []
                for k, ids in encode_column(tokenizer, batch.column(1), end_id, most=most_units):
                    raw = ids.astype("<u4").tobytes()
                    row = zlib.crc32(raw, zlib.crc32(f"{seed} {partition} {doc_ids[k]}".encode()))
                    seen[row] += 1
                    for start in range(0, len(ids), length):
                        mixed = zlib.crc32(f"{seen[row]} {start}".encode(), row)
                        out.append((doc_ids[k], mixed % groups, start, len(ids), raw[4 * start : 4 * (start + length)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def sequences(key: tuple, table: pa.Table) -> pa.Table:
        doc, null = common.long_buffers(table.column("doc_id").combine_chunks())
        crc = np.fromiter((zlib.crc32(x.as_buffer()) for x in table.column("ids")), np.int64, table.num_rows)
        start = table.column("start").to_numpy()
        order = np.lexsort((crc, start, doc, null))
        size = pc.binary_length(table.column("ids")).to_numpy().astype(np.int64)[order] // 4
        rest = size < length
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        sequence[rest], offset[rest] = first_fit_decreasing(size[rest], length)
        sequence[~rest] = (sequence[rest].max(initial=-1) + 1) + np.arange(int((~rest).sum()))
        table = table.take(pa.array(order))
        columns = {"length": size, "sequence_id": sequence + (key[0].as_py() << 32), "offset": offset}
        found = {c: table.column(c) for c in ("doc_id", "start", "doc_tokens", "ids")} | {c: pa.array(v, pa.int64()) for c, v in columns.items()}
        return pa.table({c.split()[0]: found[c.split()[0]] for c in PIECES.split(", ")})

    return rows.mapInArrow(encode, "doc_id long, grp long, start long, doc_tokens long, ids binary").groupBy("grp").applyInArrow(sequences, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7 over all documents."""
    from .tokens import public_vocabulary

    return digest(pack(common.read_table(spark, sf_dir, "documents"), public_vocabulary(), end_id=1))
