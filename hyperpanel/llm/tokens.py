"""Token ids of texts, by a public tokenizer file of the ``tokenizers`` library.

Byte-level BPE cuts a text by a fixed pattern and encodes each piece by itself.
A batch of texts is cut by numpy over its bytes, and only the distinct pieces
are encoded, once per worker, by the library's model. Texts with characters on
whose kind Unicode tables may differ, and texts that hold an added token of the
file (such as its end mark), go to the library as a whole; all ways give the
ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Pieces kept per worker (some 200 bytes each); above it, or above MOST_BYTES of pieces, the table starts anew, which bounds memory.
MOST_UNITS = 800_000
MOST_BYTES = 32 << 20
#: Bytes of a piece that is kept, at most.
LONG = 64
#: Bytes and rows of texts that are cut together.
AT_ONCE, ROWS_AT_ONCE = 4 << 20, 4096

# The pattern by which byte-level BPE cuts texts, in kinds of bytes:
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_LETTER, _NUMBER, _MARK, _WHITE, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x30, 0x3A)]] = _NUMBER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
#: Two-byte letters of U+00C0 to U+023F, on which all Unicode tables agree, and what continues them; two of these characters are marks.
_KIND[0xC3:0xC9] = _LETTER
_KIND[0x80:0xC0] = _LETTER
_SIGNS = (0x97, 0xB7)


def byte_letters() -> str:
    """The letter of every byte in a byte-level vocabulary: visible Latin-1 bytes stand for themselves, the rest follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of every byte."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    kind[lead[np.isin(data[lead + 1], _SIGNS)]] = _ODD
    return kind


def pieces(offsets: np.ndarray, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """First byte of every piece of texts without odd bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    opens = opens[:n]
    white = kind == _WHITE
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) & ~((data[:-1] == 32) & ~white[1:])  # a space belongs to what follows it
    new[:-1] |= white[:-1] & ~white[1:] & ~opens[1:]  # the last white one before something stands apart from those before it
    new |= opens
    mark = np.flatnonzero(new & (data == 39))  # an apostrophe that opens a piece may be a short form
    if len(mark):
        end = offsets[np.searchsorted(offsets, mark, "right")]
        at = lambda k: np.where(mark + k < end, data[np.minimum(mark + k, n - 1)], 0)
        a, b = at(1), at(2)
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        new[mark[two | three] + 1] = False
        after = np.concatenate([mark[two] + 2, mark[three] + 3])
        new[after[after < n]] = True
    return np.flatnonzero(new)


class UnitTable:
    """Ids of the pieces met so far, as one array with the start of each piece."""

    def __init__(self, path: str, most: int = MOST_UNITS):
        from tokenizers import Tokenizer

        self.most = most
        self.library = Tokenizer.from_file(path)
        pre = str(self.library.pre_tokenizer)
        self.by_piece = pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and self.library.normalizer is None
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, new: list[bytes]) -> np.ndarray:
        """Places of new pieces; long ones are not looked up again."""
        tokenize, base = self.library.model.tokenize, len(self.starts) - 1
        spelt = b"\0".join(new).decode("latin-1").translate(self.letters).split(self.letters[0])  # no piece holds a zero byte
        flat = [array("I", [t.id for t in tokenize(p)]) for p in spelt]
        self.index.update((p, base + k) for k, p in enumerate(new) if len(p) <= LONG)
        self.held += sum(map(len, new))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(flat), np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))])
        return base + np.arange(len(new))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start of each text and the end) of a string column; null is empty."""
        if column.null_count:
            column = column.fill_null("")
        if not self.by_piece:
            return _joined([self.whole(t) for t in column.to_pylist()])
        if len(self.starts) > self.most or len(self.ids) > 8 * self.most or self.held > MOST_BYTES:
            self.clear()
        apart = np.zeros(len(column), bool)
        for token in self.added:
            apart |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        offsets, data = common.utf8_buffers(column)
        kind = kinds(data)
        odd = np.flatnonzero(kind == _ODD)
        apart[np.searchsorted(offsets, odd, "right") - 1] = True
        texts = {}
        if apart.any():
            texts = {int(k): self.whole(column[int(k)].as_py()) for k in np.flatnonzero(apart)}
            offsets, data = common.utf8_buffers(pc.if_else(pa.array(apart), "", column))
            kind = kinds(data)
        at = pieces(offsets, data, kind)
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(cut)
        known = coded.dictionary.to_pylist()
        get = self.index.get
        place = np.fromiter((get(p, -1) for p in known), np.int64, len(known))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self.learn([known[k] for k in new])
        place = place[coded.indices.to_numpy()]
        first = self.starts[place]
        lengths = self.starts[place + 1] - first
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        if texts:
            return _joined([texts.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(column))])
        return ids, bounds


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *arrays]), np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)


@functools.lru_cache(maxsize=2)
def unit_table(path: str, most: int = MOST_UNITS) -> UnitTable:
    """One table per worker process and tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return UnitTable(path, most)


def encode_column(path: str, column: pa.Array, end_id: int, most: int = MOST_UNITS) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (row, ids with the end id) of a string column; a text that stands in it several times is encoded once."""
    table = unit_table(path, most)
    column = column.fill_null("")
    code = pc.dictionary_encode(column).indices.to_numpy()
    first = np.zeros(len(code), bool)
    first[np.unique(code, return_index=True)[1]] = True
    again = np.bincount(code) > 1 if len(code) else first
    sizes = np.concatenate([[0], np.cumsum(np.where(first, pc.binary_length(column).to_numpy(), 0))])
    kept: dict[int, np.ndarray] = {}
    start = 0
    while start < len(column):
        stop = max(start + 1, min(start + ROWS_AT_ONCE, int(np.searchsorted(sizes, sizes[start] + AT_ONCE, "right")) - 1))
        rows = np.arange(start, min(stop, len(column)))
        ids, bounds = table.encode(column.take(pa.array(rows[first[rows]])))
        k = 0
        for row in rows:
            if first[row]:
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                k += 1
                if again[code[row]]:
                    kept[code[row]] = own
            else:
                own = kept[code[row]]
            yield int(row), own
        start = stop


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public tokenizer file; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)
