"""Token files and packing: exact round trips against the library."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hyperpanel.llm import common, packing, token_files
from hyperpanel.llm.tokens import public_vocabulary, unit_table


def key(i):
    return (-1 if i is None else i)


@pytest.fixture(scope="module")
def encoded(corpus):
    library = unit_table(public_vocabulary()).library
    return [(i, t, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in corpus]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ,.\n\t\r'sS1é \u0085 中<|>"), max_size=24), min_size=1, max_size=4))
def test_units_equal_the_library(texts):
    table = unit_table(public_vocabulary())
    ids, at = table.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == table.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [5], [7] * 500, list(range(1000)), [0, 2**32 - 1] * 200, [3, 3, 3, 90_000] * 64])
def test_blocks_round_trip(ids, tmp_path):
    writer = token_files.ShardWriter()
    body = writer.head() + writer.add(4, np.array(ids[: len(ids) // 2], np.uint32)) + writer.add(None, np.array(ids[len(ids) // 2 :], np.uint32)) + writer.close()
    (tmp_path / "s").write_bytes(body)
    with (tmp_path / "s").open("rb") as f:
        shard = token_files.ShardReader(f)
        assert shard.ids(0, len(ids)).tolist() == ids and shard.null.tolist() == [False, True]
        assert shard.ids(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 : len(ids) // 2]
        assert [x.tolist() for _, x in shard.documents(10)] == [ids[: len(ids) // 2], ids[len(ids) // 2 :]]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(request, spark, which, encoded):
    docs = request.getfixturevalue(which)
    manifest = token_files.write_token_files(docs, public_vocabulary(), common.new_path(spark, "t"), end_id=2)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = sorted(encoded, key=lambda r: (key(r[0]), r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _, _ in want]
    start = 0
    for r, (_, _, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens) == (start, len(ids) + 1) and np.frombuffer(r.ids, "<u4").tolist() == [*ids, 2]
        start += r.n_tokens


def test_packing(docs, encoded):
    pieces = packing.pack(docs, public_vocabulary(), end_id=1, length=64, group_docs=16).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 0 < p.length <= 64
        whole[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert sum(p.length for p in pieces) == sum(len(ids) + 1 for _, _, ids in encoded)
    for i, _, ids in encoded:
        if sum(e[0] == i for e in encoded) == 1:
            parts = sorted(whole[i], key=lambda p: p.start)
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == [*ids, 1] and all(p.doc_tokens == len(ids) + 1 for p in parts)
    fill = sum(p.length for p in pieces) / (64 * len(sequences))
    assert fill > 0.9


def test_first_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300)
    bins, at = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for k in sorted(range(300), key=lambda k: -lengths[k]):
        b = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
        if b == len(room):
            room.append(100)
        assert (bins[k], at[k]) == (b, 100 - room[b])
        room[b] -= lengths[k]


def test_empty_tables(spark, none):
    manifest = token_files.write_token_files(none, public_vocabulary(), common.new_path(spark, "t"), end_id=2)
    assert token_files.read_token_files(manifest).count() == 0
    assert packing.digest(packing.pack(none, public_vocabulary(), end_id=1)).count() == 0


def test_digest_is_of_little_endian_ids(docs, encoded):
    rows = packing.digest(packing.pack(docs, public_vocabulary(), end_id=1)).filter("doc_id = 203").collect()
    ids = next(ids for i, _, ids in encoded if i == 203)
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array([*ids, 1], "<u4").tobytes())]
