"""Chunks and buckets grow with the text."""

import pytest

from hyperpanel.llm import census


@pytest.mark.parametrize("n_bytes", [0, 1, 10**6, 10**8, 3 * 10**10, 10**12, 10**14])
def test_extents(n_bytes):
    chunk, buckets = census.extents(n_bytes)
    assert census.CHUNK_BYTES <= chunk <= census.MOST_CHUNK_BYTES and buckets >= 1
    assert n_bytes / census.ENTRY_BYTES / buckets <= census.MOST_BUCKET_ENTRIES * 1.5  # what a bucket holds
    assert n_bytes / chunk <= 2 * census.MOST_BUCKET_ENTRIES  # entries of an item that every chunk has
    if n_bytes <= 10**12:
        assert chunk / census.ENTRY_BYTES / buckets >= min(16, chunk / census.ENTRY_BYTES)  # entries of a row
