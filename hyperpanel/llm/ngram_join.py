"""N-gram Jaccard join with token-combination prefixes (operator 2).

Sets of word shingles are joined at a Jaccard threshold above one half:

1. A census counts in how many documents each shingle stands. Shingles are
   ordered from rare to frequent. A set whose shared shingles are too few to
   reach the threshold with any other set is done.
2. Each remaining set extends its prefix in that order until at least one
   signature must be common to any two linked sets. Rare shingles are indexed
   one by one; the frequent ones are split into classes by hash and indexed as
   pairs of a class. With x rare and x_c frequent shingles of class c in a
   prefix, x + sum(max(0, x_c - 1)) must exceed the mismatches that the
   threshold allows. The number of classes grows with the size of the sets, so
   signatures stay in proportion to it; sizes are banded, and a set is indexed
   in its own band and in the next.
3. Equal sets are one class. Classes that share a signature form families; the
   sets of a family are verified exactly, in blocks of bounded size, so no pair
   of classes is ever a row. A family of many blocks, which boilerplate chains
   together, is verified signature by signature instead, where that moves less;
   a pair counts under the smallest signature that it shares.

The result has a row for each document: doc_id, n_shingles, component_id (the
smallest doc_id reachable by links), n_links (rows that the row links with).

Defined results: null and empty texts and texts without words have no shingle
and link with nothing; a text with fewer words than a shingle is one shingle;
rows with equal ids are one document: what one of them links with, all of them
reach; a null ``doc_id`` is returned and links with nothing (its component is null); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import hot_keys, lookup_by
from . import census, common
from .components import connected
from .textstats import LOWER, Words, mix

#: From this document frequency on, shingles are indexed in pairs.
FREQUENT = 64
#: Mismatches for each class of frequent shingles.
CLASS_SPAN = 8
#: Bounds of a block in which sets are verified.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 2_000_000
#: Signatures of more sets are looked up by broadcast: the HOT_SIGNATURES most frequent of these, bounded whatever the data.
LEAST_SHARED, HOT_SIGNATURES = 100, 1000
#: A family of more blocks is verified by signatures, if its sets share fewer signatures on average than it has blocks.
MOST_BLOCKS = 8
SETS = "doc_id long, n_shingles long, k1 long, k2 long, common binary, signatures array<long>"


def shingles(chunk: census.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, in order; A to Z are lowered."""
    words = Words(chunk.offsets, LOWER[chunk.data])
    h = words.hashes()
    at = np.flatnonzero(words.fits(k))
    doc, value = words.doc[at], words.windows(h, k, 5)[at]
    n = np.diff(words.first)
    for short in range(1, k):  # whole sequences of fewer words
        first = words.first[:-1][n == short]
        if len(first):
            doc = np.concatenate([doc, words.doc[first]])
            value = np.concatenate([value, words.windows(h, short, 5)[first] ^ np.uint64(short)])
    order, firsts = census.runs(doc, value)
    return doc[order][firsts], value[order][firsts]


def _needed(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Smallest overlap with which a set of ``n`` can reach ``threshold`` hundredths."""
    return -(-threshold * n // 100)


def signatures(value: np.ndarray, df: np.ndarray, n_alone: int, threshold: int) -> np.ndarray:
    """Index keys of a set whose shared shingles, from rare to frequent, are ``value``; ``n_alone`` stand in no other set."""
    n = len(value) + n_alone
    spare = n - _needed(n, threshold)
    growth = 100 / threshold
    own = int(math.log(n) / math.log(growth) + 1e-9)
    out = []
    often = df >= FREQUENT
    for band in (own, own + 1):
        classes = 1 + int((1 - 1 / growth) * growth**band / CLASS_SPAN)
        group = np.where(often, (value >> np.uint64(20)) % np.uint64(classes), 0).astype(np.int64)
        opens = np.zeros(len(value), bool)
        at = np.flatnonzero(often)
        opens[at[np.unique(group[at], return_index=True)[1]]] = True
        enough = np.searchsorted(n_alone + np.cumsum(~opens), spare + 1) + 1
        prefix, rare = value[:enough], ~often[:enough]
        salt = np.uint64(band * 2 + 1)
        out.append(mix(prefix[rare] ^ mix(salt)))
        for c in np.unique(group[:enough][~rare]):
            members = np.sort(prefix[~rare & (group[:enough] == c)])
            a, b = np.triu_indices(len(members), 1)
            with np.errstate(over="ignore"):
                out.append(mix(mix(members[a] + salt) * np.uint64(0x9E3779B97F4A7C15) + members[b]))
    return np.unique(np.concatenate(out))


def shingle_sets(docs: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """SETS of every document, stored; ``common`` and ``signatures`` are null where no link is possible."""
    chunks, buckets = census.chunk_table(docs, id_col, text_col)

    def count(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = census.Chunk(row)
        doc, value = shingles(chunk, k)
        value = value[~chunk.null[doc]]
        if not len(value):
            return
        bucket, key = census.bucket_of(value, buckets), value & census.KEY_MASK
        order, firsts = census.runs(bucket, key)
        yield census.deal(chunk.id, bucket[order][firsts], census.four_bytes(key[order][firsts], np.minimum(census.sizes(firsts, len(key)), 3)))

    def frequencies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, seen = census.key_and_flags(rows)
        order, firsts = census.runs(key)
        total = np.add.reduceat(seen.astype(np.int64)[order], firsts)
        n = np.zeros(len(key), np.int64)
        n[order] = np.repeat(total, census.sizes(firsts, len(key)))
        which = np.flatnonzero(n > 1)
        return which, np.minimum(n[which], 65_535).astype("<u2").view(np.uint8).reshape(-1, 2)

    counted = common.materialize(census.meet(census.ask(chunks, count), 4, frequencies), "frequencies")

    def index(chunk: census.Chunk, said: dict[int, bytes]) -> pa.Table:
        doc, value = shingles(chunk, k)
        df = np.ones(len(value), np.int64)
        if said and len(value):
            mine = ~chunk.null[doc]
            bucket, key = census.bucket_of(value, buckets), value & census.KEY_MASK
            order, firsts = census.runs(bucket[mine], key[mine])
            holds, often = census.replied(said, bucket[mine][order][firsts], 2)
            found = np.ones(len(firsts), np.int64)
            found[holds] = np.ascontiguousarray(often).view("<u2").reshape(-1)
            own = np.empty(len(order), np.int64)
            own[order] = np.repeat(found, census.sizes(firsts, len(order)))
            df[mine] = own
        total = len(chunk.ids)
        n = np.bincount(doc, minlength=total)
        shared = np.bincount(doc[df > 1], minlength=total)
        able = (n > 0) & (shared >= _needed(n, threshold)) & ~chunk.null
        start = np.concatenate([[0], np.cumsum(n)])
        with np.errstate(over="ignore"):
            k1, k2 = (np.add.reduceat(np.append(mix(value + np.uint64(s)), np.uint64(0)), np.minimum(start[:-1], len(value))).astype(np.int64) for s in (11, 97))
        sets, keys = [None] * total, [None] * total
        for d in np.flatnonzero(able):
            v, f = value[start[d] : start[d + 1]], df[start[d] : start[d + 1]]
            v, f = v[f > 1], f[f > 1]
            order = np.lexsort((v, f))
            sets[d] = v.tobytes()
            keys[d] = signatures(v[order], f[order], int(n[d] - len(v)), threshold).astype(np.int64)
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.null), "n_shingles": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64(), mask=~able), "k2": pa.array(k2, pa.int64(), mask=~able),
            "common": pa.array(sets, pa.binary()), "signatures": pa.array(keys, pa.list_(pa.int64())),
        })

    out = common.materialize(census.answer(chunks, [counted], index, SETS), "sets")
    common.drop_table(docs.sparkSession, chunks)
    common.drop_table(docs.sparkSession, counted)
    return out


def _verify(threshold: int):
    """Links inside a block, or between its two parts: for each class (k1, k2) the number of linked rows, and a spanning forest (a, b) of smallest ids."""

    def run(table: pa.Table) -> pa.Table:
        cid, n, weight, part, k1, k2 = (table.column(c).to_numpy() for c in ("cid", "n_shingles", "n_docs", "part", "k1", "k2"))
        by, shared = table.column("signature")[0].as_py(), None
        if by is not None:
            shared = [np.sort(np.array(x, np.int64)) for x in table.column("shared").to_pylist()]
        sets = [np.frombuffer(x, np.uint64) for x in table.column("common").to_pylist()]
        length = np.array([len(s) for s in sets])
        token, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), length)
        by_token = owner[np.argsort(flat, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(token)))])
        at = np.concatenate([[0], np.cumsum(length)])
        parts = table.column("parts")[0].as_py()
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        a, b = [], []
        for x in range(len(sets)):
            mine = flat[at[x] : at[x + 1]]
            first, sizes = starts[mine], starts[mine + 1] - starts[mine]
            ends = np.cumsum(sizes)
            met = by_token[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])]
            both = np.bincount(met, minlength=len(sets))
            ok = (100 * both >= threshold * (n[x] + n - both)) & (both > 0)
            ok[: x + 1] = False
            if parts == 2:
                ok &= part != part[x]
            found = np.flatnonzero(ok)
            if shared is not None:  # other signatures' groups hold the pair too
                found = np.array([y for y in found if np.intersect1d(shared[x], shared[y], assume_unique=True)[0] == by], np.int64)
            links[x] += weight[found].sum()
            links[found] += weight[x]
            for y in found:
                i, j = x, int(y)
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    root[max(i, j)] = min(i, j)
                    a.append(cid[x])
                    b.append(cid[y])
        some = np.flatnonzero(links)
        tree, none = len(a), len(some)
        columns = {"a": [None] * none + a, "b": [None] * none + b, "k1": [*k1[some], *[None] * tree], "k2": [*k2[some], *[None] * tree], "n": [*links[some], *[0] * tree]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})

    return run


def jaccard_components(docs: DataFrame, *, k: int, threshold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document; ``threshold`` in hundredths, above 50."""
    if not 50 < threshold < 100:
        raise ValueError("threshold must lie between 50 and 100")
    sets = shingle_sets(docs, k, threshold, id_col, text_col)
    able = sets.filter("k1 IS NOT NULL")
    same = able.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("n_docs"))
    classes = common.materialize(able.join(same, ["k1", "k2"]).filter("doc_id = cid").dropDuplicates(["k1", "k2"]).select("k1", "k2", "cid", "n_docs", "n_shingles", "common", "signatures"), "classes")

    keys = classes.select("cid", "k1", "k2", F.explode("signatures").alias("signature"))
    leaders = keys.groupBy("signature").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    leaders = common.materialize(leaders, "leaders")
    hot = [r[0] for r in leaders.filter(F.col("n") > LEAST_SHARED).orderBy(F.desc("n")).limit(HOT_SIGNATURES).select("signature").collect()]
    meetings = common.materialize(lookup_by(keys, "signature", leaders.drop("n"), hot).select("leader", "cid", "k1", "k2", "signature"), "meetings")
    families = connected(meetings.filter("leader <> cid").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct())
    family = classes.join(families.withColumnRenamed("node", "cid"), "cid", "left").withColumn("family", F.coalesce("label", "cid")).drop("label")
    extent = family.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.length("common") / 8).alias("tokens"), F.avg(F.size("signatures")).alias("spread")).filter("sets > 1")
    extent = extent.select("family", "spread", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    extent = common.materialize(extent, "extents")
    wide = (F.col("blocks") > MOST_BLOCKS) & (F.col("spread") < F.col("blocks"))
    columns = ["family", "cid", "k1", "k2", "n_shingles", "n_docs", "common"]
    none = F.lit(None)
    dealt = lookup_by(family.select(*columns), "family", extent.filter(~wide), hot_keys(family, "family")).select(*columns, none.cast("long").alias("signature"), none.cast("array<long>").alias("shared"), "blocks")
    chained = extent.filter(wide).select("family")
    if chained.limit(1).count():
        met = meetings.groupBy("cid", "k1", "k2").agg(F.collect_list("signature").alias("shared"))  # a set's signatures are in proportion to its size
        whole = family.select(*columns).join(F.broadcast(chained), "family", "left_semi").join(met.drop("cid"), ["k1", "k2"]).select("*", F.explode("shared").alias("signature"))  # fewer families than blocks
        sizes = whole.groupBy("signature").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum(F.length("common") / 8) / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        dealt = dealt.unionByName(lookup_by(whole, "signature", sizes, hot).select(*columns, "signature", "shared", "blocks"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j")))
    blocks = dealt.select("*", F.explode(every).alias("ij")).select("*", F.when(F.col("ij.i") == F.col("ij.j"), 1).otherwise(2).alias("parts"))
    found = common.materialize(blocks.groupBy("family", "signature", "ij").applyInArrow(_verify(threshold), "a long, b long, k1 long, k2 long, n long"), "links")

    # ids of several rows join the classes that these are in
    repeated = sets.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    repeated = common.materialize(repeated, "repeated")
    links = found.filter("b IS NOT NULL").select("a", "b")
    some = repeated.limit(1).count() > 0
    if some:
        own = able.join(repeated, "doc_id", "left_semi").select("k1", "k2", F.col("doc_id").alias("b")).distinct()
        links = links.unionByName(own.join(classes.select("k1", "k2", F.col("cid").alias("a")), ["k1", "k2"]).select("a", "b").filter("a <> b"))
    label = connected(links)
    linked = found.filter("b IS NULL").groupBy("k1", "k2").agg(F.sum("n").alias("others"))
    known = (
        classes.select("k1", "k2", "cid", "n_docs")
        .join(label.withColumnRenamed("node", "cid"), "cid", "left")
        .join(linked, ["k1", "k2"], "left")
        .select("k1", "k2", F.coalesce("label", "cid").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("n_docs") - 1).alias("links"))
    )
    # only sets in a class are looked up: all others would meet under null keys
    alone = sets.filter("k1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("links"))
    out = sets.filter("k1 IS NOT NULL").select("doc_id", "n_shingles", "k1", "k2").join(known, ["k1", "k2"], "left").select("doc_id", "n_shingles", "component", "links").unionByName(alone)
    if some:
        of = repeated.join(label.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "label")
        out = lookup_by(out, "doc_id", of, hot_keys(sets, "doc_id"), "left").withColumn("component", F.coalesce("label", "component"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("links").cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2 over all documents: 4-word shingles at 85 hundredths."""
    return jaccard_components(common.read_table(spark, sf_dir, "documents"), k=4, threshold=85)
