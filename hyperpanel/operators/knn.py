"""Nearest-neighbour graphs and range joins of points.

``knn`` and ``radius`` are exact. For ``knn`` points lie in files of blocks, which every
task reads one after the other and merges what it finds, so no task holds more than
a block and its own rows, and the driver none. ``radius`` ranks against a broadcast
matrix up to a checked bound, beyond it by pairs of blocks. ``lsh_knn``
finds candidates by random projections, as many as a stated recall needs on the
points at hand, and ranks these exactly; at very large sizes it is the one to use.

Ties are broken by the smaller id, and a point is never its own neighbour.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import METRICS
from ..sources import files

SCHEMA = "i long, j long, rk int, d2 double"
#: Cells (points x dimensions) that are broadcast, at most: 64 MB of doubles.
MOST_CELLS = 8_000_000
BLOCK_CELLS = 2_000_000
#: Cells of a distance matrix that a task holds.
TILE = 1 << 22
#: Pairs that a task returns at once.
PAIRS = 1 << 20
#: Pairs of an L1 tile: few enough for a core's cache.
L1_ROWS, L1_COLUMNS = 40, 256
#: Points whose exact neighbours decide how many cells ``lsh_knn`` asks.
SAMPLE = 256


def _distances(a: np.ndarray, b: np.ndarray, metric: str, squares: np.ndarray | None = None) -> np.ndarray:
    """Of rows to rows, fast; sums of squares of ``b`` may be given."""
    if metric == "l1":
        return _l1(a, b.T)
    d2 = a @ b.T
    d2 *= -2
    d2 += (a * a).sum(1)[:, None]
    d2 += (b * b).sum(1) if squares is None else squares
    np.maximum(d2, 0, out=d2)
    return d2 if metric == "l2sq" else np.sqrt(d2, out=d2)


def _l1(a: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of rows of ``a`` and columns of ``bt``, in tiles that fit a core's cache: twice the larger ones, less both sums."""
    out = np.empty((len(a), bt.shape[1]), a.dtype)
    sums = a.sum(1)
    for t in range(0, bt.shape[1], L1_COLUMNS):
        y = np.ascontiguousarray(bt[:, t : t + L1_COLUMNS])
        below = y.sum(0)
        for s in range(0, len(a), L1_ROWS):
            x = np.ascontiguousarray(a[s : s + L1_ROWS].T)
            total = np.zeros((x.shape[1], y.shape[1]), a.dtype)
            larger = np.empty_like(total)
            for d in range(len(y)):
                total += np.maximum(x[d][:, None], y[d], out=larger)
            total *= 2
            total -= sums[s : s + L1_ROWS, None]
            total -= below
            out[s : s + L1_ROWS, t : t + L1_COLUMNS] = np.maximum(total, 0, out=total)
    return out


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to rows, without cancellation."""
    gap = a - b
    if metric == "l1":
        return np.abs(gap).sum(-1)
    d2 = (gap * gap).sum(-1)
    return d2 if metric == "l2sq" else np.sqrt(d2)


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to rows; those that are small for a product of matrices to give are summed by gaps."""
    if metric == "l1":
        return _distances(a, b, metric)
    d = _distances(a, b, "l2sq")
    near = np.nonzero(d <= 1e-6 * ((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0)))
    for s in range(0, len(near[0]), 1 << 14):
        i, j = (v[s : s + (1 << 14)] for v in near)
        d[i, j] = _exact(a[i], b[j], "l2sq")
    return d if metric == "l2sq" else np.sqrt(d, out=d)


def _nearest(ids: np.ndarray, a: np.ndarray, all_ids: np.ndarray, b: np.ndarray, k: int, metric: str, names: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, rank, distance) of the k nearest of ``b`` for rows of ``a``, which go by ``names`` if given; approximate distances choose 2k + 8, exact ones rank.

    Where the k-th is not nearer than what was left out by more than the error of
    an approximate distance (copies, near ties), all that may be as near are ranked.
    """
    m = min(len(b), 2 * k + 8)
    step = max(1, min(TILE // max(1, len(b)), 4 * TILE // max(1, m * b.shape[1])))
    if not (len(a) and m):
        return
    sizes = [np.abs(v).sum(1).max(initial=0.0) for v in (a, b)] if metric == "l1" else [(v * v).sum(1).max(initial=0.0) for v in (a, b)]
    single = metric == "l1" and sum(sizes) < 1e30  # halves the time; its error is allowed for
    doubt = 2 * (b.shape[1] + 4) * float(np.finfo(np.float32 if single else np.float64).eps) * float(sum(sizes))
    squares = None if metric == "l1" else (b * b).sum(1)
    bt = np.ascontiguousarray(b.T, np.float32 if single else float) if metric == "l1" else None
    for s in range(0, len(a), step):
        own, x = ids[s : s + step], a[s : s + step]
        d = _l1(x.astype(bt.dtype), bt) if bt is not None else _distances(x, b, "l2sq", squares)
        d[own[:, None] == all_ids[None]] = np.inf
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(b) else np.broadcast_to(np.arange(len(b)), d.shape)
        chosen = np.take_along_axis(d, near, axis=1)
        exact = _exact(x[:, None, :], b[near], metric)
        exact[np.isinf(chosen)] = np.inf
        order = np.lexsort((all_ids[near], exact), axis=1)[:, :k]
        dist, j = np.take_along_axis(exact, order, axis=1), all_ids[np.take_along_axis(near, order, axis=1)]
        if m < len(b):
            reach = dist[:, -1] ** 2 if metric == "l2" else dist[:, -1]
            for r in np.flatnonzero(reach + 2 * doubt >= chosen.max(1)):
                every = np.flatnonzero((d[r] <= reach[r] + 2 * doubt) & np.isfinite(d[r]))
                exactly = _exact(x[r], b[every], metric)
                best = np.lexsort((all_ids[every], exactly))[:k]
                dist[r, : len(best)], j[r, : len(best)] = exactly[best], all_ids[every[best]]
        ok = np.isfinite(dist)
        rank = np.broadcast_to(np.arange(1, dist.shape[1] + 1), dist.shape)
        yield np.repeat(own if names is None else names[s : s + step], ok.sum(1)), j[ok], rank[ok], dist[ok]


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "features") -> np.ndarray:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def _rows(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for i, j, rank, d in parts:
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(rank.astype(np.int32)), pa.array(d)], names=["i", "j", "rk", "d2"])


def size_of(points: DataFrame) -> tuple[int, int]:
    row = points.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    return row[0], row[1] or 0


def fetched(points: DataFrame) -> pa.Table | None:
    """id and features of all points, if they have at most MOST_CELLS cells; the driver never holds more than that and one row."""
    first = points.limit(1).select(F.size("features")).first()
    most = MOST_CELLS // max(1, first[0] if first else 1)
    table = points.limit(most + 1).toArrow()
    return table if table.num_rows <= most else None


def knn(points: DataFrame, k: int, metric: str = "l2sq", method: str = "auto") -> DataFrame:
    """SCHEMA: the ``k`` nearest of every point (id, features); ``d2`` is the distance of the metric.

    method: 'broadcast', 'blocks' (pairs of blocks by a shuffle), 'sql' (one join, for
    small data and tests) or 'auto': tasks rank their points against files of blocks
    in the shared folder, one after the other, and the driver holds no points.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    points = points.select("id", "features")
    if method == "sql":
        a, b = points.select(F.col("id").alias("i"), F.col("features").alias("fa")), points.select(F.col("id").alias("j"), F.col("features").alias("fb"))
        pairs = a.join(b, F.col("i") != F.col("j")).select("i", "j", METRICS[metric](F.col("fa"), F.col("fb")).alias("d2"))
        return ranked(pairs, k)
    if method == "auto":
        return _by_files(points, k, metric)
    if method == "blocks":
        n, width = size_of(points)
        return _by_blocks(points, k, metric, max(1, -(-n * width // BLOCK_CELLS)))
    table = points.toArrow()
    matrix = points.sparkSession.sparkContext.broadcast((table.column("id").to_numpy(), _matrix(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, b = matrix.value
        for batch in batches:
            if batch.num_rows:
                yield from _rows(_nearest(batch.column("id").to_numpy(), _matrix(batch), ids, b, k, metric))

    return points.mapInArrow(run, SCHEMA)


def stored_blocks(points: DataFrame) -> list[tuple[str, int, int]]:
    """(file, points, width) of blocks of ids and features in the shared folder, of at most BLOCK_CELLS cells or one point."""
    path = files.folder(points.sparkSession, "points")

    def write(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, x = (np.concatenate(v) for v in zip(*held, strict=True))
        file = f"{path}/{uuid.uuid4().hex}"
        store, at = files.located(file)
        with store.open_output_stream(at) as f:
            f.write(np.ascontiguousarray(ids).tobytes())
            f.write(np.ascontiguousarray(x).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (file, len(ids), x.shape[1])], names=["file", "n", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), _matrix(batch)
            step = max(1, BLOCK_CELLS // max(1, x.shape[1]))
            for s in range(0, len(ids), step):
                part = (ids[s : s + step], x[s : s + step])
                if held and (sum(v.size for _, v in held) + part[1].size > BLOCK_CELLS or held[0][1].shape[1] != x.shape[1]):
                    yield write(held)
                    held = []
                held.append(part)
        if held:
            yield write(held)

    rows = points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    return sorted(tuple(r) for r in rows.mapInArrow(run, "file string, n long, width long").collect())


def read_block(file: str, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    store, at = files.located(file)
    with store.open_input_file(at) as f:
        data = f.read()
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, float, n * width, n * 8).reshape(n, width)


def _by_files(points: DataFrame, k: int, metric: str) -> DataFrame:
    """The nearest of each block, merged after each, for as many points as a task reads at once."""
    blocks = stored_blocks(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column("id").to_numpy(), _matrix(batch)
            if len(blocks) == 1:
                yield from _rows(_nearest(own, x, *read_block(*blocks[0]), k, metric))
                continue
            best, place = None, np.arange(len(own))
            for block in blocks:
                parts = list(_nearest(own, x, *read_block(*block), k, metric, place))
                if not parts:
                    continue
                found = [np.concatenate(v) for v in zip(*parts, strict=True)]
                i, j, _, d = found if best is None else (np.concatenate(v) for v in zip(best, found, strict=True))
                order = np.lexsort((j, d, i))
                i = i[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                near = rank <= k
                best = i[near], j[order][near], rank[near], d[order][near]
            if best is not None:
                yield from _rows([(own[best[0]], *best[1:])])

    return points.mapInArrow(run, SCHEMA)


def _by_blocks(points: DataFrame, k: int, metric: str, blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = points.select("id", "features", block.alias("own"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = dealt.select("id", "features", "own", others.alias("other"), F.lit(True).alias("asks"))
    asked = dealt.select("id", "features", others.alias("own"), F.col("own").alias("other"), F.lit(False).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = table.column("id").to_numpy(), _matrix(table)
        return pa.Table.from_batches([_EMPTY, *_rows(_nearest(ids[asks], x[asks], ids[~asks], x[~asks], k, metric))])

    return ranked(asking.unionByName(asked).groupBy("own", "other").applyInArrow(run, SCHEMA), k)


_EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.float64())], names=["i", "j", "rk", "d2"])


def ranked(pairs: DataFrame, k: int, order: str = "d2") -> DataFrame:
    """The first ``k`` of every i, numbered."""
    near = Window.partitionBy("i").orderBy(order, "j")
    return pairs.withColumn("rk", F.row_number().over(near)).filter(F.col("rk") <= k).select("i", "j", "rk", "d2")


def _flips(side: np.ndarray, bits: int) -> np.ndarray:
    """For rows of ``side`` (row, table, bit: distances to the planes), table << bits | planes to cross, nearest cells first; own cells lead."""
    crossed = np.arange(1 << bits)[:, None] >> np.arange(bits) & 1
    far = np.abs(side) @ crossed.T
    return np.argsort(far.reshape(len(side), -1), axis=1, kind="stable")


def _cells(side: np.ndarray, bits: int) -> np.ndarray:
    """table << bits | cell of every row and table."""
    return ((side > 0) << np.arange(bits)).sum(2) + (np.arange(side.shape[1]) << bits)


def probes_needed(points: DataFrame, k: int, directions: np.ndarray, tables: int, bits: int, recall: float) -> int:
    """Cells that a point has to ask for ``recall`` of its ``k`` nearest: exact neighbours of SAMPLE points decide, less two standard errors."""
    most = tables << bits
    total = points.count()
    sample = points.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return tables
    ids, x = sample.column("id").to_numpy(), _matrix(sample)
    asked = points.sparkSession.sparkContext.broadcast((ids, x))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, a = asked.value
        for batch in batches:
            if batch.num_rows:
                b = _matrix(batch)
                cells = _cells((b @ directions).reshape(len(b), tables, bits), bits)
                place = {v: p for p, v in enumerate(batch.column("id").to_pylist())}
                for i, j, rank, d in _nearest(own, a, batch.column("id").to_numpy(), b, k, "l2sq"):
                    at = cells[[place[v] for v in j.tolist()]] if len(j) else cells[:0]
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(rank.astype(np.int32)), pa.array(d), pa.array(list(at), pa.list_(pa.int64()))], names=["i", "j", "rk", "d2", "cells"])

    best = Window.partitionBy("i").orderBy("d2", "j")
    found = points.select("id", "features").mapInArrow(near, SCHEMA + ", cells array<long>").withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k).select("i", "cells").toArrow()
    if not found.num_rows:
        return tables
    side = (x @ directions).reshape(len(x), tables, bits)
    mine, of = _cells(side, bits), {v: p for p, v in enumerate(ids.tolist())}
    row = np.array([of[v] for v in found.column("i").to_pylist()])
    theirs = _matrix(found, "cells").astype(np.int64)
    rank = np.empty(len(row), np.int64)
    step = max(1, TILE // most)
    for s in range(0, len(x), step):
        order = _flips(side[s : s + step], bits)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(most), order.shape), 1)
        here = (row >= s) & (row < s + step)
        crossed = (theirs[here] ^ mine[row[here]]) + (np.arange(tables) << bits)
        rank[here] = place[(row[here] - s)[:, None], crossed].min(1)
    each = np.bincount(row, minlength=len(x))
    for n in np.unique(np.maximum(rank + 1, tables)):
        share = np.bincount(row, rank < n, len(x))[each > 0] / each[each > 0]
        doubt = 0.0 if total <= len(x) else 2 * share.std() / np.sqrt(len(share))
        if share.mean() - doubt >= recall:
            return int(n)
    return most


def lsh_knn(points: DataFrame, k: int, *, tables: int = 8, bits: int = 6, seed: int = 0, recall: float = 0.9) -> DataFrame:
    """Approximate ``knn`` that finds ``recall`` of the true neighbours.

    Points lie in one cell of each of ``tables`` random partitions of space and
    ask their own cells and then those across the nearest planes, as many as
    :func:`probes_needed` measures on these points; ranks are exact among the
    candidates. Where all cells are needed, the result is that of ``knn``.
    """
    if not 0 <= recall <= 1:
        raise ValueError("recall lies between 0 and 1")
    _, width = size_of(points)
    directions = np.random.Generator(np.random.PCG64(seed)).normal(size=(width, tables * bits))
    probes = probes_needed(points, k, directions, tables, bits, recall)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // (tables << bits))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                side = (_matrix(batch) @ directions).reshape(batch.num_rows, tables, bits)
                flips = _flips(side, bits)[:, :probes]
                cell = np.take_along_axis(_cells(side, bits), flips >> bits, 1) ^ (flips & ((1 << bits) - 1))
                order = np.repeat(np.arange(batch.num_rows), flips.shape[1])
                own = flips & ((1 << bits) - 1) == 0
                yield pa.RecordBatch.from_arrays([batch.column("id").take(order), batch.column("features").take(order), pa.array(cell.reshape(-1).astype(np.int64)), pa.array(own.reshape(-1))], names=["id", "features", "cell", "own"])

    dealt = points.select("id", "features").mapInArrow(cells, "id long, features array<double>, cell long, own boolean")

    def run(table: pa.Table) -> pa.Table:
        ids, a = table.column("id").to_numpy(), _matrix(table)
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        return pa.Table.from_batches([_EMPTY, *_rows(_nearest(ids, a, ids[own], a[own], k, "l2sq"))])

    return ranked(dealt.groupBy("cell").applyInArrow(run, SCHEMA).dropDuplicates(["i", "j"]), k)


def _within(ids: np.ndarray, a: np.ndarray, all_ids: np.ndarray, b: np.ndarray, r: float, metric: str) -> Iterator[pa.RecordBatch]:
    """i, j, d2 of rows of ``a`` and ``b`` within ``r``; approximate distances leave a margin, exact ones decide."""
    base, limit = ("l2sq", r * r) if metric == "l2" else (metric, r)
    width = max(1, b.shape[1])
    step = max(1, TILE // max(1, len(b)))
    for s in range(0, len(a) if len(b) else 0, step):
        own, x = ids[s : s + step], a[s : s + step]
        near = own[:, None] != all_ids[None]
        if np.isfinite(r):
            near &= _distances(x, b, base) <= limit + 1e-9 * (1 + limit + (x * x).sum(1).max() + (b * b).sum(1).max())
        i, j = np.nonzero(near)
        for t in range(0, len(i), max(1, TILE // width)):
            u, v = i[t : t + max(1, TILE // width)], j[t : t + max(1, TILE // width)]
            d = _exact(x[u], b[v], metric)
            ok = d <= r
            yield pa.RecordBatch.from_arrays([pa.array(own[u[ok]]), pa.array(all_ids[v[ok]]), pa.array(d[ok])], names=["i", "j", "d2"])


def radius(points: DataFrame, queries: DataFrame, r: float, metric: str = "l2sq", method: str = "auto") -> DataFrame:
    """i (query), j (point), d2 of all points within ``r`` of the metric (inclusive); a query's own id is left out.

    method: 'broadcast', 'blocks', or 'auto', which broadcasts the points up to MOST_CELLS.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    points, queries = (x.select("id", "features").filter("features IS NOT NULL") for x in (points, queries))
    n, width = size_of(points)
    if method == "auto":
        method = "broadcast" if n * width <= MOST_CELLS else "blocks"
    schema = "i long, j long, d2 double"
    if method == "broadcast":
        table = points.toArrow()
        matrix = points.sparkSession.sparkContext.broadcast((table.column("id").to_numpy(), _matrix(table)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, b = matrix.value
            for batch in batches:
                if batch.num_rows:
                    yield from _within(batch.column("id").to_numpy(), _matrix(batch), ids, b, r, metric)

        return queries.mapInArrow(run, schema)
    blocks = max(2, -(-n * width // BLOCK_CELLS))
    block, others = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = queries.select("id", "features", block.alias("own"), others.alias("other"), F.lit(True).alias("asks"))
    asked = points.select("id", "features", others.alias("own"), block.alias("other"), F.lit(False).alias("asks"))

    def pairs(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(table))
        asks = whole.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = whole.column("id").to_numpy(), _matrix(whole)
        yield from _within(ids[asks], x[asks], ids[~asks], x[~asks], r, metric)

    return asking.unionByName(asked).groupBy("own", "other").applyInArrow(pairs, schema)


def all_distances(points: DataFrame, metric: str = "l2sq") -> DataFrame:
    """i, j, d2 of every ordered pair of different points; quadratic by definition.

    Tasks hold all points (MOST_CELLS) and make tiles of pairs by products of
    matrices, small distances by gaps; more points go by blocks.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    given = points.select("id", "features").filter("features IS NOT NULL")
    table = fetched(given)
    if table is None:
        return radius(points, points, float("inf"), metric)
    matrix = points.sparkSession.sparkContext.broadcast((table.column("id").to_numpy(), _matrix(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, b = matrix.value
        step = max(1, PAIRS // max(1, len(ids)))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                own = part.column("id").to_numpy()
                other = own[:, None] != ids
                i, j = (np.broadcast_to(v, other.shape)[other] for v in (own[:, None], ids))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(_apart(_matrix(part), b, metric)[other])], names=["i", "j", "d2"])

    return given.mapInArrow(run, "i long, j long, d2 double")
