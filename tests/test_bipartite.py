"""Bipartite sessions, cluster trees and stored hierarchies against plain Python."""

import pytest
from pyspark.sql import functions as F

from hyperpanel.operators import bipartite as B
from hyperpanel.operators import hsne as H
from hyperpanel.sources import tables as T

#: Sets 0 and 1 are equal, 5 shares no member with others.
MEMBERS = [(0, 10), (0, 11), (1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (3, 13), (4, 13), (4, 10), (5, 20), (2, 14)]


def sets_of(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


def unique_of(sets):
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    return set(first.values())


def rows(df, *c):
    return {tuple(r[k] for k in c[:-1]): r[c[-1]] for r in df.select(*c).collect()}


@pytest.fixture(scope="module")
def found(spark):
    noise = [(None, 3), (4, None), (0, 10)]
    return B.session(spark.createDataFrame(MEMBERS + noise, "a long, b long"))


def test_overview_of_one_scale(spark, found):
    a, b = sets_of(MEMBERS), sets_of((y, x) for x, y in MEMBERS)
    ua, ub = unique_of(a), unique_of(b)
    view = B.overview(found)
    assert (view.scale_a, view.scale_b) == (0, 0)
    assert rows(view.a, "id", "weight") == {(i,): float(sum(a[k] == a[i] for k in a)) for i in ua}
    assert rows(view.b, "id", "weight") == {(i,): float(len(b[i])) for i in ub}
    assert rows(view.links, "a", "b", "n") == {(i, j): 1 for i in ua for j in a[i] & ub}
    w = {(i, j): len(a[i] & a[j]) / len(a[i] | a[j]) for i in ua for j in ua if a[i] & a[j]}
    total = {j: sum(v for (_, k), v in w.items() if k == j) for j in ua}
    assert rows(view.edges_a, "i", "j", "w") == pytest.approx({k: v / total[k[1]] for k, v in w.items()})
    sizes = rows(B.histograms(found), "side", "sets", "n", "count")
    assert sizes["a", "all", 2] == 4 and sizes["a", "unique", 2] == 3 and sum(v for k, v in sizes.items() if k[:2] == ("b", "unique")) == len(ub)


def test_empty_membership(spark):
    view = B.overview(B.session(spark.createDataFrame([], "a long, b long")))
    assert B.tables(view).count() == 0


def test_drill_into_the_scale_below(spark, found):
    points = found.a.hierarchy.scales[0].landmarks
    aoi = spark.createDataFrame([(0, 0, 1.0), (2, 0, 0.6), (2, 3, 0.4), (3, 3, 1.0), (4, 3, 0.9), (5, 3, 0.2)], "prev long, lm long, p double")
    top = points.filter("lm IN (0, 3)")
    edges = spark.createDataFrame([(0, 3, 1.0), (3, 0, 1.0)], "i long, j long, w double")
    taller = H.Hierarchy([*found.a.hierarchy.scales, H.Scale(top, edges, aoi)])
    s = B.Session(found.membership, B.Side(found.a.sets, found.a.unique, taller), found.b)
    view = B.overview(s)
    landmark = {0: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    a, ub = sets_of(MEMBERS), unique_of(sets_of((y, x) for x, y in MEMBERS))
    want = {}
    for i, lm in landmark.items():
        for j in a[i] & ub:
            want[lm, j] = want.get((lm, j), 0) + 1
    assert rows(view.links, "a", "b", "n") == want
    chosen = spark.createDataFrame([(3,)], "id long")
    linked = spark.createDataFrame([(12, 0.5), (13, 0.9), (10, 0.3)], "id long, v double")
    below = B.drill(s, view, chosen, linked)
    assert below.scale_a == 0 and {r.id for r in below.a.collect()} == {3, 4}
    assert {r.id for r in below.b.collect()} == {12, 13}
    assert rows(below.links, "a", "b", "n") == {(3, 12): 1, (3, 13): 1, (4, 13): 1}
    assert rows(below.edges_b, "i", "j", "w") == {(12, 13): 1.0, (13, 12): 1.0}  # columns sum to one
    assert {(r.i, r.j) for r in below.edges_a.collect()} <= {(x, y) for x in (3, 4) for y in (3, 4)}
    same = B.drill(s, view, chosen, linked.filter("v > 1"))
    assert {r.id for r in same.b.collect()} == {r.id for r in view.b.collect()}
    with pytest.raises(ValueError):
        B.drill(s, below, chosen, linked)


def test_taller_sides_link_every_landmark_to_its_points(spark):
    pairs = [(i, (i * k) % 97) for i in range(120) for k in (1, 3, 7)]
    p = H.Parameters(neighbours=8, walks=5, walk_length=4, walks_per_landmark=20, max_jumps=15)
    s = B.session(spark.createDataFrame(pairs, "a long, b long"), p, most_top=60, small=20)
    view = B.overview(s)
    assert view.scale_a >= 1 and view.a.count() < s.a.unique.count()
    la, lb = (rows(x.landmarks_of(k), "id", "lm") for x, k in ((s.a, view.scale_a), (s.b, view.scale_b)))
    want = {}
    for a, b in set(pairs):
        if (a,) in la and (b,) in lb:
            want[la[a,], lb[b,]] = want.get((la[a,], lb[b,]), 0) + 1
    assert rows(view.links, "a", "b", "n") == want


def test_cluster_tree(spark):
    tree = spark.createDataFrame([], "scale int, cluster_id int, parent_id int")
    tree = H.add_cluster(tree, 1, 0, None, 1)
    tree = H.add_cluster(tree, 0, 0, 0, 1)
    assert H.free_cluster_id(tree, 0) == 1 and H.has_cluster(tree, 1, 0) and not H.has_cluster(tree, 1, 1)
    assert H.get_cluster(tree, 0, 0).first().parent_id == 0
    for bad in ((0, 0, 0), (0, 3, None), (1, 3, 0)):
        with pytest.raises(ValueError):
            H.add_cluster(tree, *bad, 1)
    assert not H.has_cluster(H.remove_cluster(tree, 0, 0), 0, 0)
    for f in (H.get_cluster, H.remove_cluster):
        with pytest.raises(KeyError):
            f(tree, 0, 9)


def test_hierarchy_from_similarities_is_stored(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0), (1, 0, 5.0)], "i long, j long, w double")
    h = H.from_similarities(edges)
    h.scales[0].landmarks = h.scales[0].landmarks.withColumn("weight", F.lit(3.0))
    assert [tuple(r) for r in H.statistics(h).collect()] == [(0, 3, 3, 0, 9.0)]
    T.save_hierarchy(h, str(tmp_path))
    back = T.load_hierarchy(spark, str(tmp_path))
    assert rows(back.scales[0].transition, "i", "j", "w") == {(0, 1): 0.5, (0, 2): 0.5, (1, 0): 1.0}
    assert {r.weight for r in back.scales[0].landmarks.collect()} == {1.0}
    assert {r.weight for r in T.load_hierarchy(spark, str(tmp_path), weights=True).scales[0].landmarks.collect()} == {3.0}
    spark.createDataFrame([("9.9",)], "version string").write.mode("overwrite").parquet(f"{tmp_path}/version")
    with pytest.raises(ValueError):
        T.load_hierarchy(spark, str(tmp_path))
    with pytest.raises(ValueError):
        H.from_similarities(spark.createDataFrame([(0, 1, -1.0)], "i long, j long, w double"))


def test_ties_of_influence_go_to_the_smaller_id_whatever_the_order_of_sums(spark):
    # landmarks 1 and 2 influence 0 alike, but 0.1 + 0.2 + 0.3 is above 0.3 + 0.3 in doubles
    points = spark.createDataFrame([(k, k, k, 1.0) for k in range(7)], "lm long, orig_id long, prev_id long, weight double")
    first = spark.createDataFrame([(0, 3, 0.1), (0, 4, 0.2), (0, 5, 0.3), (0, 6, 0.6)], "prev long, lm long, p double")
    second = spark.createDataFrame([(3, 2, 1.0), (4, 2, 1.0), (5, 2, 1.0), (6, 1, 1.0)], "prev long, lm long, p double")
    own = H.Hierarchy([H.Scale(points, None), H.Scale(points, None, first), H.Scale(points, None, second)])
    for order in (F.asc, F.desc):
        own.scales[1].aoi = first.orderBy(order("p")).coalesce(1)
        assert {r.id: r.lm for r in B.Side(None, None, own).landmarks_of(2).collect()}[0] == 1
