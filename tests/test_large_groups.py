"""Groups above the bounds: radix selection, the k-d tree, boxes in cells, jitter stability; each against brute force with the bounds set low."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.functions import ranking
from pointmill.operators import fuse, geom, match, points
from pointmill.operators.tree import Boxes, Tree, cell_of, splits

PTS = "cloud_id long, pt long, x double, y double, z double"


def test_bits_keep_the_order(spark):
    v = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1e-310, 1.0, np.nextafter(1, 2), np.nextafter(2, 1), 2.0, -1.5, 1.797e308, float("inf"), -float("inf"), float("nan"), 0.1, 1e16, 3.0]
    v += np.random.default_rng(0).normal(size=300).tolist() + (10.0 ** np.random.default_rng(1).uniform(-300, 300, 300)).tolist()
    got = [r["k"] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").select("i", ranking.ordered_bits(F.col("v")).alias("k")).orderBy("i").collect()]
    raw = np.array(v).view(np.int64)
    want = [(2047 << 52) + 1 if np.isnan(x) else int(r) if r >= 0 else -int(r & 0x7FFFFFFFFFFFFFFF) for x, r in zip(v, raw)]
    assert got == want


@pytest.mark.parametrize(("by", "bin_rows"), [(["g"], 0), (["g"], 30), ([], 0), ([], 30)])
def test_quantiles_by_histograms(spark, monkeypatch, by, bin_rows):
    monkeypatch.setattr(ranking.select_ranks, "__defaults__", (bin_rows,))
    rng = np.random.default_rng(2)
    values = {None: rng.normal(size=400) * 1e-3, "constant": np.full(500, 7.25), "few": rng.integers(0, 50, 600) / 10.0, "wide": 10.0 ** rng.uniform(-200, 200, 300), "small": rng.normal(size=20), "one": np.array([3.5])}
    rows = [(g, float(x)) for g, own in values.items() for x in own] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    at = [0, 0.1, 0.5, 0.951, 1]
    got = {r["g"] if by else None: r["q"] for r in ranking.quantiles(df, "v", at, by, small=100).collect()}
    groups = values if by else {None: np.concatenate(list(values.values()))}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert np.allclose(got[g], np.quantile(own, at), rtol=1e-12), g
    assert {r["g"] if by else None: r["q"] for r in ranking.quantiles(df, "v", at, by).collect()}.keys() == got.keys()  # buffers


def test_equal_values_stay_spread(spark):
    """A constant column is counted where it lies: each task sends one row, and no task gets more than the bins."""
    df = spark.range(200_000).select(F.lit(1.5).alias("__v")).repartition(8)
    rows = df.withColumn("__key", ranking.ordered_bits(F.col("__v")))
    bins = rows.groupBy(F.shiftright("__key", 48)).agg(F.count("*"))
    assert bins.count() == 1
    found = ranking.select_ranks(df, [], [F.lit(0), F.col("__n") - 1]).first()
    assert found["__n"] == 200_000 and found["__at"] == {0: 1.5, 1: 1.5}


def test_first_of_equals_a_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(rng.integers(0, 6)) if g else float(rng.normal()), 1.0, k) for g, k in ((0, 150), (1, 77), (2, 0), (3, 5000)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i long, v double, other double, k int")
    want = sorted((g, i) for g, k in ((0, 150), (1, 77), (3, 300)) for _, i in sorted((r[2], r[1]) for r in rows if r[0] == g)[:k])
    for bounded in (True, False):
        got = ranking.first_of(df, ["g"], "v", "k", "i", bounded)
        assert sorted((r["g"], r["i"]) for r in got.collect()) == want and got.columns == df.columns


def test_clouds_above_the_bound_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(c, i, *map(float, p)) for c, n in ((1, 300), (2, 40)) for i, p in enumerate((rng.normal(size=(n, 3)) * (5, 1, 1)).round(2))]
    df = spark.createDataFrame(rows, PTS)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "pair_id long, a_id long, b_id long")

    def everything():
        plain = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
        found = [geom.centreline_slope(df), match.align_pairs(pairs, df, 0.5), points.occlude(df, (0.5, 0.8), 1), points.top_down(df, (0.3, 0.6), 0.5), points.resample(df, 64), points.resample(df, 3)]
        return [plain(d) for d in found]

    small = everything()
    monkeypatch.setattr(ranking.fits, "__defaults__", (50,))
    monkeypatch.setattr(ranking.quantiles, "__defaults__", ((), None, 50))
    monkeypatch.setattr(ranking.quantiles_of, "__defaults__", ((), None, 50))
    assert everything() == small


def brute(pt, x, k, y=None, y_pt=None):
    y, y_pt = (x, pt) if y is None else (y, y_pt)
    out = []
    for p, a in zip(pt, x):
        d = ((a - y) ** 2).sum(1)
        order = [j for j in np.lexsort((y_pt, np.floor(d * 1e9 + 0.5))) if y is not x or y_pt[j] != p][:k]
        out += [(int(p), int(y_pt[j]), r + 1) for r, j in enumerate(order)]
    return sorted(out)


def test_tree_of_a_dense_cloud(spark, monkeypatch):
    """A half of the points in a millionth of the box, copies of one point, a line of ties, outliers."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(0, 1e5, (500, 3)), 5e4 + rng.uniform(0, 0.1, (700, 3)), np.tile([0.25, 0.5, 0.75], (150, 1)), np.column_stack([np.arange(100) / 8, np.zeros(100), np.zeros(100)]), rng.normal(size=(5, 3)) * 1e6])
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)], PTS)
    others = df.select("cloud_id", F.col("pt").alias("n_pt"), *(F.col(c).alias("n_" + c) for c in "xyz"))
    tree = Tree(others, ["cloud_id"], 5, leaf=32)
    sizes = [r["count"] for r in tree.cells.groupBy("__leaf").count().collect()]
    assert max(sizes) <= 64 and len(sizes) > 30
    monkeypatch.setattr("pointmill.operators.geom.Tree", lambda o, keys, k: Tree(o, keys, k, leaf=32))
    got = sorted((r["pt"], r["n_pt"], r["rank"]) for r in geom.neighbours(df, 5, 0).collect())
    assert got == brute(np.arange(len(x)), x, 5)
    visited = tree.nearest(df, ["pt"]).count()
    assert visited < len(x) * 5 * 10  # a few leaves a point, not all


def test_tree_for_points_far_from_the_cloud(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a, b = np.vstack([rng.normal(size=(60, 3)) * 3, [[1e3, 0, 0], [0, 0, 0]]]), rng.normal(size=(500, 3))
    left = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(a)] + [(1, 99, None, 0.0, 0.0)], PTS)
    right = spark.createDataFrame([(2, i, *map(float, p)) for i, p in enumerate(b)] + [(2, 900, float("nan"), 0.0, 0.0)], PTS)
    monkeypatch.setattr("pointmill.operators.geom.Tree", lambda o, keys, k: Tree(o, keys, k, leaf=16))
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, a_id long, b_id long")
    got = {r["pt"]: r["d"] for r in geom.nearest_other(pairs, left, right, 0).collect() if r["pt"] < 99}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2).min(1))
    assert len(got) == len(a) and np.allclose([got[i] for i in range(len(a))], want)


def test_boxes_and_splits():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 3))
    cell = cell_of(x, *splits(x, 64))
    assert len(set(cell)) == 64 and np.bincount(cell).max() <= 40
    low, high = (np.array([f(x[cell == c], axis=0) for c in sorted(set(cell))]) for f in (np.min, np.max))
    boxes = Boxes(low, high)
    q, far = rng.normal(size=(50, 3)) * 2, rng.uniform(0, 1, 50)
    point, leaf = boxes.within(q, far)
    gap = np.maximum(0, np.maximum(low - q[:, None], q[:, None] - high))
    assert set(zip(point.tolist(), leaf.tolist())) == set(zip(*(v.tolist() for v in np.nonzero((gap**2).sum(2) <= far[:, None]))))
    assert (cell_of(np.ones((5, 3)), *splits(np.ones((30, 3)), 8)) == 0).all()


def test_near_boxes_are_the_same_pairs(spark):
    rng = np.random.default_rng(8)
    n = 160
    size = 10.0 ** rng.uniform(-3, 2.5, n)
    at = rng.uniform(-60, 60, (n, 2)).round(1)
    pts = [(i, k, float(at[i, 0] + s * size[i]), float(at[i, 1] + s * size[i] / 3), float(s)) for i in range(n) for k, s in enumerate((0.0, 1.0))]
    pts = spark.createDataFrame([p for p in pts if p[0] != 5], PTS)
    cat = spark.createDataFrame([(i, f"o{i % 40}", None if i % 9 == 0 else i * 10, i % 2, 0.5) for i in range(n)], "cloud_id long, object_id string, us long, split int, confidence double")
    a, b = cat.filter("cloud_id % 3 = 0"), cat.filter("cloud_id % 3 > 0")
    every = match.candidates_in_time(a, b, ["split"], 400)
    box = match.boxes(pts)
    for gap in (0.0, 2.5, 30.0):
        near = match.near_in_time(a.join(box, "cloud_id"), b.join(box, "cloud_id"), ["split"], 400, gap)
        got = sorted((r["a_cloud_id"], r["b_cloud_id"]) for r in near.collect())
        scored = match.box_gap_score(every.withColumns({"a_id": F.col("a_cloud_id"), "b_id": F.col("b_cloud_id")}), pts)
        want = {(r["a_id"], r["b_id"]) for r in scored.filter(F.col("gap_xy") <= gap).collect()}
        assert len(got) == len(set(got)) and want <= set(got)
        assert gap > 2.5 or len(got) < scored.count() / 2
    limits = {"gap_xy": 2.5, "centre": 90.0}
    fast = sorted(map(tuple, match.match_boxes(a, b, pts, ["split"], 400, limits).select("a_cloud_id", "b_cloud_id", "score").collect()))
    slow = sorted(map(tuple, match.match_boxes(a, b, pts, ["split"], 400, {"centre": 90.0, "gap_xy": float("inf")}).filter("gap_xy <= 2.5").select("a_cloud_id", "b_cloud_id", "score").collect()))
    assert fast and set(slow) <= set(fast)


def test_mean_logits_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i % 7, [None if j == 2 and i % 5 == 0 else float(v) for j, v in enumerate(rng.integers(0, 4, 3 + i % 3))]) for i in range(200)] + [(50, []), (51, [1.0]), (52, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, logits array<double>")
    side = sorted(map(tuple, fuse.mean_logits(df, ["k"]).collect()))
    monkeypatch.setattr(fuse, "SIDE_BY_SIDE", 0)
    assert side == sorted(map(tuple, fuse.mean_logits(df, ["k"]).collect())) and (52, 0, 2.0) in side


def scores(x, k):
    order = np.array([[j for j in np.lexsort((np.arange(len(x)), np.floor(((p - x) ** 2).sum(1) * 1e9 + 0.5))) if j != i][:k] for i, p in enumerate(x)])
    near = x[order]
    d = np.sqrt(((near - x[:, None]) ** 2).sum(2))
    low, vec = np.linalg.eigh(np.einsum("nki,nkj->nij", near - near.mean(1, keepdims=True), near - near.mean(1, keepdims=True)) / order.shape[1])
    normal = vec[:, :, 0]
    turned = normal[order] * np.where((normal[order] * normal[:, None]).sum(2) < 0, -1, 1)[:, :, None]
    mean = turned.mean(1)
    cos = np.abs((normal * mean).sum(1)) / np.linalg.norm(mean, axis=1)
    return {"curvature": np.maximum(low[:, 0], 0) / low.sum(1), "cv": d.std(1) / d.mean(1), "angle": np.degrees(np.arccos(np.clip(cos, 0, 1)))}


def jaccard(a, b):
    return 1.0 if not (a | b).any() else (a & b).sum() / (a | b).sum()


def test_stability_and_agreement_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(c, i, v, *map(float, p)) for c in (1, 2) for v in (0, 1) for i, p in enumerate((rng.normal(size=(50, 3)) * (3, 2, 0.3)).round(3), 100 * v)]
    df = spark.createDataFrame(rows, "cloud_id long, pt long, view_id int, x double, y double, z double")
    limits = {"curvature": 0.03, "cv": 0.35, "angle": 25.0}
    moved = points.jitter(df.withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2)))), 0.2, 0.3, F.col("rep")).toPandas().sort_values("pt")
    own = df.toPandas().sort_values("pt")
    want = {}
    for key, view in own.groupby(["cloud_id", "view_id"]):
        before = scores(view[["x", "y", "z"]].to_numpy(), 6)
        for label, t in limits.items():
            again = [scores(moved[(moved.cloud_id == key[0]) & (moved.view_id == key[1]) & (moved.rep == r)][["x", "y", "z"]].to_numpy(), 6)[label] >= t for r in (1, 2)]
            want[(*key, label)] = np.mean([jaccard(before[label] >= t, a) for a in again])
    found = {(r["cloud_id"], r["view_id"], r["label"]): r["jaccard"] for r in geom.jitter_stability(df, 6, limits, 2, 0.2, 0.3).collect()}
    assert found.keys() == want.keys() and max(abs(found[i] - want[i]) for i in want) < 0.03 and len(set(want.values())) > 6
    monkeypatch.setattr("pointmill.operators.geom.Tree", lambda o, keys, k, all_copies=False: Tree(o, keys, k, leaf=8, all_copies=all_copies))
    treed = {(r["cloud_id"], r["view_id"], r["label"]): r["jaccard"] for r in geom.jitter_stability(df, 6, limits, 2, 0.2, 0.3, whole_up_to=0).collect()}
    assert treed.keys() == found.keys() and all(abs(treed[i] - found[i]) < 1e-9 for i in found)
    first = df.filter("view_id = 0")
    agreed = {(r["cloud_id"], r["a"], r["b"]): r["jaccard"] for r in geom.method_agreement(geom.neighbours(first, 6), limits).collect()}
    for c in (1, 2):
        s = scores(own[(own.cloud_id == c) & (own.view_id == 0)][["x", "y", "z"]].to_numpy(), 6)
        for a, b in (("curvature", "cv"), ("curvature", "angle"), ("cv", "angle")):
            assert abs(agreed[c, a, b] - jaccard(s[a] >= limits[a], s[b] >= limits[b])) < 0.05
