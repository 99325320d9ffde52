"""What queries send through shuffles grows with their tables, not with pairs or neighbours."""

import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from pointmill.operators import clouds, geom
from pointmill.plans import fixtures

SF = "/root/testdata/sf0.01"


def shuffled(spark, action):
    """Rows that the stages of ``action`` wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))}
    before = set(stages())
    action()
    return sum(s.shuffleWriteRecords() for i, s in stages().items() if i not in before)


@pytest.mark.parametrize("name", ["e5_neighbours", "e6_curvature", "e6_normals", "e8_normal_difference", "e11_stability", "e11_stability_shape", "e11_methods", "e14_residual", "e15_gain"])
def test_points_are_shuffled_and_neighbours_are_not(spark, name):
    points = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    rows = shuffled(spark, lambda: __spark_entry__.queries()[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert rows < 4 * points


def test_scores_in_tasks_equal_those_by_joins(spark):
    big = fixtures.view(spark, SF, "big").filter("cloud_id <= 3")
    names = geom.POINT_SCORES
    one, other = (geom.point_scores(big, 7, names, n).toPandas().sort_values(["cloud_id", "pt"])[list(names)].to_numpy() for n in (4096, 0))
    assert len(one) == len(other) > 1000 and np.allclose(one, other, atol=1e-6, equal_nan=True)


def test_residuals_in_tasks_equal_those_by_joins(spark):
    big = fixtures.view(spark, SF, "big").filter("cloud_id <= 3")
    for a, b in zip(geom.registration_residuals(big, [0.0, 10.0]), geom.registration_residuals(big, [0.0, 10.0], 0)):
        a, b = (df.toPandas().sort_values(["cloud_id", "pair"]) for df in (a, b))
        assert (a[["cloud_id", "pair", "n", "inliers"]].to_numpy() == b[["cloud_id", "pair", "n", "inliers"]].to_numpy()).all()
        assert np.allclose(a[["rmse", "inlier_ratio"]], b[["rmse", "inlier_ratio"]])


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_nearest_of_equal_and_unknown_places(scale):
    """Ties go to the first point, and unknown places come last; also where distances are too large to be packed with places."""
    rng = np.random.default_rng(3)
    for n in (2, 5, 40, 130):
        x = rng.integers(0, 3, (3, n, 3)) * scale
        if n == 40:
            x[1, 7] = np.nan
        near, gaps = clouds.knn(x, 6)
        for c in range(3):
            for i in range(n):
                d = ((x[c] - x[c, i]) ** 2).sum(1)
                order = [j for j in np.lexsort((np.arange(n), np.nan_to_num(d, nan=np.inf))) if j != i][:6]
                assert list(near[c, i]) == order and np.array_equal(gaps[c, i], d[order], equal_nan=True)


def brute(x, k):
    """Places of the k nearest others of every point, ties by the first, and the squared distances."""
    d = (x[:, None, 1] - x[None, :, 1]) ** 2 + (x[:, None, 2] - x[None, :, 2]) ** 2 + (x[:, None, 0] - x[None, :, 0]) ** 2
    key = np.floor(d * 1e9 + 0.5)
    np.fill_diagonal(key, np.inf)
    order = np.argsort(key, 1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


def test_nearest_in_strips(monkeypatch):
    """Also of grids full of ties, of points on a line, of copies and of a few far away; no cloud is met as a whole but where its points ask for it."""
    rng = np.random.default_rng(8)
    even, grid, line = rng.random((2, 600, 3)) * (50, 100, 10), rng.integers(0, 9, (2, 600, 3)) * (1.0, 2.0, 1.0), rng.random((2, 600, 3)) * (0, 0, 7)
    copies, far, large = np.repeat(rng.random((2, 30, 3)), 20, 1), rng.random((2, 600, 3)), rng.random((1, 3000, 3)) * (1, 9, 9)
    far[1, ::40] += 1e3
    mixed = np.concatenate([even[:1], grid[:1], copies[:1], line[:1]])
    met, squares = [], clouds.squares
    monkeypatch.setattr(clouds, "squares", lambda a, b: met.append(a.shape[0] * a.shape[1] * b.shape[1]) or squares(a, b))
    for x in (even, grid, line, copies, far, large, mixed):
        for k in (1, 8, 12):
            near, gaps = clouds.knn(x, k)
            for c in range(len(x)):
                order, d = brute(x[c], k)
                assert np.array_equal(near[c], order) and np.array_equal(gaps[c], d)
    met.clear()
    clouds.nearest_places(even, 12)
    assert sum(met) < even.shape[0] * even.shape[1] ** 2 / 2


def test_views_meet_once(monkeypatch):
    rng = np.random.default_rng(9)
    x, view = rng.random((600, 3)), np.sort(rng.integers(0, 7, 600))
    first = np.flatnonzero(np.append(True, view[1:] != view[:-1]))
    met, squares = [], clouds.squares
    monkeypatch.setattr(clouds, "squares", lambda a, b: met.append(a.shape[1] * b.shape[1]) or squares(a, b))
    frame = pd.DataFrame(x, columns=list(clouds.XYZ)).assign(cloud_id=1, view_id=view, pt=range(600))
    got = clouds.residuals_of([0.0, 0.1])(frame).set_index(["va", "vb"])
    assert sum(met) < 600 * 600 / 2 and len(got) == 21
    for unknown in (False, True):
        if unknown:
            x[::9, 1] = np.nan
            x[view == 2, 0] = np.nan
        d = clouds._to_views(x, first)
        for v in range(7):
            gaps = ((x[view != v][:, None] - x[view == v][None]) ** 2)[..., [1, 2, 0]]
            want = np.fmin.reduce(gaps[..., 0] + gaps[..., 1] + gaps[..., 2], 1)
            assert np.array_equal(d[view != v, v], want, equal_nan=True)
    for (a, b), r in got.iterrows():
        assert r["n"] == (view == a).sum() + (view == b).sum() == r["inliers"][0] > r["inliers"][1]


@pytest.mark.parametrize("name", ["d6_resample", "d10_top_down", "d17_occlude", "d18_silhouette", "i7_part_refinement"])
def test_partitions_follow_the_rows(spark, name, monkeypatch):
    monkeypatch.setattr(fixtures, "PARTITION", 2_000)
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(l_\w+#\d+L, 30\), REPARTITION_BY_NUM", plan)  # 60,000 points
