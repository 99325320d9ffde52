"""Registered queries meet every row of their tables: brute force on small tables with ids beyond any fixed part."""

import hashlib
import json

import numpy as np
import pytest

import __spark_entry__
from pointmill.plans import fixtures


def run(spark, name, folder):
    return __spark_entry__.queries()[name](spark, str(folder)).toPandas()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five clouds with ids from 19 up."""
    made = tmp_path_factory.mktemp("tables")
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    rows.filter("l_suppkey IN (19, 20, 21, 47, 90) AND l_orderkey % 5 = 0").write.parquet(str(made / "lineitem.parquet"))
    return made


@pytest.fixture(scope="module")
def clouds(spark, folder):
    big = fixtures.view(spark, str(folder), "big").toPandas().sort_values("pt")
    return {i: (g["pt"].to_numpy(), g[["x", "y", "z"]].to_numpy(float), g["view_id"].to_numpy()) for i, g in big.groupby("cloud_id")}


def nearest(pt, x, k):
    """Places of the k nearest others of every point, ties by smaller pt, and the squared distances."""
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    order = np.array([np.lexsort((pt, row.round(9)))[:k] for row in d])
    return order, np.take_along_axis(d, order, 1)


def test_neighbours_of_every_cloud(spark, folder, clouds):
    got = run(spark, "e5_neighbours_all", folder)
    want = {}
    for i, (pt, x, _) in clouds.items():
        order, d = nearest(pt, x, 8)
        want |= {(i, pt[a], pt[b]): v for a in range(len(pt)) for b, v in zip(order[a], d[a])}
    assert len(clouds) == 5 and len(got) == len(want)
    assert all(abs(want[r.cloud_id, r.pt, r.n_pt] - r.d2) < 1e-5 for r in got.itertuples())


def test_shapes_of_every_cloud(spark, folder, clouds):
    curved, normals, turned = (run(spark, n, folder).set_index(["cloud_id", "pt"]) for n in ("e6_curvature_all", "e6_normals", "e8_normal_difference"))
    assert len(curved) == len(normals) == len(turned) == sum(len(pt) for pt, *_ in clouds.values())
    for i, (pt, x, _) in clouds.items():
        order, _ = nearest(pt, x, 12)
        own = normals.loc[i].loc[pt].to_numpy()
        for a, near in enumerate(order):
            low, vectors = np.linalg.eigh(np.cov(x[near].T, bias=True))
            assert abs(curved.loc[(i, pt[a]), "curvature"] - low[0] / low.sum()) < 1e-3
            if low[1] - low[0] > 1e-3 * low[2]:
                assert abs(vectors[:, 0] @ own[a]) > 1 - 1e-4 and own[a] @ x[a] > -1e-4
            mean = (own[near] * np.where(own[near] @ own[a] < 0, -1, 1)[:, None]).mean(0)
            angle = np.degrees(np.arccos(np.clip(own[a] @ mean / np.linalg.norm(mean), -1, 1)))
            assert abs(turned.loc[(i, pt[a]), "angle"] - angle) < 0.2


def test_residuals_of_every_cloud(spark, folder, clouds):
    near, gain = (run(spark, n, folder).set_index(["cloud_id", "pair"]) for n in ("e14_residual_all", "e15_gain_all"))
    n = 0
    for i, (_, x, v) in clouds.items():
        views = np.unique(v)
        for a, b in ((a, b) for a in views for b in views if a < b):
            d = ((x[v == a][:, None] - x[v == b][None]) ** 2).sum(2)
            d = np.concatenate([d.min(1), d.min(0)])
            inside, r, w = d[d <= 100], near.loc[(i, f"{a}-{b}")], gain.loc[(i, f"{a}-{b}")]
            assert (r["n"], r["inliers"]) == (len(d), len(inside)) and abs(w["pre"] - np.sqrt(d.mean())) < 1e-5
            if len(inside):
                assert abs(r["rmse"] - np.sqrt(inside.mean())) < 1e-5 and abs(w["post"] - r["rmse"]) < 1e-5
            n += 1
    assert len(near) == len(gain) == n


def uniform(*key):
    return int(hashlib.md5("::".join(map(str, ("0", *key))).encode()).hexdigest()[:8], 16) / 2**32


def test_surface_of_every_point(spark, folder, clouds):
    got = run(spark, "a9_surface_all", folder).set_index(["mesh_id", "pt"])
    assert len(got) == 16 * len(clouds) and max(len(pt) for pt, *_ in clouds.values()) > 60
    for m, (pt, x, _) in clouds.items():
        t = x[np.argsort(pt)][: len(pt) // 3 * 3].reshape(-1, 3, 3)
        area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) / 2
        hi = np.cumsum(area) / area.sum()
        for i in range(16):
            face = t[np.searchsorted(hi, uniform(m, i), side="right")]
            a, b = np.sqrt(uniform(m, i, "a")), uniform(m, i, "b")
            assert np.abs(got.loc[(m, i), ["x", "y", "z"]].to_numpy() - ((1 - a) * face[0] + a * (1 - b) * face[1] + a * b * face[2])).max() < 1e-5


def test_sidecars_of_every_event(spark):
    folder = "/root/testdata/sf0.01"
    props = {r["event_id"]: r["props"] for r in spark.read.parquet(f"{folder}/events.parquet").select("event_id", "props").collect()}
    shared = {}
    for i in (i for i in props if i % 2 == 0):
        shared[i % 3, i % 500] = min(props[i], shared.get((i % 3, i % 500), props[i]))
    want = {i: json.loads(props[i] if i % 2 else shared[i % 3, i % 500]).get("k") if i % 2 or (i % 3, i % 500) in shared else None for i in props}
    got = run(spark, "a5_sidecars_all", folder).set_index("event_id")["k"]
    assert len(got) == len(props) and max(props) > 1000
    assert all(got[i] == want[i] or got[i] != got[i] and want[i] is None for i in props)


def test_every_cloud_is_aligned_with_the_next(spark, folder, clouds):
    got = run(spark, "f7_align_all", folder)
    assert {(r.pair_id, r.source_id, r.pt) for r in got.itertuples()} == {(a, c, p) for a in (19, 20) for c in (a, a + 1) for p in clouds[c][0]}
    lines = run(spark, "e17_centreline", folder).set_index("cloud_id")
    for a in (19, 20):
        line, own = lines.loc[a + 1], got[(got["pair_id"] == a) & (got["source_id"] == a)]
        u, v = own["x"] * line["ax"] + own["y"] * line["ay"], own["y"] * line["ax"] - own["x"] * line["ay"]
        assert abs(u.quantile(0.99) - (line["u_min"] - 0.5)) < 1e-3 and abs((v.quantile(0.01) + v.quantile(0.99)) / 2 - line["v_mid"]) < 1e-3
        assert abs(own["z"].min() - line["ground"]) < 1e-5
