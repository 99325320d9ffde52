"""Farthest-point resampling against the sequential order."""

import hashlib

import numpy as np
import pytest

from pointmill.operators.sampling import farthest_points, farthest_resample, greedy

PTS = "cloud_id long, pt long, x double, y double, z double"


def in_hash_order(cloud, pts):
    return sorted(pts, key=lambda p: (hashlib.md5(f"0::{cloud}::{p}".encode()).hexdigest(), p))


def by_hand(cloud, x, n, bins=8):
    """(pt, bin) in the order of places, by one sequential pass a bin."""
    axis = int(np.argmax(np.ptp(x, axis=0)))
    low, width = x[:, axis].min(), np.ptp(x[:, axis])
    place = np.minimum(np.floor((x[:, axis] - low) / width * bins), bins - 1).astype(int) if width else np.zeros(len(x), int)
    if len(x) <= n:
        order = in_hash_order(cloud, range(len(x)))
        return [(order[i % len(x)], place[order[i % len(x)]]) for i in range(n)]
    out = []
    for b in sorted(set(place)):
        own = in_hash_order(cloud, np.flatnonzero(place == b).tolist())
        out += [(own[i], b) for i in greedy(x[own], n // len(set(place)))]
    rest = in_hash_order(cloud, sorted(set(range(len(x))) - {p for p, _ in out}))
    return out + [(rest[i], place[rest[i]]) for i in (greedy(x[rest], n - len(out)) if n > len(out) else [])]


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(1)
    return {1: rng.normal(size=(400, 3)) * (9, 1, 1), 2: rng.normal(size=(20, 3)), 3: np.ones((70, 3)), 4: np.vstack([rng.normal(size=(300, 3)) * 0.01, [[50, 0, 0]], np.zeros((40, 3))]), 5: rng.normal(size=(64, 3))}


def frame(spark, clouds):
    rows = [(c, i, *map(float, p)) for c, x in clouds.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows + [(1, 9000, None, 0.0, 0.0), (1, 9001, float("nan"), 0.0, 0.0)], PTS)


def test_small_clouds_equal_the_sequential_order(spark, clouds):
    got = farthest_resample(frame(spark, clouds), 64).toPandas().sort_values(["cloud_id", "place"])
    for c, x in clouds.items():
        own = got[got["cloud_id"] == c]
        assert own["place"].tolist() == list(range(64)) and list(zip(own["pt"], own["bin"])) == by_hand(c, x, 64)
    assert farthest_resample(frame(spark, clouds).limit(0), 64).count() == 0


def test_rounds_of_parts_cover_as_well(spark):
    """Groups of many parts: the covering radius stays within twice that of the sequential order, and ties are fixed."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(3000, 3)), rng.normal(size=(5, 3)) * 30, np.repeat(rng.normal(size=(50, 3)), 10, 0)])
    df = frame(spark, {7: x}).filter("x IS NOT NULL AND NOT isnan(x)").selectExpr("*", "md5(concat_ws('::', '0', cloud_id, pt)) AS __h", "40L AS __take")
    runs = [farthest_points(df.repartition(k), ["cloud_id"], candidates=200).orderBy("__order").select("pt").toPandas()["pt"].tolist() for k in (2, 5)]
    assert runs[0] == runs[1] and len(set(runs[0])) == 40
    radius = lambda chosen: np.sqrt(((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)).max()
    order = in_hash_order(7, range(len(x)))
    assert radius(runs[0]) <= 2 * radius([order[i] for i in greedy(x[order], 40)])
