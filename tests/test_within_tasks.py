"""Steps that meet bounded clouds and meshes within tasks: the same rows as by joins, and no more than points in shuffles."""

import numpy as np
import pytest
from test_bounded_work import SF, shuffled
from test_sampling import frame

import __spark_entry__
from pointmill.operators import sampling
from pointmill.sources import mesh


def test_clouds_in_tasks_equal_those_in_rounds(spark):
    rng = np.random.default_rng(4)
    clouds = {1: rng.normal(size=(500, 3)) * (1, 5, 2), 2: rng.integers(0, 4, (300, 3)) * 1.0, 3: np.zeros((90, 3)), 4: rng.normal(size=(9, 3))}
    df = frame(spark, clouds).filter("x IS NOT NULL AND NOT isnan(x)")
    for n in (64, 5):
        one, other = (sorted(map(tuple, d.select("cloud_id", "pt", "bin", "place").collect())) for d in (sampling.farthest_resample(df, n), sampling._in_rounds(df, n, 8, 0, 4096)))
        assert one == other and len(one) == 4 * n


@pytest.mark.parametrize("scaled", [False, True])
def test_meshes_in_tasks_equal_those_by_joins(spark, scaled):
    """Also meshes without area, with unknown corners, of one mesh above the bound, and of faces in several blocks."""
    rng = np.random.default_rng(6)
    v = [(m, i, *map(float, p)) for m, k in ((1, 40), (2, 300), (3, 5)) for i, p in enumerate(rng.normal(size=(k, 3)) * m)] + [(4, 0, 1.0, None, 2.0), (4, 1, 1.0, 1.0, float("nan")), (5, 0, 1.0, 2.0, 3.0)]
    f = [(1, 7 * i, *map(int, rng.integers(0, 42, 3))) for i in range(60)] + [(2, i, *map(int, rng.integers(0, 300, 3))) for i in range(400)] + [(3, 0, 1, 1, 2), (4, 0, 0, 1, 2), (6, 0, 0, 1, 2)]
    v = spark.createDataFrame(v, "mesh_id long, v long, x double, y double, z double")
    f = spark.createDataFrame(f, "mesh_id long, face long, v0 long, v1 long, v2 long")
    rows = lambda df: sorted((r[0], r[1], *(str(None if c is None else round(c, 9) + 0.0) for c in r[2:])) for r in df.collect())
    want = rows(mesh._sample_by_joins(v, f, 50, 0, scaled, 32))
    for most in (16_384, 200):
        assert rows(mesh.sample_surface(v, f, 50, 0, scaled, 32, most)) == want
    assert len(want) == 2 * 50 + 5 + 2 + 1


def test_points_are_shuffled_once(spark):
    points = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled(spark, lambda: __spark_entry__.queries()["d6_farthest"](spark, SF).write.format("noop").mode("overwrite").save()) < 3.5 * points


def test_meshes_are_sampled_without_a_join(spark):
    assert "Join" not in __spark_entry__.queries()["a9_surface"](spark, SF)._jdf.queryExecution().toString()
