"""The slope of the centreline where rows arrive in another order each time they are read, as they do from other machines."""

import secrets

import numpy as np
from pyspark.sql import functions as F

from pointmill.operators import geom


def slope_by_hand(x, y):
    t = np.arctan2(2 * np.cov(x, y)[0, 1], x.var(ddof=1) - y.var(ddof=1)) / 2
    a, b = np.array([np.cos(t), np.sin(t)]) * (-1 if np.sin(t) < 0 else 1)
    u, v = x * a + y * b, y * a - x * b
    at = np.sort(u)[[len(u) // 20, len(u) - 1 - len(u) // 20]]
    inside = (u >= at[0]) & (u <= at[1])
    u, v = u[inside] - np.median(u[inside]), v[inside] - np.median(v[inside])
    return (u * v).sum() / (u * u).sum()


def test_points_at_the_ends_stay_in_any_order_of_rows(spark):
    """Clouds of 41 points: p5 and p95 are the third point from either end."""
    rng = np.random.default_rng(5)
    clouds = {c: (rng.normal(size=41) * 9, rng.normal(size=41) * 4) for c in range(300)}
    rows = [(c, i, float(a), float(b), 0.0) for c, (x, y) in clouds.items() for i, (a, b) in enumerate(zip(x, y))]
    deal = F.udf(lambda _: secrets.randbelow(16), "int").asNondeterministic()
    df = spark.createDataFrame(rows, "cloud_id long, pt long, x double, y double, z double").withColumn("d", deal("pt")).repartition(16, "d").drop("d")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["cloud_id"]: r["slope"] for r in geom.centreline_slope(df, bounded=True).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sum(abs(got[c] - slope_by_hand(x, y)) > 1e-9 for c, (x, y) in clouds.items()) == 0
