"""Best partners in time against brute force, and without a pair in a shuffle."""

import numpy as np
import pytest

import __spark_entry__
from pointmill.operators import closest
from tests.test_bounded_work import SF, shuffled


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(5)

    def side(n, first):
        known = lambda v, share: [None if rng.random() < share else x.item() for x in v]
        return list(zip(range(first, first + n), map(int, rng.integers(0, 2, n)), known(rng.integers(0, 4000, n), 0.1), known(rng.integers(0, 9, n), 0.1), known(rng.integers(0, 60, n) / 4, 0.05)))

    return side(300, 0), side(500, 1000)


@pytest.mark.parametrize("small", [False, True])
def test_closest_in_time(spark, sides, monkeypatch, small):
    if small:  # many parts, and windows that must grow
        for name, size in (("A_PART", 32), ("B_PART", 64), ("CHUNK", 8), ("WINDOW", 2)):
            monkeypatch.setattr(closest, name, size)
    a, b = (spark.createDataFrame(rows, "id long, k int, us long, user long, value double") for rows in sides)
    found = closest.closest_in_time(a, b, ["k"], 100, "value", 1.0, closest.value_gap(6), differ="user")
    want = {}
    for i, k, t, u, v in sides[0]:
        own = []
        for j, l, s, w, y in sides[1]:
            if k == l and (t is None or s is None or abs(t - s) <= 100) and (u is None or w is None or u != w):
                own.append((v is None or y is None, round(abs(v - y), 6) if v is not None and y is not None else 0.0, j))
        if own:
            unknown, score, j = min(own)
            want[i] = (j, None if unknown else score)
    assert {r["a_id"]: (r["b_id"], r["score"]) for r in found.collect()} == want and len(want) > 200


@pytest.mark.parametrize("name, table, times", [("f3_best_match", "events", 12), ("f3_boxes", "lineitem", 4)])
def test_no_pair_is_shuffled(spark, name, table, times):
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert shuffled(spark, lambda: __spark_entry__.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()) < times * rows
