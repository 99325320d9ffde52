"""Operator 13 against brute force over all pairs, in many groups and blocks, and on odd rows."""

import numpy as np
import pytest

from pointmill.llm import negatives
from pointmill.llm.embeddings import exact_products
from pointmill.llm.negatives import Best, mine_negatives, upper_bounds, walk
from pointmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_hand(rows, every=100, k=5, n=5):
    """Rows of (vec_id, label, embedding), judged with Python's integers."""
    good = {(i, str(y), tuple(int(np.floor(np.float64(256) * x)) for x in e)) for i, y, e in rows if i is not None and y is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for a, label, q in good:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, y) for i, y, v in good if len(v) == len(q)]
        for p, i, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:k]:
            p = -p
            near = sorted(s for s in scored if s[2] != label and 80 * p <= -100 * s[0] <= 100 * p)[:n]
            out += [(a, i, r + 1, j, p, -s) for r, (s, j, _) in enumerate(near)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.0) for r in rows], "vec_id long, label int, embedding array<double>, key string, norm double")


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 6))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 12] + rng.normal(size=6) * 0.2).round(2).tolist()) for i in range(900)]
    rows += [(1000 + i, i % 2, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(300)]  # a third are copies, anchors among them
    rows += [(2000 + i, i % 3, (rng.normal(size=4)).tolist()) for i in range(60)]  # of another length
    return rows


def test_hard_negatives_equal_brute_force(spark, mixed):
    want = by_hand(mixed, every=10)
    assert len(want) > 1000
    assert got(mine_negatives(frame(spark, mixed), every=10)) == want
    assert got(mine_negatives(frame(spark, mixed), every=10, group_size=8, block_size=32, cluster_size=4)) == want  # many pivots, groups, blocks and clusters


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (100, 1, [0.0, 0.0]), (None, 1, [1.0, 1.0]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [])]
    rows += [(7, 1, [1.0, 2.0]), (8, 1, [1.0, 1.9]), (9, 2, [1.0, 2.0]), (9, 2, [1.0, 1.9]), (10, 2, [0.9, 1.9]), (11, 2, [1.0, 2.0]), (200, 3, [-1.0, -1.0]), (-100, 1, [-0.5, 0.5]), (300, 4, [2.0, 2.0])]
    assert got(mine_negatives(frame(spark, rows))) == by_hand(rows)
    assert mine_negatives(frame(spark, rows).limit(0)).count() == 0
    assert mine_negatives(frame(spark, [(1, 1, [1.0])])).count() == 0


def test_large_components_are_exact(spark):
    rows = [(100 * (i == 0) + i, i % 2, [float(2**22 + 3 * i), float(2**21 - i), 1.0 / (i + 1)]) for i in range(40)]
    assert got(mine_negatives(frame(spark, rows))) == by_hand(rows)  # 60 bits
    with pytest.raises(Exception, match="64 bits"):
        mine_negatives(frame(spark, [(i, i % 2, [1e30, 1.0]) for i in range(8)])).collect()
    u = np.array([[2.0**60, 1.0], [3.0, -(2.0**70)]])
    assert exact_products(u, np.array([[4.0, 5.0], [0.0, 1.0]]), (1 << 63) - 1).tolist() == [[(1 << 62) + 5, 1], [-(2**63) + 1, -(2**63) + 1]]


def test_share_is_a_parameter(spark, mixed):
    rows = mixed[:300]
    found = got(mine_negatives(frame(spark, rows), share=(1, 2), negatives=300, positives=2))
    wide = {(a, p): sum(1 for r in found if r[:2] == (a, p)) for a, p, *_ in found}
    tight = got(mine_negatives(frame(spark, rows), negatives=300, positives=2))
    assert all(2 * r[5] >= r[4] >= r[5] for r in found) and sum(wide.values()) > len(tight) and set(tight) <= set(found)


def test_lists_end_early_and_certified():
    rng = np.random.default_rng(14)
    v = (rng.normal(size=(4000, 8)) * 10).round()
    q = v[:200] * 3
    best = Best(np.full(200, -(1 << 62)), None, 3)
    seen = walk(q, v, lambda m: best.low[m], lambda m, e, s: best.add(m, e, e, s, np.ones(s.shape, bool)), size=8, step=64)
    assert seen < 200 * 4000 * 0.8
    score = q @ v.T
    want = -np.sort(-score, 1)[:, :3]
    assert (np.sort(best.found[2].reshape(200, 3)) == np.sort(want)).all()


def test_upper_bounds_hold():
    rng = np.random.default_rng(15)
    unit, norm = negatives._unit(rng.normal(size=(500, 5)))
    users, _ = negatives._unit(rng.normal(size=(300, 5)))
    n = 0
    for members, centre, widest in negatives.clusters(users, 16):
        n += len(members)
        assert (upper_bounds(centre, widest, unit, norm) + 1e-9 >= (users[members] @ (unit * norm[:, None]).T)).all()
    assert n == 300


def test_query_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in df.collect()]
    assert got(QUERIES["op13_hard_negatives"](spark, SF)) == by_hand(rows)
