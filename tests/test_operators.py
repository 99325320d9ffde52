"""Quirks and properties on small hand-made tables."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.functions import ranking
from pointmill.operators import audit, catalog, curate, geom, match, metrics, points, split
from pointmill.plans import fixtures
from pointmill.sources import ingest

SF = "/root/testdata/sf0.001"


def pcd(points_, data="ascii", fields="x y z", sizes="4 4 4", types="F F F", counts="1 1 1", declared=None):
    n = len(points_) if declared is None else declared
    head = f"# .PCD\nVERSION .7\nFIELDS {fields}\nSIZE {sizes}\nTYPE {types}\nCOUNT {counts}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {data}\n".encode()
    return head + ("\n".join(" ".join(map(str, p)) for p in points_).encode() if data == "ascii" else points_.tobytes())


def test_read_clouds(spark, tmp_path):
    (tmp_path / "a.pcd").write_bytes(pcd([(1, 2, 3), (4, 5, float("nan"))]))
    rows = np.array([(1.5, 2, 3, 7, (1, 2, 3))], dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<u2"), ("n", "<f4", 3)])
    (tmp_path / "b.pcd").write_bytes(pcd(rows, "binary", "x y z i n", "4 4 4 2 4", "F F F U F", "1 1 1 1 3"))
    (tmp_path / "cut.pcd").write_bytes(pcd([(1, 2, 3)], declared=5))
    (tmp_path / "empty.pcd").write_bytes(pcd([]))
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty float confidence\nend_header\n1 2 3 0.5\n")
    np.save(tmp_path / "n.npy", np.ones((2, 4)))
    got = {}
    for r in ingest.read_clouds(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert len(got["a.pcd"]) == 2 and got["a.pcd"][1]["z"] is None
    assert got["b.pcd"][0]["x"] == 1.5 and got["b.pcd"][0]["extra"] == {"i": 7.0, "n_0": 1.0, "n_1": 2.0, "n_2": 3.0}
    assert got["cut.pcd"][0]["error"] and got["empty.pcd"][0]["error"]
    assert got["p.ply"][0]["extra"] == {"confidence": 0.5} and len(got["n.npy"]) == 2
    counts = {r["path"].rsplit("/", 1)[1]: r["n_points"] for r in ingest.header_counts(spark, str(tmp_path)).collect()}
    assert counts == {"a.pcd": 2, "b.pcd": 1, "cut.pcd": 5, "empty.pcd": 0}


def test_manifest_and_sink(spark, tmp_path):
    (tmp_path / "m" / "train" / "car").mkdir(parents=True)
    (tmp_path / "m" / "train" / "car" / "s1.pcd").write_bytes(pcd([(1, 2, 3)]))
    schema = "split string, dataset_class string, sample_id string, dataset_pcd string"
    r = ingest.read_manifest(spark, str(tmp_path / "m"), schema).first()
    assert (r["split"], r["dataset_class"], r["sample_id"]) == ("train", "car", "s1")
    (tmp_path / "m" / "manifest.jsonl").write_text(json.dumps({"split": "val", "dataset_class": "bus", "sample_id": "x"}) + "\n")
    assert ingest.read_manifest(spark, str(tmp_path / "m"), schema).first()["split"] == "val"
    df = spark.createDataFrame([("train", "car", 1)], "split string, dataset_class string, n int")
    curate.write_dataset(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        curate.write_dataset(df, str(tmp_path / "out"))
    curate.write_dataset(df, str(tmp_path / "out"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_rules(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "A")], "predicted_class string, current_class string")
    rules = lambda t: curate.rule_table(spark.createDataFrame([(t,)], "text string"))
    assert curate.apply_rules(df, rules('{"A": ["*"], "*": []}')).count() == 2
    assert curate.apply_rules(df, rules('{"A": {"allow_sources": ["*"], "deny_sources": ["B"]}}')).count() == 1
    assert curate.apply_rules(df, rules('{"A": {"disallowed_sources": "*"}}')).count() == 0
    assert curate.apply_rules(df, rules('{"*": ["A"]}')).count() == 2
    for bad in ('{"A": {"require_equal": ["nope"]}}', '{"A": {"mode": "any"}}'):
        with pytest.raises(Exception, match="unsupported"):
            rules(bad).collect()


def test_rule_file_with_header_and_defaults(spark):
    """A file of the full format: header, list and single names, or and and, a rule without allowed sources, alias columns, default rule."""
    text = json.dumps(
        {
            "target_column": "predicted_class", "source_column": "folder_class",
            "rules": {"BUS": {"allow_sources": ["*"], "require_equal": ["folder_class", "predicted_class"], "match_mode": "or"}, "CAR": {"allow_sources": ["CAR"], "require_equal": ["folder_class", "class_name"], "match_mode": "and"}, "VAN": {"must_equal": "json_class"}, "*": []},
        }
    )
    texts = spark.createDataFrame([(text,)], "text string")
    rows = [(1, "BUS", "CAR", "X"), (2, "CAR", "CAR", "CAR"), (3, "CAR", "CAR", "BUS"), (4, "CAR", "BUS", "CAR"), (5, "VAN", "VAN", "CAR"), (6, "VAN", "CAR", "VAN"), (7, "TRAM", "TRAM", "TRAM")]
    df = spark.createDataFrame(rows, "i int, predicted_class string, current_class string, folder_class string")
    columns = curate.rule_columns(texts)
    assert columns == {"target": "predicted_class", "source": "folder_class"}
    assert sorted(r["i"] for r in curate.apply_rules(df, curate.rule_table(texts), **columns).collect()) == [1, 2, 5]
    with pytest.raises(ValueError, match="unsupported"):
        curate.rule_columns(spark.createDataFrame([('{"rules": {}, "target_column": "nope"}',)], "text string"))


def test_ground_truth_prefers_the_class(spark):
    truth = [("t1", "r", "o1", "car", "a", 0), ("t2", "r", "o1", "bus", "b", 120), ("t3", "r3", "o2", "car", "c", 0), ("t4", "r4", "o2", "bus", "d", 9), ("t5", "r5", "o3", "bus", "e", 0), ("t6", "r6", "o4", "car", "f", 5), ("t7", "r6", "o4", "car", "g", 5)]
    truth = spark.createDataFrame(truth, "stem string, run_id string, object_id string, class_name string, path string, score int")
    samples = spark.createDataFrame([("s1", "r", "o1", "car"), ("s2", "x", "o2", "car"), ("s3", "x", "o3", "car"), ("s4", "r6", "o4", "car"), ("t2", None, None, "car"), ("s6", None, None, "car")], "stem string, run_id string, object_id string, class_name string")
    got = {r["stem"]: (r["path"], r["tier"], r["ambiguous"]) for r in match.resolve_ground_truth(samples, truth).collect()}
    assert got == {"s1": ("a", 2, False), "s2": ("c", 3, False), "s3": (None, None, None), "s4": ("g", 2, True), "t2": ("b", 1, False), "s6": (None, None, None)}


def test_unreadable_sidecars_fall_back(spark):
    clouds = spark.createDataFrame([("r/pcds/a__frame_1.pcd",), ("r/pcds/b__frame_1.pcd",), ("r/pcds/c__frame_1.pcd",)], "path string")
    cars = [("r/pcds/a__frame_1.json", "{broken"), ("r/json/a.json", '{"k": 5}'), ("r/pcds/b__frame_1.json", "{}"), ("r/json/b.json", '{"k": 6}'), ("r/json/c.json", "")]
    got = {r["path"][7]: r["meta"] for r in ingest.attach_sidecars(clouds, spark.createDataFrame(cars, "path string, text string"), "k int").collect()}
    assert got["a"]["k"] == 5 and got["b"]["k"] is None and got["c"] is None


def test_audit_cases(spark):
    nan = float("nan")
    cloud = [(1, nan, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (2, 1.0, 4.0, 2.0), (3, nan, 1.0, 1.0), (3, 1.0, 1.0, 1.0)]
    stats = audit.shape_stats(spark.createDataFrame(cloud, "cloud_id long, x double, y double, z double"))
    two = stats.filter("cloud_id = 2").first()
    assert (two["aspect_xy"], two["aspect_xz"]) == (4.0, 2.0)
    manifest = spark.createDataFrame([(1, False), (2, True), (3, None), (4, None)], "cloud_id long, read_error boolean")
    got = {r["cloud_id"]: (r["hard_score"], ";".join(r["hard_reasons"])) for r in audit.hard_checks(manifest, stats).collect()}
    assert got == {1: (120.0, "non_finite_xyz;empty_or_invalid_xyz"), 2: (100.0, "pcd_read_error"), 3: (20.0, "non_finite_xyz"), 4: (100.0, "missing_pcd")}
    queued = spark.createDataFrame([(1, "low_manifest_point_count", 25.0), (2, "low_pcd_point_count", 25.0), (3, "x_extent_outlier_z9.0", 90.0), (4, "", 0.0)], "s int, reasons string, score double")
    got = {r["s"]: (r["high_priority"], r["rank"]) for r in audit.queue(queued.withColumn("c", F.lit("car")), "score", "c", "s").collect()}
    assert got == {1: (False, 2), 2: (True, 3), 3: (True, 1), 4: (False, 4)}


def test_ranks_and_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i, float(rng.integers(0, 40)) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    ranked = ranking.hash_ranked(df, ["g"], F.md5(F.col("i").cast("string")), ["i"]).toPandas()
    want = ranked.assign(h=[hashlib.md5(str(i).encode()).hexdigest() for i in ranked["i"]]).sort_values("h").groupby("g", dropna=False).cumcount() + 1
    assert len(ranked) == 500 and (ranked["__r"] == want.reindex(ranked.index)).all() and (ranked["__n"] == ranked.groupby("g", dropna=False)["i"].transform("size")).all()
    by_value = ranking.range_ranked(df, [F.desc_nulls_last("v"), F.asc("i")]).toPandas().sort_values("rank")
    assert by_value["rank"].tolist() == list(range(1, 501)) and by_value["v"].dropna().is_monotonic_decreasing
    for g, q in ((r["g"], r["q"]) for r in ranking.quantiles(df, "v", [0, 0.1, 0.5, 0.95, 1], ["g"]).collect()):
        own = [v for h, _, v in rows if h == g and v is not None]
        assert np.allclose(q, np.quantile(own, [0, 0.1, 0.5, 0.95, 1]))
    assert ranking.quantiles(df.limit(0), "v", [0.5]).first()["q"] == [None] and ranking.quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_nearest_through_the_grid_equals_brute_force(spark):
    """Clumps, outliers outside the other cloud's box, and equal points; other clouds met through the grid and whole."""
    rng = np.random.default_rng(5)
    a = [(1, i, *map(float, p)) for i, p in enumerate(np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(5, 3)) * 300, np.zeros((3, 3))]))]
    b = [(2, i, *map(float, p)) for i, p in enumerate(np.vstack([rng.normal(size=(300, 3)) * 0.01, rng.normal(size=(40, 3)) * 3]))]
    schema = "cloud_id long, pt long, x double, y double, z double"
    a, b = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, a_id long, b_id long")
    x, y = (df.toPandas().sort_values("pt")[["x", "y", "z"]].to_numpy() for df in (a, b))
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2).min(1))
    for limit in (0, 4096):
        got = geom.nearest_other(pairs, a, b, limit).toPandas().sort_values("pt")["d"].to_numpy()
        assert len(got) == len(want) and np.allclose(got, want)
    whole, grid = (sorted(map(tuple, geom.neighbours(b, 5, n).select("pt", "n_pt", "rank").collect())) for n in (4096, 0))
    assert whole == grid


def test_split_properties(spark):
    cat = fixtures.view(spark, SF, "cat")
    for counts in (split.largest_remainder, split.with_minimum):
        out = split.split_objects(cat, counts, (0.7, 0.2, 0.1), ["object_id"])
        assert out.count() == cat.count() and split.leaks(out, ["object_id"]).isEmpty()
    one = spark.createDataFrame([("a", "o1"), ("a", "o2")], "class_name string, object_id string")
    assert {r["split"] for r in split.split_objects(one, split.with_minimum, (0.7, 0.2, 0.1), ["object_id"]).collect()} == {"train", "test"}
    assert cat.count() == split.permute_labels(cat, "stem", 1).count()
    assert catalog.cap_hashed(cat, 3, "stem").groupBy("class_name").count().agg(F.max("count")).first()[0] <= 3


def test_points(spark):
    big = fixtures.view(spark, SF, "big")
    same = points.rotate_z(big, 360.0).alias("a").join(big.alias("b"), ["cloud_id", "pt"]).agg(F.max(F.abs(F.col("a.x") - F.col("b.x")))).first()[0]
    assert same < 1e-9
    fit = geom.rigid_fit(big, points.rotate_z(big, 20.0)).collect()
    assert all(r["rmse"] < 1e-4 and abs(r["rotation"][0] - math.cos(math.radians(20))) < 1e-6 for r in fit)
    pairs = big.select("cloud_id").distinct().filter("cloud_id % 2 = 0").selectExpr("cloud_id AS pair_id", "cloud_id AS a_id", "cloud_id - 1 AS b_id")
    assert not match.align_pairs(pairs, big, 0.5).isEmpty()


def test_neighbours_grid_equals_whole(spark):
    big = fixtures.view(spark, SF, "big").filter("cloud_id <= 3")
    cols = ["cloud_id", "pt", "n_pt", "rank"]
    whole, grid = (sorted(map(tuple, geom.neighbours(big, 5, n).select(cols).collect())) for n in (4096, 0))
    assert whole == grid


def test_metrics(spark):
    pred = fixtures.view(spark, SF, "pred")
    cm = metrics.confusion(pred, "current_class", "predicted_class")
    oa = cm.agg(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n"))) / F.sum("n")).first()[0]
    assert abs(oa - metrics.accuracy(pred, "current_class", "predicted_class").first()["oa"]) < 1e-6
