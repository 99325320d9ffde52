"""Byte ranges, headers, meshes, sidecars, manifests and the feed's commits on files made here."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.functions.scratch import materialize, remove_scratch
from pointmill.operators import audit
from pointmill.sources import ingest, mesh, ranges
from pointmill.streaming import feed as feeds


def clouds(folder):
    """(file, rows of x, y, z and more) of every format, in files of several ranges of 512 bytes."""
    rng = np.random.default_rng(1)
    table = rng.normal(size=(97, 5)).round(3)
    table[5, 1] = np.nan
    text = "\n".join(" ".join(map(str, r)) + ("\n\n# note" if i % 9 == 0 else "") for i, r in enumerate(table))
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f8"), ("i", "<u2"), ("t", "<i8")])
    rows = np.zeros(61, kind)
    for c in "xyz":
        rows[c] = rng.integers(0, 100, 61)
    rows["i"], rows["t"] = np.arange(61), np.arange(61) * 10
    pcd = "VERSION .7\nFIELDS x y z i t\nSIZE {}\nTYPE {}\nCOUNT 1 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {}\n"
    (folder / "a.pcd").write_text(pcd.format("8 8 8 8 8", "F F F F F", "ascii", n=97) + text)
    (folder / "b.pcd").write_bytes(pcd.format("4 4 8 2 8", "F F F U I", "binary", n=61).encode() + rows.tobytes())
    ply = "ply\nformat {} 1.0\nelement vertex {}\nproperty {f} x\nproperty {f} y\nproperty {g} z\nproperty {h} i\nproperty {k} t\nend_header\n"
    (folder / "c.ply").write_text(ply.format("ascii", 97, f="float", g="float", h="float", k="float") + text + "\n3 1 2 3\n")  # a face behind the vertices
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 61\nproperty float x\nproperty float y\nproperty double z\nproperty ushort i\nproperty double t\nend_header\n"
    packed = np.zeros(61, np.dtype([(c, t) for c, t in zip(("x", "y", "z", "i", "t"), ("<f4", "<f4", "<f8", "<u2", "<f8"))]))
    for c in packed.dtype.names:
        packed[c] = rows[c]
    (folder / "d.ply").write_bytes(head.encode() + packed.tobytes())
    np.save(folder / "e.npy", table)
    np.save(folder / "f.npy", np.asfortranarray(table.astype("<f4")))
    wide = np.array([[float(r[c]) for c in ("x", "y", "z", "i", "t")] for r in rows])
    return {"a.pcd": table, "b.pcd": wide, "c.ply": table, "d.ply": wide, "e.npy": table, "f.npy": table.astype("<f4").astype(float)}


def test_ranges_give_every_point_once(spark, tmp_path):
    want = clouds(tmp_path)
    for size in (512, 1 << 25):
        read = ranges.read_clouds(spark, str(tmp_path), range_bytes=size)
        got = {}
        for r in read.collect():
            assert r["error"] is None
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["pt"]] = [r["x"], r["y"], r["z"], *(v for _, v in sorted(r["extra"].items()))]
        assert got.keys() == want.keys()
        for name, rows in want.items():
            assert sorted(got[name]) == list(range(len(rows)))
            found = np.array([[np.nan if v is None else v for v in got[name][i]] for i in range(len(rows))])
            assert np.allclose(found, rows, equal_nan=True), name
        if size == 512:
            assert read.filter("path LIKE '%b.pcd'").select(F.spark_partition_id()).distinct().count() > 1


def test_bad_files_give_one_row(spark, tmp_path):
    head = "FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {k}\n"
    many = "\n".join("1 2 3" for _ in range(200))
    files = {"cut.pcd": head.format(n=300, k="ascii") + many, "word.pcd": head.format(n=200, k="ascii") + many.replace("1 2 3", "1 oops 3", 1), "wide.pcd": head.format(n=200, k="ascii") + many + " 4", "short.pcd": head.format(n=9, k="binary") + "xx"}
    files |= {"none.pcd": head.format(n=0, k="ascii"), "no.pcd": "nothing\n" * 10_000, "zip.pcd": head.format(n=1, k="binary_compressed"), "x.npy": "no", "flat.ply": "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = ranges.read_clouds(spark, str(tmp_path), range_bytes=512).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == sorted(files) and all(r["error"] and r["pt"] is None and r["extra"] is None for r in got)


def test_headers_read_four_kilobytes(tmp_path, monkeypatch):
    body = np.zeros(300_000, "<f4").tobytes()
    path = tmp_path / "big.pcd"
    path.write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nWIDTH 100000\nHEIGHT 1\nDATA binary\n" + body)
    read = []
    real = ranges.read_bytes
    monkeypatch.setattr(ranges, "read_bytes", lambda p, a, n: read.append(n) or real(p, a, n))
    size = path.stat().st_size
    assert ranges.points_declared(str(path), size) == 100_000 and ranges.read_head(str(path), size, "pcd")["n"] == 100_000
    assert read == [4096, 4096]
    path.write_bytes(b"# long\n" * 900 + b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nWIDTH 1\nHEIGHT 1\nDATA binary\n" + body)
    assert ranges.read_head(str(path), path.stat().st_size, "pcd")["offset"] > 6300 and sum(read[2:]) <= 4 * 4096


def test_off_files(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF\n# a square and a pentagon\n6 3 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n\n2 2 2 255 0 0\n3 1 nan\n4 0 1 2 3\n2 0 1\n5 0 1 2 3 4\n")
    (tmp_path / "b.off").write_text("OFF3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "c.off").write_text("ply\n3 1 0\n")
    (tmp_path / "d.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n")
    (tmp_path / "e.off").write_text("OFF\n3 1 0\n0 0 0\n1 x 0\n0 1 0\n3 0 1 2\n")
    v, f, e = mesh.read_meshes(spark, str(tmp_path))
    name = lambda r: r["mesh_id"].rsplit("/", 1)[1]
    assert sorted((name(r), r["v"]) for r in v.collect()) == [("a.off", i) for i in range(6)] + [("b.off", i) for i in range(3)]
    got = sorted((name(r), r["face"], r["v0"], r["v1"], r["v2"]) for r in f.collect())
    assert got == [("a.off", 0, 0, 1, 2), ("a.off", 1, 0, 2, 3), ("a.off", 6, 0, 1, 2), ("a.off", 7, 0, 2, 3), ("a.off", 8, 0, 3, 4), ("b.off", 0, 0, 1, 2)]
    assert sorted((name(r), r["error"]) for r in e.collect()) == [("c.off", "no OFF file"), ("d.off", "truncated"), ("e.off", "unreadable line")]


def uniform(*key):
    return int(hashlib.md5("::".join(map(str, (0, *key))).encode()).hexdigest()[:8], 16) / 2**32


def test_draws_over_many_blocks(spark):
    """Faces in many blocks, among them ones without area, with unknown and infinite corners; scaled; against direct arithmetic."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * (4, 1, 1) + 10
    x[7] = np.inf
    faces = rng.integers(0, 400, (900, 3))
    faces[::50, 2] = faces[::50, 1]  # no area
    faces[3] = (0, 1, 5000)
    v = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(x)] + [("bare", 0, 1.0, 2.0, 3.0)], "mesh_id string, v long, x double, y double, z double")
    f = spark.createDataFrame([("m", i, *map(int, t)) for i, t in enumerate(faces)], "mesh_id string, face long, v0 long, v1 long, v2 long")
    got = {(r["mesh_id"], r["pt"]): (r["x"], r["y"], r["z"]) for r in mesh.sample_surface(v, f, 300, scaled=True, block=16).collect()}
    assert got.pop(("bare", 0)) == (1.0, 2.0, 3.0) and len(got) == 300
    good = [t for t in faces if (t < 400).all() and np.isfinite(x[t]).all()]
    t = x[np.array(good)]
    t = t - t.mean((0, 1))
    t = t / np.linalg.norm(t.reshape(-1, 3), axis=1).max()
    area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) / 2
    t, area = t[area > 1e-12], area[area > 1e-12]
    hi = np.cumsum(area) / area.sum()
    for i in range(300):
        own = t[np.searchsorted(hi, uniform("m", i), side="right")]
        a, b = np.sqrt(uniform("m", i, "a")), uniform("m", i, "b")
        assert np.abs(np.array(got["m", i]) - ((1 - a) * own[0] + a * (1 - b) * own[1] + a * b * own[2])).max() < 1e-9
    assert mesh.sample_surface(v.limit(0), f.limit(0), 5).count() == 0


def test_sidecars_by_folder_and_order(spark):
    c = spark.createDataFrame([(i, p) for i, p in enumerate(("r/a/pcds/s__frame_1.pcd", "r/b/pcds/s__frame_1.pcd", "r/a/pcds/t__frame_2.pcd", "r/a/x/s__frame_1.pcd", "pcds/u.pcd", "r/a/pcds/v.pcd"))], "i int, path string")
    s = [("r/a/pcds/s__frame_1.json", '{"k": 1}'), ("r/a/json/s.json", '{"k": 2}'), ("r/b/json/s.json", '{"k": 3}'), ("r/b/json/s.json", '{"k": 4}'), ("r/a/pcds/t__frame_2.json", "{broken"), ("r/a/json/t.json", '{"k": 5}'), ("json/u.json", '{"k": 6}'), ("r/json/s.json", '{"k": 9}')]
    got = ingest.attach_sidecars(c, spark.createDataFrame(s, "path string, text string"), "k int").collect()
    assert sorted((r["i"], r["meta"]["k"] if r["meta"] else None) for r in got) == [(0, 1), (1, 3), (2, 5), (3, None), (4, 6), (5, None)]


def test_validation_of_meshes_reads_test(spark):
    p = spark.createDataFrame([("r/chair/train/a.off",), ("r/chair/test/b.off",), ("r/train/car/c.pcd",), ("r/val/car/d.pcd",), ("r/test/car/e.pcd",)], "path string")
    read = lambda s: sorted(r["path"][-5] for r in ingest.of_split(p, s).collect())
    assert (read("train"), read("val"), read("test")) == (["a", "c"], ["b", "d"], ["b", "e"])


def test_manifest_of_a_subfolder_is_not_taken(spark, tmp_path):
    (tmp_path / "train" / "car" / "more").mkdir(parents=True)
    (tmp_path / "train" / "car" / "s1.pcd").write_text("x")
    (tmp_path / "train" / "car" / "more" / "manifest.jsonl").write_text(json.dumps({"split": "no"}) + "\n")
    schema = "split string, dataset_class string, sample_id string, dataset_pcd string"
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert [r["split"] for r in ingest.read_manifest(spark, folder, schema).collect()] == ["train"]


def test_error_type_in_reasons(spark):
    m = spark.createDataFrame([(1, True, "ValueError"), (2, True, None), (3, False, None)], "cloud_id long, read_error boolean, error_type string")
    stats = spark.createDataFrame([(3, 5, 5)], "cloud_id long, n_points long, n_finite long")
    got = {r["cloud_id"]: r["hard_reasons"] for r in audit.hard_checks(m, stats).collect()}
    assert got == {1: ["pcd_read_error:ValueError"], 2: ["pcd_read_error"], 3: []}


def test_half_a_batch_is_never_seen(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    make = lambda i: spark.createDataFrame([(i, i % 2, [0.0, 1.0])], "id long, label long, logits array<double>").write.mode("append").parquet(str(source))
    start = lambda: feeds.feed(spark, str(source), "id long, label long, logits array<double>", "label", out, f"{out}/state")
    seen = lambda: [sorted(r["id"] for r in feeds.read_feed(spark, out, t).collect()) for t in ("predictions", "mismatches")]
    make(2)
    start().awaitTermination()
    assert seen() == [[2], [2]]
    make(4)
    with monkeypatch.context() as m:
        m.setattr(feeds, "mismatches", lambda *a: (_ for _ in ()).throw(RuntimeError("between")))
        with pytest.raises(Exception, match="between"):
            start().awaitTermination()
    assert spark.read.parquet(f"{out}/predictions").count() == 2 and seen() == [[2], [2]]  # half of the second batch lies there
    start().awaitTermination()
    assert seen() == [[2, 4], [2, 4]]


def test_scratch_is_removed(spark):
    df = materialize(spark.range(5), "some")
    assert df.count() == 5
    path = df.inputFiles()[0]
    remove_scratch(spark)
    with pytest.raises(FileNotFoundError):
        ranges.read_bytes(path, 0, 1)
