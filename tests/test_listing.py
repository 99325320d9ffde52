"""Folders are listed by tasks, as Spark's own listing would, and files are written by tasks."""

from pointmill.sources import ranges


def test_listing_equals_sparks_without_the_driver(spark, tmp_path):
    names = ["a.pcd", "b/c.ply", "b/d=1/e f%.npy", "b/_hidden/x.pcd", "b/_k=v/y.pcd", ".git/z.pcd", "b/.tmp.pcd", "b/none.txt", "b/_SUCCESS"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * (i + 1))
    (tmp_path / "empty").mkdir()
    for folder in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/a.pcd", f"{tmp_path}/[b]"):
        for glob in ("*", "*.{pcd,ply,npy}"):
            own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")
            assert sorted(map(tuple, ranges.list_files(spark, folder, glob).collect())) == sorted(map(tuple, own.collect()))
    (tmp_path / "b" / "void.pcd").touch()  # an empty file is one that can't be read, not one that isn't there
    assert [(r["path"][-8:], r["error"] is not None) for r in ranges.read_clouds(spark, str(tmp_path), "void.*").collect()] == [("void.pcd", True)]
    assert "binaryFile" not in ranges.list_files(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_texts_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('k=', id % 3, '/', id, '.txt') AS name", "concat('text é ', id, '\n') AS text").repartition(5)
    ranges.write_texts(rows, f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {f"k={i % 3}/{i}.txt": f"text é {i}\n" for i in range(50)}
