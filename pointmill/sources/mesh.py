"""Triangle meshes: OFF files to vertices and triangles, and area-weighted points on their surface."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.hashing import uniform
from pointmill.functions.scratch import materialize
from pointmill.operators.clouds import PARTITION, TOGETHER
from pointmill.operators.points import XYZ

#: Numbers of faces that share a block, in which areas are summed up by one task.
BLOCK = 4096
#: Meshes of up to so many vertices and faces are sampled within tasks that hold some of them.
WHOLE_UP_TO = 16_384


def numbered_lines(spark: SparkSession, folder: str, glob: str = "*.off") -> DataFrame:
    """(path, line, text): the lines of all files that are neither blank nor comments, numbered from 0 in each file.

    Spark's text source splits large files; the lines of each split are counted, and the splits before give the numbers.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.trim(F.translate("value", "\t\r", "  ")).alias("text"))
    lines = materialize(lines.filter("text <> '' AND NOT startswith(text, '#')").withColumn("__m", F.monotonically_increasing_id()), "lines")
    sizes = lines.groupBy("path", "__block").agg(F.count("*").alias("__k"), F.min("__m").alias("__lo"))
    before = F.sum("__k").over(W.partitionBy("path").orderBy("__block")) - F.col("__k")  # splits, not lines
    return lines.join(sizes.select("path", "__block", "__lo", before.alias("__b")), ["path", "__block"]).select("path", (F.col("__m") - F.col("__lo") + F.col("__b")).alias("line"), "text")


def read_meshes(spark: SparkSession, folder: str, glob: str = "*.off") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (mesh_id, v, x, y, z), triangles (mesh_id, face, v0, v1, v2) and errors (mesh_id, error) of OFF files; mesh_id is the path.

    Polygons are cut into fans around their first corner; faces of fewer than three corners are left out. Triangles are numbered in the order of the file. A file that does
    not begin with OFF, or whose counts cannot be read, gives an error and nothing else; so do missing or unreadable lines.
    """
    lines = numbered_lines(spark, folder, glob)
    first = lines.filter("line < 2").groupBy("path").agg(F.max(F.when(F.col("line") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("line") == 1, F.col("text"))).alias("b"))
    own_line = F.col("a") == "OFF"
    counts = F.split(F.when(own_line, F.col("b")).otherwise(F.trim(F.substring("a", 4, 1 << 20))), r"\s+")
    number = lambda i: F.get(counts, F.lit(i)).try_cast("long")
    head = first.select("path", F.when(own_line, 2).otherwise(1).alias("start"), F.when(F.startswith("a", F.lit("OFF")), number(0)).alias("nv"), F.when(F.startswith("a", F.lit("OFF")), number(1)).alias("nf"))
    head = materialize(head, "heads")
    parts = F.split("text", r"\s+")
    body = lines.join(head.filter("nv IS NOT NULL AND nf IS NOT NULL"), "path").withColumn("at", F.col("line") - F.col("start")).filter("at >= 0 AND at < nv + nf")
    is_vertex = F.col("at") < F.col("nv")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    n = F.get(numbers, F.lit(0)).cast("long")
    corners = F.transform(F.slice(parts, 2, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("int")), lambda p: p.try_cast("long"))
    bad = F.when(is_vertex, (F.size(parts) < 3) | F.exists(F.slice(numbers, 1, 3), lambda x: x.isNull())).otherwise(n.isNull() | (F.size(corners) < n) | F.exists(corners, lambda x: x.isNull()))
    body = materialize(body.select("path", "at", "nv", "nf", is_vertex.alias("is_vertex"), F.slice(numbers, 1, 3).alias("p"), corners.alias("c"), bad.alias("bad")), "body")
    told = body.groupBy("path").agg(F.count("*").alias("k"), F.max("bad").alias("bad"))
    error = F.when(F.col("nv").isNull() | F.col("nf").isNull(), "no OFF file").when(F.coalesce("k", F.lit(0)) < F.col("nv") + F.col("nf"), "truncated").when(F.col("bad"), "unreadable line")
    told = head.join(told, "path", "left").select("path", error.alias("error"))
    errors = told.filter("error IS NOT NULL").select(F.col("path").alias("mesh_id"), "error")
    body = body.join(told.filter("error IS NULL").select("path"), "path")
    v = body.filter("is_vertex").select(F.col("path").alias("mesh_id"), F.col("at").alias("v"), *(F.col("p")[i].alias(c) for i, c in enumerate(XYZ)))
    faces = body.filter("NOT is_vertex AND size(c) >= 3").withColumn("at", F.col("at") - F.col("nv"))
    most = faces.groupBy("path").agg((F.max(F.size("c")) - 2).alias("most"))
    fan = F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.struct((i - 1).alias("i"), F.get("c", i).alias("v1"), F.get("c", i + 1).alias("v2")))
    t = faces.join(most, "path").select(F.col("path").alias("mesh_id"), "at", "most", F.get("c", F.lit(0)).alias("v0"), F.explode(fan).alias("t"))
    return v, t.select("mesh_id", (F.col("at") * F.col("most") + F.col("t.i")).alias("face"), "v0", "t.v1", "t.v2"), errors


def _last_before(df: DataFrame, keys: list[str], place: str, marks: DataFrame, at: str, value: str) -> DataFrame:
    """``df`` with ``value`` of the last of ``marks`` (keys, at, value) whose place is not above: both sides are merged in one order, no pair is listed."""
    right = marks.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    left = df.select(*keys, F.col(place).alias("__at"), F.lit(1).alias("__side"), F.struct(*(c for c in df.columns if c not in keys)).alias("__row"))
    w = W.partitionBy(*keys).orderBy("__at", "__side", "__value").rowsBetween(W.unboundedPreceding, 0)
    merged = left.unionByName(right, allowMissingColumns=True).withColumn("__value", F.last("__value", ignorenulls=True).over(w)).filter("__side = 1")
    return merged.select(*keys, "__row.*", F.col("__value").alias(value))


def _uniforms(seed: int, mesh, n: int, *last: str) -> np.ndarray:
    """As :func:`pointmill.functions.hashing.uniform` of (seed, mesh, 0 to n - 1, last)."""
    end = "".join("::" + x for x in last)
    return np.array([int(hashlib.md5(f"{seed}::{mesh}::{i}{end}".encode()).hexdigest()[:8], 16) for i in range(n)]) / 4294967296.0


def _sampled(n: int, seed: int, scaled: bool, block: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """:func:`sample_surface` of whole meshes, by the same sums."""
    corners = [f"{c}{i}" for i in range(3) for c in XYZ]

    def f(vertices: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        known = vertices[np.isfinite(vertices[list(XYZ)].to_numpy(float)).all(1)]
        t = faces[["__mesh", "face", "v0", "v1", "v2"]].rename(columns={"__mesh": "mesh_id"})
        for i in range(3):
            t = t.merge(known[["mesh_id", "v", *XYZ]].rename(columns={"v": f"v{i}"} | {c: f"{c}{i}" for c in XYZ}), on=["mesh_id", f"v{i}"])
        t = t.sort_values(["mesh_id", "face"], kind="stable")
        x, mesh, face = t[corners].to_numpy(float).reshape(-1, 3, 3), t["mesh_id"].to_numpy(), t["face"].to_numpy(np.int64)
        starts = np.flatnonzero(np.append(True, mesh[1:] != mesh[:-1])) if len(t) else np.empty(0, int)
        drawn = {}
        for at, end in zip(starts, np.append(starts[1:], len(t))):
            p = x[at:end]
            if scaled:
                p = p - p.mean(0).sum(0) / 3
                size = np.sqrt((p**2).sum(2)).max()
                p = p / (size if size > 1e-12 else 1.0)
            area = np.sqrt((np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) ** 2).sum(1)) / 2
            p, own, area = p[area > 1e-12], face[at:end][area > 1e-12], area[area > 1e-12]
            if not len(area):
                continue
            first = np.flatnonzero(np.append(True, own[1:] // block != own[:-1] // block))
            ends = np.append(first[1:], len(area))
            upto = np.concatenate([np.cumsum(area[a:b]) for a, b in zip(first, ends)])
            before = upto - area
            size = np.maximum.reduceat(before + area, first)
            start, total = np.cumsum(size) - size, np.cumsum(size)[-1]
            place = _uniforms(seed, mesh[at], n) * total
            which = np.searchsorted(start, place, "right") - 1
            inner = np.maximum(place - start[which], 0.0)
            hit = np.array([a + np.searchsorted(before[a:b], v, "right") - 1 for a, b, v in zip(first[which], ends[which], inner)], int)
            r1, r2 = np.sqrt(_uniforms(seed, mesh[at], n, "a"))[:, None], _uniforms(seed, mesh[at], n, "b")[:, None]
            drawn[mesh[at]] = (1 - r1) * p[hit, 0] + r1 * (1 - r2) * p[hit, 1] + r1 * r2 * p[hit, 2]
        bare = vertices[~vertices["mesh_id"].isin(list(drawn))].rename(columns={"v": "pt"})[["mesh_id", "pt", *XYZ]]
        if not drawn:
            return bare
        points = np.concatenate(list(drawn.values()))
        found = pd.DataFrame({"mesh_id": np.repeat(np.array(list(drawn), dtype=object), n), "pt": np.tile(np.arange(n), len(drawn))} | {c: points[:, i] for i, c in enumerate(XYZ)})
        return pd.concat([found, bare.astype({"mesh_id": object})]) if len(bare) else found

    return lambda v, t: f(v, t).astype({"pt": np.int64})


def sample_surface(vertices: DataFrame, faces: DataFrame, n: int, seed: int = 0, scaled: bool = False, block: int = BLOCK, whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """n area-weighted points per mesh. vertices (mesh_id, v, x, y, z), faces (mesh_id, face, v0, v1, v2), v and face being whole numbers; faces without area, with unknown or
    non-finite corners are dropped; a mesh without any gives its vertices. ``scaled`` moves a mesh's corners to their mean and divides by the largest norm first.

    Meshes of up to ``whole_up_to`` vertices and faces, whose ids are texts or whole numbers and that have no NaN, are sampled within tasks that hold some of them, so vertices and faces are shuffled once;
    larger ones by joins, see :func:`_sample_by_joins`.
    """
    kind = vertices.schema["mesh_id"].dataType
    if not isinstance(kind, (T.StringType, T.LongType, T.IntegerType)) or faces.schema["mesh_id"].dataType != kind:
        return _sample_by_joins(vertices, faces, n, seed, scaled, block)
    whole = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    v = vertices.filter("mesh_id IS NOT NULL").select("mesh_id", *whole("v"), *(F.col(c).cast("double").alias(c) for c in XYZ))
    t = faces.select("mesh_id", *whole("face", "v0", "v1", "v2")).filter("mesh_id IS NOT NULL AND face IS NOT NULL AND v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL")
    unknown = F.max(F.isnan("x") | F.isnan("y") | F.isnan("z"))  # pandas would make nulls of NaN
    each = v.groupBy("mesh_id").agg(F.count("*").alias("__n"), unknown.alias("__u")).unionByName(t.groupBy("mesh_id").agg(F.count("*").alias("__n"), F.lit(False).alias("__u")))
    sizes = each.groupBy("mesh_id").agg(F.sum("__n").alias("__n"), F.max("__u").alias("__u"))
    sizes = materialize(sizes.select("mesh_id", "__n", ((F.col("__n") > whole_up_to) | F.coalesce("__u", F.lit(False))).alias("__large")), "sizes")
    some, rows = sizes.agg(F.max("__large"), F.sum("__n")).first()
    large = None
    if some:
        large = materialize(sizes.filter("__large").select("mesh_id"), "large")
        large_v, large_t = (df.join(large, "mesh_id", "left_semi") for df in (v, t))
        v, t = (df.join(large, "mesh_id", "left_anti") for df in (v, t))
    groups = max(1, -(-(rows or 0) // TOGETHER))
    parts = max(vertices.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // PARTITION))
    v, t = (df.withColumn("__g", F.pmod(F.xxhash64("mesh_id"), F.lit(groups)).cast("int")).repartition(parts, "__g") for df in (v, t))
    v, t = v.groupBy("__g"), t.select("__g", F.col("mesh_id").alias("__mesh"), "face", "v0", "v1", "v2").groupBy("__g")  # names apart: faces may be made of vertices
    schema = T.StructType([T.StructField("mesh_id", kind), T.StructField("pt", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in XYZ)])
    found = v.cogroup(t).applyInPandas(_sampled(n, seed, scaled, block), schema)
    return found if large is None else found.unionByName(_sample_by_joins(large_v, large_t, n, seed, scaled, block))


def _sample_by_joins(vertices: DataFrame, faces: DataFrame, n: int, seed: int, scaled: bool, block: int) -> DataFrame:
    """The same, of meshes of any size.

    A draw is a place in the cumulated areas. Areas are summed in blocks of ``block`` face numbers; the draws of a mesh are merged with its blocks, and those of a block with its
    faces. So no draw meets all faces, and a task holds the blocks of one mesh, or one block, with the draws that fall there.
    """
    ok = F.lit(True)
    for c in XYZ:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    v = [vertices.filter(ok).select("mesh_id", F.col("v").alias(f"v{i}"), *(F.col(c).alias(f"{c}{i}") for c in XYZ)) for i in range(3)]
    t = faces
    for i in range(3):
        t = t.join(v[i], ["mesh_id", f"v{i}"])
    if scaled:
        t = materialize(t, "triangles")
        mean = t.groupBy("mesh_id").agg(*((sum((F.avg(f"{c}{i}") for i in (1, 2)), F.avg(f"{c}0")) / 3).alias("__" + c) for c in XYZ))
        t = t.join(mean, "mesh_id").withColumns({f"{c}{i}": F.col(f"{c}{i}") - F.col("__" + c) for c in XYZ for i in range(3)}).drop(*("__" + c for c in XYZ))
        norm = F.greatest(*(F.sqrt(F.col(f"x{i}") ** 2 + F.col(f"y{i}") ** 2 + F.col(f"z{i}") ** 2) for i in range(3)))
        size = t.groupBy("mesh_id").agg(F.max(norm).alias("__s")).withColumn("__s", F.when(F.col("__s") > 1e-12, F.col("__s")).otherwise(1.0))
        t = t.join(size, "mesh_id").withColumns({f"{c}{i}": F.col(f"{c}{i}") / F.col("__s") for c in XYZ for i in range(3)}).drop("__s")
    e, f = ({c: F.col(f"{c}{i}") - F.col(f"{c}0") for c in XYZ} for i in (1, 2))
    cross = (e["y"] * f["z"] - e["z"] * f["y"], e["z"] * f["x"] - e["x"] * f["z"], e["x"] * f["y"] - e["y"] * f["x"])
    t = t.withColumn("area", F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2) / 2).filter("area > 1e-12")
    t = materialize(t.withColumn("block", F.floor(F.col("face") / F.lit(block)).cast("long")), "faces")
    in_order = W.partitionBy("mesh_id", "block").orderBy("face")
    t = t.withColumn("before", F.sum("area").over(in_order) - F.col("area"))
    blocks = t.groupBy("mesh_id", "block").agg(F.max(F.col("before") + F.col("area")).alias("size"))
    of_mesh = W.partitionBy("mesh_id")
    blocks = blocks.withColumns({"start": F.sum("size").over(of_mesh.orderBy("block")) - F.col("size"), "total": F.sum("size").over(of_mesh)})
    blocks = materialize(blocks, "blocks")
    draws = blocks.groupBy("mesh_id").agg(F.max("total").alias("total")).withColumn("pt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    draws = draws.withColumn("place", uniform(seed, "mesh_id", "pt") * F.col("total"))
    placed = _last_before(draws, ["mesh_id"], "place", blocks, "start", "block").join(blocks.select("mesh_id", "block", "start"), ["mesh_id", "block"])
    placed = placed.withColumn("inner", F.greatest(F.col("place") - F.col("start"), F.lit(0.0))).drop("start", "total", "place")
    hit = _last_before(placed, ["mesh_id", "block"], "inner", t, "before", "face").join(t.drop("block", "before", "area"), ["mesh_id", "face"])
    r1, r2 = F.sqrt(uniform(seed, "mesh_id", "pt", F.lit("a"))), uniform(seed, "mesh_id", "pt", F.lit("b"))
    sampled = hit.select("mesh_id", "pt", *(((1 - r1) * F.col(f"{c}0") + r1 * (1 - r2) * F.col(f"{c}1") + r1 * r2 * F.col(f"{c}2")).alias(c) for c in XYZ))
    bare = vertices.join(t.select("mesh_id").distinct(), "mesh_id", "left_anti").select("mesh_id", F.col("v").cast("bigint").alias("pt"), *XYZ)
    return sampled.unionByName(bare)
