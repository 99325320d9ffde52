"""Point analytics: voxels, visibility, neighbours, shape scores, residuals, centrelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.ranking import fits, join_same, quantiles_of
from pointmill.functions.ranking import quantiles as exact_quantiles
from pointmill.functions.scratch import materialize
from pointmill.operators import clouds
from pointmill.operators.points import XYZ, bounds, jitter, shifted
from pointmill.operators.tree import Tree

VOXEL = ("vx", "vy", "vz")


def _d2(a: str = "", b: str = "n_") -> Column:
    return sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in XYZ[1:]), (F.col(a + "x") - F.col(b + "x")) * (F.col(a + "x") - F.col(b + "x")))


def with_voxel(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({v: F.floor(F.col(c) / F.lit(float(size))).cast("bigint") for v, c in zip(VOXEL, XYZ)})


def voxel_counts(df: DataFrame, size: float) -> DataFrame:
    return with_voxel(df, size).groupBy("cloud_id", *VOXEL).agg(F.count("*").alias("n"))


def consolidate(df: DataFrame, size: float, least: float, order: list | None = None) -> DataFrame:
    """Drop conf < least; per voxel the most confident point (ties: smaller pt); size <= 0 keeps all."""
    df = df.filter(F.col("conf") >= least)
    if size <= 0:
        return df
    rank = F.row_number().over(W.partitionBy("cloud_id", *VOXEL).orderBy(*(order or [F.desc("conf"), F.asc("pt")])))
    return with_voxel(df, size).withColumn("__r", rank).filter("__r = 1").drop("__r")


def voxel_passes(df: DataFrame, size: float) -> DataFrame:
    """Pass i takes point (i mod count) of every voxel, for i below the cloud's largest count."""
    w = W.partitionBy("cloud_id", *VOXEL)
    df = with_voxel(df, size).withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("pt")) - 1)
    most = df.groupBy("cloud_id").agg(F.max("__n").alias("__m"))
    df = df.join(most, "cloud_id").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__m") - 1)))
    return df.filter(F.col("pass") % F.col("__n") == F.col("__r")).select("cloud_id", "pass", "pt")


def visible(df: DataFrame, origin: tuple[float, float, float], cell: float, mode: str = "nearest", margin: float = 0.0) -> DataFrame:
    """Per azimuth/elevation cell about the origin: the nearest point, the one closest to the median depth, or all within a margin of the nearest."""
    dx, dy, dz = (F.col(c) - F.lit(float(o)) for c, o in zip(XYZ, origin))
    df = df.withColumn("depth", F.sqrt(dx * dx + dy * dy + dz * dz)).filter("depth > 0")
    az, el = F.degrees(F.atan2(dy, dx)), F.degrees(F.asin(F.greatest(F.least(dz / F.col("depth"), F.lit(1.0)), F.lit(-1.0))))
    df = df.withColumns({"az": F.floor(F.round(az, 9) / F.lit(cell)).cast("bigint"), "el": F.floor(F.round(el, 9) / F.lit(cell)).cast("bigint")})
    w = W.partitionBy("cloud_id", "az", "el")
    if mode == "margin":
        return df.withColumn("__m", F.min("depth").over(w)).filter(F.col("depth") <= F.col("__m") + margin).drop("__m")
    key = F.round("depth", 9)
    if mode == "median":
        middle = df.groupBy("cloud_id", "az", "el").agg(F.median("depth").alias("__m"))
        df = df.join(middle, ["cloud_id", "az", "el"])
        key = F.round(F.abs(F.col("depth") - F.col("__m")), 9)
    return df.withColumn("__r", F.row_number().over(w.orderBy(key, "pt"))).filter("__r = 1").drop("__r", "__m")


#: Clouds of up to so many points are met whole; larger ones through a tree.
WHOLE_UP_TO = 4096


def nearest(points: DataFrame, others: DataFrame, keys: list[str], ids: list[str], k: int, whole_up_to: int = WHOLE_UP_TO, distance_only: bool = False) -> DataFrame:
    """The k nearest of ``others`` (keys, n_pt, n_x, n_y, n_z) with equal keys for each of ``points`` (keys, ids, x, y, z): both sides' columns, d2 and rank; ties by
    smaller n_pt. Rows of others that carry the own id as n_pt are left out where ``ids`` is ["pt"]. ``distance_only``, for k = 1: no more than (keys, ids, x, y, z, d2),
    by a hash aggregate.

    Clouds of others of up to ``whole_up_to`` points are met whole, in an equi join; larger ones through a k-d tree with leaves of a bounded number of points, see
    :class:`pointmill.operators.tree.Tree`.
    """
    own = keys + ids
    n_cols = ["n_pt", "n_x", "n_y", "n_z"]
    about = others.groupBy(*keys).agg(F.count("*").alias("__n"))

    def ranked(met: DataFrame) -> DataFrame:
        met = met.filter("pt <> n_pt") if ids == ["pt"] else met
        if distance_only:
            return met.groupBy(*own, *XYZ).agg(F.min("d2").alias("d2"))
        return met.withColumn("rank", F.row_number().over(W.partitionBy(*own).orderBy(F.round("d2", 9), "n_pt"))).filter(F.col("rank") <= k)

    out_cols = [*own, *XYZ, *([] if distance_only else n_cols), "d2", *([] if distance_only else ["rank"])]
    points, others = points.select(*own, *XYZ), others.select(*keys, *n_cols)
    small, large = about.filter(F.col("__n") <= whole_up_to).select(*keys), about.filter(F.col("__n") > whole_up_to).select(*keys)
    found = ranked(points.join(small, keys).join(others, keys).withColumn("d2", _d2())).select(*out_cols)
    if large.isEmpty():
        return found
    tree = Tree(others.join(large, keys), keys, k)
    asked = materialize(points.join(large, keys), "asked")
    return found.unionByName(ranked(tree.nearest(asked, ids)).select(*out_cols))


def _points(df: DataFrame) -> DataFrame:
    return df.select("cloud_id", "pt", *(F.col(c).cast("double").alias(c) for c in XYZ))


def _long_neighbours(df: DataFrame, k: int, whole_up_to: int) -> DataFrame:
    others = df.select("cloud_id", F.col("pt").alias("n_pt"), *(F.col(c).alias("n_" + c) for c in XYZ))
    return nearest(df, others, ["cloud_id"], ["pt"], k, whole_up_to)


def neighbours(df: DataFrame, k: int, whole_up_to: int = WHOLE_UP_TO, ids_only: bool = False) -> DataFrame:
    """The k nearest other points of the same cloud: (cloud_id, pt, x, y, z, n_pt, n_x, n_y, n_z, d2, rank), without the coordinates if ``ids_only``; ties by smaller n_pt.

    Clouds of up to ``whole_up_to`` points are searched within tasks that hold some of them, see :mod:`pointmill.operators.clouds`; larger ones by :func:`nearest`.
    """
    df = _points(df)
    kinds = {f.name: f.dataType for f in df.schema.fields} | {"n_pt": df.schema["pt"].dataType, "d2": T.DoubleType(), "rank": T.IntegerType()} | {"n_" + c: T.DoubleType() for c in XYZ}
    names = ["cloud_id", "pt", *XYZ, "n_pt", *("n_" + c for c in XYZ), "d2", "rank"]
    names = [n for n in names if not ids_only or n.removeprefix("n_") not in XYZ]
    small, large, rows = clouds.by_size(df, "cloud_id", whole_up_to)
    found = clouds.within(small, "cloud_id", rows, clouds.neighbours_of(k, names), T.StructType([T.StructField(n, kinds[n]) for n in names]))
    return found if large is None else found.unionByName(_long_neighbours(large, k, whole_up_to).select(*names))


#: The scores of a point by its neighbours.
POINT_SCORES = ("curvature", "normal_x", "normal_y", "normal_z", "cv", "angle")


def point_scores(df: DataFrame, k: int, names: tuple[str, ...], whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """(cloud_id, pt, names) of every point that has another in its cloud: those of POINT_SCORES that ``names`` has, by its k nearest others.

    As :func:`shape`, :func:`distance_cv` and :func:`normal_difference` of :func:`neighbours`; within clouds of up to ``whole_up_to`` points no row of a neighbour leaves its task.
    """
    df = _points(df)
    small, large, rows = clouds.by_size(df, "cloud_id", whole_up_to)
    schema = T.StructType([*df.select("cloud_id", "pt").schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    found = clouds.within(small, "cloud_id", rows, clouds.scores_of(k, names), schema)
    if large is None:
        return found
    nb, keys = materialize(_long_neighbours(large, k, whole_up_to), "neighbours"), ["cloud_id", "pt"]
    parts = []
    if set(names) - {"cv"}:
        parts.append(shape(nb))
    if "angle" in names:
        parts.append(normal_difference(nb, parts[0]))
    if "cv" in names:
        parts.append(distance_cv(nb))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys)
    return found.unionByName(out.select(*keys, *names))


def _eigen(m: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix, largest first, in closed form."""
    q = (m["xx"] + m["yy"] + m["zz"]) / 3
    p2 = (m["xx"] - q) ** 2 + (m["yy"] - q) ** 2 + (m["zz"] - q) ** 2 + 2 * (m["xy"] ** 2 + m["xz"] ** 2 + m["yz"] ** 2)
    p = F.sqrt(p2 / 6)
    a, b, c = ((m[k] - q) for k in ("xx", "yy", "zz"))
    det = a * (b * c - m["yz"] ** 2) - m["xy"] * (m["xy"] * c - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - b * m["xz"])
    r = F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))
    phi = F.acos(r) / 3
    top, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + F.lit(2.0943951023931953))
    flat = p <= 1e-12
    return F.when(flat, q).otherwise(top), F.when(flat, q).otherwise(3 * q - top - low), F.when(flat, q).otherwise(low)


def shape(nb: DataFrame) -> DataFrame:
    """Curvature (least eigenvalue over their sum) and normal (away from the origin) of the neighbours of every point."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    agg = [F.avg("n_" + c).alias("m" + c) for c in XYZ] + [F.avg(F.col("n_" + a) * F.col("n_" + b)).alias("s" + a + b) for a, b in pairs]
    df = nb.groupBy("cloud_id", "pt").agg(*agg, *(F.first(c).alias(c) for c in XYZ))
    m = {a + b: F.col("s" + a + b) - F.col("m" + a) * F.col("m" + b) for a, b in pairs}
    top, middle, low = _eigen(m)
    total = top + middle + low
    df = df.withColumns({"curvature": F.when(total <= 1e-12, 0.0).otherwise(F.greatest(low, F.lit(0.0)) / total), "__l": low})
    rows = [[m["xx"] - F.col("__l"), m["xy"], m["xz"]], [m["xy"], m["yy"] - F.col("__l"), m["yz"]], [m["xz"], m["yz"], m["zz"] - F.col("__l")]]

    def cross(u: list[Column], v: list[Column]) -> Column:
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return F.struct((n[0] * n[0] + n[1] * n[1] + n[2] * n[2]).alias("l"), *(x.alias(c) for x, c in zip(n, XYZ)))

    df = df.withColumn("__n", F.greatest(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])))
    side = F.col("__n.x") * F.col("x") + F.col("__n.y") * F.col("y") + F.col("__n.z") * F.col("z")
    length = F.sqrt("__n.l") * F.when(side < 0, -1.0).otherwise(1.0)
    normal = {"normal_" + c: F.when(F.col("__n.l") <= 0, 1.0 if c == "z" else 0.0).otherwise(F.col("__n." + c) / length) for c in XYZ}
    return df.withColumns(normal).select("cloud_id", "pt", "curvature", *normal)


def distance_cv(nb: DataFrame) -> DataFrame:
    d = F.sqrt("d2")
    return nb.groupBy("cloud_id", "pt").agg((F.stddev_pop(d) / F.avg(d)).alias("cv"))


def normal_difference(nb: DataFrame, shapes: DataFrame) -> DataFrame:
    """Angle in degrees between a normal and the mean of its neighbours' normals, turned to its side."""
    own = shapes.select("cloud_id", "pt", *(F.col("normal_" + c).alias(c + "0") for c in XYZ))
    near = shapes.select("cloud_id", F.col("pt").alias("n_pt"), *(F.col("normal_" + c).alias(c + "1") for c in XYZ))
    df = nb.select("cloud_id", "pt", "n_pt").join(own, ["cloud_id", "pt"]).join(near, ["cloud_id", "n_pt"])
    sign = F.when(F.col("x0") * F.col("x1") + F.col("y0") * F.col("y1") + F.col("z0") * F.col("z1") < 0, -1.0).otherwise(1.0)
    df = df.groupBy("cloud_id", "pt").agg(*(F.first(c + "0").alias(c + "0") for c in XYZ), *(F.avg(F.col(c + "1") * sign).alias(c + "m") for c in XYZ))
    dot = sum((F.col(c + "0") * F.col(c + "m") for c in XYZ[1:]), F.col("x0") * F.col("xm"))
    size = F.sqrt(sum((F.col(c + "m") * F.col(c + "m") for c in XYZ[1:]), F.col("xm") * F.col("xm")))
    return df.select("cloud_id", "pt", F.degrees(F.acos(F.greatest(F.least(dot / F.greatest(size, F.lit(1e-12)), F.lit(1.0)), F.lit(-1.0)))).alias("angle"))


def transfer_threshold(df: DataFrame, a: str, t: float, b: str) -> DataFrame:
    """The quantile of b that marks as large a share as a >= t does."""
    ratio = df.agg(F.avg((F.col(a) >= t).cast("double"))).first()[0] or 0.0  # one scalar
    return exact_quantiles(df, b, [1 - ratio]).select(F.round(F.lit(ratio), 6).alias("ratio"), F.round(F.get("q", F.lit(0)), 6).alias("threshold"))


def sweep(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return df.select(score).crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.round(F.avg((F.col(score) >= F.col("threshold")).cast("double")), 6).alias("share"))


def quantiles(df: DataFrame, score: str, at: list[float]) -> DataFrame:
    return exact_quantiles(df, score, at).select(*(F.round(F.get("q", F.lit(i)), 6).alias(f"p{round(100 * p)}") for i, p in enumerate(at)))


def jaccard(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """|A and B| / |A or B| of two flags per group; an empty union is 1."""
    both, either = F.sum((a & b).cast("int")), F.sum((a | b).cast("int"))
    return df.groupBy(*by).agg(F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


#: The scores of a point that labels are made of.
SCORES = ("curvature", "cv", "angle")


def shape_scores(nb: DataFrame) -> DataFrame:
    """(cloud_id, pt, curvature, cv, angle) of every point with neighbours."""
    s = shape(nb)
    keys = ["cloud_id", "pt"]
    return s.select(*keys, "curvature").join(distance_cv(nb), keys).join(normal_difference(nb, s), keys)


def _flags(scores: DataFrame, thresholds: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, label, flag): whether each score, to nine places, is at its threshold or above."""
    made = [F.struct(F.lit(n).alias("label"), F.coalesce(F.round(n, 9) >= t, F.lit(False)).alias("flag")) for n, t in thresholds.items()]
    return scores.select(*keys, F.explode(F.array(*made)).alias("x")).select(*keys, "x.label", "x.flag")


def method_agreement(nb: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(cloud_id, a, b, jaccard): how far the labels of every two scores agree in each cloud."""
    return score_agreement(shape_scores(nb), thresholds)


def score_agreement(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The same of scores that are there, see :func:`point_scores`."""
    flags = scores.select("cloud_id", *((F.coalesce(F.round(n, 9) >= t, F.lit(False))).alias(n) for n, t in thresholds.items()))
    both = [(a, b) for i, a in enumerate(thresholds) for b in list(thresholds)[i + 1 :]]
    counts = [f.alias(f"{n}{i}") for i, (a, b) in enumerate(both) for n, f in (("b", F.count_if(F.col(a) & F.col(b))), ("e", F.count_if(F.col(a) | F.col(b))))]
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"e{i}") == 0, 1.0).otherwise(F.col(f"b{i}") / F.col(f"e{i}")).alias("jaccard")) for i, (a, b) in enumerate(both)]
    return flags.groupBy("cloud_id").agg(*counts).select("cloud_id", F.explode(F.array(*each)).alias("x")).select("cloud_id", "x.*")


def jitter_stability(points: DataFrame, k: int, thresholds: dict[str, float], repeats: int, sigma: float, clip: float, whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """(cloud_id, view_id, label, jaccard): the mean, over ``repeats`` of clipped noise, of the Jaccard index of each label of a view before and after.

    Labels are scores of the k nearest of the same view, see :func:`point_scores`, at ``thresholds`` or above. Views of up to ``whole_up_to`` points are judged within a task each, which gets
    all their places in one row a point; so only points are shuffled. Larger ones: see :func:`_large_stability`.
    """
    whole = points.select(F.concat_ws("/", "cloud_id", "view_id").alias("__view"), "cloud_id", "view_id", "pt", *(F.col(c).cast("double").alias(c) for c in XYZ))
    small, large, rows = clouds.by_size(whole, "__view", whole_up_to)
    places, moved = [list(XYZ)], small
    for rep in range(1, repeats + 1):
        own = [f"__{c}{rep}" for c in XYZ]
        moved = moved.withColumns({n: shifted(c, sigma, clip, F.lit(rep)) for n, c in zip(own, XYZ)})
        places.append(own)
    keys = ["cloud_id", "view_id"]
    schema = T.StructType([*whole.select(*keys).schema.fields, T.StructField("label", T.StringType()), T.StructField("jaccard", T.DoubleType())])
    found = clouds.within(moved, "__view", rows, clouds.stability_of(k, thresholds, places, keys), schema)
    return found if large is None else found.unionByName(_large_stability(large, k, thresholds, repeats, sigma, clip))


def _large_stability(whole: DataFrame, k: int, thresholds: dict[str, float], repeats: int, sigma: float, clip: float) -> DataFrame:
    """Stability in views that no task could hold. Neighbours are searched once: noise moves a point by at most clip * sqrt(3), so the k nearest of every repeat lie within the k-th
    distance and four times that of each point; only these meet in the repeats."""
    keys = ["cloud_id", "pt"]
    whole = materialize(whole, "views")
    base = whole.select(F.col("__view").alias("cloud_id"), "pt", *XYZ)
    nb = materialize(_long_neighbours(base, k, 0), "neighbours")
    wanted = SCORES if set(thresholds) - {"cv"} else ("cv",)
    scores = shape_scores if len(wanted) > 1 else distance_cv
    before = _flags(scores(nb), thresholds, keys)
    slack = 4 * 3**0.5 * clip
    around = nb.groupBy(*keys).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"), F.pow(F.sqrt(F.max("d2")) + slack, 2).alias("square"))
    others = base.select("cloud_id", F.col("pt").alias("n_pt"), *(F.col(c).alias("n_" + c) for c in XYZ))
    tree = Tree(others, ["cloud_id"], k, all_copies=True)
    near = materialize(tree.within(materialize(around, "around"), ["pt"], "square").select(*keys, "n_pt"), "candidates")
    moved = jitter(whole.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))), sigma, clip, F.col("rep"))
    moved = materialize(moved.select(F.col("__view").alias("cloud_id"), "rep", "pt", *XYZ), "moved")
    met = near.join(moved, keys).join(moved.select("cloud_id", "rep", F.col("pt").alias("n_pt"), *(F.col(c).alias("n_" + c) for c in XYZ)), ["cloud_id", "rep", "n_pt"])
    rank = F.row_number().over(W.partitionBy("cloud_id", "rep", "pt").orderBy(F.round("d2", 9), "n_pt"))
    again = met.withColumn("d2", _d2()).withColumn("rank", rank).filter(F.col("rank") <= k)
    again = again.withColumn("cloud_id", F.struct("cloud_id", "rep"))
    after = _flags(scores(materialize(again, "again") if len(wanted) > 1 else again), thresholds, keys).select(F.col("cloud_id.cloud_id").alias("cloud_id"), F.col("cloud_id.rep").alias("rep"), "pt", "label", F.col("flag").alias("after"))
    per = jaccard(after.join(before, [*keys, "label"]), F.col("flag"), F.col("after"), ["cloud_id", "rep", "label"])
    mean = per.groupBy(F.col("cloud_id").alias("__view"), "label").agg(F.avg("jaccard").alias("jaccard"))
    return whole.select("__view", "cloud_id", "view_id").distinct().join(mean, "__view").drop("__view")


def score_summary(df: DataFrame, metrics: list[str], by: str = "class_name") -> DataFrame:
    """mean, median, p10, p90 of every metric per class and over all."""
    long = df.unpivot([by], metrics, "metric", "value")
    long = long.select("metric", F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col(by).alias("c")), F.struct(F.lit(True).alias("all"), F.lit("overall").alias("c")))).alias("g"), "value")
    long = long.select("metric", "g.all", F.col("g.c").alias("class_name"), "value")
    keys = ["metric", "all", "class_name"]
    out = join_same(long.groupBy(*keys).agg(F.avg("value").alias("mean")), exact_quantiles(long, "value", [0.5, 0.1, 0.9], keys), keys)
    return out.select("metric", "class_name", F.round("mean", 6).alias("mean"), *(F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("median", "p10", "p90"))))


def nearest_other(pairs: DataFrame, a: DataFrame, b: DataFrame, whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """For each pair (pair_id, a_id, b_id) and point of cloud a_id, the distance to the nearest point of b_id."""
    left = pairs.join(a.select(F.col("cloud_id").alias("a_id"), "pt", *XYZ), "a_id")
    right = b.select(F.col("cloud_id").alias("b_id"), F.col("pt").alias("n_pt"), *(F.col(c).alias("n_" + c) for c in XYZ))
    return nearest(left, right, ["b_id"], ["pair_id", "pt"], 1, whole_up_to, distance_only=True).select("pair_id", "pt", F.sqrt("d2").alias("d"))


def chamfer(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean nearest distance in either direction, added."""
    there = nearest_other(pairs, a, b).groupBy("pair_id").agg(F.avg("d").alias("ab"))
    back = nearest_other(pairs.selectExpr("pair_id", "b_id AS a_id", "a_id AS b_id"), b, a).groupBy("pair_id").agg(F.avg("d").alias("ba"))
    return there.join(back, "pair_id").withColumn("chamfer", F.col("ab") + F.col("ba"))


def registration_residuals(df: DataFrame, limits: list[float], whole_up_to: int = WHOLE_UP_TO) -> list[DataFrame]:
    """All view pairs of an object, nearest neighbours both ways: counts, RMSE of inliers (d <= limit; <= 0: all) and inlier ratio, a table for each of ``limits``.

    Distances are found once. Objects of up to ``whole_up_to`` points give a row a pair of views from within a task; of larger ones points meet by :func:`nearest`.
    """
    df = df.select("cloud_id", "view_id", "pt", *(F.col(c).cast("double").alias(c) for c in XYZ)).filter("view_id IS NOT NULL")
    small, large, rows = clouds.by_size(df, "cloud_id", whole_up_to)
    view = df.schema["view_id"].dataType
    sums = [T.StructField("n", T.LongType()), T.StructField("inliers", T.ArrayType(T.LongType())), T.StructField("squares", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([df.schema["cloud_id"], T.StructField("va", view), T.StructField("vb", view), *sums])
    found = clouds.within(small, "cloud_id", rows, clouds.residuals_of(limits), schema)
    if large is not None:
        v = large.select("cloud_id", "view_id").distinct()
        pairs = v.alias("p").join(v.alias("q"), "cloud_id").filter("p.view_id <> q.view_id").select("cloud_id", F.col("p.view_id").alias("va"), F.col("q.view_id").alias("vb"))
        left = pairs.join(large.select("cloud_id", F.col("view_id").alias("va"), "pt", *XYZ), ["cloud_id", "va"])
        right = large.select("cloud_id", F.col("view_id").alias("vb"), F.col("pt").alias("n_pt"), *(F.col(c).alias("n_" + c) for c in XYZ))
        d = nearest(left, right, ["cloud_id", "vb"], ["va", "pt"], 1, distance_only=True).withColumns({"__a": F.least("va", "vb"), "__b": F.greatest("va", "vb")})
        inside = [F.lit(True) if most <= 0 else F.col("d2") <= most * most for most in limits]
        sums = [F.array(*(F.count_if(w) for w in inside)).alias("inliers"), F.array(*(F.sum(F.when(w, F.col("d2"))) for w in inside)).alias("squares")]
        found = found.unionByName(d.groupBy("cloud_id", F.col("__a").alias("va"), F.col("__b").alias("vb")).agg(F.count("*").alias("n"), *sums))
    found = materialize(found, "residuals") if len(limits) > 1 else found  # a row a pair of views
    out = []
    for i in range(len(limits)):
        n = F.get("inliers", F.lit(i))
        rmse = F.when(n > 0, F.sqrt(F.get("squares", F.lit(i)) / n))
        out.append(found.select("cloud_id", F.concat_ws("-", "va", "vb").alias("pair"), "n", n.alias("inliers"), rmse.alias("rmse"), (n / F.col("n")).alias("inlier_ratio")))
    return out


def registration_residual(df: DataFrame, most: float = 0.0) -> DataFrame:
    """All view pairs of an object, nearest neighbours both ways: RMSE of inliers (d <= most; <= 0: all), inlier ratio, counts."""
    return registration_residuals(df, [most])[0]


def residual_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """RMSE before and after, gain absolute and in percent."""
    j = before.select("cloud_id", "pair", F.col("rmse").alias("pre")).join(after.select("cloud_id", "pair", F.col("rmse").alias("post")), ["cloud_id", "pair"])
    return j.withColumn("gain", F.col("pre") - F.col("post")).withColumn("percent", F.when(F.col("pre") > 0, 100 * F.col("gain") / F.col("pre")))


def principal_axis(df: DataFrame) -> DataFrame:
    """Unit eigenvector (ax, ay), y >= 0, of the xy covariance; fewer than 3 points: (1, 0). Angle theta = atan2(2 cxy, cxx - cyy) / 2."""
    c = df.groupBy("cloud_id").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("c"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    t = F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2
    sign = F.when(F.sin(t) < 0, -1.0).otherwise(1.0)
    few = F.col("n") < 3
    return c.select("cloud_id", F.when(few, 1.0).otherwise(F.cos(t) * sign).alias("ax"), F.when(few, 0.0).otherwise(F.sin(t) * sign).alias("ay"))


def _projected(df: DataFrame, axis: DataFrame) -> DataFrame:
    return df.join(axis, "cloud_id").select("cloud_id", "ax", "ay", "z", (F.col("x") * F.col("ax") + F.col("y") * F.col("ay")).alias("u"), (F.col("y") * F.col("ax") - F.col("x") * F.col("ay")).alias("v"))


def centreline(df: DataFrame, axis: DataFrame | None = None, bounded: bool | None = None) -> DataFrame:
    """1st/99th percentiles along and across the axis: ends, centre across, length and width. ``bounded``: see :func:`quantiles_of`."""
    bounded = fits(df, ["cloud_id"]) if bounded is None else bounded
    axis = principal_axis(df) if axis is None else axis
    ends = [0.01, 0.99]
    g = quantiles_of(_projected(df, axis), {"u": ends, "v": ends}, ["cloud_id", "ax", "ay"], [F.min("z").alias("ground")], bounded)
    lo, hi = (lambda c: F.get(c, F.lit(0))), (lambda c: F.get(c, F.lit(1)))
    return g.select("cloud_id", "ax", "ay", lo("u").alias("u_min"), hi("u").alias("u_max"), ((lo("v") + hi("v")) / 2).alias("v_mid"), (hi("u") - lo("u")).alias("length"), (hi("v") - lo("v")).alias("width"), "ground")


def centreline_slope(df: DataFrame, least: int = 20, bounded: bool | None = None, axis: DataFrame | None = None) -> DataFrame:
    """Least squares through 0 of median-centred v on u between p5 and p95 of u; null under ``least`` points.

    ``axis``, the written principal axis, is read twice: its sums, taken anew, may differ in the last bit, and a point at p5 would lie beyond it.
    """
    bounded = fits(df, ["cloud_id"]) if bounded is None else bounded
    axis = materialize(principal_axis(df), "axis") if axis is None else axis
    p = _projected(df, axis).select("cloud_id", "u", "v")
    p = p.join(quantiles_of(p.select("cloud_id", F.col("u").alias("q")), {"q": [0.05, 0.95]}, ["cloud_id"], (), bounded), "cloud_id")
    p = p.filter((F.col("u") >= F.get("q", F.lit(0))) & (F.col("u") <= F.get("q", F.lit(1)))).drop("q")
    m = quantiles_of(p.select("cloud_id", F.col("u").alias("mu"), F.col("v").alias("mv")), {"mu": [0.5], "mv": [0.5]}, ["cloud_id"], (), bounded)
    centred = [(F.col(c) - F.get("m" + c, F.lit(0))).alias(c) for c in "uv"]
    s = p.join(m, "cloud_id").select("cloud_id", *centred).groupBy("cloud_id").agg(F.count("*").alias("n"), (F.sum(F.col("u") * F.col("v")) / F.sum(F.col("u") * F.col("u"))).alias("slope"))
    return s.select("cloud_id", F.when(F.col("n") >= least, F.col("slope")).alias("slope"))


def straighten(df: DataFrame) -> DataFrame:
    """The centreline model after turning the axis by the slope's angle."""
    bounded = fits(df, ["cloud_id"])
    axis = materialize(principal_axis(df), "axis")
    axis = axis.join(centreline_slope(df, bounded=bounded, axis=axis), "cloud_id")
    t = F.atan(F.coalesce("slope", F.lit(0.0)))
    turned = axis.select("cloud_id", (F.col("ax") * F.cos(t) - F.col("ay") * F.sin(t)).alias("ax"), (F.col("ay") * F.cos(t) + F.col("ax") * F.sin(t)).alias("ay"))
    return centreline(df, turned, bounded)


def best_yaw(df: DataFrame, degrees: list[float], bounded: bool | None = None) -> DataFrame:
    """The first offset of the principal axis with the least robust width."""
    bounded = fits(df, ["cloud_id"]) if bounded is None else bounded
    grid = df.sparkSession.createDataFrame([(d,) for d in degrees], "yaw double")
    p = df.join(principal_axis(df), "cloud_id").crossJoin(F.broadcast(grid))
    t = F.atan2("ay", "ax") + F.radians("yaw")
    p = p.select("cloud_id", "yaw", (F.col("y") * F.cos(t) - F.col("x") * F.sin(t)).alias("v"))
    w = quantiles_of(p, {"v": [0.01, 0.99]}, ["cloud_id", "yaw"], (), bounded)
    w = w.withColumn("width", F.round(F.get("v", F.lit(1)) - F.get("v", F.lit(0)), 6))
    return w.groupBy("cloud_id").agg(F.min_by("yaw", F.struct("width", "yaw")).alias("yaw"), F.min("width").alias("width"))


def rigid_fit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kabsch rotation (9 row-major numbers), translation and RMSE that move cloud a onto b, points paired by pt.

    The moments are one Spark aggregate; only the 3x3 SVD per pair is NumPy.
    """
    j = a.select("cloud_id", "pt", *XYZ).join(b.select("cloud_id", "pt", *(F.col(c).alias("n_" + c) for c in XYZ)), ["cloud_id", "pt"])
    agg = [F.avg(c).alias("a" + c) for c in XYZ] + [F.avg("n_" + c).alias("b" + c) for c in XYZ]
    agg += [F.avg(F.col(c) * F.col("n_" + d)).alias(f"h{c}{d}") for c in XYZ for d in XYZ]
    agg += [F.avg(sum((F.col(p + c) ** 2 for c in XYZ[1:]), F.col(p + "x") ** 2)).alias(n) for p, n in (("", "sa"), ("n_", "sb"))]

    def solve(batches):
        for m in batches:
            out = []
            for r in m.itertuples(index=False):
                ca, cb = (np.array([getattr(r, s + c) for c in XYZ]) for s in "ab")
                h = np.array([[getattr(r, f"h{c}{d}") for d in XYZ] for c in XYZ]) - np.outer(ca, cb)
                u, s, vt = np.linalg.svd(h)
                flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
                rot = vt.T @ flip @ u.T
                error = (r.sa - ca @ ca) + (r.sb - cb @ cb) - 2 * (s * np.diag(flip)).sum()
                out.append((r.cloud_id, rot.ravel().tolist(), (cb - rot @ ca).tolist(), float(np.sqrt(max(error, 0)))))
            yield pd.DataFrame(out, columns=["cloud_id", "rotation", "translation", "rmse"])

    return j.groupBy("cloud_id").agg(*agg).mapInPandas(solve, "cloud_id long, rotation array<double>, translation array<double>, rmse double")


def confidence_histogram(df: DataFrame, bins: int = 20, c: str = "confidence") -> DataFrame:
    return df.groupBy(F.greatest(F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)), F.lit(0)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def confidence_summary(df: DataFrame, least: float, c: str = "confidence") -> DataFrame:
    own = df.agg(F.round(F.avg(c), 6).alias("mean"), F.count_if(F.col(c) < least).alias("rejected"))
    return own.join(exact_quantiles(df, c, [0.5]).select(F.round(F.get("q", F.lit(0)), 6).alias("median")), F.lit(True), "left").select("mean", "median", "rejected")
