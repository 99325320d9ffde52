"""Point transforms on the points table: cloud_id, pt, x, y, z and optional view_id, conf, label."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.hashing import hash_key, uniform
from pointmill.functions.ranking import first_of, fits, hash_ranked
from pointmill.functions.scratch import materialize

XYZ = ("x", "y", "z")
_PT = ("cloud_id", "pt")


def finite() -> Column:
    ok = F.lit(True)
    for c in XYZ:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return ok


def bounds(df: DataFrame, by: str = "cloud_id") -> DataFrame:
    """min, max, mean of the finite points per cloud, with finite and total counts."""
    ok = finite()
    agg = [f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.groupBy(by).agg(*agg, F.count_if(ok).alias("n_finite"), F.count("*").alias("n_points"))


def _centred(df: DataFrame, centre: DataFrame, radius_of: str, keys: list[str]) -> DataFrame:
    """Subtract cx, cy, cz of ``centre`` and divide by the largest norm per ``radius_of`` (1 if it is 1e-8 or less)."""
    df = df.join(centre, keys).withColumns({c: F.col(c) - F.col("c" + c) for c in XYZ})
    r = df.groupBy(radius_of).agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("radius"))
    r = r.withColumn("radius", F.when(F.col("radius") <= 1e-8, 1.0).otherwise(F.col("radius")))
    return df.join(r, radius_of).withColumns({c: F.col(c) / F.col("radius") for c in XYZ})


def _centroid(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(*(F.avg(c).alias("c" + c) for c in XYZ))


def unit_sphere(df: DataFrame) -> DataFrame:
    return _centred(df, _centroid(df, "cloud_id"), "cloud_id", ["cloud_id"]).drop("cx", "cy", "cz", "radius")


def shared_normalise(df: DataFrame) -> DataFrame:
    """Centroid of the first view, one radius over all views of the object; sensor origin is -c/r."""
    first = df.groupBy("cloud_id").agg(F.min("view_id").alias("__v"))
    centre = _centroid(df.join(first, "cloud_id").filter("view_id = __v"), "cloud_id")
    out = _centred(df, centre, "cloud_id", ["cloud_id"])
    return out.withColumns({"origin_" + c: -F.col("c" + c) / F.col("radius") for c in XYZ}).drop("cx", "cy", "cz", "radius")


def pair_normalise(df: DataFrame, partial: Column) -> DataFrame:
    """Centroid of the partial cloud, radius of the centred complete one; ``partial`` marks the partial cloud's points."""
    centre = _centroid(df.filter(partial), "cloud_id")
    df = df.join(centre, "cloud_id").withColumns({c: F.col(c) - F.col("c" + c) for c in XYZ})
    r = df.groupBy("cloud_id").agg(F.max(F.when(~partial, F.sqrt(sum((F.col(c) * F.col(c) for c in XYZ[1:]), F.col("x") * F.col("x"))))).alias("radius"))
    r = r.withColumn("radius", F.when(F.col("radius") <= 1e-8, 1.0).otherwise(F.col("radius")))
    return df.join(r, "cloud_id").withColumns({c: F.col(c) / F.col("radius") for c in XYZ}).drop("cx", "cy", "cz", "radius")


def joint_rescale(df: DataFrame) -> DataFrame:
    """All points of a cloud_id, partial and complete, divided by their largest norm (by 1 if it is 1e-8 or less), as after resampling a normalised pair."""
    r = df.groupBy("cloud_id").agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("radius"))
    r = r.withColumn("radius", F.when(F.col("radius") <= 1e-8, 1.0).otherwise(F.col("radius")))
    return df.join(r, "cloud_id").withColumns({c: F.col(c) / F.col("radius") for c in XYZ}).drop("radius")


def object_features(df: DataFrame, most: tuple[float, float, float], distance: Column, scale: float = 20.0) -> DataFrame:
    """Extents over fixed maximal sizes, and sensor distance / 20."""
    b = bounds(df)
    size = [((F.col("max_" + c) - F.col("min_" + c)) / m).alias("size_" + c) for c, m in zip(XYZ, most)]
    return b.select("cloud_id", *size, (distance / scale).alias("range_feature"))


def resample(df: DataFrame, n: int, bins: int = 8, seed: int = 0, bounded: bool | None = None) -> DataFrame:
    """n points per cloud: equal quotas from equal bins of the longest axis in hash order, the shortfall from the rest, repeats if the cloud is small. Where a cloud is too large for
    one task (``bounded`` is false, or found to be), ranks come from cells by hash."""
    bounded = fits(df, ["cloud_id"]) if bounded is None else bounded
    b = bounds(df).select("cloud_id", *("min_" + c for c in XYZ), *((F.col("max_" + c) - F.col("min_" + c)).alias("e" + c) for c in XYZ))
    df = df.join(b, "cloud_id")
    use_x, use_y = (F.col("ex") >= F.col("ey")) & (F.col("ex") >= F.col("ez")), F.col("ey") >= F.col("ez")
    value = F.when(use_x, F.col("x") - F.col("min_x")).when(use_y, F.col("y") - F.col("min_y")).otherwise(F.col("z") - F.col("min_z"))
    width = F.greatest("ex", "ey", "ez")
    df = df.withColumn("bin", F.when(width <= 0, 0).otherwise(F.least(F.floor(value / width * bins), F.lit(bins - 1))).cast("int"))
    df = df.withColumn("__h", hash_key(seed, "cloud_id", "pt"))
    filled = df.groupBy("cloud_id").agg(F.count_distinct("bin").alias("__bins"), F.count("*").alias("__n"))
    df = df.join(filled, "cloud_id")
    quota = F.floor(F.lit(n) / F.col("__bins"))
    if bounded:
        df = df.withColumn("__r", F.row_number().over(W.partitionBy("cloud_id", "bin").orderBy("__h", "pt")))
        df = df.withColumn("__p", F.row_number().over(W.partitionBy("cloud_id").orderBy(F.col("__r") > quota, "__h", "pt")) - 1)
    else:
        df = hash_ranked(materialize(df, "binned").withColumnRenamed("__n", "__size"), ["cloud_id", "bin"], F.col("__h"), ["pt"]).drop("__n")
        df = materialize(df.withColumn("__x", F.col("__r") > quota).drop("__r"), "quotas")
        own = df.filter("NOT __x").groupBy("cloud_id").agg(F.count("*").alias("__own"))
        df = hash_ranked(df, ["cloud_id", "__x"], F.col("__h"), ["pt"]).drop("__n").join(own, "cloud_id", "left")
        df = df.withColumn("__p", F.col("__r") - 1 + F.when(F.col("__x"), F.coalesce("__own", F.lit(0))).otherwise(0)).withColumnRenamed("__size", "__n")
    copies = F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(n) / F.col("__n")).cast("int") - 1, F.lit(0)))
    out = df.withColumn("__c", F.explode(copies)).withColumn("place", (F.col("__c") * F.col("__n") + F.col("__p")).cast("bigint")).filter(F.col("place") < n)
    return out.select("cloud_id", "pt", *XYZ, F.col("bin").cast("bigint").alias("bin"), "place")


def dropout(df: DataFrame, low: float, high: float, seed: int = 0) -> DataFrame:
    """Drop rate per cloud in [low, high]; a cloud of which none is left keeps the point of the greatest number, of equal ones the smaller pt."""
    rate = low + uniform(seed, "cloud_id") * (high - low)
    u = uniform(seed, "cloud_id", "pt")
    last = df.groupBy("cloud_id").agg(F.max(F.struct(u.alias("u"), (-F.col("pt")).alias("p"))).alias("__l")).select("cloud_id", (-F.col("__l.p")).alias("__pt"))
    return df.join(last, "cloud_id").filter((u > rate) | (F.col("pt") == F.col("__pt"))).select(*df.columns)


def add_noise(df: DataFrame, ratio: float, grow: float, seed: int = 0) -> DataFrame:
    """round(n * ratio) uniform points in the bounding box scaled about its centre (half-extent at least 1e-3)."""
    b = bounds(df).withColumn("__i", F.explode(F.sequence(F.lit(1), F.round(F.col("n_points") * ratio).cast("int")))).filter("__i > 0") if ratio > 0 else bounds(df).withColumn("__i", F.lit(0)).limit(0)
    new = [((F.col("max_" + c) + F.col("min_" + c)) / 2 + (2 * uniform(seed, "cloud_id", "__i", F.lit(c)) - 1) * F.greatest((F.col("max_" + c) - F.col("min_" + c)) / 2 * grow, F.lit(1e-3))).alias(c) for c in XYZ]
    noise = b.select("cloud_id", (-F.col("__i")).cast("bigint").alias("pt"), *new, F.lit(1).alias("is_noise"))
    return df.select(*_PT, *XYZ, F.lit(0).alias("is_noise")).unionByName(noise)


def _between(bounds: float | tuple[float, float], *key) -> Column:
    """The number, or a hash uniform of the key between two."""
    low, high = bounds if isinstance(bounds, tuple) else (bounds, bounds)
    return F.lit(float(low)) if low == high else low + uniform(*key) * (high - low)


def top_down(df: DataFrame, keep: float | tuple[float, float], squash: float | tuple[float, float], bias: float = 1.0, seed: int = 0, xy_sigma: float = 0.0, bounded: bool | None = None) -> DataFrame:
    """A z-biased weighted subset of round(n * keep) points (largest ln(u)/w first), z squashed about its mean, and optionally Gaussian noise of ``xy_sigma``
    on x and y. Weights are 1 - bias + bias * height from 0 to 1, equal ones in a flat cloud. Ranges of keep and squash are drawn per cloud."""
    b = bounds(df).select("cloud_id", "min_z", "max_z", F.greatest(F.lit(1), F.bround(F.col("n_points") * _between(keep, seed, "cloud_id", F.lit("keep")))).alias("__k"))
    span = F.col("max_z") - F.col("min_z")
    w = F.when(span > 1e-6, 1.0 - bias + bias * (F.col("z") - F.col("min_z")) / span).otherwise(1.0) if bias > 0 else F.lit(1.0)
    chance = F.log(F.greatest(uniform(seed, "cloud_id", "pt"), F.lit(1e-12))) / F.greatest(w, F.lit(1e-12))
    df = first_of(df.join(b, "cloud_id").withColumn("__c", -chance), ["cloud_id"], "__c", "__k", "pt", bounded)
    mean = df.groupBy("cloud_id").agg(F.avg("z").alias("__m"))
    df = df.join(mean, "cloud_id").withColumn("z", F.col("__m") + (F.col("z") - F.col("__m")) * _between(squash, seed, "cloud_id", F.lit("squash")))
    return (df.withColumns({c: F.col(c) + _gauss(c, xy_sigma, seed) for c in "xy"}) if xy_sigma > 0 else df).select(*_PT, *XYZ)


def rigid(df: DataFrame, angles: tuple[Column, Column, Column], scale: Column, shift: tuple[Column, Column, Column]) -> DataFrame:
    """p' = s * Rz Ry Rx p + t."""
    a, b, c = angles
    y1, z1 = F.cos(a) * F.col("y") - F.sin(a) * F.col("z"), F.sin(a) * F.col("y") + F.cos(a) * F.col("z")
    x2, z2 = F.cos(b) * F.col("x") + F.sin(b) * z1, -F.sin(b) * F.col("x") + F.cos(b) * z1
    x3, y3 = F.cos(c) * x2 - F.sin(c) * y1, F.sin(c) * x2 + F.cos(c) * y1
    return df.withColumns({"x": scale * x3 + shift[0], "y": scale * y3 + shift[1], "z": scale * z2 + shift[2]})


def augment(df: DataFrame, max_angle: float, scales: tuple[float, float], max_shift: float, seed: int = 0) -> DataFrame:
    """One rotation, scale and shift per object, from hash uniforms of its id; all views share it."""
    u = [uniform(seed, "cloud_id", F.lit(k)) for k in ("a", "b", "c", "s", "tx", "ty", "tz")]
    angles = tuple((2 * x - 1) * max_angle for x in u[:3])
    return rigid(df, angles, scales[0] + u[3] * (scales[1] - scales[0]), tuple((2 * x - 1) * max_shift for x in u[4:]))


def _gauss(c: str, sigma: float, seed: int) -> Column:
    """Gaussian noise for a coordinate of a point, by Box-Muller on two hash uniforms."""
    u, v = uniform(seed, "cloud_id", "pt", F.lit(c), F.lit("u")), uniform(seed, "cloud_id", "pt", F.lit(c), F.lit("v"))
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * v) * sigma


def jitter(df: DataFrame, sigma: float, clip: float, seed: int = 0) -> DataFrame:
    """Clipped Gaussian noise per coordinate."""
    return df.withColumns({c: shifted(c, sigma, clip, seed) for c in XYZ})


def shifted(c: str, sigma: float, clip: float, seed: int | Column = 0) -> Column:
    """A coordinate with clipped Gaussian noise."""
    return F.col(c) + F.greatest(F.least(_gauss(c, sigma, seed), F.lit(clip)), F.lit(-clip))


def rotate_z(df: DataFrame, degrees: float) -> DataFrame:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return df.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def mirror(df: DataFrame, axis: str = "x", side: str = "both", centre: Column | None = None) -> DataFrame:
    """Points of a side of the plane with their reflections; points on the plane belong to both sides. ``larger``: the side of more
    points, of equal ones the negative."""
    mid = (F.min(axis).over(W.partitionBy("cloud_id")) + F.max(axis).over(W.partitionBy("cloud_id"))) / 2
    df = df.withColumn("__m", F.coalesce(centre, mid) if centre is not None else mid)
    low, high = F.col(axis) <= F.col("__m"), F.col(axis) >= F.col("__m")
    if side == "larger":
        w = W.partitionBy("cloud_id")
        df = df.withColumns({"__a": F.count_if(low).over(w), "__b": F.count_if(high).over(w)})
        df = df.filter(F.when(F.col("__a") >= F.col("__b"), low).otherwise(high)).drop("__a", "__b")
    elif side != "both":
        df = df.filter(low if side == "negative" else high)
    kept = df.withColumn("mirrored", F.lit(0))
    return kept.unionByName(kept.withColumn(axis, 2 * F.col("__m") - F.col(axis)).withColumn("mirrored", F.lit(1))).drop("__m")


def target_clouds(catalog: DataFrame, points: DataFrame, group: list[str], distance: str | None = None) -> DataFrame:
    """Points of all clouds of an object, or of the nearest cloud only. ``catalog`` has cloud_id and the group columns."""
    if distance is not None:
        catalog = catalog.groupBy(*group).agg(F.min_by("cloud_id", F.struct(distance, "cloud_id")).alias("cloud_id"))
    return catalog.select(*group, "cloud_id").join(points, "cloud_id")


def partial_view(df: DataFrame, delta: float, group: str, distance: str, key: str, pick: str = "first", seed: int = 0) -> DataFrame:
    """One item per object farther than its nearest by more than delta, else any but the nearest: first, last or hash pick."""
    w = W.partitionBy(group)
    df = df.withColumn("__r", F.row_number().over(w.orderBy(distance, key))).withColumn("__far", F.col(distance) > F.min(distance).over(w) + delta)
    some = F.max(F.col("__far").cast("int")).over(w) == 1
    df = df.withColumn("__any", some).filter(F.when(F.col("__any"), F.col("__far")).otherwise(F.col("__r") > 1))
    order = {"first": [F.asc("__r")], "last": [F.desc("__r")], "random": [hash_key(seed, key), F.col(key)]}[pick]
    return df.withColumn("__p", F.row_number().over(w.orderBy(*order))).filter("__p = 1").drop("__r", "__far", "__any", "__p")


def occlude(df: DataFrame, keep: tuple[float, float], parts: int, seed: int = 0, bounded: bool | None = None) -> DataFrame:
    """Keep max(1, round(n * r)) points of a cloud, r a hash uniform in the range ``keep`` per cloud: ``parts`` times a hash-picked centre among the points left
    takes its nearest, an equal share of what is still to be removed (rounded up)."""
    low = max(0.05, min(1.0, keep[0]))
    bounded = fits(df, ["cloud_id"]) if bounded is None else bounded
    columns = df.columns
    share = _between((low, max(low, min(1.0, keep[1]))), seed, "cloud_id", F.lit("keep"))
    n = df.groupBy("cloud_id").agg(F.count("*").alias("__n"))
    n = n.withColumn("__left", F.when(F.col("__n") > 1, F.col("__n") - F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("bigint"))).otherwise(0)).drop("__n")
    df = df.join(n, "cloud_id")
    for i in range(parts):
        h = hash_key(seed, i, "cloud_id", "pt")
        centre = df.groupBy("cloud_id").agg(F.min_by(F.struct(*XYZ), F.struct(h, "pt")).alias("__c"))
        d = F.round(sum(((F.col(c) - F.col("__c." + c)) ** 2 for c in XYZ[1:]), (F.col("x") - F.col("__c.x")) ** 2), 9)
        df = df.join(centre, "cloud_id").withColumns({"__d": d, "__t": F.ceil(F.col("__left") / F.lit(float(parts - i)))}).drop("__c")
        if bounded:
            left = df.withColumn("__r", F.row_number().over(W.partitionBy("cloud_id").orderBy("__d", "pt"))).filter("__r > __t").drop("__r")
        else:  # no cloud is ordered: the nearest are found by a cut-off
            df = materialize(df, "occluded")
            left = df.join(first_of(df, ["cloud_id"], "__d", "__t", "pt", False).select("cloud_id", "pt"), ["cloud_id", "pt"], "left_anti")
        df = left.withColumn("__left", F.col("__left") - F.col("__t")).drop("__d", "__t")
    return df.select(*columns)


def silhouette(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """Outline on an axis pair: extremes of b per bin of a, and of a per bin of b with max(32, bins // 3) bins; distinct. Half-open bins
    leave out the maximum; a constant axis has no bins."""
    out = None
    for u, v, n in ((a, b, bins), (b, a, max(32, bins // 3))):
        w = W.partitionBy("cloud_id")
        lo, hi = F.min(u).over(w), F.max(u).over(w)
        cut = df.withColumns({"__lo": lo, "__hi": hi}).filter("__hi > __lo")
        cut = cut.withColumn("__b", F.floor((F.col(u) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * n)).filter(F.col("__b") < n)
        ends = cut.groupBy("cloud_id", "__b").agg(*(f(F.struct(a, b), F.struct(v, "pt")).alias(k) for k, f in (("s", F.min_by), ("e", F.max_by))))
        part = ends.select("cloud_id", F.explode(F.array("s", "e")).alias("p")).select("cloud_id", f"p.{a}", f"p.{b}")
        out = part if out is None else out.unionByName(part)
    third = next(c for c in XYZ if c not in (a, b))
    return out.distinct().withColumn(third, F.lit(0.0))


def apply_pose(points: DataFrame, poses: DataFrame, required: bool = True) -> DataFrame:
    """Move points by the accepted 4x4 pose (array of 12 row-major numbers) of their frame; frames without one are dropped if required."""
    own = poses.filter("accepted").select("cloud_id", F.col("transform").alias("__t"))
    return _moved(points.join(own, "cloud_id", "inner" if required else "left"))


def frame_poses(metadata: DataFrame, poses: str = "final_frame_poses") -> DataFrame:
    """(stem, frame, transform): one row per accepted pose of the arrays ``poses`` of struct(frame_id, accepted, pose_6d_radians, transform), a 4x4 matrix as nested
    rows, that has both numbers and matrix; transform becomes the 12 numbers of its first three rows. The last of several poses of a frame counts."""
    each = metadata.select("stem", F.posexplode(poses).alias("at", "p")).filter("p.accepted AND p.pose_6d_radians IS NOT NULL AND p.transform IS NOT NULL")
    each = each.withColumn("frame", F.col("p.frame_id").cast("string").try_cast("bigint")).filter("frame IS NOT NULL")
    return each.groupBy("stem", "frame").agg(F.max_by(F.slice(F.flatten("p.transform"), 1, 12), "at").alias("transform"))


def apply_frame_poses(points: DataFrame, metadata: DataFrame, required: bool = True) -> DataFrame:
    """Move the points of (stem, frame_id, x, y, z, ...) by the accepted pose of their frame: that of the stem without its frame, by the integer frame id, so
    that 007 is 7. Points of frames without one are dropped if required, else they stay where they are."""
    own = frame_poses(metadata).select(F.col("stem").alias("__s"), F.col("frame").alias("__f"), F.col("transform").alias("__t"))
    group, frame = F.regexp_replace("stem", "__frame_[^_]+$", ""), F.col("frame_id").cast("string").try_cast("bigint")
    return _moved(points.join(own, (group == F.col("__s")) & (frame == F.col("__f")), "inner" if required else "left")).drop("__s", "__f")


def _moved(df: DataFrame) -> DataFrame:
    def row(k: int) -> Column:
        t = [F.get("__t", F.lit(4 * k + j)) for j in range(4)]
        return t[0] * F.col("x") + t[1] * F.col("y") + t[2] * F.col("z") + t[3]

    return df.withColumns({c: F.coalesce(row(k), F.col(c)) for k, c in enumerate(XYZ)}).drop("__t")


def normalised_pose(df: DataFrame, centre: tuple[Column, Column, Column], radius: Column, pose: str = "relative") -> DataFrame:
    """A pose of 12 row-major numbers in the coordinates (p - centre) / radius: the rotation stays, the translation is (R c + t - c) / radius."""
    t = lambda i, j: F.get(pose, F.lit(4 * i + j))
    rows = [[t(i, 0), t(i, 1), t(i, 2), (t(i, 0) * centre[0] + t(i, 1) * centre[1] + t(i, 2) * centre[2] + t(i, 3) - centre[i]) / radius] for i in range(3)]
    return df.withColumn(pose, F.array(*(x for row in rows for x in row)))


def relative_pose(poses: DataFrame, group: str, order: str) -> DataFrame:
    """inv(T0) * Ti for every pose of a group, T0 the first one: arrays of 12 row-major numbers."""
    first = poses.groupBy(group).agg(F.min_by("transform", order).alias("__a"))
    df = poses.join(first, group)
    t, a = (lambda i, j: F.get("transform", F.lit(4 * i + j))), (lambda i, j: F.get("__a", F.lit(4 * i + j)))
    cells = []
    for i in range(3):
        for j in range(3):
            cells.append(sum((a(k, i) * t(k, j) for k in (1, 2)), a(0, i) * t(0, j)))
        cells.append(sum((a(k, i) * (t(k, 3) - a(k, 3)) for k in (1, 2)), a(0, i) * (t(0, 3) - a(0, 3))))
    return df.withColumn("relative", F.array(*cells)).drop("__a")


def height(df: DataFrame, axis: str = "z") -> DataFrame:
    return df.withColumn("height", F.col(axis) - F.min(axis).over(W.partitionBy("cloud_id")))


def scale_colour(c: Column, signed: bool = False) -> Column:
    """c / 255 or (c + 1) / 2, clipped to [0, 1]."""
    return F.least(F.greatest((c + 1) / 2 if signed else c / 255, F.lit(0.0)), F.lit(1.0))
