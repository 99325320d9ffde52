"""Joins and matching: trailer to vehicle pairs, ground-truth resolution, track matches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.hashing import hash_key
from pointmill.functions.ranking import fits, hash_ranked, quantiles_of
from pointmill.functions.scratch import materialize
from pointmill.operators.closest import box_gap, closest_in_time
from pointmill.operators.geom import centreline, principal_axis
from pointmill.operators.points import XYZ, bounds


def gap_distance(a: Column, b: Column, a_span: tuple[Column, Column], b_span: tuple[Column, Column]) -> Column:
    """|a - b| when both are known, else the gap of the two intervals (0 if they overlap), else null."""
    known = a_span[0].isNotNull() & a_span[1].isNotNull() & b_span[0].isNotNull() & b_span[1].isNotNull()
    gap = F.greatest(F.lit(0), F.greatest(b_span[0] - a_span[1], a_span[0] - b_span[1]))
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b)).when(known, gap)


def seconds_between(a_ns: Column, b_ns: Column) -> Column:
    return F.abs(a_ns - b_ns) / F.lit(1e9)


def boxes(points: DataFrame) -> DataFrame:
    """(cloud_id, box): the bounds and means of every cloud's finite points."""
    b = bounds(points)
    return b.select("cloud_id", F.struct(*(F.col(f"{s}_{c}").alias(f"{s}_{c}") for s in ("min", "max", "mean") for c in XYZ)).alias("box"))


def _gaps(a: Column, b: Column) -> dict[str, Column]:
    """gap_xy, gap_z, centre and score of two boxes."""
    gap = {c: F.greatest(F.lit(0.0), b["min_" + c] - a["max_" + c], a["min_" + c] - b["max_" + c]) for c in XYZ}
    mid = {c: a["mean_" + c] - b["mean_" + c] for c in "xy"}
    gap_xy, centre = F.sqrt(gap["x"] ** 2 + gap["y"] ** 2), F.sqrt(mid["x"] ** 2 + mid["y"] ** 2)
    return {"gap_xy": gap_xy, "gap_z": gap["z"], "centre": centre, "score": gap_xy + 0.15 * centre + 0.5 * gap["z"]}


def box_gap_score(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """gap_xy + 0.15 * centre + 0.5 * gap_z of the bounding boxes of a_id and b_id; centre is the distance of their means in the plane."""
    b = boxes(points)
    df = pairs.join(b.select(F.col("cloud_id").alias("a_id"), F.col("box").alias("__a")), "a_id").join(b.select(F.col("cloud_id").alias("b_id"), F.col("box").alias("__b")), "b_id")
    return df.select(*pairs.columns, *(c.alias(n) for n, c in _gaps(F.col("__a"), F.col("__b")).items()))


def _in_cells(df: DataFrame, grow: float, level: Column) -> DataFrame:
    """A row for each cell of the plane's grid of side 2 ** ``level`` that the box, grown by ``grow`` and the rounding of its numbers, meets: __l, __cx, __cy, and the first cell __fx, __fy."""
    df = df.withColumn("__l", level)
    side = F.pow(F.lit(2.0), F.col("__l"))
    for c in "xy":
        lo, hi = F.col(f"box.min_{c}"), F.col(f"box.max_{c}")
        more = grow + (F.abs(lo) + F.abs(hi) + grow) * 1e-9
        cell = lambda v: F.floor(v / side).cast("long")
        df = df.withColumn("__f" + c, cell(lo - more)).withColumn("__c" + c, F.explode(F.sequence(F.col("__f" + c), cell(hi + more))))
    return df


def near_in_time(a: DataFrame, b: DataFrame, keys: list[str], limit: int, gap: float, time: str = "us", salt: int = 16) -> DataFrame:
    """The pairs of :func:`candidates_in_time`, less their boxes, whose boxes, in the column ``box`` of both sides, may be within ``gap`` in the plane.

    The boxes of a are grown by the gap. Every box has a level, the power of two that its longer side fits, and meets four cells or so of that side. Two boxes meet in
    the cells of the larger one's level, a pair in its first common cell, so candidates are in proportion to near pairs whatever the sizes of the boxes are. Where the middle box
    of a spans half of all, all pairs in time are near ones, and no cells are made.
    """
    long = lambda more: F.greatest(*(F.col(f"box.max_{c}") - F.col(f"box.min_{c}") for c in "xy"), F.lit(1e-9)) + more
    own = F.col("__own")
    a, b = (df.filter("box IS NOT NULL").withColumn("__own", F.ceil(F.log2(long(2 * gap if grown else 0.0))).cast("int")) for df, grown in ((a, True), (b, False)))
    least = math.floor(math.log2(gap)) if gap > 0 else -30
    a, b = (df.withColumn("__own", F.greatest(own, F.lit(least))) for df in (a, b))
    ends = [f(f"box.{n}_{c}").alias(n + c) for c in "xy" for n, f in (("min", F.min), ("max", F.max))]
    told = [df.groupBy("__own").agg(F.count("*").alias("n"), *ends).collect() for df in (a, b)]  # a row a power of two: a few dozen
    levels = sorted({r["__own"] for rows in told for r in rows})
    span = max((max(r["max" + c] for rows in told for r in rows) - min(r["min" + c] for rows in told for r in rows) for c in "xy"), default=0.0) if levels else 0.0
    own_levels = sorted((r["__own"], r["n"]) for r in told[0])
    middle = next((level for i, (level, _) in enumerate(own_levels) if 2 * sum(n for _, n in own_levels[: i + 1]) >= sum(n for _, n in own_levels)), -math.inf)
    if span <= 2 * 2.0**middle:  # the middle box of a spans half of all: cells would part nothing
        return candidates_in_time(a.drop("__own", "box"), b.drop("__own", "box"), keys, limit, time, salt)
    coarser = F.array(*map(F.lit, levels))
    sides = []
    for df, grow, ranks in ((a, gap, ("own", "above")), (b, 0.0, ("own and above", "own"))):
        parts = []
        for way, rank in enumerate(ranks):  # way 0: a is not the smaller one; way 1: b is the larger one
            level = {"own": F.array(own), "above": F.filter(coarser, lambda x: x > own), "own and above": F.filter(coarser, lambda x: x >= own)}[rank]
            parts.append(_in_cells(df.withColumn("__x", F.explode(level)), grow, F.col("__x")).withColumn("__way", F.lit(way)).drop("__x"))
        sides.append(parts[0].unionByName(parts[1]).drop("__own", "box"))
    met = candidates_in_time(*sides, [*keys, "__way", "__l", "__cx", "__cy"], limit, time, salt)
    first = (F.col("a___cx") == F.greatest("a___fx", "b___fx")) & (F.col("a___cy") == F.greatest("a___fy", "b___fy"))
    return met.filter(first).drop(*(f"{p}___{c}" for p in "ab" for c in ("way", "l", "cx", "cy", "fx", "fy")))


def candidates_in_time(a: DataFrame, b: DataFrame, keys: list[str], limit: int, time: str = "us", salt: int = 16) -> DataFrame:
    """Pairs of equal keys whose times differ by at most ``limit``; unknown times pass. Columns get the prefixes a_ and b_.

    Known times meet through buckets of ``limit`` (own and the two beside), so a key's rows are not all compared; rows of unknown
    time meet all rows of their keys, as they must, those of a hot key in ``salt`` parts.
    """
    a, b = (df.select(*(F.col(c).alias(p + c) for c in df.columns)) for df, p in ((a, "a_"), (b, "b_")))
    on = [F.col("a_" + k) == F.col("b_" + k) for k in keys]
    cell = lambda c: F.floor(F.col(c) / F.lit(limit)).cast("bigint")
    near = a.filter(F.col("a_" + time).isNotNull()).withColumn("__c", F.explode(F.array(*(cell("a_" + time) + i for i in (-1, 0, 1)))))
    known = b.filter(F.col("b_" + time).isNotNull()).withColumn("__d", cell("b_" + time))
    met = near.join(known, [*on, F.col("__c") == F.col("__d")]).filter(F.abs(F.col("a_" + time) - F.col("b_" + time)) <= limit).drop("__c", "__d")
    part = F.expr(f"sequence(0, {salt - 1})")
    on = [*on, F.col("__c") == F.col("__d")]
    spread = lambda df, c: df.withColumn(c, F.pmod(F.xxhash64(*df.columns), F.lit(salt)).cast("int"))
    some = a.filter(F.col("a_" + time).isNull()).withColumn("__c", F.explode(part)).join(spread(b, "__d"), on)
    rest = spread(a.filter(F.col("a_" + time).isNotNull()), "__c").join(b.filter(F.col("b_" + time).isNull()).withColumn("__d", F.explode(part)), on)
    return met.unionByName(some.drop("__c", "__d")).unionByName(rest.drop("__c", "__d"))


def within_limits(pairs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Pairs whose named measures (frames, gap_xy, gap_z, centre) are at most their limits. Unknown frames pass, unknown geometry does not."""
    for name, limit in limits.items():
        pairs = pairs.filter(F.coalesce(F.col(name) <= limit, F.lit(name == "frames")))
    return pairs


def match_boxes(a: DataFrame, b: DataFrame, points: DataFrame, keys: list[str], limit: int, limits: dict[str, float], frames: Column | None = None, time: str = "us", salt: int = 16) -> DataFrame:
    """Each row of a with its best partner in b: of equal keys, within ``limit`` in time, another object, within ``limits``; the lowest box-gap score wins, then
    the smaller b_cloud_id. a and b have cloud_id, object_id and the keys; a_ and b_ mark their columns. Unknown times, objects, frames and
    confidences pass; a cloud without points has no partner.

    ``limits`` on a_confidence and b_confidence (at least), frames, gap_xy, gap_z and centre (at most); confidences are judged before points are met, and a limit on gap_xy
    makes the candidates by :func:`near_in_time`.
    """
    least = {p: limits.get(p + "_confidence") for p in "ab"}
    a, b = (df if least[p] is None else df.filter(F.coalesce(F.col("confidence") >= least[p], F.lit(True))) for p, df in (("a", a), ("b", b)))
    ids = a.select("cloud_id").unionByName(b.select("cloud_id")).distinct()
    box = materialize(boxes(points.join(ids, "cloud_id", "left_semi")), "boxes")
    a, b = (materialize(df.join(box, "cloud_id"), "boxed") for df in (a, b))
    gap = limits.get("gap_xy")
    near = gap is not None and not math.isinf(gap)
    pairs = near_in_time(a, b, keys, limit, float(gap), time, salt) if near else candidates_in_time(a.drop("box"), b.drop("box"), keys, limit, time, salt)
    pairs = pairs.filter("coalesce(a_object_id <> b_object_id, true)").withColumn("frames", frames if frames is not None else F.lit(None).cast("double"))
    pairs = within_limits(pairs, {k: v for k, v in limits.items() if k == "frames"})
    for p in "ab":
        pairs = pairs.join(box.select(F.col("cloud_id").alias(f"{p}_cloud_id"), F.col("box").alias(f"__{p}")), f"{p}_cloud_id")
    pairs = pairs.withColumns(_gaps(F.col("__a"), F.col("__b"))).drop("__a", "__b")
    return best_match(within_limits(pairs, {k: v for k, v in limits.items() if k in ("gap_xy", "gap_z", "centre")}), "a_cloud_id", "score", "b_cloud_id")


def closest_boxes(a: DataFrame, b: DataFrame, points: DataFrame, keys: list[str], limit: int, limits: dict[str, float], frame: str, time: str = "us") -> DataFrame:
    """(a_cloud_id, b_cloud_id, score): as :func:`match_boxes`, where frames are the difference of the column ``frame``; cloud ids are whole numbers.

    The score is 0.15 times the distance of the centres at least, so partners are sought outwards from a cloud along x; no pair is listed, whatever times are unknown.
    """
    least = {p: limits.get(p + "_confidence") for p in "ab"}
    a, b = (df if least[p] is None else df.filter(F.coalesce(F.col("confidence") >= least[p], F.lit(True))) for p, df in (("a", a), ("b", b)))
    ids = a.select("cloud_id").unionByName(b.select("cloud_id")).distinct()
    box = materialize(boxes(points.join(ids, "cloud_id", "left_semi")), "boxes")
    sides = [df.join(box, "cloud_id").select(F.col("cloud_id").alias("id"), *keys, "object_id", time, F.col(frame).alias("frame"), "box.*").filter("mean_x IS NOT NULL") for df in (a, b)]
    sides = [materialize(df, "boxed") for df in sides]
    reach = float(limits.get("centre", math.inf))
    found = closest_in_time(*sides, keys, limit, "mean_x", 0.15, box_gap(limits), reach, "object_id", time)
    return found.select(F.col("a_id").alias("a_cloud_id"), F.col("b_id").alias("b_cloud_id"), "score")


def best_match(pairs: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Lowest score per key, first on ties, by a map-side minimum."""
    least = F.min(F.struct(F.col(score).isNull().alias("u"), F.col(score).alias("s"), F.col(tie).alias("t"), F.struct(*pairs.columns).alias("row"))).alias("b")
    return pairs.groupBy(key).agg(least).select("b.row.*")


def hash_match(a: DataFrame, b: DataFrame, keys: list[str], a_key: str, b_key: str, seed: int, draw: str | None = None) -> DataFrame:
    """One candidate of equal keys per row of a, at an evenly distributed hash place, without listing the pairs."""
    ranked = hash_ranked(b, keys, hash_key(seed, b_key), [b_key]).withColumn("__i", F.col("__r") - 1)
    size = b.groupBy(*keys).agg(F.count("*").alias("__n"))
    parts = [seed, a_key] + ([draw] if draw else [])
    place = F.pmod(F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint"), F.col("__n"))
    own = a.select(*keys, a_key, *([draw] if draw else [])).join(size, keys).withColumn("__i", place)
    return own.join(ranked.select(*keys, F.col(b_key), "__i"), [*keys, "__i"]).drop("__i", "__n")


def draw_pairs(a: DataFrame, b: DataFrame, keys: list[str], a_key: str, b_key: str, n: int, seed: int) -> DataFrame:
    """Exactly n draws per key group with replacement: a hash place in a, then :func:`hash_match` into b with the draw in the hash."""
    ranked = hash_ranked(a, keys, hash_key(seed, a_key), [a_key]).withColumn("__i", F.col("__r") - 1)
    size = a.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.pmod(F.conv(F.substring(hash_key(seed, *keys, "draw"), 1, 8), 16, 10).cast("bigint"), F.col("__n"))
    drawn = size.withColumn("__i", place).join(ranked.select(*keys, a_key, "__i"), [*keys, "__i"]).drop("__i", "__n")
    return hash_match(drawn, b, keys, a_key, b_key, seed, "draw")


def unmatched(a: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return a.join(matched.select(key), key, "left_anti").select(key, F.lit("no_candidate").alias("reason"))


def _alignment(pairs: DataFrame, points: DataFrame, gap: float, flipped: bool) -> tuple[DataFrame, DataFrame]:
    """Turned points of the trailers (a_id), and per pair the turn and the shifts that bring them behind the vehicles (b_id)."""
    ids = pairs.select(F.explode(F.array("a_id", "b_id")).alias("cloud_id")).distinct()
    lines = centreline(points.join(ids, "cloud_id", "left_semi"))  # of the paired clouds only
    v = lines.select(F.col("cloud_id").alias("b_id"), F.atan2("ay", "ax").alias("vt"), F.col("ax").alias("vax"), F.col("ay").alias("vay"), F.col("u_min").alias("rear"), F.col("v_mid").alias("mid"), F.col("ground").alias("vg"))
    t = lines.select(F.col("cloud_id").alias("a_id"), F.atan2("ay", "ax").alias("tt"))
    turn = pairs.join(v, "b_id").join(t, "a_id").withColumn("d", F.col("vt") - F.col("tt") + F.lit(math.pi if flipped else 0.0))
    own = turn.join(points.select(F.col("cloud_id").alias("a_id"), "pt", *XYZ), "a_id")
    own = own.withColumns({"x": F.col("x") * F.cos("d") - F.col("y") * F.sin("d"), "y": F.col("x") * F.sin("d") + F.col("y") * F.cos("d")})
    bounded = fits(points, ["cloud_id"])
    u, w = F.col("x") * F.col("vax") + F.col("y") * F.col("vay"), F.col("y") * F.col("vax") - F.col("x") * F.col("vay")
    kept, ends = ("a_id", "b_id", "d", "rear", "mid", "vg", "vax", "vay"), [0.01, 0.99]
    wide = own.select("pair_id", *kept, "z", u.alias("u"), w.alias("w"))
    fit = quantiles_of(wide, {"u": ends, "w": ends}, ["pair_id"], [F.min("z").alias("g"), *(F.first(c).alias(c) for c in kept)], bounded)
    du = F.col("rear") - F.lit(gap) - F.get("u", F.lit(1))
    dv = F.col("mid") - (F.get("w", F.lit(0)) + F.get("w", F.lit(1))) / 2
    fit = fit.select("pair_id", *kept, du.alias("du"), dv.alias("dv"), (du * F.col("vax") - dv * F.col("vay")).alias("dx"), (du * F.col("vay") + dv * F.col("vax")).alias("dy"), (F.col("vg") - F.col("g")).alias("dz"))
    return own, fit


def align_pairs(pairs: DataFrame, points: DataFrame, gap: float, flipped: bool = False) -> DataFrame:
    """Trailer points (a_id) turned to the vehicle's axis (b_id), front at the vehicle's rear less ``gap``, lateral centres and ground
    aligned; united with the vehicle's points, with source_id. ``flipped`` turns the trailer by half a circle more."""
    own, fit = _alignment(pairs, points, gap, flipped)
    moved = own.join(fit.select("pair_id", "dx", "dy", "dz"), "pair_id").select("pair_id", F.col("a_id").alias("source_id"), "pt", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"))
    still = pairs.join(points.select(F.col("cloud_id").alias("b_id"), "pt", *XYZ), "b_id").select("pair_id", F.col("b_id").alias("source_id"), "pt", *XYZ)
    return moved.unionByName(still)


def alignment_report(pairs: DataFrame, points: DataFrame, gap: float, flipped: bool = False) -> DataFrame:
    """Per pair: the turn in degrees from -180 to 180, the shifts along the axis, across it and upwards, and the angle left between the axes of the
    moved trailer and the vehicle, 0 to 90 degrees."""
    own, fit = _alignment(pairs, points, gap, flipped)
    axis = principal_axis(own.select(F.col("pair_id").alias("cloud_id"), *XYZ)).select(F.col("cloud_id").alias("pair_id"), "ax", "ay")
    dot = F.least(F.abs(F.col("ax") * F.col("vax") + F.col("ay") * F.col("vay")), F.lit(1.0))
    turn = F.degrees(F.atan2(F.sin("d"), F.cos("d")))
    return fit.join(axis, "pair_id").select("pair_id", "a_id", "b_id", turn.alias("turn"), F.col("du").alias("along"), F.col("dv").alias("across"), F.col("dz").alias("up"), F.degrees(F.acos(dot)).alias("angle_error"))


def merged_class(vehicle: Column, style: str = "snake") -> Column:
    names = {"snake": ("truck_with_trailer", "car_with_trailer"), "title": ("TRUCK WITH TRAILER", "CAR WITH TRAILER")}[style]
    return F.when(F.lower(vehicle).contains("truck"), names[0]).otherwise(names[1])


def ground_truth_score(path: Column, declared: Column, role: Column, review: Column) -> Column:
    """gt folder +120, prediction folder -100, declared path +80, role +100, review +10."""
    parts = F.transform(F.split(path, "/"), lambda p: F.lower(p))
    gt = F.exists(parts, lambda p: F.regexp_like(p, F.lit("^(gt|ground_?truth)")))
    pred = F.exists(parts, lambda p: F.regexp_like(p, F.lit("^pred")))
    return (gt.cast("int") * 120 - pred.cast("int") * 100 + F.coalesce((declared == path).cast("int"), F.lit(0)) * 80 + F.coalesce((role == "ground_truth").cast("int"), F.lit(0)) * 100 + F.coalesce(review.cast("int"), F.lit(0)) * 10).cast("bigint")


def resolve_ground_truth(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """(stem, class_name, path, tier, ambiguous) of every sample: candidates by exact stem, else by (run, object), else the only candidate of its class among those of
    the object. Of the candidates, those of the sample's class if there are any; of these the best score, then the greatest path; ambiguous if
    that score is shared. A candidate is known by its stem and by its sample_id, where there is one. Samples without a candidate keep nulls.
    """
    t = truth.select("stem", "run_id", "object_id", "class_name", "path", "score")
    named = t if "sample_id" not in truth.columns else t.unionByName(truth.withColumn("stem", F.col("sample_id")).select(*t.columns)).distinct()

    def summaries(df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, best): the best score of the candidates of a key, the greatest path that has it, and how many do. Partial ones add up map-side."""
        ties = df.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.max("path").alias("path"))
        return ties.groupBy(*keys).agg(F.max(F.struct(F.col("score").isNotNull().alias("known"), "score", "path", "n")).alias("best"))

    def met(left: DataFrame, df: DataFrame, keys: list[str], tier: int) -> DataFrame:
        """The samples with the summary of their key and class, else of their key."""
        of_class = summaries(df, [*keys, "class_name"]).withColumnRenamed("best", "own")
        found = left.join(of_class, [*keys, "class_name"], "left").join(summaries(df, keys), keys, "left")
        return found.withColumn("b", F.coalesce("own", "best")).drop("own", "best").withColumn("tier", F.when(F.col("b").isNotNull(), F.lit(tier)).cast("bigint"))

    left = samples.select("stem", "run_id", "object_id", "class_name")
    settled = None
    for tier, (df, keys) in enumerate(((named, ["stem"]), (t, ["run_id", "object_id"])), 1):
        found = materialize(met(left, df, keys, tier), "tier")
        done = found.filter("b IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        left = found.filter("b IS NULL").drop("b", "tier")
    only = summaries(t, ["object_id", "class_name"]).join(t.groupBy("object_id", "class_name").agg(F.count("*").alias("k")).filter("k = 1").drop("k"), ["object_id", "class_name"])
    last = left.join(only.withColumnRenamed("best", "b"), ["object_id", "class_name"], "left").withColumn("tier", F.when(F.col("b").isNotNull(), F.lit(3)).cast("bigint"))
    every = settled.unionByName(last)
    return every.select("stem", "class_name", "b.path", "tier", (F.col("b.n") > 1).alias("ambiguous"))


def ground_truth_report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("class_name").agg(F.count_if(F.col("path").isNull()).alias("missing"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))


def match_tracks(aggregates: DataFrame, groups: DataFrame, track: str, order: str) -> DataFrame:
    """Each aggregate with the last raw group of its track; groups without one are left out."""
    last = groups.groupBy(track).agg(F.max_by("group_key", order).alias("group_key"))
    return aggregates.join(last, track)
