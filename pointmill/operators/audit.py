"""Audit of curated clouds: shape statistics, checks, robust outliers, ranked queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.ranking import fits, quantiles, range_ranked
from pointmill.operators.points import XYZ, bounds

# The audited fields, in the order of their reasons.
FIELDS = ("point_count", "x_extent", "y_extent", "z_extent", "volume", "density", "aspect_xy", "aspect_xz")


def shape_stats(points: DataFrame) -> DataFrame:
    """Extents, volume (at least 1e-9), density and two aspect ratios per cloud: the longer side in the plane by the shorter one, and by the height."""
    b = bounds(points)
    e = {c: F.col("max_" + c) - F.col("min_" + c) for c in XYZ}
    long = F.greatest(e["x"], e["y"])
    volume = F.greatest(e["x"] * e["y"] * e["z"], F.lit(1e-9))
    return b.select(
        "cloud_id", "n_finite", "n_points", *(e[c].alias(c + "_extent") for c in XYZ), volume.alias("volume"), (F.col("n_finite") / volume).alias("density"),
        (long / F.greatest(F.least(e["x"], e["y"]), F.lit(1e-9))).alias("aspect_xy"), (long / F.greatest(e["z"], F.lit(1e-9))).alias("aspect_xz"),
    )


def hard_checks(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``hard_score`` and ``hard_reasons``: unreadable +100 (and nothing else), missing +100, some points non-finite +20, no finite point +100.
    A column error_type of the manifest is named in the reason, pcd_read_error:<type>."""
    df = manifest.join(stats, "cloud_id", "left")
    unread = F.coalesce(F.col("read_error"), F.lit(False))
    rules = [
        ("pcd_read_error", unread, 100),
        ("missing_pcd", ~unread & F.col("n_points").isNull(), 100),
        ("non_finite_xyz", ~unread & (F.col("n_finite") != F.col("n_points")), 20),
        ("empty_or_invalid_xyz", ~unread & (F.col("n_finite") == 0), 100),
    ]
    hit = [(F.lit(name), F.coalesce(c, F.lit(False)), s) for name, c, s in rules]
    if "error_type" in manifest.columns:
        hit[0] = (F.concat_ws(":", hit[0][0], "error_type"), *hit[0][1:])
    score = sum((F.when(c, s).otherwise(0) for _, c, s in hit[1:]), F.when(hit[0][1], hit[0][2]).otherwise(0))
    return df.withColumns({"hard_score": score.cast("double"), "hard_reasons": F.array_compact(F.array(*(F.when(c, n) for n, c, _ in hit)))})


def label_checks(df: DataFrame, least_conf: float, least_points: int) -> DataFrame:
    """predicted <> dataset class +80; confidence < c: 25 + (c - conf) * 50; manifest or file points below the minimum +25 each."""
    rules = [
        ("dataset_class_ne_predicted_class", (F.col("predicted_class") != "") & (F.col("predicted_class") != F.col("dataset_class")), F.lit(80.0)),
        ("low_confidence", F.col("confidence") < least_conf, 25 + (least_conf - F.col("confidence")) * 50),
        ("low_manifest_point_count", F.col("point_count") < least_points, F.lit(25.0)),
        ("low_pcd_point_count", F.col("file_points") < least_points, F.lit(25.0)),
    ]
    hit = [(name, F.coalesce(c, F.lit(False)), s) for name, c, s in rules]
    score = sum((F.when(c, s).otherwise(0.0) for _, c, s in hit[1:]), F.when(hit[0][1], hit[0][2]).otherwise(0.0))
    return df.withColumns({"label_score": score, "label_reasons": F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c, _ in hit)))})


def robust_z(df: DataFrame, key: str, by: str, fields: tuple[str, ...], limit: float = 4.5, least: int = 8) -> DataFrame:
    """(key, outlier_score, outlier_reasons): log1p of the fields against median and 1.4826 * MAD of the class (``least`` values or more);
    z >= limit adds min(40, 4z) and ``<field>_outlier_z<z>``."""
    long = df.select(key, by, *(F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in fields)).unpivot([key, by], list(fields), "field", "v").filter("v IS NOT NULL")
    k = long.groupBy(by, "field").agg(F.count("*").alias("k"))
    bounded = fits(df, [by])
    middle = quantiles(long, "v", [0.5], [by, "field"], bounded).select(by, "field", F.get("q", F.lit(0)).alias("m")).join(k, [by, "field"])
    dev = long.join(middle, [by, "field"]).withColumn("d", F.abs(F.col("v") - F.col("m")))
    mad = quantiles(dev, "d", [0.5], [by, "field"], bounded).select(by, "field", F.greatest(F.get("q", F.lit(0)) * 1.4826, F.lit(1e-9)).alias("s"))
    z = dev.join(mad, [by, "field"]).withColumn("z", F.round(F.col("d") / F.col("s"), 6)).filter((F.col("k") >= least) & (F.col("z") >= limit))
    place = F.coalesce(*(F.when(F.col("field") == f, i) for i, f in enumerate(fields)))
    reason = F.format_string("%s_outlier_z%.1f", F.col("field"), F.col("z"))
    found = z.groupBy(key).agg(F.sum(F.least(F.lit(40.0), 4 * F.col("z"))).alias("outlier_score"), F.array_sort(F.collect_list(F.struct(place.alias("p"), reason.alias("r")))).alias("__r"))
    return found.select(key, F.round("outlier_score", 6).alias("outlier_score"), F.transform("__r", lambda x: x["r"]).alias("outlier_reasons"))


def join_reasons(df: DataFrame, columns: list[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.withColumn("reasons", F.array_join(F.array_distinct(F.concat(*(F.coalesce(c, none) for c in columns))), ";"))


# Beginnings of the reasons that make a sample a case of high priority.
HARD = ("dataset_class_ne_predicted_class", "low_confidence", "low_pcd_point_count", "non_finite_xyz", "empty_or_invalid_xyz", "pcd_read_error")


def queue(df: DataFrame, score: str, by: str, key: str) -> DataFrame:
    """suspicious, high_priority and rank by score, class, sample. High priority: a reason that begins like one of HARD, or an outlier with a score of 80 or more."""
    df = df.withColumn("suspicious", F.col(score) > 0)
    hard = F.exists(F.split("reasons", ";"), lambda r: reduce(lambda a, b: a | b, (r.startswith(h) for h in HARD)))
    high = F.col("suspicious") & (hard | (F.contains("reasons", F.lit("_outlier_z")) & (F.col(score) >= 80)))
    return range_ranked(df.withColumn("high_priority", high), [F.desc(score), F.asc(by), F.asc(key)])


def report(df: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent reasons of suspicious samples."""
    r = df.filter("suspicious AND reasons <> ''").select(F.explode(F.split("reasons", ";")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def class_report(df: DataFrame, by: str) -> DataFrame:
    """Samples, suspicious and high-priority ones per class."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if("suspicious").alias("suspicious"), F.count_if("high_priority").alias("high_priority"))


def top_samples(df: DataFrame, n: int = 25) -> DataFrame:
    """The first n suspicious samples of the queue."""
    return df.filter("suspicious").orderBy("rank").limit(n)
