"""Prediction merging: softmax, scatter means, late fusion, votes, projection, part refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.operators.geom import VOXEL, consolidate, neighbours, with_voxel


def argmax(c: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("bigint")


def predict(df: DataFrame, logits: str = "logits") -> DataFrame:
    """pred (first maximum) and confidence (its softmax share)."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({"pred": argmax(F.col(logits)), "confidence": 1 / total})


def mismatches(df: DataFrame, current: str) -> DataFrame:
    return df.filter(F.col("pred") != F.col(current))


#: Classes whose means are summed side by side; more go one to a row.
SIDE_BY_SIDE = 256


def mean_logits(df: DataFrame, by: list[str], logits: str = "logits", classes: int | None = None) -> DataFrame:
    """Mean per class over the rows of a key, and its argmax: overlapping points, views of an object, votes. ``classes``, the length of the longest array, is found out if not given.

    The classes' sums stand side by side, so a task sends one row a key, already added up.
    """
    if classes is None:
        classes = df.agg(F.max(F.size(logits))).first()[0] or 0
    if not 0 < classes <= SIDE_BY_SIDE:
        long = df.select(*by, F.posexplode(logits).alias("__k", "__v")).groupBy(*by, "__k").agg(F.round(F.avg("__v"), 9).alias("__m"))
        return long.groupBy(*by).agg(F.max_by("__k", F.struct("__m", -F.col("__k"))).cast("bigint").alias("pred"), F.round(F.max("__m"), 6).alias("top"))
    means = df.filter(F.size(logits) > 0).groupBy(*by).agg(*(F.round(F.avg(F.get(logits, F.lit(i))), 9).alias(f"__{i}") for i in range(classes)))
    means = means.select(*by, F.array(*(f"__{i}" for i in range(classes))).alias("__m"))
    return means.select(*by, F.coalesce(argmax(F.col("__m")), F.lit(0).cast("bigint")).alias("pred"), F.round(F.array_max("__m"), 6).alias("top"))


def project(points: DataFrame, size: float, value: str) -> DataFrame:
    """The value of each voxel's representative (most confident point) on all points of the voxel."""
    rep = consolidate(points, size, float("-inf")).select("cloud_id", *VOXEL, F.col(value).alias("projected"))
    return with_voxel(points, size).join(rep, ["cloud_id", *VOXEL]).drop(*VOXEL)


def refine_parts(df: DataFrame, label: str, least: int, allowed: DataFrame | None = None) -> DataFrame:
    """Parts of fewer than ``least`` points, or not in ``allowed`` (cloud_id, label), take the most frequent other label among the least + 1 nearest
    points (ties: smaller label), in one pass; only where the cloud has several labels."""
    n = df.groupBy("cloud_id", F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    kinds = n.groupBy("cloud_id").agg(F.count("*").alias("__k"))
    bad = n.join(kinds, "cloud_id").filter(F.col("__k") > 1)
    if allowed is not None:
        ok = allowed.select("cloud_id", F.col("label").alias("__l"), F.lit(True).alias("__ok"))
        bad = bad.join(ok, ["cloud_id", "__l"], "left").filter((F.col("__n") < least) | F.col("__ok").isNull())
    else:
        bad = bad.filter(F.col("__n") < least)
    weak = df.join(bad.select("cloud_id", F.col("__l").alias(label)), ["cloud_id", label], "left_semi").select("cloud_id", "pt")
    clouds = df.join(bad.select("cloud_id").distinct(), "cloud_id", "left_semi")
    nb = neighbours(clouds, least + 1, ids_only=True).join(weak, ["cloud_id", "pt"], "left_semi").select("cloud_id", "pt", "n_pt")
    own = df.select("cloud_id", "pt", F.col(label).alias("__own"))
    near = df.select("cloud_id", F.col("pt").alias("n_pt"), F.col(label).alias("__near"))
    votes = nb.join(own, ["cloud_id", "pt"]).join(near, ["cloud_id", "n_pt"]).filter("__near <> __own").groupBy("cloud_id", "pt", "__near").agg(F.count("*").alias("__v"))
    new = votes.groupBy("cloud_id", "pt").agg(F.max_by("__near", F.struct("__v", -F.col("__near"))).alias("__new"))
    return df.join(new, ["cloud_id", "pt"], "left").withColumn("refined", F.coalesce("__new", label)).drop("__new")


def remap_ids(df: DataFrame, label: str, table: dict[int, int]) -> DataFrame:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return df.withColumn("mapped", F.element_at(m, F.col(label)))


def agreement(df: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    """Accuracy of two models, their difference, number and share of changed predictions."""
    acc = [F.avg((F.col(p) == F.col(truth)).cast("double")) for p in (a, b)]
    changed = F.count_if(F.col(a) != F.col(b))
    return df.agg(F.round(acc[0], 6).alias("acc_a"), F.round(acc[1], 6).alias("acc_b"), F.round(acc[1] - acc[0], 6).alias("diff"), changed.alias("changed"), F.round(changed / F.count("*"), 6).alias("changed_share"))
