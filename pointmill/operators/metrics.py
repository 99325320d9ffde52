"""Metrics and logs: confusion, accuracy, F1, IoU, running bests, latency, run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.ranking import join_same, quantiles
from pointmill.operators.catalog import cap
from pointmill.operators.geom import consolidate


def confusion(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Dense (true, pred, n): every pair of classes seen on either side, zeros included."""
    n = df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    names = df.select(F.explode(F.array(true, pred)).alias("true")).distinct()  # classes only
    grid = names.crossJoin(names.select(F.col("true").alias("pred")))
    if by:
        grid = df.select(*by).distinct().crossJoin(grid)
    return grid.join(n, [*by, "true", "pred"], "left").na.fill(0, ["n"])


def normalised(cm: DataFrame) -> DataFrame:
    row = F.sum("n").over(W.partitionBy("true"))
    return cm.withColumn("share", F.round(F.col("n") / F.greatest(row, F.lit(1)), 4))


def pivoted(cm: DataFrame, classes: list[str]) -> DataFrame:
    return normalised(cm).groupBy("true").pivot("pred", classes).agg(F.first("share"))


def accuracy(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    """OA and mean class accuracy; classes without rows are left out of the mean."""
    per = df.groupBy(*by, true).agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("a"), F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 6).alias("oa"), F.round(F.avg("a"), 6).alias("macc"), F.sum("n").alias("n"))


def precision_recall(cm: DataFrame) -> DataFrame:
    """Per class; 0 where undefined."""
    row = cm.groupBy(F.col("true").alias("class_name")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n"))).alias("tp"))
    col = cm.groupBy(F.col("pred").alias("class_name")).agg(F.sum("n").alias("predicted"))
    df = row.join(col, "class_name").na.fill(0)
    p, r = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return df.select("class_name", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def macro(pr: DataFrame) -> DataFrame:
    return pr.filter("support > 0").agg(*(F.round(F.avg(c), 6).alias("macro_" + c) for c in ("precision", "recall", "f1")))


def iou(cm: DataFrame, by: list[str] = (), ignore: str | None = None) -> DataFrame:
    """IoU, recall per class and their means with OA, in percent, from (by, true, pred, n) rows; an ignored label is left out before counting."""
    cm = cm.filter(F.col("true") != ignore) if ignore is not None else cm
    row = cm.groupBy(*by, F.col("true").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    col = cm.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("predicted"))
    df = row.join(col, [*by, "c"], "left").na.fill(0)
    union = F.col("support") + F.col("predicted") - F.col("tp")
    df = df.withColumns({"i": F.when(union > 0, 100 * F.col("tp") / union), "a": F.when(F.col("support") > 0, 100 * F.col("tp") / F.col("support"))})
    return df.groupBy(*by).agg(F.round(F.avg("i"), 6).alias("miou"), F.round(F.avg("a"), 6).alias("macc"), F.round(100 * F.sum("tp") / F.sum("support"), 6).alias("oa"))


def pooled_folds(df: DataFrame, area: str, true: str, pred: str) -> DataFrame:
    """IoU metrics per area and pooled over ``all``."""
    cube = df.groupingSets([[F.col(area), F.col(true), F.col(pred)], [F.col(true), F.col(pred)]], area, true, pred).agg(F.count("*").alias("n"), F.grouping(area).alias("g"))
    cm = cube.select(F.when(F.col("g") == 1, "all").otherwise(F.col(area).cast("string")).alias("area"), F.col(true).alias("true"), F.col(pred).alias("pred"), "n")
    return iou(cm, ["area"])


def shape_iou(df: DataFrame, shape: str, category: str, label: str, pred: str, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per shape the mean IoU (percent) over the parts of its category, empty unions 100; and the instance mean with the mean over all categories of
    ``parts`` (category, part), where absent categories count 0."""
    both = df.groupBy(shape, category, F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    own = df.select(shape, category).distinct().join(parts, category)
    t = own.join(both, [shape, category], "left")
    inter = F.sum(F.when((F.col("l") == F.col("part")) & (F.col("p") == F.col("part")), F.col("n")).otherwise(0))
    union = F.sum(F.when((F.col("l") == F.col("part")) | (F.col("p") == F.col("part")), F.col("n")).otherwise(0))
    per = t.groupBy(shape, category, "part").agg(F.when(union == 0, 100.0).otherwise(100 * inter / union).alias("i"))
    per = per.groupBy(shape, category).agg(F.avg("i").alias("iou"))
    cats = parts.select(category).distinct().join(per.groupBy(category).agg(F.avg("iou").alias("c")), category, "left").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("c"))
    total = per.agg(F.round(F.avg("iou"), 6).alias("instance_miou")).crossJoin(F.broadcast(cats.select(F.round("c", 6).alias("category_miou"))))
    return per, total


def weighted_means(df: DataFrame, metrics: list[str], weight: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*(F.round(F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight))), 6).alias(m) for m in metrics))


def running_best(df: DataFrame, epoch: str, value: str, by: list[str] = ()) -> DataFrame:
    """Best value so far, and whether the epoch improved on all before it (strictly)."""
    w = W.partitionBy(*by).orderBy(epoch)
    before = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumns({"best": F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0)), "improved": before.isNull() | (F.col(value) > before)})


def best_epoch(df: DataFrame, epoch: str, value: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(epoch, F.struct(value, -F.col(epoch))).cast("bigint").alias("best_epoch"), F.max(value).alias("best"))


def latency(df: DataFrame, c: str, by: list[str] = ()) -> DataFrame:
    """Median, 95th percentile, deviation and number of the non-null values of a group; groups without any keep nulls."""
    own = df.groupBy(*by).agg(F.round(F.stddev_pop(c), 6).alias("std"), F.count(c).alias("n"))
    q = quantiles(df, c, [0.5, 0.95], by)
    both = join_same(own, q, list(by), "left")
    return both.select(*by, F.round(F.get("q", F.lit(0)), 6).alias("median"), F.round(F.get("q", F.lit(1)), 6).alias("p95"), "std", "n")


def timing_summary(df: DataFrame, first: str, second: str, by: list[str] = ()) -> DataFrame:
    """The first present of two fields, missing ones counted, then latency statistics."""
    df = df.withColumn("__s", F.coalesce(first, second))
    missing = df.groupBy(*by).agg(F.count_if(F.col("__s").isNull()).alias("missing"))
    out = latency(df, "__s", by)
    return join_same(out, missing, list(by))


def result_table(df: DataFrame, run: str, true: str, pred: str, classes: list[str]) -> DataFrame:
    """One wide row per run: OA, mAcc and a column per class."""
    per = df.groupBy(run, true).agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("a"))
    wide = per.groupBy(run).pivot(true, classes).agg(F.round(F.first("a"), 6))
    return accuracy(df, true, pred, [run]).drop("n").join(wide, run)


def run_matrix(runs: DataFrame, results: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Runs with their metrics and status (done, failed, missing); and how many of each."""
    df = runs.join(results, run, "left")
    df = df.withColumn("status", F.when(F.col("oa").isNotNull(), "done").when(F.col("error").isNotNull(), "failed").otherwise("missing"))
    return df, df.groupBy("status").agg(F.count("*").alias("n"))


def export_manifest(points: DataFrame, size: float, least: float, classes: DataFrame | None = None, per_class: int = 0, by: str = "class_name") -> DataFrame:
    """Per cloud: views, points before and after consolidation, rejected by confidence, mean confidence of the kept. With ``classes`` (cloud_id, class, in the
    order of cloud_id) and ``per_class`` above 0, at most so many clouds of a class, and their class."""
    if classes is not None:
        classes = cap(classes.select("cloud_id", by), per_class, by, ["cloud_id"])
        points = points.join(classes.select("cloud_id"), "cloud_id", "left_semi")
    before = points.groupBy("cloud_id").agg(F.count_distinct("view_id").alias("views"), F.count("*").alias("fused"), F.count_if(F.col("conf") < least).alias("rejected"))
    after = consolidate(points, size, least).groupBy("cloud_id").agg(F.count("*").alias("kept"), F.round(F.avg("conf") + 1e-10, 6).alias("mean_conf"))
    out = before.join(after, "cloud_id", "left").na.fill(0, ["kept"])
    return out if classes is None else out.join(classes, "cloud_id")
