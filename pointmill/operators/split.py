"""Leak-free splits, class balance and label randomisation. Shuffles are hash orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.hashing import hash_key, uniform
from pointmill.functions.ranking import hash_ranked


def largest_remainder(n: Column, ratios: tuple[float, float, float]) -> list[Column]:
    """Counts of train, val, test: floors, then one each to the largest fractions; ties in that order."""
    exact = [n * F.lit(float(r)) for r in ratios]
    base = [F.floor(e + F.lit(1e-9)).cast("bigint") for e in exact]
    rest = n - (base[0] + base[1] + base[2])
    frac = [F.round(e - b, 9) for e, b in zip(exact, base)]
    return [b + F.when(sum(((g > f) | ((g == f) & F.lit(j < i))).cast("int") for j, g in enumerate(frac) if j != i) < rest, 1).otherwise(0) for i, (b, f) in enumerate(zip(base, frac))]


def with_minimum(n: Column, ratios: tuple[float, float, float]) -> list[Column]:
    """int(ratio * n); from three objects at least one each of train and val; two: train and test; one: train."""
    t, v = (F.floor(n * F.lit(float(r)) + F.lit(1e-9)).cast("bigint") for r in ratios[:2])
    t, v = F.greatest(t, F.lit(1)), F.greatest(v, F.lit(1))
    full = t + v >= n
    train = F.when(n == 1, 1).when(n == 2, 1).when(full, F.greatest(F.lit(1), n - 2)).otherwise(t)
    val = F.when(n <= 2, 0).when(full, 1).otherwise(v)
    return [train, val, n - train - val]


def zero_aware(n: Column, ratios: tuple[float, float, float]) -> list[Column]:
    """As many as the ratios ask, a minimum of one only where a ratio is above 0; overflow is taken from val, then train."""
    v, s = (F.greatest(F.floor(n * F.lit(float(r)) + F.lit(1e-9)).cast("bigint"), F.lit(1 if r > 0 else 0)) for r in ratios[1:])
    floor = 1 if ratios[0] > 0 else 0
    over = F.greatest(F.lit(0), v + s + floor - n)
    val = F.greatest(F.lit(0), v - over)
    test = F.least(s, F.greatest(F.lit(0), n - floor - val))
    return [n - val - test, val, test]


def split_objects(df: DataFrame, counts, ratios: tuple[float, float, float], group: list[str], stratum: str | None = None) -> DataFrame:
    """``split`` for every row: the objects of a stratum in hash order are dealt by ``counts``; rows inherit their object's split.

    stratum None: the sorted set of the object's classes.
    """
    own = F.array_join(F.array_sort(F.collect_set("class_name")), "::") if stratum is None else F.first(stratum)
    objects = df.groupBy(*group).agg(own.alias("__stratum"))
    objects = hash_ranked(objects, ["__stratum"], hash_key(*group), group)
    train, val, _ = counts(F.col("__n"), ratios)
    side = F.when(F.col("__r") <= train, "train").when(F.col("__r") <= train + val, "val").otherwise("test")
    return df.join(objects.select(*group, side.alias("split")), group)


def split_review(df: DataFrame, ratios: tuple[float, float, float], key: str, by: str = "class_name") -> DataFrame:
    """Curated rows train; review rows fill val and test up to the counts of both sources together; the rest of them train."""
    total = df.groupBy(by).agg(F.count("*").alias("__n"))
    val, test = (F.floor(F.col("__n") * F.lit(r) + F.lit(1e-9)) for r in ratios[1:])
    rank = F.col("__r")
    side = F.when(F.col("source") == "curated", "train").when(rank <= val, "val").when(rank <= val + test, "test").otherwise("train")
    ranked = hash_ranked(df, [by, "source"], hash_key(key), [key]).drop("__n")
    return ranked.join(total, by).withColumn("split", side).drop("__n", "__r")


def split_report(df: DataFrame, ratios: tuple[float, float, float], by: str = "class_name") -> DataFrame:
    """Rows per split and class with the achieved and the requested share; ratios are divided by their sum."""
    if min(ratios) < 0 or sum(ratios) <= 0:
        raise ValueError("ratios must be non-negative and not all zero")
    asked = F.lit(None).cast("double")
    for name, r in zip(("train", "val", "test"), ratios):
        asked = F.when(F.col("split") == name, F.lit(r / sum(ratios))).otherwise(asked)
    n = df.groupBy("split", by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(by)), 6)).withColumn("requested", F.round(asked, 6))


def leaks(df: DataFrame, group: list[str]) -> DataFrame:
    """Objects that stand in more than one split."""
    return df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n")).filter("n > 1")


def assert_no_leaks(df: DataFrame, group: list[str]) -> DataFrame:
    found = leaks(df, group).orderBy(*group).limit(10).collect()
    if found:
        raise ValueError(f"objects in several splits: {[tuple(r[g] for g in group) for r in found]}")
    return df


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("n_shared"))


def _dealt(df: DataFrame, target: Column, key: str, by: str) -> DataFrame:
    """Rows in hash order repeated or cut to ``target`` per class (of __n rows), with a 0-based place."""
    df = hash_ranked(df, [by], hash_key(key), [key])
    df = df.withColumn("__t", target).withColumn("__c", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__t") / F.col("__n")).cast("int") - 1)))
    return df.withColumn("place", F.col("__c") * F.col("__n") + F.col("__r") - 1).filter("place < __t").drop("__n", "__r", "__t", "__c")


def balanced_epoch(df: DataFrame, batch: int, k: int, max_repeat: int, key: str, by: str = "class_name") -> DataFrame:
    """Batches with batch/k rows of each of k classes: minorities repeat evenly, majorities are cut."""
    if batch % k:
        raise ValueError("batch must be a multiple of the number of classes")
    per = batch // k
    size = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").alias("__hi"), F.min("n").alias("__lo"))
    batches = F.least(F.ceil(F.col("__hi") / F.lit(per)), F.floor(F.col("__lo") * F.lit(max_repeat) / F.lit(per)))
    out = _dealt(df.crossJoin(F.broadcast(size)), batches.cast("bigint") * per, key, by)
    return out.withColumn("batch", F.floor(F.col("place") / F.lit(per)).cast("bigint")).drop("__hi", "__lo")


def oversampled_epoch(df: DataFrame, repeat: int, key: str, by: str = "class_name") -> DataFrame:
    """Every class repeated to the largest one's size, at most ``repeat`` times."""
    size = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").alias("__hi"))
    return _dealt(df.crossJoin(F.broadcast(size)), F.least(F.col("__hi"), F.col("__n") * repeat), key, by).drop("__hi")


def class_weights(df: DataFrame, mode: str = "inverse_sqrt", by: str = "class_name", classes: list[str] | None = None) -> DataFrame:
    """1/sqrt(n), 1/n or 1 by class, divided by their mean. A class of the list ``classes`` without rows is an error."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    if classes is not None:
        named = df.sparkSession.createDataFrame([(c,) for c in classes], f"{by} string")
        n = named.join(n, by, "left")
        n = n.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no rows of class "), F.col(by))).cast("bigint")).otherwise(F.col("n")))
    raw = {"inverse_sqrt": 1 / F.sqrt("n"), "inverse": 1 / F.col("n"), "none": F.lit(1.0)}[mode]
    return n.withColumn("w", raw).withColumn("weight", F.round(F.col("w") / F.avg("w").over(W.partitionBy()), 6)).drop("w")  # a row a class


def permute_labels(df: DataFrame, key: str, seed: int, label: str = "class_name") -> DataFrame:
    """The same labels re-paired with rows: the i-th row by key takes the label of the i-th by hash."""
    a = hash_ranked(df, [], hash_key(key), [key], "__i").drop("__n")
    b = hash_ranked(df.select(key, F.col(label).alias("random_label")), [], hash_key(seed, key), [key], "__i").select("__i", "random_label")
    return a.join(b, "__i").drop("__i")


def uniform_labels(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    return df.withColumn("random_class", F.floor(uniform(seed, key) * k).cast("bigint"))
