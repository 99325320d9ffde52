"""Catalogue preparation: filters, label resolution, caps, class maps, view selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.hashing import hash_key


def _long(c: Column) -> Column:
    return c.cast("bigint")


def since(df: DataFrame, start: str, day: str = "day", keep_undated: bool = False) -> DataFrame:
    """Rows of ``day`` >= start. Text that is not a date is skipped, or kept for raw frames."""
    d = F.col(day) if dict(df.dtypes)[day] == "date" else F.try_to_date(F.col(day), "yyyy-MM-dd")
    keep = d >= F.to_date(F.lit(start))
    return df.filter(keep | d.isNull() if keep_undated else keep)


def min_points(df: DataFrame, least: int, exempt: list[str] = (), counts: tuple[str, ...] = ("point_count",)) -> DataFrame:
    """Drop clouds of fewer points unless the class is exempt; of several counts the smallest decides; 0 disables."""
    if least <= 0:
        return df
    n = F.least(*counts) if len(counts) > 1 else F.col(counts[0])
    return df.filter((n >= least) | F.col("class_name").isin(*exempt))


def remap_classes(df: DataFrame, exclude: list[str] = (), only: list[str] = (), mapping: dict[str, str] | None = None) -> DataFrame:
    """Class map first, then exclude and restrict lists."""
    name = F.col("class_name")
    for old, new in (mapping or {}).items():
        name = F.when(F.col("class_name") == old, F.lit(new)).otherwise(name)
    df = df.withColumn("class_name", name)
    df = df.filter(~F.col("class_name").isin(*exclude)) if exclude else df
    return df.filter(F.col("class_name").isin(*only)) if only else df


def class_index(df: DataFrame, forced: list[str] = (), column: str = "class_name") -> DataFrame:
    """Distinct names with their index: forced names first in their order, the rest sorted."""
    names = df.select(F.col(column).alias("class_name")).distinct()
    if forced:
        names = names.unionByName(df.sparkSession.createDataFrame([(n,) for n in forced], "class_name string")).distinct()
    place = F.coalesce(*(F.when(F.col("class_name") == n, i) for i, n in enumerate(forced)), F.lit(len(forced))) if forced else F.lit(0)
    return names.select("class_name", _long(F.row_number().over(W.orderBy(place, "class_name")) - 1).alias("class_id"))  # classes only


def union_labels(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Datasets united: tagged by name, missing id columns empty, classes indexed over all of them."""
    both = None
    for name, df in parts.items():
        own = df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in columns)).withColumn("source_dataset", F.lit(name))
        both = own if both is None else both.unionByName(own)
    return both.join(class_index(both), "class_name")


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


# The metadata fields that name a class, in the order in which a label is looked for; and those that its provenance is looked for in, with what it is called.
LABEL_FIELDS = ("review_final_class_name", "final_class_name", "class_name", "gt_class_name", "obj_class", "predicted_class_name")
SOURCE_FIELDS = (
    ("review_final_class_name", "review.final_class_name"), ("final_class_name", "final_class_name"), ("gt_class_name", "gt_class_name"), ("gt_obj_class", "gt_obj_class"),
    ("obj_class", "obj_class"), ("class_name", "class_name_pseudo"), ("predicted_class_name", "predicted_class_name_pseudo"),
)


def resolve_label(df: DataFrame, known: list[str], path: str, fields: tuple[str, ...] = LABEL_FIELDS, sources: tuple[tuple[str, str], ...] = SOURCE_FIELDS) -> DataFrame:
    """``label``: the first of ``fields`` that names a known class, else the path part nearest the leaf that does. ``label_source``: the first of ``sources`` that is
    filled, whatever it names, else ``path``. The two orders differ. Fields that the table lacks are empty."""
    names = F.array(*(F.lit(k) for k in known))
    plain = F.transform(names, plain_name)

    def match(c: Column) -> Column:
        return F.get(names, (F.array_position(plain, plain_name(c)) - 1).cast("int"))

    parts = F.filter(F.transform(F.reverse(F.split(path, "/")), match), lambda x: x.isNotNull())
    found = [F.when(F.array_contains(plain, plain_name(F.col(f))), match(F.col(f))) for f in fields if f in df.columns]
    filled = [F.when(F.col(f) != "", F.lit(name)) for f, name in sources if f in df.columns]
    return df.withColumns({"label": F.coalesce(*found, F.get(parts, F.lit(0))), "label_source": F.coalesce(*filled, F.lit("path"))})


def all_pseudo(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whether every label comes from a pseudo field or the path."""
    pseudo = F.col("label_source").endswith("_pseudo") | (F.col("label_source") == "path")
    return df.groupBy(*by).agg((F.coalesce(F.bool_and(pseudo), F.lit(False)) & (F.count("*") > 0)).alias("all_pseudo"))


def cap(df: DataFrame, k: int, by: str, order: list) -> DataFrame:
    """At most k rows per class in the given order; k <= 0 keeps all."""
    if k <= 0:
        return df
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def cap_hashed(df: DataFrame, k: int, key: str, by: str = "class_name", seed: int | None = None) -> DataFrame:
    return cap(df, k, by, [hash_key(key) if seed is None else hash_key(seed, key), key])


def cap_summary(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    b, a = (df.groupBy(by).agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    return b.join(a, by, "left").na.fill(0, ["n_after"])


def first_groups(df: DataFrame, n: int, by: str, group: str, order: str) -> DataFrame:
    """All rows of the first n groups per class, by first appearance."""
    first = df.groupBy(by, group).agg(F.min(order).alias("__f"))
    keep = first.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy("__f", group))).filter(F.col("__r") <= n)
    return df.join(keep.select(by, group), [by, group], "left_semi")


def sample_per_class(df: DataFrame, n: int, key: str, by: str, seed: int, earlier: DataFrame | None = None) -> DataFrame:
    """At most n rows per class without replacement, or the rows of an earlier run."""
    return df.join(earlier.select(key), key, "left_semi") if earlier is not None else cap_hashed(df, n, key, by, seed)


def _best_order(key: str) -> Column:
    return F.struct(F.col("extent"), F.col("point_count"), hash_key(key), F.col(key))


def best_frame(df: DataFrame, group: str, key: str) -> DataFrame:
    """The frame of largest extent, then points, then hash, per group."""
    return df.groupBy(group).agg(F.max_by(F.struct(*(c for c in df.columns if c != group)), _best_order(key)).alias("b")).select(group, "b.*")


def frame_order(frame: str) -> list[Column]:
    """Frames by number, then those whose id is no number, by text."""
    number = F.col(frame).cast("string").try_cast("bigint")
    return [number.isNull(), number, F.col(frame)]


def views_uniform(df: DataFrame, v: int, group: str, order: str) -> DataFrame:
    """Up to v frames per group at evenly spaced places of the frame order, with their new index."""
    w, by = W.partitionBy(group), frame_order(order)
    df = df.withColumn("__i", F.row_number().over(w.orderBy(*by)) - 1).withColumn("__n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(v - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(v - 1, 1))))
    keep = (F.col("__n") <= v) | F.array_contains(places, F.col("__i").cast("bigint"))
    return df.filter(keep).withColumn("view_idx", _long(F.row_number().over(w.orderBy(*by)) - 1)).drop("__i", "__n")


def views_largest(df: DataFrame, v: int, group: str, key: str) -> DataFrame:
    """The v best frames per group, numbered in frame order."""
    best = cap(df, v, group, [F.desc("extent"), F.desc("point_count"), F.desc(hash_key(key)), F.desc(key)])
    return best.withColumn("view_idx", _long(F.row_number().over(W.partitionBy(group).orderBy(*frame_order(key))) - 1))


def assemble_objects(df: DataFrame, group: str, key: str, distance: str) -> DataFrame:
    """One row per object: frame list, count, representative, mean distance."""
    return df.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list(key)), ",").alias("frames"),
        F.count("*").alias("n_views"),
        F.max_by(F.col(key), _best_order(key)).alias("representative"),
        F.round(F.avg(distance), 6).alias("distance"),
    )


def distance_and_extent(df: DataFrame, first: str, second: str, extents: list[str], bounds: DataFrame | None = None, key: str = "cloud_id") -> DataFrame:
    """|first present metric| else 0; the largest |extent| of the metadata, else that of the points."""
    df = df.withColumn("distance", F.coalesce(F.abs(first), F.abs(second), F.lit(0.0)))
    meta = F.greatest(*(F.abs(F.col(c)) for c in extents))
    if bounds is None:
        return df.withColumn("extent", F.coalesce(meta, F.lit(0.0)))
    size = bounds.select(key, F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.col("max_z") - F.col("min_z")).alias("__s"))
    return df.join(size, key, "left").withColumn("extent", F.coalesce(meta, "__s", F.lit(0.0))).drop("__s")


def class_overview(df: DataFrame, splits: tuple[str, ...] = ("train", "val", "test"), by: str = "class_name") -> DataFrame:
    """class x (train, val, test, total), zero-filled."""
    wide = df.groupBy(by).pivot("split", list(splits)).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(s) for s in splits[1:]), F.col(splits[0])))


def round_robin(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """One row of each class in turn until n."""
    turn = df.withColumn("turn", _long(F.row_number().over(W.partitionBy(by).orderBy(key)))).filter(F.col("turn") <= n)
    return turn.orderBy("turn", by).limit(n)
