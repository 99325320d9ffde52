"""Curation from predictions: rule tables, rule filter, row selection and the composite builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.operators import catalog, split

# Column aliases and columns of rule files, and the names of their keys, the first present one counts.
ALIASES = {"class_name": "current_class", "json_class": "current_class"}
COLUMNS = ("bucket", "current_class", "predicted_class", "folder_class")
ALLOW = ("allow_sources", "sources", "allowed_sources")
DENY = ("disallow_sources", "deny_sources", "disallowed_sources")
EQUAL = ("require_equal", "must_equal", "strict_columns")
MODE = ("match_mode", "mode")


def _column(c: Column) -> Column:
    c = F.trim(c)
    return F.coalesce(*(F.when(c == a, F.lit(b)) for a, b in ALIASES.items()), c)


def _names(text: Column) -> Column:
    """A list, a single name, or none (null, false) of a rule file's value."""
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == "false"), none).when(F.ltrim(text).startswith("["), F.coalesce(F.from_json(text, "array<string>"), none)).otherwise(F.array(text))


def _first(body: Column, keys: tuple[str, ...], default: Column) -> Column:
    """The value of the first key that is there, even if it is null."""
    out = default
    for k in reversed(keys):
        out = F.when(F.map_contains_key(body, k), F.element_at(body, k)).otherwise(out)
    return out


def rule_table(texts: DataFrame) -> DataFrame:
    """rules(target, allow, deny, require_equal, mode) from JSON texts: {"rules": {target: rule, ...}, ...} or the rules alone.

    A rule is an object with the keys ALLOW (default ``*``), DENY, EQUAL and MODE (``and``, ``or``), or just its allowed sources. A list, one name, ``*``, null
    and false stand for names. Unknown columns or modes are errors.
    """
    file = F.from_json("text", "map<string,string>")
    each = texts.select(F.explode(F.when(F.map_contains_key(file, "rules"), F.from_json(F.element_at(file, "rules"), "map<string,string>")).otherwise(file)).alias("target", "body"))
    each = each.withColumn("rule", F.when(F.ltrim("body").startswith("{"), F.from_json("body", "map<string,string>")))
    rule, none = F.col("rule"), F.lit(None).cast("string")
    long = rule.isNotNull()
    rules = each.select(
        "target",
        F.when(long, _names(_first(rule, ALLOW, F.lit("*")))).otherwise(_names(F.col("body"))).alias("allow"),
        _names(F.when(long, _first(rule, DENY, none))).alias("deny"),
        F.transform(_names(F.when(long, _first(rule, EQUAL, none))), _column).alias("require_equal"),
        F.when(long, F.lower(_first(rule, MODE, F.lit("and")))).otherwise("and").alias("mode"),
    )
    bad = F.exists("require_equal", lambda c: ~c.isin(*COLUMNS)) | ~F.coalesce(F.col("mode").isin("and", "or"), F.lit(False))
    check = F.assert_true(~bad, F.concat(F.lit("unsupported rule for "), F.col("target")))
    return rules.withColumn("__ok", check).filter("__ok IS NULL").drop("__ok")


def rule_columns(texts: DataFrame, target: str = "predicted_class", source: str = "current_class") -> dict[str, str]:
    """The target and source columns that a rule file with ``rules`` names, else the given ones; aliases resolved, others are errors."""
    file = F.from_json("text", "map<string,string>")
    named = lambda key, other: _column(F.coalesce(F.when(F.map_contains_key(file, "rules"), F.nullif(F.element_at(file, key), F.lit(""))), F.lit(other)))
    row = texts.select(named("target_column", target).alias("target"), named("source_column", source).alias("source")).first()  # one file
    found = row.asDict() if row else {"target": target, "source": source}
    if found["target"] not in COLUMNS or found["source"] not in (*COLUMNS, "is_match"):
        raise ValueError(f"unsupported rule columns {found}")
    return found


def apply_rules(df: DataFrame, rules: DataFrame, target: str = "predicted_class", source: str = "current_class") -> DataFrame:
    """Rows that the rule of their target, else that of ``*``, lets pass; no rule rejects. Deny beats allow; ``*`` in either is any; then all (and) or any (or)
    of the require_equal columns must equal the target; a column that the table lacks is empty. The rule table is small and broadcast by Spark's own size
    check."""
    own = rules.filter("target <> '*'").select(F.col("target").alias("__t"), F.struct("allow", "deny", "require_equal", "mode").alias("__own"))
    other = rules.filter("target = '*'").agg(F.first(F.struct("allow", "deny", "require_equal", "mode")).alias("__any"))
    df = df.join(own, F.col(target) == F.col("__t"), "left").crossJoin(F.broadcast(other)).withColumn("__r", F.coalesce("__own", "__any"))  # one row
    s = F.coalesce(F.trim(F.col(source).cast("string")), F.lit(""))
    allowed, denied = (F.array_contains(f"__r.{k}", s) | F.array_contains(f"__r.{k}", "*") for k in ("allow", "deny"))
    value = {c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("") for c in COLUMNS}
    flags = F.transform("__r.require_equal", lambda c: F.coalesce(*(F.when(c == name, v == F.col(target)) for name, v in value.items()), F.lit(False)))
    equal = (F.size(flags) == 0) | F.when(F.col("__r.mode") == "or", F.exists(flags, lambda x: x)).otherwise(F.forall(flags, lambda x: x))
    return df.filter(F.col("__r").isNotNull() & allowed & ~denied & equal).drop("__t", "__own", "__any", "__r")


def select_rows(df: DataFrame, rules: DataFrame, buckets: list[str] = (), which: str = "all", least: float = 0.0, limit: int = 0, key: str = "ord", **columns) -> DataFrame:
    """Bucket list, all/matches/mismatches, confidence (missing counts 0), rules, then the first ``limit`` rows by key."""
    if buckets:
        df = df.filter(F.col("bucket").isin(*buckets))
    if which != "all":
        df = df.filter(F.col("is_match") == (1 if which == "matches" else 0))
    df = apply_rules(df.filter(F.coalesce("confidence", F.lit(0.0)) >= least), rules, **columns)
    return df.orderBy(key).limit(limit) if limit else df


def folder_class(path: Column) -> Column:
    """The parent folder, or the grandparent when the parent is ``pcds``."""
    parts = F.split(path, "/")
    parent = F.try_element_at(parts, F.lit(-2))
    return F.when(parent == "pcds", F.try_element_at(parts, F.lit(-3))).otherwise(parent)


def unique_names(df: DataFrame, by: list[str], name: str, key: str) -> DataFrame:
    """``output_name``: the sample, then ``<sample>__dup1``, ... within a class folder."""
    r = F.row_number().over(W.partitionBy(*by, name).orderBy(key)) - 1
    return df.withColumn("output_name", F.concat(F.col(name), F.when(r > 0, F.concat(F.lit("__dup"), r.cast("string"))).otherwise(F.lit(""))))


def curated_build(df: DataFrame, rules: DataFrame, k: int, ratios: tuple[float, float, float], seed: int, least: float = 0.0) -> DataFrame:
    """Select, cap per target class, split per (class, object), unique names: the manifest rows."""
    chosen = select_rows(df, rules, least=least).withColumn("dataset_class", F.col("predicted_class"))
    capped = catalog.cap_hashed(chosen, k, "stem", "dataset_class", seed)
    parts = split.split_objects(capped, split.zero_aware, ratios, ["dataset_class", "object_id"], "dataset_class")
    return unique_names(parts, ["split", "dataset_class"], "object_id", "stem")


def review_build(df: DataFrame, ratios: tuple[float, float, float], exclude: list[str], mapping: dict[str, str]) -> DataFrame:
    return split.split_review(catalog.remap_classes(df, exclude, mapping=mapping), ratios, "stem")


def flat_build(df: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """Leak-free split by object, checked (an error if any object stands in two splits), with unique names."""
    parts = split.assert_no_leaks(split.split_objects(df, split.with_minimum, ratios, ["object_id"]), ["object_id"])
    return unique_names(parts, ["split", "class_name"], "object_id", "stem")


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def manifest_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def write_dataset(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A split/class tree; refuses an existing one unless told to overwrite."""
    df.write.partitionBy("split", "dataset_class").mode("overwrite" if overwrite else "error").parquet(path)


