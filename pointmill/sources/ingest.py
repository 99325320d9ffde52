"""Layouts, sidecars, identities, prediction tables and manifests; clouds and meshes are read by ``ranges`` and ``mesh``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.sources.mesh import read_meshes, sample_surface
from pointmill.sources.ranges import header_counts, list_files, read_clouds, write_texts

__all__ = ["read_meshes", "sample_surface", "header_counts", "list_files", "read_clouds", "write_texts"]

IGNORED = (".git", "__pycache__", "exports", "wandb", "checkpoint", "checkpoints")


def ignored(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*names))


def is_frame(path: Column, frame_meta: Column | None = None) -> Column:
    by_name = F.regexp_like(path, F.lit(r"__frame_[^_/]+\.[a-z]+$"))
    return by_name if frame_meta is None else by_name | F.coalesce(frame_meta, F.lit(False))


def layout(paths: DataFrame, path: str = "path") -> DataFrame:
    """layout, class_name, split, bucket of a path by the seven directory layouts."""
    parts = F.split(path, "/")
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    leaf = at(1)
    splits, mesh = ("train", "val", "test"), leaf.endswith(".off")
    kind = (
        F.when(mesh & at(2).isin("train", "test"), "mesh")
        .when(at(3).isin(*splits), "flat")
        .when((at(2) == "pcds") & at(4).startswith("gt-pred"), "bucket_pcds")
        .when(at(3).startswith("gt-pred"), "bucket_first")
        .when(at(2) == "pcds", "class_pcds")
        .when(F.regexp_like(at(4), F.lit(r"^\d{4}-\d{2}-\d{2}$")), "day_bucket_source")
        .otherwise("raw_frames")
    )
    name = (
        F.when(F.col("layout") == "mesh", at(3)).when(F.col("layout").isin("flat", "bucket_first"), at(2)).when(F.col("layout").isin("bucket_pcds", "class_pcds"), at(3))
        .when(F.col("layout") == "day_bucket_source", at(5)).otherwise(at(3))
    )
    bucket = F.when(F.col("layout") == "bucket_pcds", at(4)).when(F.col("layout") == "bucket_first", at(3)).when(F.col("layout") == "day_bucket_source", at(3))
    side = F.when(F.col("layout") == "mesh", at(2)).when(F.col("layout") == "flat", at(3))
    return paths.withColumn("layout", kind).withColumns({"class_name": name, "bucket": bucket, "split": side})


def of_split(paths: DataFrame, split: str, path: str = "path") -> DataFrame:
    """The files that a split reads of flat folders, split/class/file, and of mesh folders, class/{train,test}/file.off, where every split but train reads test."""
    mesh = F.regexp_like(path, F.lit(r"(^|/)(train|test)/[^/]*\.off$"))
    own = F.regexp_like(path, F.lit(rf"(^|/){'train' if split == 'train' else 'test'}/[^/]*\.off$"))
    return paths.filter(F.when(mesh, own).otherwise(F.regexp_like(path, F.lit(rf"(^|/){split}/[^/]+/[^/]+$"))))


def attach_sidecars(clouds: DataFrame, sidecars: DataFrame, schema: str, path: str = "path") -> DataFrame:
    """``meta`` from the JSON (path, text) beside the cloud, <folder>/<stem>.json; else, where the cloud's folder is pcds, from ../json/<stem without its frame>.json: the first
    that is JSON; else null. Each cloud keeps one row, whatever sidecars there are: of several rows of one sidecar path the least text counts."""
    readable = sidecars.filter(F.expr("try_parse_json(text)").isNotNull()).groupBy(F.regexp_replace("path", r"\.json$", "").alias("__s")).agg(F.min("text").alias("__t"))
    parsed = readable.select("__s", F.from_json("__t", schema, {"mode": "PERMISSIVE"}).alias("__m"))
    own = F.regexp_replace(path, r"\.[^./]*$", "")
    shared = F.when(F.regexp_like(path, F.lit(r"(^|/)pcds/[^/]+$")), F.regexp_replace(F.regexp_replace(own, "__frame_[^_/]+$", ""), r"(^|/)pcds/([^/]+)$", "$1json/$2"))
    a, b = (parsed.select(F.col("__s").alias(s), F.col("__m").alias(m)) for s, m in (("__s1", "__m1"), ("__s2", "__m2")))
    df = clouds.join(a, own == F.col("__s1"), "left").join(b, shared == F.col("__s2"), "left")
    return df.withColumn("meta", F.coalesce("__m1", "__m2")).drop("__s1", "__s2", "__m1", "__m2")


def identity(stem: Column) -> dict[str, Column]:
    """object_id, track_id, run_id, frame_id and group_id of a stem."""
    found = lambda p: F.nullif(F.regexp_extract(stem, p, 1), F.lit(""))
    return {
        "p_object": F.coalesce(found("__object_([^_]+)"), stem),
        "p_track": found("__track_([^_]+)"),
        "p_run": found("^(.*?)__track_"),
        "p_frame": found("__frame_([^_]+)$"),
        "p_group": F.regexp_replace(stem, "__frame_[^_]+$", ""),
    }


def parse_predictions(text: DataFrame) -> DataFrame:
    """Typed confidence (unparsable: 0) and is_match (1, true, yes, y) of an all-text prediction table."""
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    return text.withColumns({"confidence": conf, "is_match": F.lower(F.trim("is_match")).isin("1", "true", "yes", "y")})


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_predictions(spark.read.csv(path, header=True, schema=schema))


def read_manifest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """manifest.jsonl of the folder itself where there is one, else rows from split/class/*.pcd."""
    files = list_files(spark, folder)
    top = F.regexp_like("path", F.lit(r"/manifest\.jsonl(/part-[^/]*)?$"))
    names = F.regexp_replace(F.regexp_replace("path", r"/manifest\.jsonl(/part-[^/]*)?$", ""), "^[a-z0-9]+:/+", "/")
    if not files.filter(top & (names == F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z0-9]+:/+", "/"))).isEmpty():
        return spark.read.schema(schema).json(f"{folder}/manifest.jsonl")
    clouds = layout(files.filter(F.col("path").endswith(".pcd"))).filter("layout = 'flat'")
    return clouds.select(F.col("split"), F.col("class_name").alias("dataset_class"), F.regexp_extract("path", r"([^/]+)\.pcd$", 1).alias("sample_id"), F.col("path").alias("dataset_pcd"))
