"""The streaming feed as a query: its tables equal the batch result (A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.scratch import scratch_folder
from pointmill.plans.base import ORACLE_SQL, QUERIES
from pointmill.streaming.feed import feed, read_feed


def _logits(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("label").cast("bigint").alias("label"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits"))


def a14_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and mismatches written by the stream, counted per table and predicted class."""
    source = f"{sf_dir}/embeddings.parque[t]"
    out = scratch_folder(spark, "feed")
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    feed(spark, source, schema, "label", out, f"{out}/state", _logits).awaitTermination()
    tables = [read_feed(spark, out, t).select(F.lit(t).alias("kind"), "pred", "vec_id") for t in ("predictions", "mismatches")]
    return tables[0].unionByName(tables[1]).groupBy("kind", "pred").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


QUERIES["a14_feed"] = a14_feed
ORACLE_SQL["a14_feed"] = """
WITH e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding[1:10]] l FROM embeddings), p AS (SELECT vec_id, label, CAST(list_position(l, list_max(l))-1 AS BIGINT) AS pred FROM e),
b AS (SELECT 'predictions' AS kind, pred, vec_id FROM p UNION ALL SELECT 'mismatches', pred, vec_id FROM p WHERE pred<>label)
SELECT kind, pred, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM b GROUP BY 1,2
"""
