"""Incremental prediction feed: logits arrive as files; all predictions go to one table, mismatches to another."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pointmill.operators.fuse import mismatches, predict


COMMIT = "batch long, attempt string"


def feed(spark: SparkSession, source: str, schema: StructType | str, current: str, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Score every new Parquet file of ``source`` (after ``prepare``, which must yield ``logits``) once and append to the tables predictions and mismatches of ``out``.

    Both tables of a batch are written to a folder of this attempt; a line in the log ``out``/commits, written last, makes them visible to :func:`read_feed` together. A batch that fails
    in between leaves nothing to be seen; one that is run again after its line was written is left as it is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not committed(spark, out).filter(F.col("batch") == batch_id).isEmpty():
            return
        attempt = f"a{uuid.uuid4().hex}"
        scored = predict(prepare(batch) if prepare else batch).persist()
        scored.write.parquet(f"{out}/predictions/batch={batch_id}/attempt={attempt}")
        mismatches(scored, current).write.parquet(f"{out}/mismatches/batch={batch_id}/attempt={attempt}")
        scored.unpersist()
        spark.createDataFrame([(batch_id, attempt)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{out}/commits/log={batch_id}")

    spark.createDataFrame([], COMMIT).write.mode("append").json(f"{out}/commits/log=-1")  # the log is there from the start
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str) -> DataFrame:
    """(batch, attempt) of the batches that are whole."""
    return spark.read.schema(COMMIT).json(f"{out}/commits/*")


def read_feed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of whole batches of predictions or mismatches."""
    rows = spark.read.parquet(f"{out}/{table}").withColumns({"batch": F.col("batch").cast("long"), "attempt": F.col("attempt").cast("string")})
    return rows.join(F.broadcast(committed(spark, out)), ["batch", "attempt"], "left_semi")  # a row a batch
