"""Helpers shared by the training-data operators: shared scratch tables, connected components, table reads."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on local masters only, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pointmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back, so that a lost executor costs one re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of ``edges`` with the smallest node id they can reach: (node, component).

    Every round maps each node to the smallest node among itself and its neighbours and contracts those edges, so the
    graph shrinks geometrically; the smallest node of a component always survives and ends as its only vertex. Hubs only
    meet partial minima and joins that adaptive execution can split. Nothing is collected.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("low"))
        low = materialize(low, "low")
        if labels is None:
            labels = low.select("node", F.col("low").alias("component"))
        else:
            step = low.select(F.col("node").alias("component"), F.col("low"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("low", "component").alias("component"))
            labels = materialize(labels, "labels")
        u, v = low.select(F.col("node").alias("u"), F.col("low").alias("lu")), low.select(F.col("node").alias("v"), F.col("low").alias("lv"))
        e = e.join(u, "u").join(v, "v").filter("lu <> lv")
        e = materialize(e.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "edges")
        if e.isEmpty():
            return labels


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; both tables grow by doubling."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of the lower-cased text in order: runs of letters, digits, underscores and non-ASCII characters.

    All words are hashed at once: a running polynomial over the bytes gives each word's value as a difference of two sums.
    """
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start])
