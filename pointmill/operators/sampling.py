"""Fixed-size resampling in farthest-point order, in rounds of bounded parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.hashing import hash_key
from pointmill.functions.scratch import materialize
from pointmill.operators import clouds
from pointmill.operators.points import XYZ, bounds

#: A group of up to so many candidates, or twice its quota if that is more, is put in order by one task.
CANDIDATES = 4096


def greedy(x: np.ndarray, k: int) -> np.ndarray:
    """Places of k points in farthest-point order from the first: each is the one farthest from all before, the first of equal ones."""
    k = min(k, len(x))
    chosen, gap, at = np.empty(k, int), np.full(len(x), np.inf), 0
    for i in range(k):
        chosen[i] = at
        gap = np.minimum(gap, ((x - x[at]) ** 2).sum(1))
        gap[at] = -1.0
        at = int(gap.argmax())
    return chosen


def _order(schema: T.StructType):
    def order(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__h", "pt"], ignore_index=True)
        chosen = greedy(part[list(XYZ)].to_numpy(float), int(part["__take"].iloc[0]))
        return part.iloc[chosen].assign(__order=np.arange(len(chosen)))[schema.names]

    return order


def farthest_points(df: DataFrame, keys: list[str], candidates: int = CANDIDATES) -> DataFrame:
    """The first ``__take`` points of each group in farthest-point order, with their ``__order`` from 0; df has keys, pt, x, y, z, the hash __h, whose least begins, and __take.

    Groups of too many points are dealt into parts by hash, of which each gives its own first ``__take`` points, round by round, until a group is small enough to be put in
    order at once: greedy k-centre over the k-centres of parts. No group meets in one task before.
    """
    columns = [*keys, "pt", *XYZ, "__h", "__take"]
    schema = T.StructType([*df.select(*columns).schema, T.StructField("__order", T.LongType())])
    df, most = df.select(*columns), F.greatest(2 * F.col("__take"), F.lit(candidates))
    round_ = 0
    while True:
        large = df.groupBy(*keys, "__take").agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
        large = materialize(large.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__parts")), "large")
        if large.isEmpty():
            return df.groupBy(*keys).applyInPandas(_order(schema), schema)
        dealt = df.join(large, keys).withColumn("__part", F.pmod(F.xxhash64("pt", F.lit(round_)), F.col("__parts")))
        reduced = dealt.groupBy(*keys, "__part").applyInPandas(_order(schema), schema).select(*columns)
        df = materialize(df.join(large.select(*keys), keys, "left_anti").select(*columns).unionByName(reduced), "candidates")
        round_ += 1


def whole(n: int, bins: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """:func:`farthest_resample` of whole clouds of finite points with their hashes ``__h``."""

    def f(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(__h=part["__h"].to_numpy().astype("S32"))
        part, starts = clouds.in_order(part, "cloud_id", "__h", "pt")
        x, rows, bin_, place = part[list(XYZ)].to_numpy(float), [], [], []
        for at, end in zip(starts, np.append(starts[1:], len(part))):
            own = x[at:end]
            low, extent = own.min(0), own.max(0) - own.min(0)
            axis, width = int(extent.argmax()), extent.max()
            b = np.zeros(len(own), int) if width <= 0 else np.minimum(np.floor((own[:, axis] - low[axis]) / width * bins), bins - 1).astype(int)
            if len(own) <= n:
                chosen = np.arange(n) % len(own)
            else:
                used = np.unique(b)
                inside = [np.flatnonzero(b == v) for v in used]
                chosen = np.concatenate([i[greedy(own[i], n // len(used))] for i in inside]) if n >= len(used) else np.empty(0, int)
                rest = np.setdiff1d(np.arange(len(own)), chosen)
                chosen = np.append(chosen, rest[greedy(own[rest], n - len(chosen))] if n > len(chosen) else rest[:0])
            rows.append(at + chosen)
            bin_.append(b[chosen])
            place.append(np.arange(len(chosen)))
        found = part[["cloud_id", "pt", *XYZ]].iloc[np.concatenate(rows)]
        return found.assign(bin=np.concatenate(bin_), place=np.concatenate(place))

    return f


def farthest_resample(df: DataFrame, n: int, bins: int = 8, seed: int = 0, candidates: int = CANDIDATES) -> DataFrame:
    """(cloud_id, pt, x, y, z, bin, place): n points per cloud. Equal bins of the longest axis, the last one closed, give equal quotas in farthest-point order; the shortfall comes from
    the rest of the cloud in the same way; a cloud of fewer points gives them all, and repeats them in hash order.

    Clouds of up to ``candidates`` points are put in order within tasks that hold some of them; larger ones see :func:`farthest_points`. Points with a null or non-finite coordinate are left out.
    """
    ok = F.lit(True)
    for c in XYZ:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    df = df.filter(ok).select("cloud_id", "pt", *(F.col(c).cast("double").alias(c) for c in XYZ))
    small, large, rows = clouds.by_size(df, "cloud_id", candidates)
    schema = T.StructType([*df.schema, T.StructField("bin", T.LongType()), T.StructField("place", T.LongType())])
    found = clouds.within(small, "cloud_id", rows, whole(n, bins), schema, {"__h": hash_key(seed, "cloud_id", "pt")})
    return found if large is None else found.unionByName(_in_rounds(large, n, bins, seed, candidates))


def _in_rounds(df: DataFrame, n: int, bins: int, seed: int, candidates: int) -> DataFrame:
    """The same by joins and rounds, see :func:`farthest_points`; df has finite points."""
    b = bounds(df).select("cloud_id", *("min_" + c for c in XYZ), *((F.col("max_" + c) - F.col("min_" + c)).alias("e" + c) for c in XYZ))
    df = df.join(b, "cloud_id")
    use_x, use_y = (F.col("ex") >= F.col("ey")) & (F.col("ex") >= F.col("ez")), F.col("ey") >= F.col("ez")
    value = F.when(use_x, F.col("x") - F.col("min_x")).when(use_y, F.col("y") - F.col("min_y")).otherwise(F.col("z") - F.col("min_z"))
    width = F.greatest("ex", "ey", "ez")
    place = F.when(width <= 0, 0).otherwise(F.least(F.floor(value / width * bins), F.lit(bins - 1))).cast("long")
    df = materialize(df.select("cloud_id", "pt", *XYZ, place.alias("bin"), hash_key(seed, "cloud_id", "pt").alias("__h")), "binned")
    per_bin = df.groupBy("cloud_id", "bin").agg(F.count("*").alias("__k"))
    sizes = per_bin.groupBy("cloud_id").agg(F.count("*").alias("__b"), F.sum("__k").alias("__n"))
    sizes = materialize(sizes.withColumn("__take", F.floor(F.lit(n) / F.col("__b")).cast("long")), "sizes")
    whole = df.join(sizes.filter(F.col("__n") <= n).select("cloud_id", "__n"), "cloud_id")
    quota = df.join(sizes.filter(F.col("__n") > n).select("cloud_id", "__take"), "cloud_id")
    first = materialize(farthest_points(quota.filter("__take > 0"), ["cloud_id", "bin"], candidates), "quotas")
    got = first.groupBy("cloud_id").agg(F.count("*").alias("__got"))
    short = sizes.filter(F.col("__n") > n).join(got, "cloud_id", "left").select("cloud_id", (F.lit(n) - F.coalesce("__got", F.lit(0))).cast("long").alias("__take")).filter("__take > 0")
    rest = df.join(short, "cloud_id").join(first.select("cloud_id", "pt"), ["cloud_id", "pt"], "left_anti")
    more = farthest_points(rest, ["cloud_id"], candidates).join(df.select("cloud_id", "pt", "bin"), ["cloud_id", "pt"])
    columns = ["cloud_id", "pt", *XYZ, "bin"]
    chosen = first.withColumn("__phase", F.lit(0)).unionByName(more.withColumn("__phase", F.lit(1)))
    in_order = F.row_number().over(W.partitionBy("cloud_id").orderBy("__phase", F.when(F.col("__phase") == 0, F.col("bin")), "__order")) - 1  # n rows of a cloud
    chosen = chosen.select(*columns, in_order.cast("long").alias("place"))
    copies = F.sequence(F.lit(0), F.ceil(F.lit(n) / F.col("__n")).cast("int") - 1)
    own = F.row_number().over(W.partitionBy("cloud_id").orderBy("__h", "pt")) - 1  # n rows of a cloud at most
    repeated = whole.withColumn("__p", own).withColumn("__c", F.explode(copies)).withColumn("place", (F.col("__c") * F.col("__n") + F.col("__p")).cast("long"))
    return chosen.unionByName(repeated.filter(F.col("place") < n).select(*columns, "place"))
