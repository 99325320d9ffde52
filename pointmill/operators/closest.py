"""The best partner of each row among those of equal keys and near times, where the score grows with the distance along one coordinate. No pair is listed or shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of either side that meet in one task, at most about.
A_PART, B_PART = 8_192, 131_072
#: Rows of a that are looked up together, and partners on either side that they meet first.
CHUNK, WINDOW = 64, 256
#: The score of allowed pairs that have none.
UNKNOWN = 1.7e308

Judge = Callable[[dict, dict], np.ndarray]


def search(a: dict, b: dict, place: str, slope: float, reach: float, judge: Judge) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the place in b of its best partner (-1: none) and the score. ``judge`` gives the scores of all pairs of some rows, inf where a pair is not allowed; equal ones go to the
    smaller ``id`` of b.

    Rows of b lie in the order of ``place``; those around a row of a are met first, then wider windows, until ``slope`` times the distance exceeds the best score found, or the distance ``reach``.
    """
    order = np.lexsort((b["id"], np.where(np.isnan(b[place]), np.inf, b[place])))
    b = {c: v[order] for c, v in b.items()}
    at_b = np.where(np.isnan(b[place]), np.inf, b[place])
    best, found = np.full(len(a["id"]), np.inf), np.full(len(a["id"]), -1)
    places = np.nan_to_num(a[place], nan=0.0)

    def meet(rows: np.ndarray, lo: int, hi: int) -> None:
        for i in range(lo, hi, 2048):
            part = {c: v[i : min(i + 2048, hi)] for c, v in b.items()}
            score = judge({c: v[rows] for c, v in a.items()}, part)
            least = score.min(1)
            hit = (score == least[:, None]) & np.isfinite(least)[:, None]
            own = np.where(hit, part["id"], np.iinfo(np.int64).max).argmin(1)
            now = found[rows]
            better = np.isfinite(least) & ((least < best[rows]) | ((least == best[rows]) & (part["id"][own] < b["id"][now])))
            best[rows[better]], found[rows[better]] = least[better], i + own[better]

    for chunk in np.split(np.argsort(places, kind="stable"), range(CHUNK, len(places), CHUNK)):
        lo = hi = int(np.searchsorted(at_b, places[chunk[len(chunk) // 2]]))
        wide, rows = WINDOW, chunk
        while len(rows):
            new_lo, new_hi = max(0, lo - wide), min(len(at_b), hi + wide)
            meet(rows, new_lo, lo)
            meet(rows, hi, new_hi)
            lo, hi, wide = new_lo, new_hi, 2 * wide
            far = np.where(best[rows] >= UNKNOWN, np.inf, best[rows] / slope)
            far = np.where(np.isnan(a[place][rows]), np.inf, np.minimum(far, reach)) * (1 + 1e-9) + 1e-9
            left = (lo > 0) & (places[rows] - far <= at_b[max(lo - 1, 0)])
            right = (hi < len(at_b)) & (places[rows] + far >= at_b[min(hi, len(at_b) - 1)])
            rows = rows[left | right]
    return np.where(found >= 0, order[found], -1), best


def _met(a: DataFrame, b: DataFrame, by: list[str], columns: dict[str, list[str]], f: Callable, schema: T.StructType) -> DataFrame:
    """f on all rows of equal ``by`` of both sides, in parts of bounded size."""
    counts = [df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias(n)) for df, size, n in ((a, A_PART, "__na"), (b, B_PART, "__nb"))]
    both = counts[0].join(counts[1], by)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(both, by).withColumn("__i", own("__na")).withColumn("__j", each("__nb")).select(*by, "__i", "__j", *columns["a"])
    right = b.join(both, by).withColumn("__j", own("__nb")).withColumn("__i", each("__na")).select(*by, "__i", "__j", *columns["b"])
    on = [*by, "__i", "__j"]
    right = right.select(*(F.col(c).alias("__r_" + c) for c in right.columns))

    def named(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return f(x, y.rename(columns=lambda c: c.removeprefix("__r_")))

    return left.groupBy(*on).cogroup(right.groupBy(*("__r_" + c for c in on))).applyInPandas(named, schema)


def closest_in_time(a: DataFrame, b: DataFrame, keys: list[str], limit: int, place: str, slope: float, judge: Judge, reach: float = np.inf, differ: str | None = None, time: str = "us") -> DataFrame:
    """(a_id, b_id, score): for each row of a the row of b of equal keys, whose times differ by at most ``limit`` (unknown ones pass), another ``differ`` (unknown ones pass), and the least score, then
    the smaller id; rows of a without one are left out. Both sides have id, a whole number, the keys, ``time``, ``place``, ``differ`` and the numbers that ``judge`` takes; see :func:`search`.

    Rows of known time meet in cells of ``limit``, those of unknown time meet all of their keys, in parts of bounded size; what is shuffled are rows of either side.
    """
    columns = [c for c in a.columns if c not in keys]
    schema = T.StructType([T.StructField("a_id", T.LongType()), T.StructField("b_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def numbers(df: pd.DataFrame) -> dict:
        return {c: df[c].to_numpy() if c in ("id", "__differ") else df[c].to_numpy(float) for c in df.columns}

    def allowed(x: dict, y: dict) -> np.ndarray:
        score = judge(x, y)
        score = np.where(np.isnan(score), UNKNOWN, score)
        ok = ~(np.abs(x[time][:, None] - y[time]) > limit)
        if differ is not None:
            ok &= (x["__differ"][:, None] != y["__differ"]) | (x["__differ"][:, None] < 0)
        return np.where(ok, score, np.inf)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a_id": [], "b_id": [], "score": []})
        if differ is not None:
            codes = pd.factorize(pd.concat([left[differ], right[differ]]))[0]
            left, right = left.assign(__differ=codes[: len(left)]), right.assign(__differ=codes[len(left) :])
        drop = lambda df: numbers(df[[c for c in [*columns, "__differ"] if c in df.columns and c != differ]])
        x, y = drop(left), drop(right)
        # whole microseconds are compared from the first of the task on, so that doubles hold them
        zero = np.nanmin(np.concatenate([x[time], y[time], [np.inf]])) if not np.isnan(np.concatenate([x[time], y[time]])).all() else 0.0
        x[time], y[time] = x[time] - zero, y[time] - zero
        at, score = search(x, y, place, slope, reach, allowed)
        some = at >= 0
        return pd.DataFrame({"a_id": x["id"][some], "b_id": y["id"][at[some]], "score": np.where(score[some] >= UNKNOWN, np.nan, score[some])})

    known = {"a": a.filter(F.col(time).isNotNull()), "b": b.filter(F.col(time).isNotNull())}
    narrow = F.floor(F.col(time) / F.lit(limit)).cast("bigint")
    cells, rows = known["a"].groupBy(*keys, narrow.alias("__c")).agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n")).first()
    wide = max(1, A_PART // 4 * cells // max(1, rows or 0))  # sparse cells share a group
    cell = lambda i: F.floor((narrow + i) / F.lit(wide)).cast("bigint")
    beside = known["b"].withColumn("__c", F.explode(F.array_distinct(F.array(*map(cell, (-1, 0, 1))))))
    both = {"a": columns, "b": columns}
    found = _met(known["a"].withColumn("__c", cell(0)), beside, [*keys, "__c"], both, best, schema)
    found = found.unionByName(_met(a.filter(F.col(time).isNull()), b, keys, both, best, schema))
    found = found.unionByName(_met(known["a"], b.filter(F.col(time).isNull()), keys, both, best, schema))
    least = F.min(F.struct(F.col("score").isNull().alias("u"), "score", "b_id")).alias("m")
    return found.groupBy("a_id").agg(least).select("a_id", "m.b_id", "m.score")


def value_gap(digits: int, value: str = "value") -> Judge:
    """The difference of two numbers, to so many places."""
    scale = 10.0**digits
    return lambda x, y: np.floor(np.abs(x[value][:, None] - y[value]) * scale + 0.5) / scale


def box_gap(limits: dict[str, float]) -> Judge:
    """The score of :func:`pointmill.operators.match.box_gap_score` of boxes in columns min_x to mean_z, within limits on frames, gap_xy, gap_z and centre."""

    def judge(x: dict, y: dict) -> np.ndarray:
        gap = {c: np.maximum(np.maximum(0.0, y["min_" + c] - x["max_" + c][:, None]), x["min_" + c][:, None] - y["max_" + c]) for c in "xyz"}
        xy = np.sqrt(gap["x"] ** 2 + gap["y"] ** 2)
        centre = np.sqrt((x["mean_x"][:, None] - y["mean_x"]) ** 2 + (x["mean_y"][:, None] - y["mean_y"]) ** 2)
        score = xy + 0.15 * centre + 0.5 * gap["z"]
        for name, value in (("gap_xy", xy), ("gap_z", gap["z"]), ("centre", centre)):
            if name in limits:
                score = np.where(value <= limits[name], score, np.inf)
        if "frames" in limits:
            score = np.where(np.abs(x["frame"][:, None] - y["frame"]) > limits["frames"], np.inf, score)
        return score

    return judge
