"""Operator 13: hard negatives from shared lists, one for each cluster of anchors, in the order of angular upper bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointmill.llm.common import materialize
from pointmill.llm.embeddings import exact_products, valid, whole

SCALE = 256.0
#: Anchors of a group, vectors of a block, blocks that a task gets of one group at once, anchors of a cluster, list entries walked at once, and parts of a hot class.
GROUP, BLOCK, BLOCKS, CLUSTER, STEP, PARTS = 16_384, 2048, 16, 64, 1024, 16
MAX_PIVOTS = 1024
_LOWEST, _LIMIT = -(1 << 62), (1 << 63) - 1


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, zero for zero, and norms."""
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(x, axis=1)
        scaled = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300), norm


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def clusters(unit: np.ndarray, size: int = CLUSTER) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, greatest angle of a member to it): anchors by the nearest of evenly chosen ones, each cluster around its mean direction."""
    chosen = unit[np.linspace(0, len(unit) - 1, -(-len(unit) // size)).astype(int)]
    nearest = (unit @ chosen.T).argmax(1)
    order = np.argsort(nearest, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(nearest[order])) + 1):
        mean = unit[members].mean(0, keepdims=True)
        centre = _unit(mean)[0][0] if np.abs(mean).max() > 1e-12 else unit[members[0]]
        yield members, centre, float(_angle(unit[members] @ centre).max())


def upper_bounds(centre: np.ndarray, widest: float, unit: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """No vector within ``widest`` of ``centre`` has an inner product over its norm with the rows above these."""
    rest = np.maximum(0, _angle(unit @ centre) - widest - 1e-7)
    return norm * np.cos(rest)


def walk(q: np.ndarray, v: np.ndarray, threshold: Callable[[np.ndarray], np.ndarray], visit: Callable[[np.ndarray, np.ndarray, np.ndarray], None], size: int = CLUSTER, step: int = STEP) -> int:
    """Every anchor of ``q`` walks its cluster's list of the vectors ``v``, sorted once by upper bound, until no later entry can reach its threshold.

    ``threshold`` gives the current thresholds of given anchors, ``visit`` gets anchors, vectors and their scores. The number of scores computed is returned.
    """
    q_unit, q_norm = _unit(q)
    v_unit, v_norm = _unit(v)
    done = 0
    for members, centre, widest in clusters(q_unit, size):
        bound = upper_bounds(centre, widest, v_unit, v_norm)
        listed = np.argsort(-bound, kind="stable")
        for at in range(0, len(listed), step):
            with np.errstate(over="ignore", invalid="ignore"):
                reach = q_norm[members] * max(bound[listed[at]], 0.0)
            members = members[~(reach * (1 + 1e-9) + 1 < threshold(members))]
            if not len(members):
                break
            entries = listed[at : at + step]
            visit(members, entries, exact_products(q[members], v[entries], _LIMIT))
            done += len(members) * len(entries)
    return done


class Best:
    """The ``k`` best (score, then smaller first id) of every one of ``n`` lists, of scores from ``low`` to ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray | None, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.found = np.empty((4, 0), np.int64)  # list, first id, score, place

    def add(self, lists: np.ndarray, first: np.ndarray, places: np.ndarray, score: np.ndarray, among: np.ndarray) -> None:
        """Scores of the lists (rows) with the vectors ``places`` (columns), those of ``among`` only."""
        hit = among & (score >= self.low[lists][:, None])
        if self.high is not None:
            hit &= score <= self.high[lists][:, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        found = np.concatenate([self.found, np.stack([lists[i], first[j], score[i, j], places[j]])], 1)
        found = found[:, np.lexsort((found[1], -found[2], found[0]))]
        start = np.flatnonzero(np.append(True, found[0, 1:] != found[0, :-1]))
        rank = np.arange(found.shape[1]) - np.repeat(start, np.diff(np.append(start, found.shape[1])))
        self.found = found[:, rank < self.k]
        full = found[:, rank == self.k - 1]
        self.low[full[0]] = full[2]


def _group(blocks: pd.DataFrame, group: pd.DataFrame) -> tuple:
    """Anchors and vectors of a task as arrays: keys, values, label codes."""
    head = group.iloc[0]
    keys, q = np.asarray(head["keys"]), np.asarray(head["values"], np.float64).reshape(len(head["keys"]), -1)
    v_keys, first = np.concatenate(list(blocks["keys"])), np.concatenate(list(blocks["firsts"]))
    v = np.concatenate([np.asarray(x, np.float64) for x in blocks["values"]]).reshape(len(v_keys), -1)
    codes, _ = pd.factorize(np.concatenate([np.asarray(head["labels"], object), *(np.asarray(x, object) for x in blocks["labels"])]))
    return keys, q, codes[: len(keys)], v_keys, first, v, codes[len(keys) :]


def _cut(x: np.ndarray, start: np.ndarray) -> pd.Series:
    """A column of the stretches of ``x`` that begin at ``start``."""
    return pd.Series(np.split(x, start[1:])[: len(start)], dtype=object)


def _positives(k: int, size: int):
    def positives(blocks: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(group):
            return pd.DataFrame(columns=["key", "others", "scores"])
        keys, q, label, v_keys, first, v, v_label = _group(blocks, group)
        best = Best(np.asarray(group["lows"].iloc[0], np.int64), None, k)

        def visit(members, entries, score):
            best.add(members, first[entries], entries, score, label[members][:, None] == v_label[entries])

        walk(q, v, lambda members: best.low[members], visit, size)
        lists, start = np.unique(best.found[0], return_index=True)
        return pd.DataFrame({"key": keys[lists], "others": _cut(v_keys[best.found[3]], start), "scores": _cut(best.found[2], start)})

    return positives


def _negatives(k: int, windows: int, size: int):
    def negatives(blocks: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(group):
            return pd.DataFrame(columns=["key", "tops", "others", "scores"])
        keys, q, label, v_keys, first, v, v_label = _group(blocks, group)
        low, high = (np.asarray(group[c].iloc[0], np.int64).reshape(len(keys), windows) for c in ("lows", "highs"))
        best = Best(low.ravel(), high.ravel(), k)
        open_ones = low <= high

        def threshold(members):
            now = best.low.reshape(len(keys), windows)[members]
            return np.where(open_ones[members], now, _LIMIT).min(1)

        def visit(members, entries, score):
            other = label[members][:, None] != v_label[entries]
            for w in range(windows):
                own = open_ones[members, w]
                best.add(members[own] * windows + w, first[entries], entries, score[own], other[own])

        walk(q, v, threshold, visit, size)
        at, _, score, place = best.found
        lists, start = np.unique(at, return_index=True)
        return pd.DataFrame({"key": keys[lists // windows], "tops": best.high[lists], "others": _cut(v_keys[place], start), "scores": _cut(score, start)})

    return negatives


def mine_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, share: tuple[int, int] = (4, 5), scale: float = SCALE,
    group_size: int = GROUP, block_size: int = BLOCK, cluster_size: int = CLUSTER,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows of (vec_id, label, embedding).

    Components become floor(scale * x); scores are integer inner products, higher first, ties by smaller vec_id. Anchors are the rows whose vec_id is divisible by ``every``;
    their positives the first other rows of their label, and the negatives of each positive the first rows of other labels whose score is at most the positive's and at
    least ``share`` of it.

    Equal vectors of one label are one class with its smallest ids, so copies are scored once. Anchors lie in groups by the nearest of some pivots, vectors in blocks; a task gets
    one group and some blocks. There the anchors of a cluster share one list of the vectors, sorted once by what the angles to the cluster's centre allow; each anchor walks it
    until no later entry can reach the worst it still needs. Pairs of a group and a block whose pivots rule that out are left out before vectors are sent. Positives come first,
    from the blocks of the group's own pivot, then from all that can beat those; their scores then bound the negatives.

    Defined cases: null ids, labels and vectors, empty vectors and those with null or non-finite components take no part; vectors of different lengths
    never meet; rows equal in id, label and vector count once, and rows with the anchor's id are not its positives; a positive with a negative score has no negatives; fewer candidates give
    fewer rows; a score among the results that does not fit 64 bits is an error; other columns are ignored; no rows, no result.
    """
    spark, k = vectors.sparkSession, positives + 1  # an anchor is among its own label
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("embedding")))
    rows = materialize(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: whole(x, scale)).alias("q")).distinct(), "vectors")
    firsts = rows.withColumn("r", F.row_number().over(W.partitionBy("label", "q").orderBy("id"))).filter(F.col("r") <= max(k, negatives))
    classes = firsts.groupBy("label", "q").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id())
    classes = materialize(classes.withColumns({"first": F.col("ids")[0], "dims": F.size("q")}), "classes")
    anchors = rows.filter(F.col("id") % every == 0)
    wanted = anchors.select("label", "q").distinct().join(classes.select("label", "q", "key"), ["label", "q"])  # a hot class is one row here, and meets its anchors in parts
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    asked = materialize(anchors.withColumn("salt", part).join(wanted.withColumn("salt", every_part), ["label", "q", "salt"]).select(F.col("id").alias("anchor_id"), "key", "salt"), "asked")
    n_anchors = wanted.count()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], empty)

    n_pivots = min(MAX_PIVOTS, max(1, n_anchors // group_size))
    sample = [np.array(r["q"], np.float64) for r in classes.orderBy(F.xxhash64("key", F.lit(5)), "key").select("q").limit(n_pivots).collect()]
    units = [_unit(x[None])[0][0] for x in sample]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("dims"):
                pivots = [(i, x) for i, x in enumerate(units) if len(x) == d] or [(-1, np.eye(1, d)[0])]
                unit, norm = _unit(np.array(part["q"].tolist(), np.float64))
                cos = unit @ np.stack([x for _, x in pivots]).T
                at = cos.argmax(1)
                yield part.assign(pivot=np.array([i for i, _ in pivots])[at], angle=_angle(cos.max(1)), norm=norm)

    schema = "key long, label string, q array<double>, first long, dims int, pivot int, angle double, norm double"
    placed = materialize(classes.select("key", "label", "q", "first", "dims").mapInPandas(place, schema), "placed")

    def gathered(df: DataFrame, size: int, name: str, *columns) -> DataFrame:
        """Rows of a pivot in parts of about ``size``: (dims, pivot, part, keys, labels, firsts, values, ...)."""
        parts = materialize(df.groupBy("dims", "pivot").agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias("parts")), "parts")
        df = df.join(parts, ["dims", "pivot"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int"))
        lists = [F.collect_list("key").alias("keys"), F.collect_list("label").alias("labels"), F.collect_list("first").alias("firsts"), F.flatten(F.collect_list("q")).alias("values")]
        return materialize(df.groupBy("dims", "pivot", "part").agg(*lists, F.max("angle").alias("angle"), F.max("norm").alias("norm"), *columns), name)

    stored = gathered(placed, block_size, "stored").withColumnsRenamed({"pivot": "p", "part": "block", "angle": "p_angle", "norm": "p_norm"})
    own = materialize(placed.join(wanted.select("key"), "key", "left_semi"), "anchors")
    n_blocks = stored.count()

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of a group and a block in which some score can reach the least threshold over a norm, ``need``."""
        apart = {d: None for d in set(map(len, units))}
        for batch in batches:
            for d, part in batch.groupby("dims"):
                least = np.zeros(len(part))
                if d in apart:
                    if apart[d] is None:
                        apart[d] = _angle(np.stack([x if len(x) == d else np.zeros(d) for x in units]) @ np.stack([x if len(x) == d else np.zeros(d) for x in units]).T)
                    least = apart[d][part["pivot"], part["p"]] - part["angle"] - part["p_angle"] - 1e-7
                bound = part["p_norm"] * np.cos(np.clip(least, 0, np.pi / 2)) * (1 + 1e-9)
                yield part.loc[~(bound < part["need"]), ["dims", "pivot", "part", "p", "block"]]

    def met(groups: DataFrame, near: bool, schema: str, f) -> DataFrame:
        """f on each group of anchors and some blocks at a time: those of its own pivot, or all that can matter."""
        n = groups.count()
        shares = max(-(-n_blocks // BLOCKS), min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(n, 1)), 1)
        heads = groups.select("dims", "pivot", "part", "angle", "need")
        blocks = stored.select("dims", "p", "block", "p_angle", "p_norm")
        pairs = heads.join(blocks, "dims")  # a row a group and block, without vectors
        pairs = pairs.filter("pivot = p").select("dims", "pivot", "part", "p", "block") if near else pairs.mapInPandas(possible, "dims int, pivot int, part int, p int, block int")
        share = F.pmod(F.xxhash64("p", "block"), F.lit(shares)).cast("int").alias("share")
        left = stored.select("dims", "p", "block", "keys", "labels", "firsts", "values").join(pairs, ["dims", "p", "block"]).withColumn("share", share)
        keys = ["dims", "pivot", "part", "share"]
        right = groups.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumnsRenamed({c: "g_" + c for c in keys})
        tasks = max(1, min(n * shares, 100_000))
        left, right = left.repartition(tasks, *keys), right.select(*(F.col(c).alias(c) for c in right.columns)).repartition(tasks, *("g_" + c for c in keys))
        return left.groupBy(*keys).cogroup(right.groupBy(*("g_" + c for c in keys))).applyInPandas(f, schema)

    def best_entries(found: DataFrame, by: list[str], k: int) -> DataFrame:
        """The k best classes of each list, with their ids: (by, score, ids)."""
        entries = found.select(*by, F.explode(F.arrays_zip("others", "scores")).alias("x")).select(*by, F.col("x.others").alias("other"), F.col("x.scores").alias("score"))
        entries = entries.join(classes.select(F.col("key").alias("other"), "first", "ids"), "other")
        return entries.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "first"))).filter(F.col("r") <= k)

    def best_ids(entries: DataFrame, by: list[str], k: int) -> DataFrame:
        """(by, top): the k best (below, id) of each list, below being the negated score; k * k at most are gathered."""
        each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("below"), i.alias("id")))
        return entries.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k).alias("top"))

    found_schema = "key long, others array<long>, scores array<long>"
    lows = own.withColumn("low", F.lit(_LOWEST))
    need = F.min(F.col("low") / F.greatest("norm", F.lit(1.0))).alias("need")
    if n_pivots > 1:
        seen = met(gathered(lows, group_size, "near", F.collect_list("low").alias("lows"), need), True, found_schema, _positives(k, cluster_size))
        least = F.when(F.size("scores") == k, F.array_min("scores"))
        seen = materialize(seen.groupBy("key").agg(F.max(least).alias("low")), "seeds")
        lows = own.join(seen, "key", "left").withColumn("low", F.coalesce("low", F.lit(_LOWEST)))
    found = materialize(met(gathered(lows, group_size, "groups", F.collect_list("low").alias("lows"), need), False, found_schema, _positives(k, cluster_size)), "positives")
    top = materialize(best_ids(best_entries(found, ["key"], k), ["key"], k), "tops")

    # Windows of scores, one for each different score of a positive: as many as k, those without a positive empty.
    highs = F.array_distinct(F.transform("top", lambda x: -x["below"]))
    highs = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when((i <= F.size(highs)) & (F.get(highs, i - 1) >= 0), F.get(highs, i - 1)).otherwise(F.lit(-1).cast("long")))
    rest, of = F.lit(share[1] - share[0]), F.lit(share[1])
    div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  whole numbers throughout
    low_of = lambda h: F.when(h >= 0, h - div(h, of) * rest - div(h % of * rest, of)).otherwise(F.lit(0).cast("long"))
    windows = own.join(top.select("key", highs.alias("high")), "key").withColumn("lower", F.transform("high", low_of))
    need = F.min(F.array_min(F.transform(F.filter(F.arrays_zip("lower", "high"), lambda w: w["high"] >= 0), lambda w: w["lower"])) / F.greatest("norm", F.lit(1.0))).alias("need")
    groups = gathered(windows, group_size, "windows", F.flatten(F.collect_list("lower")).alias("lows"), F.flatten(F.collect_list("high")).alias("highs"), need)
    groups = groups.withColumn("need", F.coalesce("need", F.lit(float("inf"))))
    found = materialize(met(groups, False, "key long, tops long, others array<long>, scores array<long>", _negatives(negatives, k, cluster_size)), "negatives")
    chosen = best_ids(best_entries(found, ["key", "tops"], negatives), ["key", "tops"], negatives)
    per_key = chosen.groupBy("key").agg(F.collect_list(F.struct("tops", "top")).alias("negatives"))  # k at most

    result = top.join(per_key, "key", "left").withColumn("salt", every_part)
    each = asked.join(result, ["key", "salt"])
    each = each.select("anchor_id", "negatives", F.explode(F.slice(F.filter("top", lambda x: x["id"] != F.col("anchor_id")), 1, positives)).alias("p"))
    each = each.select("anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.below")).alias("positive_score"), F.get(F.filter("negatives", lambda w: w["tops"] == -F.col("p.below")), F.lit(0))["top"].alias("list"))
    out = each.select("anchor_id", "positive_id", "positive_score", F.posexplode("list").alias("at", "n"))
    score = (-F.col("n.below")).alias("negative_score")
    out = out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", score)
    fits = (F.col("positive_score") < _LIMIT) & (F.col("negative_score") > -_LIMIT)
    return out.filter(F.when(fits, True).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("boolean")))
