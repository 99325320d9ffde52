"""Operators 4 and 7 on embedding tables: lattice-hashed near-duplicates, and exact top-k by a uniform threshold."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointmill.llm.common import connected_components, materialize, mix

COSINE = 0.95
PROBES = 4
#: (up to so many vectors, scale of the projections, tables): the larger the scale, the smaller a cell is against the vectors, so that cells hold few of them as a
#: table grows; the less often vectors of cosine 0.95 share a cell, so the more tables keep their recall at 0.99. Measured with random vectors of 64
#: dimensions, chances of meeting at cosine 0.95 in one table, and of any pair: 0.49 and 1.4e-4; 0.28 and 2.7e-5; 0.15 and 6.6e-6; 0.038 and 7.3e-7.
LADDER = ((20_000, 1.0, 10), (100_000, 1.25, 16), (500_000, 1.5, 32), (1 << 62, 2.0, 130))


def valid(embedding: Column) -> Column:
    """Not null, not empty, and all components finite numbers."""
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _e8_directions() -> np.ndarray:
    """The 240 shortest vectors of E8: all +-1 pairs, and all half-integer signs with an even number of minus signs."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            pairs.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and re-round the worst coordinate where the sum is odd."""
    r = np.rint(x)
    gap = x - r
    rows = np.flatnonzero(r.sum(1) % 2)
    worst = np.abs(gap[rows]).argmax(1)
    r[rows, worst] += np.where(gap[rows, worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 united with D8 + 1/2 (Conway and Sloane 1982)."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell_key(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(points.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (2 * points[..., k]).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


class LatticeHash:
    """Home cells and the nearest neighbouring cells of unit vectors in ``tables`` random projections to eight dimensions."""

    def __init__(self, dims: int, tables: int = LADDER[0][2], probes: int = PROBES, scale: float = LADDER[0][1], seed: int = 4):
        rng = np.random.default_rng([seed, dims])
        self.planes = rng.normal(size=(tables, dims, 8)) * scale
        self.shifts, self.probes, self.directions = rng.random((tables, 8)), probes, _e8_directions()

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) home keys and (n, tables, probes) keys of the cells whose centres come next by distance."""
        homes, near = [], []
        for t, (plane, shift) in enumerate(zip(self.planes, self.shifts)):
            x = unit @ plane + shift
            home = decode_e8(x)
            along = (x - home) @ self.directions.T  # a cell at home + v is nearer, the more the rest points along v
            best = np.argpartition(-along, self.probes, axis=1)[:, : self.probes] if self.probes < 240 else np.tile(np.arange(240), (len(x), 1))
            homes.append(_cell_key(home, t))
            near.append(_cell_key(home[:, None, :] + self.directions[best], t))
        return np.stack(homes, 1), np.stack(near, 1)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, ladder=LADDER, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding): near-duplicates by lattice hashing.

    Equal vectors form one class first, so a group of copies costs one row from there on. Classes meet where the home cell of one is the
    home cell of the other or among its nearest neighbouring cells, in any of the tables; met pairs are verified by cosine in double
    precision. n_links counts the other vectors linked directly, copies included. ``ladder`` gives the cells' scale and the number of tables by the number of
    classes.

    Defined cases: null, empty, zero or non-finite vectors link with nothing (n_links 0, a component of their own); vectors of different
    lengths never link; rows that repeat a vec_id count as one vector (the first in
    order of its components); a null vec_id gives n_links 0, a null component, kept; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("e")) & F.exists("e", lambda x: x != 0))
    good = good.groupBy("vec_id").agg(F.min("e").alias("e")) if _repeats(good) else good
    classes = materialize(good.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    member = materialize(good.join(classes, "e").select("vec_id", "rep", "n"), "members")
    everyone = rows.select("vec_id").distinct()
    n = classes.count()
    _, scale, tables = next(step for step in ladder if n <= step[0])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices: dict[int, LatticeHash] = {}
        for batch in batches:
            for dims, part in batch.groupby(batch["e"].map(len)):
                if dims not in lattices:
                    lattices[dims] = LatticeHash(dims, tables, probes, scale)
                homes, near = lattices[dims](_unit(part["e"]))
                yield pd.DataFrame({"rep": part["rep"], "home": list(homes), "near": list(near.reshape(len(near), -1))})

    cells = materialize(classes.select("rep", "e").mapInPandas(hashed, "rep long, home array<long>, near array<long>"), "cells")
    homes = cells.select(F.col("rep").alias("b"), F.explode("home").alias("key"))
    asked = cells.select(F.col("rep").alias("a"), F.explode(F.concat("home", "near")).alias("key"))
    met = asked.join(homes, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["ea"].map(len)):
                yield part.loc[(_unit(part["ea"]) * _unit(part["eb"])).sum(1) >= cosine, ["a", "b"]]

    of_a = classes.select(F.col("rep").alias("a"), F.col("e").alias("ea"))
    of_b = classes.select(F.col("rep").alias("b"), F.col("e").alias("eb"))
    same = F.size("ea") == F.size("eb")
    links = materialize(met.join(of_a, "a").join(of_b, "b").filter(same).mapInPandas(verify, "a long, b long"), "links")
    sizes = classes.select("rep", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    component = connected_components(links).withColumnRenamed("node", "rep")
    out = member.join(more, "rep", "left").join(component, "rep", "left")
    out = out.select("vec_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = everyone.join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _repeats(rows: DataFrame, key: str = "vec_id") -> bool:
    return not rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


# Exact top-k search

#: Queries of a group, vectors of a block, blocks that a task gets of one group at once, queries scored together, and lists a vector is cut into.
QUERY_GROUP, VECTOR_BLOCK, BLOCKS, SLICE, LISTS = 16_384, 2048, 16, 256, 2
BITS = 1024.0
#: Scores are exact below this size; one among the results that is not is an error.
LIMIT = 1 << 61
_LOWEST = -(1 << 62)


def whole(x: Column, scale: float) -> Column:
    """floor(scale * x) as a double, which holds it exactly whatever its size."""
    y = x.cast("double") * scale
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)


def exact_products(u: np.ndarray, v: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Inner products of integers held as doubles: by floats where they hold all that can occur, by 64-bit or by Python's integers else. What reaches the limit comes as the limit."""
    most = np.abs(u).max(initial=0) * np.abs(v).max(initial=0) * float(u.shape[1])
    if most < 2**53:
        return (u @ v.T).astype(np.int64)
    if most < 2**61:
        return u.astype(np.int64) @ v.astype(np.int64).T
    exact = np.frompyfunc(int, 1, 1)
    return np.clip(exact(u) @ exact(v).T, -limit, limit).astype(np.int64)


def _partial_scores(q: np.ndarray, v: np.ndarray, lists: int) -> list[np.ndarray]:
    """Exact partial inner products of every query with every vector, one matrix a list. Where they might not fit 64 bits, the first one holds the whole products and the others nothing;
    thresholds hold for any way to share a score out over the lists."""
    cut = np.linspace(0, q.shape[1], min(lists, q.shape[1]) + 1).astype(int)
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * float(q.shape[1])
    if most < 2**53:
        return [q[:, i:j] @ v[:, i:j].T for i, j in zip(cut, cut[1:])]
    if most < 2**61:
        q, v = q.astype(np.int64), v.astype(np.int64)
        return [q[:, i:j] @ v[:, i:j].T for i, j in zip(cut, cut[1:])]
    return [exact_products(q, v), *(np.zeros((len(q), len(v)), np.int64) for _ in cut[2:])]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, by score, then smaller id, query after query."""
    order = np.lexsort((ids, -score, query))
    ranked = query[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def local_lists(q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: per query the k-th best entry of every list (the highest of any block), and the exact scores of the k best among the k best of all lists."""
    n = min(lists, q.shape[1])
    kth, totals = np.full((len(q), n), _LOWEST, np.int64), np.full((len(q), k), _LOWEST, np.int64)
    for _, v in blocks:
        for at in range(0, len(q), SLICE):
            parts = _partial_scores(q[at : at + SLICE], v, lists)
            m = min(k, len(v))
            top = [np.argpartition(-p, m - 1, axis=1)[:, :m] for p in parts]
            if m == k:
                low = np.stack([np.take_along_axis(p, t, 1).min(1) for p, t in zip(parts, top)], 1)
                kth[at : at + SLICE] = np.maximum(kth[at : at + SLICE], low)
            seen = np.sort(np.concatenate(top, 1), 1)
            score = sum(np.take_along_axis(p, seen, 1) for p in parts).astype(np.int64)
            score[:, 1:][seen[:, 1:] == seen[:, :-1]] = _LOWEST  # the same vector in several lists counts once
            both = np.concatenate([totals[at : at + SLICE], score], 1)
            totals[at : at + SLICE] = -np.sort(-both, 1)[:, :k]
    return kth, totals


def thresholds(kth: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One threshold a list, as far below each list's k-th best entry as below any other's, that add up to the bound or less: a vector below all of
    them scores less than the bound."""
    n = kth.shape[1]
    known = (kth > _LOWEST).all(1)
    kth = np.where(known[:, None], kth, 0)
    slack = -((bound - kth.sum(1)) // n)
    return np.where((bound > _LOWEST)[:, None], kth - slack[:, None], _LOWEST)


def resolve(q: np.ndarray, bound: np.ndarray, limit: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: of every block the entries that reach a list's threshold are collected and their other lists resolved where they lie; those that
    reach the bound are given, the k best of each query: (place of the query, id, score). Queries that a block cannot serve skip it: by its
    centre and radius in each list, no entry reaches a threshold, or no sum of them the bound."""
    found = [np.empty((3, 0), np.int64)]
    cut = np.linspace(0, q.shape[1], min(lists, q.shape[1]) + 1).astype(int)
    norm = np.stack([np.linalg.norm(q[:, i:j].astype(np.float64), axis=1) for i, j in zip(cut, cut[1:])], 1)
    for ids, v in blocks:
        centre = v.mean(0)
        radius = [np.linalg.norm(v[:, i:j] - centre[i:j], axis=1).max() for i, j in zip(cut, cut[1:])]
        most = np.stack([q[:, i:j] @ centre[i:j] for i, j in zip(cut, cut[1:])], 1) + norm * radius
        most += 1 + 1e-9 * np.abs(most)
        most = np.where(np.isnan(most), np.inf, most)  # too large for floats
        serves = np.flatnonzero((most >= limit).any(1) & (most.sum(1) >= bound))
        for at in range(0, len(serves), SLICE):
            own = serves[at : at + SLICE]
            parts = _partial_scores(q[own], v, lists)
            reach = np.logical_or.reduce([p >= limit[own, j, None] for j, p in enumerate(parts)])
            i, c = np.nonzero(reach)
            score = sum(p[i, c] for p in parts).astype(np.int64)
            good = score >= bound[own[i]]
            found.append(np.stack([own[i[good]], ids[c[good]], score[good]]))
    at, ids, score = np.concatenate(found, 1)
    kept = _best(at, ids, score, k) if len(at) else np.empty(0, np.int64)
    return at[kept], ids[kept], score[kept]


def _matrix(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(ids), np.asarray(values, np.float64).reshape(len(ids), -1)


def nearest_vectors(vectors: DataFrame, k: int = 10, every: int = 100, lists: int = LISTS, query_group: int = QUERY_GROUP, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query with all other vectors, by a three-phase uniform threshold.

    Components become floor(1024 * x). Rows whose vec_id is divisible by ``every`` are the queries. Equal vectors are one class with its k + 1
    smallest ids, so copies are scored once. The dimensions are cut into ``lists`` lists. Vectors lie in blocks, queries in groups; a task gets one group and
    some blocks. Phase 1 gathers the best entries of every local list from the blocks around the group's pivot and resolves them; the
    (k + 1)-th best score so far bounds the final one from below. Phase 2 sends that bound, shared out over the lists, to all blocks; a vector below its share in all lists cannot
    be among the best. Phase 3 resolves the missing lists of the others exactly, in the block, and only what reaches the bound leaves it: a
    number of entries that does not grow with the pairs. Ties go to the smaller vec_id.

    Defined cases: vectors that are null, empty or hold null or non-finite components take no part; those of any size do, and a score among the results of LIMIT
    or more is an error; vectors of different lengths never meet; rows that repeat a vec_id count once; with fewer than k others all are returned;
    other columns are ignored; no rows, no result.
    """
    spark, best = vectors.sparkSession, k + 1  # a query is among its own best
    rows = vectors.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: whole(x, BITS)).alias("q"))
    rows = materialize(rows.groupBy("id").agg(F.min("q").alias("q")) if _repeats(rows, "id") else rows, "vectors")
    first_ids = rows.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("id"))).filter(F.col("r") <= best)
    classes = materialize(first_ids.groupBy("q").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    queries = rows.filter(F.col("id") % every == 0)
    of_queries = queries.select("q").distinct().join(classes.select("q", "rep"), "q")  # a hot vector is one row here, and meets its queries in parts
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(16))
    asked = materialize(queries.withColumn("part", part).join(of_queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["q", "part"]).select(F.col("id").alias("query_id"), "rep"), "asked")
    n_queries = of_queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # As many pivots as there are groups of queries, at most 1024, from a hash sample; every vector goes to the pivot it points along most.
    n_pivots = min(1024, max(1, n_queries // query_group))
    sample = [np.array(r["q"], np.float64) for r in classes.orderBy(F.xxhash64("rep", F.lit(5)), "rep").select("q").limit(n_pivots).collect()]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["q"].map(len)
            for d, part in batch.groupby(dims):
                pivots = [(i, x / max(1.0, np.linalg.norm(x))) for i, x in enumerate(sample) if len(x) == d] or [(0, np.zeros(d))]
                near = (np.array(part["q"].tolist(), np.float64) @ np.stack([x for _, x in pivots]).T).argmax(1)
                yield part.assign(dims=d, pivot=np.array([i for i, _ in pivots])[near])

    placed = classes.select("rep", "q").mapInPandas(place, "rep long, q array<double>, dims int, pivot int")
    placed = materialize(placed, "placed")

    def gathered(df: DataFrame, size: int, name: str, *columns) -> DataFrame:
        """Rows of a pivot in parts of about ``size``: (dims, pivot, part, ids, values, ...)."""
        parts = df.groupBy("dims", "pivot").agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias("parts"))
        df = df.join(materialize(parts, "parts"), ["dims", "pivot"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int"))
        return materialize(df.groupBy("dims", "pivot", "part").agg(F.collect_list("rep").alias("ids"), F.flatten(F.collect_list("q")).alias("values"), *columns), name)

    stored = gathered(placed, vector_block, "stored").withColumnRenamed("part", "block")
    own = materialize(placed.join(asked.select("rep").distinct(), "rep", "left_semi"), "queries")
    n_blocks = stored.count()

    def met(groups: DataFrame, near: bool, schema: str, f) -> DataFrame:
        """f on each group of queries and some blocks at a time: those of its own pivot, or all."""
        n = groups.count()
        shares = max(-(-n_blocks // BLOCKS), min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")) // n), 1)
        share = F.pmod(F.xxhash64("pivot", "block"), F.lit(shares)).cast("int").alias("share")
        keys = ["dims", "pivot", "part", "share"]
        heads = groups.select("dims", "pivot", "part")
        if near:
            left = stored.join(heads, ["dims", "pivot"])
        else:
            left = stored.withColumnRenamed("pivot", "p").join(heads, "dims")
            share = F.pmod(F.xxhash64("p", "block"), F.lit(shares)).cast("int").alias("share")
        left = left.withColumn("share", share)
        own_keys = ["g_dims", "g_pivot", "g_part", "g_share"]
        right = groups.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumnsRenamed(dict(zip(keys, own_keys)))
        right = right.select(*(F.col(c).alias(c) for c in right.columns))
        tasks = max(1, min(n * shares, 100_000))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *own_keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*own_keys)).applyInPandas(f, schema)

    def first(blocks: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(group):
            return pd.DataFrame(columns=["rep", "kth", "totals"])
        ids, q = _matrix(group["ids"].iloc[0], group["values"].iloc[0])
        kth, totals = local_lists(q, [_matrix(*x) for x in zip(blocks["ids"], blocks["values"])], best, lists)
        return pd.DataFrame({"rep": ids, "kth": list(kth), "totals": [t[t > _LOWEST] for t in totals]})

    seen = materialize(met(gathered(own, query_group, "groups"), True, "rep long, kth array<long>, totals array<long>", first), "phase1")
    kth = seen.select("rep", F.posexplode("kth").alias("j", "x")).groupBy("rep", "j").agg(F.max("x").alias("x"))
    kth = kth.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda y: y["x"]).alias("kth"))  # an entry a list
    ranked = seen.select("rep", F.explode("totals").alias("total"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("total")))).filter(F.col("r") <= best)
    bound = ranked.groupBy("rep").agg(F.max(F.when(F.col("r") == best, F.col("total"))).alias("bound"))
    cut = own.join(kth.join(bound, "rep", "left"), "rep").withColumn("bound", F.coalesce("bound", F.lit(_LOWEST)))
    groups = gathered(cut, query_group, "cutoffs", F.collect_list("bound").alias("bounds"), F.flatten(F.collect_list("kth")).alias("kths"))

    def second(blocks: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(group):
            return pd.DataFrame(columns=["query", "reps", "scores"])
        ids, q = _matrix(group["ids"].iloc[0], group["values"].iloc[0])
        bounds, kths = np.asarray(group["bounds"].iloc[0]), np.asarray(group["kths"].iloc[0]).reshape(len(ids), -1)
        at, reps, scores = resolve(q, bounds, thresholds(kths, bounds), [_matrix(*x) for x in zip(blocks["ids"], blocks["values"])], best, lists)
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
        cut = lambda x: pd.Series(np.split(x, start[1:])[: len(start)], dtype=object)
        return pd.DataFrame({"query": ids[at[start]], "reps": cut(reps), "scores": cut(scores)})

    sent = materialize(met(groups, False, "query long, reps array<long>, scores array<long>", second), "phase2")
    entries = sent.select("query", F.explode(F.arrays_zip("reps", "scores")).alias("x")).select("query", F.col("x.reps").alias("rep"), F.col("x.scores").alias("score"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    entries = entries.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= best).join(classes.select("rep", "ids"), "rep")
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("below"), i.alias("id")))
    top = entries.groupBy("query").agg(F.flatten(F.collect_list(each)).alias("x")).select(F.col("query").alias("rep"), F.slice(F.array_sort("x"), 1, best).alias("x"))  # (k + 1) ** 2 at most
    out = asked.join(top, "rep").select("query_id", F.posexplode(F.slice(F.filter("x", lambda y: y["id"] != F.col("query_id")), 1, k)).alias("at", "y"))
    out = out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("y.id").alias("vec_id"), (-F.col("y.below")).alias("score"))
    return out.filter(F.when(F.abs("score") < LIMIT, True).otherwise(F.raise_error(F.lit("a score does not fit 62 bits")).cast("boolean")))
