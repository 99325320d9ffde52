"""Operator 2: near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import connected_components, materialize, mix, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Words are counted in this many hash buckets, so the table of document frequencies has a fixed size (1 MB).
DF_BUCKETS = 1 << 18
STAR_ROUNDS = 3
#: Open buckets of up to so many members list their pairs; larger ones meet in blocks of about BLOCK members.
PAIRS_UP_TO, BLOCK = 16, 64
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their weights: occurrences times the mean inverse document frequency of the words.

    A text of fewer than five words is one shingle.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0)
    width = min(SHINGLE, n)
    h, w = np.zeros(n - width + 1, np.uint64), np.zeros(n - width + 1)
    rarity = idf[(words & np.uint64(len(idf) - 1)).astype(np.int64)]
    for i in range(width):
        h = mix(h * _MULTIPLY + words[i : n - width + 1 + i])
        w += rarity[i : n - width + 1 + i]
    keys, first, tf = np.unique(h, return_index=True, return_counts=True)
    return keys, tf * w[first] / width


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010): the chance of equal samples is the weighted Jaccard similarity.

    The gamma and uniform variates of a shingle are looked up in seeded tables by two 16-bit parts of its mixed hash.
    """

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        r, beta = rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
        self.r, self.inverse, self.beta, self.rest = (x.astype(np.float32) for x in (r, 1 / r, beta, r * (1 - beta)))
        self.log_c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.odd = rng.integers(1, 1 << 62, (samples, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        rows = np.arange(len(self.odd))
        best, out = np.full(len(rows), np.inf, np.float32), np.zeros(len(rows), np.uint64)
        log_w = np.log(weights).astype(np.float32)
        for i in range(0, len(keys), 1024):
            h = keys[i : i + 1024]
            m = self.odd * h
            at, of_c = (m >> np.uint64(48)).view(np.int64), ((m >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64)
            t = np.floor(self.inverse.take(at) * log_w[i : i + 1024] + self.beta.take(at))
            a = self.log_c.take(of_c) - self.r.take(at) * t - self.rest.take(at)
            low = a.argmin(1)
            better = a[rows, low] < best
            best[better] = a[rows, low][better]
            out[better] = mix(h[low] + t[rows, low].astype(np.int64).astype(np.uint64) * _MULTIPLY)[better]
        return out


def _bands(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _MULTIPLY
    for column in samples.reshape(bands, rows).T:
        h = mix(h * _MULTIPLY + column)
    return h.astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def inverse_document_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 for every hash bucket of words, counted over all documents.

    Counting is map-side per partition and the result has at most ``DF_BUCKETS`` rows whatever the input.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                words = word_hashes(text)
                seen[np.unique(words & np.uint64(DF_BUCKETS - 1)).astype(np.int64)] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], n)})

    rows = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DF_BUCKETS)
    real = rows[rows["bucket"] >= 0]
    df[real["bucket"].to_numpy(int)] = real["n"]
    total = rows.loc[rows["bucket"] < 0, "n"].sum()
    return np.log((1 + total) / (1 + df)) + 1


def _links_between(key: int, left: list, right: list, same: bool, idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Component pairs that two blocks of the bucket ``key`` link; pairs that an earlier band has in common are left to it."""
    k, m = np.array([r["keys"] for r in left]), np.array([r["keys"] for r in right])
    equal = k[:, None, :] == m[None, :, :]
    here = np.take_along_axis(np.broadcast_to(k[:, None, :], equal.shape), equal.argmax(2)[:, :, None], 2)[:, :, 0] == key
    a, b = (np.array([r["component"] for r in rows]) for rows in (left, right))
    todo = here & (a[:, None] != b[None, :])
    if same:
        todo &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    s = [_shingles(word_hashes(r["text"]), idf) for r in left]
    t = s if same else [_shingles(word_hashes(r["text"]), idf) for r in right]
    joined: dict[int, int] = {}

    def top(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(todo)):
        u, v = top(int(a[i])), top(int(b[j]))
        if u != v and weighted_jaccard(s[i], t[j]) >= similarity:
            joined[max(u, v)] = min(u, v)
            found.append((int(a[i]), int(b[j])))
    return found


def text_digest(text: Column) -> Column:
    """The key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, digest, copy_of, class_id, kept.

    copy_of is the smallest doc_id with the very same text; class_id is the smallest doc_id reachable through exact copies
    and verified pairs of weighted Jaccard similarity >= ``similarity``. Weights are occurrences of a five-word shingle times the mean inverse
    document frequency of its words. kept marks the rows of one (doc_id, digest) of each class: the smallest doc_id, then digest.

    Defined cases: null text counts as empty; texts without a word are alike only if they are equal; decisions are by doc_id and text, so
    rows that repeat a doc_id with another text are documents of their own, and rows that repeat both get equal results; rows with a null doc_id take part
    and are kept only where their class has no other; no rows give no rows; columns beyond doc_id and text are ignored. Very
    long texts are sampled in slices, never cut.

    Exact copies are collapsed first, to one node per digest. Within a bucket no pairs are listed: three rounds compare everyone outside a pivot's
    component with that pivot, then only buckets with members in different components stay open. Their members meet each other:
    in small buckets by pairs, in larger ones by blocks, each pair of blocks in one row that yields links only. So every pair of a
    bucket is either verified or already joined, and no task gets more of a bucket than two blocks at once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("digest", text_digest(F.col("text")))
    idf = spark.sparkContext.broadcast(inverse_document_frequencies(docs))

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(BANDS * ROWS)
        for batch in batches:
            keys = []
            for text in batch["text"]:
                s = _shingles(word_hashes(text), idf.value)
                keys.append(_bands(sampler(*s), BANDS, ROWS) if len(s[0]) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "keys": keys})

    signed = materialize(docs.mapInPandas(signatures, "doc_id long, digest binary, keys array<long>"), "signatures")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    reps = nodes.select("id", "keys")
    entries = reps.select("id", F.explode("keys").alias("key")).distinct()
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    entries = materialize(entries.join(shared, "key"), "buckets")
    wanted = nodes.join(entries.select("id").distinct(), "id", "left_semi").select("id", "rep", F.col("digest").alias("d"))
    texts = docs.join(wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("id", "text")  # a hot text is spread by doc_id
    texts = materialize(texts.dropDuplicates(["id"]), "texts")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {}
        for batch in batches:
            ok = []
            for b, tb, ta in zip(batch["b"], batch["text_b"], batch["text_a"]):
                if b not in kept:
                    kept = {b: _shingles(word_hashes(tb), idf.value)}  # the pivot of the run of rows
                ok.append(weighted_jaccard(kept[b], _shingles(word_hashes(ta), idf.value)) >= similarity)
            yield batch.loc[ok, ["ca", "cb"]]

    labels = entries.select("id").distinct().withColumn("component", F.col("id"))

    def relabel(links: DataFrame, labels: DataFrame) -> DataFrame:
        merged = connected_components(links, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("low"))
        return materialize(labels.join(merged, "component", "left").select("id", F.coalesce("low", "component").alias("component")), "labels")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").mapInPandas(verify, "ca long, cb long")

    def open_buckets(labels: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        members = entries.join(labels, "id")
        pivot = F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(k)) if k else F.col("id")).alias("p")
        spread = members.groupBy("key").agg(pivot, F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        return members, spread.filter("lo < hi")

    for k in range(STAR_ROUNDS):
        members, spread = open_buckets(labels, k)
        pairs = members.join(spread, "key").filter("component <> p.component").selectExpr("id AS a", "component AS ca", "p.id AS b", "p.component AS cb")
        pairs = materialize(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            break
        labels = relabel(verified(pairs), labels)
    else:
        members, spread = open_buckets(labels, STAR_ROUNDS)
        left = materialize(members.join(spread.select("key", "n"), "key"), "open")
        small = left.filter(F.col("n") <= PAIRS_UP_TO)
        pairs = small.selectExpr("key", "id AS a", "component AS ca").join(small.selectExpr("key", "id AS b", "component AS cb"), "key").filter("ca < cb").drop("key")
        links = verified(materialize(pairs.distinct(), "pairs"))
        large = left.filter(F.col("n") > PAIRS_UP_TO)
        blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
        large = large.join(reps, "id").join(texts, "id")
        large = materialize(large.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("id", "component", "keys", "text")).alias("rows")), "blocks")
        one = large.select("key", F.col("rows").alias("left_rows"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
        met = one.join(large.select("key", "block", "rows"), ["key", "block"])

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for x in batch.itertuples(index=False):
                    found = _links_between(x.key, list(x.left_rows), list(x.rows), x.i == x.block, idf.value, similarity)
                    yield pd.DataFrame(found, columns=["ca", "cb"], dtype="int64")

        labels = relabel(links.unionByName(met.mapInPandas(meet, "ca long, cb long")), labels)
    nodes = nodes.join(labels, "id", "left").select("digest", "rep", F.coalesce("component", "id").alias("component"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("first")
    classes = nodes.groupBy("component").agg(first)
    told = nodes.join(classes, "component").select("digest", "rep", F.col("first.rep").alias("class_id"), (F.col("digest") == F.col("first.digest")).alias("best"))
    out = signed.select("doc_id", "digest").join(told, "digest")
    return out.select("doc_id", "digest", F.col("rep").alias("copy_of"), "class_id", (F.col("best") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps: exactly one of each class. Of rows that repeat doc_id and text, any one
    stays."""
    found = near_duplicates(docs, similarity).filter("kept").groupBy(F.col("doc_id").alias("i"), F.col("digest").alias("d")).agg(F.count("*").alias("n"))
    found = materialize(found, "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own"), text_digest(F.col("text")).alias("t"))  # columns clash with none
    left = rows.join(found, F.col("own").eqNullSafe(F.col("i")) & (F.col("t") == F.col("d")))
    once = left.filter("n = 1")
    if not found.filter("n > 1").isEmpty():
        once = once.unionByName(left.filter("n > 1").dropDuplicates(["i", "d"]))
    return once.select("row.*")
