"""Operator 6: mixing sources to target weights by temperature, realised as budgeted permutations of document blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointmill.llm.common import materialize

BLOCK_TOKENS = 100_000
MAX_REPEAT = 2.0
#: Columns that the mixture adds.
ADDED = ("epoch", "block", "tokens", "weight")
#: A cell of a source's permutation holds about so many blocks, once the source has 1024 cells of them.
CELL_BLOCKS = 16


def token_count(text: Column) -> Column:
    """Words between white space of the whole text; an empty or null one counts 1, so that every row takes part."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")


def _bisect(f, low: float, high: float, steps: int = 60) -> float:
    """A zero of the rising or falling f between low and high."""
    rising = f(high) >= f(low)
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if (f(mid) > 0) == rising else (mid, high)
    return (low + high) / 2


def temperature(shares: DataFrame, max_repeat: float | None = None, entropy: float | None = None) -> float:
    """The exponent a of weights ~ share ** a, with a in [0, 1].

    max_repeat: the flattest weights at which the smallest source repeats at most so often while the largest is read once.
    entropy: weights of that entropy in nats; targets out of reach give the nearest end. ``shares`` (source, tokens) is one row
    per source; it is summed in Spark for each bisected exponent and never collected.
    """
    if (max_repeat is None) == (entropy is None):
        raise ValueError("give max_repeat or entropy")
    low, high, total = shares.agg(F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    if low is None or low == high:
        return 1.0
    if max_repeat is not None:
        if max_repeat < 1:
            raise ValueError("max_repeat must be 1 or more")
        over = lambda a: (1 - a) * math.log(high / low) - math.log(max_repeat)
        return 0.0 if over(0.0) <= 0 else _bisect(over, 0.0, 1.0)
    log_p = F.log(F.col("tokens") / F.lit(total))

    def gap(a: float) -> float:
        z, s = shares.agg(F.sum(F.exp(a * log_p)), F.sum(F.exp(a * log_p) * log_p)).first()
        return math.log(z) - a * s / z - entropy

    if gap(0.0) <= 0:
        return 0.0
    return 1.0 if gap(1.0) >= 0 else _bisect(gap, 0.0, 1.0, 24)


def _mixed(docs: DataFrame, max_repeat: float | None, entropy: float | None, budget: float | None, block_tokens: int, seed: int) -> DataFrame:
    """(__row, epoch, block, tokens, weight): the rows of ``docs`` as structs, so that their columns clash with none."""
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    unit = F.struct(name.alias("s"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("id"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), unit.alias("__u"), token_count(F.col("text")).alias("tokens"))
    stats = materialize(rows.groupBy(F.col("__u.s").alias("__s")).agg(F.sum("tokens").alias("__t")), "sources")
    a = temperature(stats.select(F.col("__s").alias("source"), F.col("__t").alias("tokens")), max_repeat, entropy)
    z, most = stats.agg(F.sum(F.pow("__t", F.lit(a))), F.max(F.pow("__t", F.lit(1 - a)))).first()
    if z is None:
        return docs.select(F.struct(*docs.columns).alias("__row"), *(F.lit(None).cast(k).alias(c) for c, k in zip(ADDED, ("int", "long", "long", "double"))))
    total = float(budget) if budget is not None else most * z
    weight = F.pow("__t", F.lit(a)) / F.lit(z)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("__t") / F.lit(block_tokens))).cast("long")
    bits = F.least(F.lit(40), F.lit(10) + F.ceil(F.log2(F.greatest(F.lit(1.0), blocks / F.lit(1024.0 * CELL_BLOCKS))))).cast("int")  # of the cells
    plan = stats.select("__s", "__t", weight.alias("weight"), blocks.alias("__blocks"), bits.alias("__bits"), F.floor(weight * total + F.lit(1e-6)).cast("long").alias("__budget"))
    plan = plan.withColumn("__full", F.floor(F.col("__budget") / F.col("__t")).cast("int")).withColumn("__rest", F.col("__budget") % F.col("__t"))

    def placed(df: DataFrame) -> DataFrame:
        """With the plan of the source, the block and its place in the permutation of the last epoch."""
        block = F.pmod(F.xxhash64("__u.id", F.lit(seed)), F.col("__blocks"))
        df = df.withColumn("__s", F.col("__u.s")).join(plan, "__s").withColumn("block", block)
        place = F.xxhash64("__s", "block", "__full", F.lit(seed))
        return df.withColumn("__place", place).withColumn("__cell", F.expr("shiftrightunsigned(__place, 64 - __bits)"))

    small = placed(rows.select("__u", "tokens"))
    cells = small.groupBy("__s", "__cell").agg(F.sum("tokens").alias("n"), F.first("__rest").alias("__rest"))
    before = F.sum("n").over(W.partitionBy("__s").orderBy("__cell")) - F.col("n")
    edge = materialize(cells.withColumn("b", before).filter("b <= __rest AND b + n > __rest").selectExpr("__s", "__cell AS __edge", "__rest - b AS __left"), "edges")
    inner = small.join(edge, "__s").filter("__cell = __edge AND __left > 0")
    order = W.partitionBy("__s").orderBy("__place", "block", F.xxhash64("__u.id", F.lit(seed + 1)), "__u.id")
    last = inner.withColumn("r", F.sum("tokens").over(order)).filter("r <= __left").select("__u").distinct()
    last = materialize(last.withColumn("__in", F.lit(1)), "boundary")  # the documents of some blocks: Spark sees its size
    out = placed(rows).join(edge, "__s", "left").join(last, "__u", "left")
    epochs = F.col("__full") + F.when((F.col("__cell") < F.col("__edge")) | F.col("__in").isNotNull(), 1).otherwise(0)
    out = out.withColumn("__n", epochs).filter("__n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return out.select("__row", *ADDED)


def mix_sources(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 6) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text, ...) with (epoch, block, tokens, weight) appended, repeated to meet the source weights.

    A source's token budget is weight * budget; ``budget`` defaults to the least at which every source is read in full at least
    once, so nothing is dropped. A budget of e epochs takes every document floor(e) times and, in the last epoch, the blocks
    that come first in a seeded permutation; the block at the boundary gives the documents that still fit. A source is short of
    its budget by less than one document. (epoch, permuted block) is the reading order of a source.

    Defined cases: a null source is a source of its own; an empty or null text counts as one token; repeated rows are separate
    rows; rows with a null doc_id are shuffled by their text; columns of ``docs`` that are named like the appended ones are replaced (see
    :func:`repeat_sources`); no rows give no rows. A hot source is split by cells of its permutation, about CELL_BLOCKS blocks each, so only the
    documents of one boundary cell are ever ordered together, whatever the source's size.
    """
    mixed = _mixed(docs, max_repeat, entropy, budget, block_tokens, seed)
    return mixed.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def repeat_sources(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 6) -> DataFrame:
    """The rows of :func:`mix_sources` with all columns of ``docs`` as they are and no others."""
    return _mixed(docs, max_repeat, entropy, budget, block_tokens, seed).select("__row.*")
