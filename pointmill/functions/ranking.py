"""Ranks and exact quantiles in groups of any size: no group is ordered by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointmill.functions.scratch import materialize

#: Leading hexadecimal digits of the hash that make a cell: 4,096 cells a group.
DIGITS = 3


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal nulls; b's keys are dropped."""
    b = b.withColumnsRenamed({k: "__k_" + k for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("__k_" + k))
    return a.join(b, on, how).drop(*("__k_" + k for k in keys))


def hash_ranked(df: DataFrame, by: list[str], order: Column, ties: list[str], rank: str = "__r", total: str = "__n") -> DataFrame:
    """Adds ``rank`` (from 1) among the rows of equal ``by`` in the order of ``order``, a hexadecimal hash, then ``ties``; and ``total``, their number.

    A group falls into cells by the first digits of the hash, evenly: a row's rank is the number of rows in earlier cells, counted with map-side sums, and its
    rank within its cell. So a group of any size is ordered by many tasks.
    """
    df = df.withColumn("__o", order).withColumn("__c", F.substring("__o", 1, DIGITS))
    sizes = df.groupBy(*by, "__c").agg(F.count("*").alias("__k"))
    w = W.partitionBy(*by)  # cells, not rows
    sizes = sizes.withColumns({"__b": F.sum("__k").over(w.orderBy("__c")) - F.col("__k"), total: F.sum("__k").over(w)}).drop("__k")
    own = F.row_number().over(W.partitionBy(*by, "__c").orderBy("__o", *ties))
    ranked = join_same(df.withColumn(rank, own), sizes, [*by, "__c"])
    return ranked.withColumn(rank, (F.col(rank) + F.col("__b")).cast("bigint")).drop("__o", "__c", "__b")


def range_ranked(df: DataFrame, order: list, by: list[str] = (), rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) in the order of ``order`` among the rows of equal ``by``, by default among all; and, if named, their number ``total``.

    Rows are dealt out by ranges of (by, order), sorted within each range and written once; ranks are places in a range plus the rows of the group in earlier
    ranges, of which there are as many as shuffle partitions.
    """
    by = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranked").withColumn("__p", F.shiftright("__m", 33))
    sizes = dealt.groupBy(*by, "__p").agg(F.count("*").alias("__k"), F.min("__m").alias("__lo"))
    w = W.partitionBy(*by)  # ranges, not rows
    added = {"__b": F.sum("__k").over(w.orderBy("__p")) - F.col("__k")} | ({total: F.sum("__k").over(w)} if total else {})
    ranked = join_same(dealt, sizes.withColumns(added).drop("__k"), [*by, "__p"])
    return ranked.withColumn(rank, F.col("__m") - F.col("__lo") + 1 + F.col("__b")).drop("__m", "__p", "__lo", "__b")


#: Groups of up to so many rows give their quantiles from one buffer each, larger ones from histograms.
SMALL = 1 << 17
#: Bits of a digit; the 64 bits of a double are selected in four.
DIGIT = 16
#: Selections of up to so many rows are sent to all tasks.
FEW = 100_000
#: Bins of up to so many rows are put in order each by themselves, in place of further digits.
BIN = 1 << 14


def ordered_bits(v: Column) -> Column:
    """The 64 bits of a double as a whole number in the order of the values; zeros of both signs are equal, NaN comes last."""
    a, two = F.abs(v), F.lit(2.0)
    about = F.floor(F.log2(a))
    lead = a / F.pow(two, about)
    e = about + F.when(lead >= 2, 1).when(lead < 1, -1).otherwise(0)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / F.pow(two, e) - 1) * F.lit(2.0**52)).cast("long")
    small = (a / F.lit(2.0**-1074)).cast("long")
    top = F.lit(2047 << 52)
    size = F.when(F.isnan(v), top + 1).when(a == float("inf"), top).when(a < 2.0**-1022, small).otherwise(normal)
    return F.when(v < 0, -size).otherwise(size)


def fits(df: DataFrame, by: list[str], small: int = SMALL) -> bool:
    """Whether no group has more than ``small`` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > small).isEmpty()


def select_ranks(rows: DataFrame, by: list[str], ranks, bin_rows: int = BIN) -> DataFrame:
    """(by, __n, __at): the size of each group of non-null doubles ``__v``, and the values at the places (from 0) that ``ranks``, a list of columns of ``__n``, gives.

    Radix selection: a histogram of the leading digit of the bits, summed map-side, tells in which bin each place lies; only rows of those bins are counted by the next
    digit. After four digits a bin is one value; once all bins that hold a place have ``bin_rows`` or fewer, they are put in order one by one. No group is sorted or ranked, equal values are a
    number in a bin, and what meets in one task are such a bin's rows, or the bins of one group, 65,536 at most for each place.
    """
    rows = materialize(rows.select(*by, "__v").withColumn("__key", ordered_bits(F.col("__v"))), "values")
    chosen = None
    for low in range(64 - DIGIT, -1, -DIGIT):
        keys, part = list(by), rows
        digit = F.shiftright("__key", low)
        if chosen is not None:
            keys, digit = [*by, "__p"], digit.bitwiseAND(F.lit((1 << DIGIT) - 1))
            part = join_same(rows.withColumn("__p", F.shiftright("__key", low + DIGIT)), F.broadcast(chosen.select(*keys)) if few else chosen.select(*keys), keys)
        bins = part.groupBy(*keys, digit.alias("__d")).agg(F.count("*").alias("__k"), F.min("__v").alias("__v"))
        w = W.partitionBy(*keys)
        bins = bins.withColumns({"__b": F.sum("__k").over(w.orderBy("__d")) - F.col("__k"), "__s": F.sum("__k").over(w)})
        if chosen is None:
            bins = bins.withColumn("__n", F.col("__s")).withColumn("__t", F.array(*(F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for i, r in enumerate(ranks))))
            prefix = F.col("__d")
        else:
            bins = join_same(bins, chosen.select(*keys, "__n", "__t"), keys)
            prefix = F.shiftleft("__p", DIGIT) + F.col("__d")
        inside = F.filter("__t", lambda x: (x["r"] >= F.col("__b")) & (x["r"] < F.col("__b") + F.col("__k")))
        bins = bins.withColumn("__t", F.transform(inside, lambda x: F.struct(x["i"].alias("i"), (x["r"] - F.col("__b")).alias("r")))).filter(F.size("__t") > 0)
        chosen = materialize(bins.select(*by, prefix.cast("long").alias("__p"), "__n", "__t", "__v", "__k"), "chosen")
        n, most = chosen.agg(F.count("*"), F.max("__k")).first()
        few = n <= FEW
        if low and (most or 0) <= bin_rows:
            keys = [*by, "__p"]
            part = join_same(rows.withColumn("__p", F.shiftright("__key", low)), F.broadcast(chosen.select(*keys)) if few else chosen.select(*keys), keys)
            ordered = join_same(chosen, part.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("__all")), keys)  # a bin's rows
            each = ordered.select(*by, "__n", "__all", F.explode("__t").alias("t"))
            chosen = each.select(*by, "__n", F.array(F.struct(F.col("t.i").alias("i"))).alias("__t"), F.element_at("__all", (F.col("t.r") + 1).cast("int")).alias("__v"))
            break
    found = chosen.select(*by, "__n", F.explode("__t.i").alias("__i"), "__v")
    return found.groupBy(*by).agg(F.first("__n").alias("__n"), F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("__at"))  # a value a place


def quantiles(df: DataFrame, value: str, at: list, by: list[str] = (), bounded: bool | None = None, small: int = SMALL) -> DataFrame:
    """(by, q): exact quantiles with linear interpolation of the non-null values of each group, in the order of ``at``, numbers from 0 to 1.

    Groups of up to ``small`` rows give them from one buffer each, larger ones by :func:`select_ranks`. ``bounded`` tells that no group is larger; it is found out if not given.
    """
    by, at = list(by), [float(p) for p in at]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    if bounded is None:
        bounded = fits(rows, by, small)
    none = F.array(*(F.lit(None).cast("double") for _ in at))
    of_small = lambda rows: rows.groupBy(*by).agg(F.coalesce(F.percentile("__v", F.array(*map(F.lit, at))), none).alias("q"))
    if bounded:
        return of_small(rows)
    rows = materialize(rows, "rows")
    large = rows.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > small).select(*by) if by else None
    if large is not None:
        large = materialize(large, "large").withColumn("__large", F.lit(True))  # one row for each ``small`` rows at most
        marked = join_same(rows, F.broadcast(large) if large.count() <= FEW else large, by, "left")
        rest, rows = marked.filter("__large IS NULL").drop("__large"), marked.filter("__large").drop("__large")
    n = F.col("__n")
    place = [F.lit(p) * (n - 1) for p in at]
    found = select_ranks(rows, by, [f(p) for p in place for f in (F.floor, F.ceil)])
    value_at = lambda i: F.element_at("__at", F.lit(i))
    q = [value_at(2 * i) + (p - F.floor(p)) * (value_at(2 * i + 1) - value_at(2 * i)) for i, p in enumerate(place)]
    found = found.select(*by, F.array(*q).alias("q"))
    return found if large is None else found.unionByName(of_small(rest))


def quantiles_of(df: DataFrame, at: dict[str, list], by: list[str], also: list[Column] = (), bounded: bool | None = None, small: int = SMALL) -> DataFrame:
    """(by, a column of quantiles for each key of ``at``, the aggregates ``also``): as :func:`quantiles`, of several columns."""
    if bounded is None:
        bounded = fits(df, by, small)
    if bounded:
        return df.groupBy(*by).agg(*(F.percentile(c, F.array(*(F.lit(float(p)) for p in ps))).alias(c) for c, ps in at.items()), *also)
    df = materialize(df, "wide")
    out = df.groupBy(*by).agg(F.count("*").alias("__rows"), *also)
    for c, ps in at.items():
        out = join_same(out, quantiles(df, c, ps, by, False, small).withColumnRenamed("q", c), by, "left")
    return out.drop("__rows")


def first_of(df: DataFrame, by: list[str], value: str, k: str, tie: str, bounded: bool | None = None, small: int = SMALL) -> DataFrame:
    """The rows of the ``k`` smallest non-null doubles ``value`` of each group, ``k`` being a column that is equal within it; of equal values those of the smaller ``tie``, a
    whole number that no two rows of a group share.

    In groups of up to ``small`` rows by a rank, in larger ones by a cut-off that :func:`select_ranks` finds, and another one among the rows at the cut-off; no group is ordered.
    """
    if bounded is None:
        bounded = fits(df, by, small)
    if bounded:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), tie))
        return df.withColumn("__r", rank).filter((F.col("__r") <= F.col(k)) & F.col(value).isNotNull()).drop("__r")
    df = materialize(df.filter(F.col(value).isNotNull()), "rows")
    sizes = df.groupBy(*by).agg(F.first(k).alias("__want"))
    ranked = select_ranks(join_same(df.select(*by, F.col(value).cast("double").alias("__v")), sizes, by), [*by, "__want"], [F.least("__want", "__n") - 1])
    cut = ranked.select(*by, F.element_at("__at", F.lit(0)).alias("__cut"))  # none where k is below 1
    marked = materialize(join_same(df, cut, by).filter(F.col(value) <= F.col("__cut")), "reached")
    below, at = marked.filter(F.col(value) < F.col("__cut")), marked.filter(F.col(value) == F.col("__cut"))
    left = join_same(at.groupBy(*by).agg(F.first(k).alias("__want")), below.groupBy(*by).agg(F.count("*").alias("__b")), by, "left")
    left = left.select(*by, (F.col("__want") - F.coalesce("__b", F.lit(0))).alias("__need"))
    ties = select_ranks(join_same(at.select(*by, F.col(tie).cast("double").alias("__v")), left, by), [*by, "__need"], [F.least("__need", "__n") - 1])
    last = ties.select(*by, F.element_at("__at", F.lit(0)).alias("__last"))
    at = join_same(at, last, by).filter(F.col(tie).cast("double") <= F.col("__last")).drop("__last")
    return below.unionByName(at).drop("__cut")
