"""Operator 1: URL filter: rules first, then naive Bayes over host names segmented into words and path tokens."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import materialize

# The rules of the contract as (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Names of sites to block, as words; each is one labelled example for naive Bayes.
BLOCK_SEEDS = (
    "casino win", "online casino", "free bets", "sports betting", "poker slots", "jackpot bonus", "lottery gambling", "adult video", "adult dating",
    "porn tube", "sex cam", "xxx", "cheap pills", "viagra pharmacy", "diet pills", "ads track", "ad tracker", "popup ads", "click banner",
    "spam farm", "link farm", "seo links", "payday loan", "fast cash", "warez crack", "keygen serial", "torrent pirate", "replica watches",
)
#: Share of tokens that a blocked address has in common with all others.
ORDINARY = 0.9
#: Probability of block before a token is seen.
PRIOR = 0.5
#: Naive Bayes counts tokens in this many hash buckets, so the model has a fixed size.
BUCKETS = 1 << 16


def split_url(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host`` and ``path`` of ``url``: the host after the first ``://``, A-Z lower-cased; both empty without one."""
    url, pattern = F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones that with the longer host, then block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[0] == "block")):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def unigrams(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of the lower-case words of letters and digits in ``text``, mark-up left out."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?s)<(style|script)[^>]*>.*?</\1>|<[^>]*>", " ")
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, log_p: dict[tuple[int, int], float], total: float) -> list[str]:
    """The likeliest split of a label into words; an unknown piece of k characters has probability 10 / (total * 10 ** k). ``log_p`` has the known pieces. Time
    grows with the label and the known pieces only: the best start of an unknown piece is the same for all its ends."""
    n, each = len(label), math.log(10)
    known: dict[int, list[tuple[int, float]]] = {}
    for (start, end), p in sorted(log_p.items()):
        known.setdefault(end, []).append((start, p))
    best, cut = [0.0] + [-math.inf] * n, [0] * (n + 1)
    lead, lead_start = 0.0, 0  # the greatest best[start] + start * each so far
    for end in range(1, n + 1):
        if best[end - 1] + (end - 1) * each > lead:
            lead, lead_start = best[end - 1] + (end - 1) * each, end - 1
        best[end], cut[end] = lead + math.log(10 / total) - end * each, lead_start
        for start, p in known.get(end, ()):
            if best[start] + p > best[end]:
                best[end], cut[end] = best[start] + p, start
    out = []
    while n:
        out.append(label[cut[n] : n])
        n = cut[n]
    return out[::-1]


def segment_labels(labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(label, words) for every distinct ``label``: unigram Viterbi over the words of ``lexicon`` (word, n).

    The pieces of a label meet the lexicon in a join, so neither side is broadcast. Only pieces as long as some word of the lexicon are looked up, so a label of any length
    gives a number of pieces in proportion to it.
    """
    total = lexicon.agg(F.sum("n")).first()[0] or 1
    lengths = sorted(r[0] for r in lexicon.select(F.length("word").alias("k")).distinct().collect())  # a few dozen numbers
    labels = labels.select("label").distinct().filter("label <> ''")
    starts = labels.select("label", F.explode(F.sequence(F.lit(0), F.length("label") - 1)).alias("s"))
    cut = starts.select("label", "s", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("k")).filter(F.col("s") + F.col("k") <= F.length("label"))
    cut = cut.select("label", "s", (F.col("s") + F.col("k")).alias("e"), F.substring(F.col("label"), F.col("s") + 1, F.col("k")).alias("word"))
    known = cut.join(lexicon, "word").groupBy("label").agg(F.collect_list(F.struct("s", "e", "n")).alias("found"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = []
            for label, found in zip(batch["label"], batch["found"]):
                log_p = {(x["s"], x["e"]): math.log(x["n"] / total) for x in (found if found is not None else [])}
                words.append(viterbi(label, log_p, total))
            yield pd.DataFrame({"label": batch["label"], "words": words})

    return labels.join(known, "label", "left").mapInPandas(split, "label string, words array<string>")


def _tokens(host_words: Column, path: Column) -> Column:
    """Marked tokens: segmented host words and lower-case path pieces, digits as one sign each run."""
    pieces = F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.concat(F.transform(host_words, lambda x: F.concat(F.lit("h:"), x)), F.transform(pieces, lambda x: F.concat(F.lit("p:"), x)))


def filter_urls(pages: DataFrame, lexicon_texts: DataFrame, rules=RULES, seeds=BLOCK_SEEDS, prior: float = PRIOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score, words) for every row of ``pages`` (page_id, url).

    Where a rule fits, it decides. Elsewhere multinomial naive Bayes does: tokens of all pages give the ordinary distribution, and
    blocked pages draw a token from it with probability ORDINARY, else from the labelled names ``seeds``. block_score is the probability
    of block, ``prior`` before a token is seen; block needs more than one half. Host labels are segmented once per distinct host. ``lexicon_texts`` has
    the column ``text`` whose words give the unigram frequencies; the words of the seeds are added to them.

    Defined cases: a null url or one without ``://`` has empty host and path and no tokens, so its score is the prior; with the default it is allowed;
    repeated rows are judged alike; urls of any length are read whole; other columns are ignored, whatever their names.
    """
    parsed = split_url(pages)
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", said)
    hosts = materialize(parsed.groupBy("host").agg(F.count("*").alias("n")).select("host"), "hosts")
    labels = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("k", "label"))
    seed_words = [w for name in seeds for w in name.split()]
    extra = pages.sparkSession.createDataFrame([(w, 20) for w in sorted(set(seed_words))], "word string, n long")
    lexicon = materialize(unigrams(lexicon_texts).unionByName(extra).groupBy("word").agg(F.sum("n").alias("n")), "lexicon")
    cut = segment_labels(labels, lexicon)
    of_host = labels.join(cut, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "words"))).alias("w"))  # a host has at most 127 labels
    of_host = materialize(of_host.select("host", F.flatten(F.transform("w", lambda x: x["words"])).alias("words")), "segmented")
    judged = parsed.join(of_host, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    judged = judged.withColumn("tokens", _tokens(F.col("words"), F.col("path")))

    # Counts by bucket: at most BUCKETS rows. Pages alike in their tokens are counted together first.
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")
    seen = judged.groupBy("tokens").agg(F.count("*").alias("n")).select("n", F.explode("tokens").alias("token"))
    counts = seen.groupBy(bucket).agg(F.sum("n").alias("n")).toPandas()
    ordinary, blocked = np.full(BUCKETS, 1e-3), np.zeros(BUCKETS)
    ordinary[counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    marked = pages.sparkSession.createDataFrame([(m + w,) for w in seed_words for m in ("h:", "p:")], "token string").select(bucket).toPandas()
    np.add.at(blocked, marked["bucket"].to_numpy(int), 1.0)
    weight = np.log(ORDINARY + (1 - ORDINARY) * (blocked / max(1, blocked.sum())) / (ordinary / ordinary.sum()))
    model, odds = pages.sparkSession.sparkContext.broadcast(weight), math.log(prior / (1 - prior))

    @F.pandas_udf("double")
    def score(buckets: pd.Series) -> pd.Series:
        z = np.array([model.value[np.asarray(b, int)].sum() + odds for b in buckets])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    buckets = F.transform("tokens", lambda token: F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int"))
    out = judged.withColumn("block_score", score(buckets))
    verdict = F.coalesce("said", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score", "words")
