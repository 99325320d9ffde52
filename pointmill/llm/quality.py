"""Operator 3: text quality by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import word_hashes

#: At most so many trusted positives and so many unlabelled texts are fitted on, taken in hash order.
FIT_ROWS = 6000
THRESHOLD = 0.7
_MARKS = b"!?.,;:'\"-#$%&*|<>@/\\+=_~^()[]{}"
_KIND = np.zeros(256, np.int64)
_KIND[[10, 13]] = 1
_KIND[[9, 32]] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 5
_KIND[128:] = 6
_KIND[list(_MARKS)] = 7 + np.arange(len(_MARKS))
N_KINDS = 7 + len(_MARKS)
N_FEATURES = N_KINDS + 9


def text_features(text: str | None) -> np.ndarray:
    """Scale-free style features of a whole text: shares of character kinds, word shapes, repetition, length. Empty: zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if not data:
        return out
    codes = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[codes], minlength=N_KINDS)
    words = word_hashes(text)
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    tokens = data.split()
    m = max(1, len(tokens))
    loud = sum(t.isupper() and len(t) > 1 for t in tokens)
    odd = sum(t[-1] in b"!#$%&*|" for t in tokens)
    out[:N_KINDS] = np.sqrt(kinds / len(codes))
    out[N_KINDS:] = (
        len(np.unique(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(data) / n / 10,
        np.log1p(n) / 10,
        loud / m,
        odd / m,
        np.log1p(n / max(1, len(lines))) / 5,
        1.0 * (len(words) == 0),
        np.mean(words[1:] == words[:-1]) if len(words) > 1 else 0.0,
    )
    return out


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Largest share of positives that the scores of the unlabelled allow: the least ratio of P(U above t) to P(P above t) over thresholds t that leave at least
    three tenths of the positives above them (the unlabelled hold prior * P and others, which can only add to it)."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.quantile(p, np.linspace(0, 0.7, 96))
    above_p = 1 - np.searchsorted(p, at, "left") / len(p)
    above_u = 1 - np.searchsorted(u, at, "left") / len(u)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.99))


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The two terms of the unbiased logistic risk, prior * E_p[l(g, +)] and E_u[l(g, -)] - prior * E_p[l(g, -)], and the step's gradient: of their sum, or, where
    the second is negative, of its negation alone (Kiryo et al. 2017)."""
    gp, gu = p @ w, u @ w
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    sp, su = _sigmoid(gp), _sigmoid(gu)
    g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return positive, negative, -prior * (p.T @ (1 - sp)) / len(p) + g_negative if negative >= 0 else -g_negative


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class PuClassifier:
    """Logistic scorer fitted to the non-negative unbiased risk (Kiryo et al. 2017) by full-batch gradient steps.

    risk = prior * E_p[l(g, +)] + max(0, E_u[l(g, -)] - prior * E_p[l(g, -)]); when the second term is negative, its
    gradient is reversed, as in the paper. Without a given prior it is estimated from positives and unlabelled rows
    alone, by fits of the ones against the others.
    """

    def __init__(self, prior: float | None = None, steps: int = 400, rate: float = 0.3, l2: float = 1e-2):
        self.prior, self.steps, self.rate, self.l2 = prior, steps, rate, l2

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.hstack([z, np.minimum(z * z, 9) - 1, np.ones((len(z), 1))])

    def _descend(self, gradient) -> np.ndarray:
        w = np.zeros(2 * N_FEATURES + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, self.steps + 1):
            g = gradient(w) + self.l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= self.rate / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> PuClassifier:
        both = np.vstack([positive, unlabelled])
        self.mean, self.std = both.mean(0), both.std(0) + 1e-6
        p, u = self._design(positive), self._design(unlabelled)
        if self.prior is None:
            self.prior = self._estimate(p, u) if min(len(p), len(u)) > 1 else 0.5
        self.w = self._descend(lambda w: pu_risk(w, p, u, self.prior)[2])
        return self

    def _estimate(self, p: np.ndarray, u: np.ndarray) -> float:
        """The class prior by scorers of positives against unlabelled, each fitted on one half of the rows and read on the other."""
        scores = []
        for k in (0, 1):
            hp, hu = p[k::2], u[k::2]
            w = self._descend(lambda w, hp=hp, hu=hu: -hp.T @ (1 - _sigmoid(hp @ w)) / len(hp) + hu.T @ _sigmoid(hu @ w) / len(hu))
            scores.append((p[1 - k :: 2] @ w, u[1 - k :: 2] @ w))
        return class_prior(*(np.concatenate(x) for x in zip(*scores)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._design(x) @ self.w)


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "x": [text_features(t) for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> PuClassifier | None:
    """Fit on at most ``rows`` trusted positives (quality 1) and ``rows`` texts as unlabelled, both outside the held-out fold.

    The class prior is estimated from both (see :class:`PuClassifier`); rows labelled 0 are never learnt from. None if there are no positives. Texts enter
    as features only, so the driver gets at most 2 * rows short vectors.
    """
    train = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(~held_out(F.col("id")))
    order = [F.xxhash64("id", F.lit(3)), F.col("id")]
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("id")).filter(~held_out(F.col("id"))).distinct().orderBy(*order).limit(rows)
    some = train.select("id").orderBy(*order).limit(rows)
    got = {}
    for name, ids in (("p", good), ("u", some)):
        wanted = train.join(F.broadcast(ids.distinct()), "id", "left_semi")  # at most ``rows`` ids
        one = wanted.mapInPandas(_features, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x")).orderBy("id")  # repeated rows count once
        got[name] = np.array(one.toPandas()["x"].tolist()).reshape(-1, N_FEATURES)
    return PuClassifier().fit(got["p"], got["u"]) if len(got["p"]) and len(got["u"]) else None


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text); labels has (doc_id, quality).

    Defined cases: a null text scores as an empty one; without any trusted positive every score is 0.5 (and :func:`accepted` keeps all); repeated rows score
    alike; a null doc_id is never held out; rows of ``labels`` for unknown ids or with null quality are ignored; only
    the text enters a score. Texts are read whole.
    """
    model = fit(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array([text_features(t) for t in batch["text"]])
                yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": model.score(x) if model else 0.5})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInPandas(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores the threshold or more. Defined cases as for :func:`score_quality`."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model.value is None or not len(texts):
            return pd.Series(np.ones(len(texts)))
        return pd.Series(model.value.score(np.array([text_features(t) for t in texts])))

    return docs.filter(score("text") >= THRESHOLD)
