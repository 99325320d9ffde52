"""Operator 9: toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import materialize, word_hashes

#: Words are hashed to so many features, so the model has a fixed size.
FEATURES = 1 << 18
#: At most so many labelled rows of each label are fitted on, taken in hash order.
FIT_ROWS = 4000
#: Grades: 0 clean, 1 toxic, 2 severely toxic.
GRADES = 3


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words of the whole text, sorted, and how often each stands in it."""
    return np.unique((word_hashes(text) & np.uint64(FEATURES - 1)).astype(np.int64), return_counts=True)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ordinal_loss(w: np.ndarray, b: np.ndarray, flat: np.ndarray, row: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of the grades and its gradients by w and b. Text ``row[i]`` holds the word ``flat[i]``; b is the first threshold and the
    logarithms of the steps to the next ones."""
    n, at = len(grade), np.arange(len(grade))
    z = np.bincount(row, w[flat], n)
    cuts = np.concatenate(([b[0]], b[0] + np.cumsum(np.exp(b[1:]))))
    above = np.column_stack([np.ones(n), *(_sigmoid(z - c) for c in cuts), np.zeros(n)])
    p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
    slope = above * (1 - above)  # of P(>= j) by z; zero at both ends
    dz = -weight * (slope[at, grade] - slope[at, grade + 1]) / p
    dc = np.array([(weight / p * slope[:, j + 1] * ((grade == j + 1).astype(float) - (grade == j))).sum() for j in range(len(cuts))])
    db = np.concatenate(([dc.sum()], [dc[j:].sum() * np.exp(b[j]) for j in range(1, len(b))]))
    return float(-(weight * np.log(p)).sum()), np.bincount(flat, dz[row], len(w)), db


class OrdinalModel:
    """P(grade >= j) = sigmoid(w . x - b_j) with one weight vector and ordered thresholds b_1 < b_2 < ... .

    x marks the distinct words of a text, whatever its length. Thresholds are b_1 plus positive steps, so they stay in order. Only words whose count
    of graded texts is ``deviations`` binomial standard deviations off, in ``least`` fitted texts or more, get a weight, so that texts of thousands of
    words aren't judged by the noise of rare ones. Steps are AdaGrad on the weighted negative log-likelihood.
    """

    def __init__(self, steps: int = 300, rate: float = 0.5, l2: float = 1e-4, least: int = 4, deviations: float = 3.0):
        self.steps, self.rate, self.l2, self.least, self.deviations = steps, rate, l2, least, deviations

    def selects(self, number: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
        """Which words get a weight: ``number`` of the texts hold each, ``bad`` of them are graded, as the ``share`` of all texts is."""
        off = (bad - share * number) / np.sqrt(np.maximum(number * share * (1 - share), 1e-9))
        return (number >= self.least) & (np.abs(off) >= self.deviations)

    def fit(self, texts: list[np.ndarray], grade: np.ndarray, weight: np.ndarray) -> OrdinalModel:
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        number, bad = np.bincount(flat, minlength=FEATURES), np.bincount(flat, (grade > 0)[row], FEATURES)
        keep = self.selects(number, bad, (grade > 0).mean())[flat]
        used, flat = np.unique(flat[keep], return_inverse=True)
        row, m = row[keep], len(used)
        self.w, self.steps_b = np.zeros(FEATURES), np.zeros(GRADES - 1)
        w, b = np.zeros(m), np.concatenate(([2.0], np.full(GRADES - 2, 0.5)))  # b_1 and logs of the steps
        gw, gb = np.full(m, 1e-6), np.full(GRADES - 1, 1e-6)
        weight = weight / weight.sum()
        for _ in range(self.steps):
            _, g, db = ordinal_loss(w, b, flat, row, grade, weight)
            g = g + self.l2 * w
            gw, gb = gw + g * g, gb + db * db
            w, b = w - self.rate * g / np.sqrt(gw), b - self.rate * db / np.sqrt(gb)
        self.w[used] = w
        self.cuts = np.concatenate(([b[0]], b[0] + np.cumsum(np.exp(b[1:]))))
        return self

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return _sigmoid(np.asarray(z)[:, None] - self.cuts)


def _grades(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades of labelled texts: toxic ones are severe if marked words stand in them more often than in the middle toxic text.

    Marked words are the 50 with the largest log-odds of standing in a toxic rather than a clean text, in five toxic texts or more.
    """
    number = [np.bincount(np.concatenate([t[0] for t, x in zip(texts, toxic) if x == k] or [np.empty(0, np.int64)]), minlength=FEATURES) for k in (0, 1)]
    marked = _marked(number, toxic)
    hits = np.array([t[1][marked[t[0]]].sum() for t in texts])
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, np.where(hits > middle, 2, 1), 0)


def _marked(number: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The marked words, by the number of clean and of toxic texts that hold each."""
    odds = np.log((number[1] + 0.5) / (1 + (toxic == 1).sum())) - np.log((number[0] + 0.5) / (1 + (toxic == 0).sum()))
    odds[number[1] < 5] = -np.inf
    marked = np.zeros(FEATURES, bool)
    marked[np.argsort(-odds, kind="stable")[:50]] = True
    return marked & (odds > 0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> OrdinalModel | None:
    """Fit on at most ``rows`` labelled texts of either label; each label weighs as it does among all labelled rows. None without both.

    Words are selected by counts over the whole texts, which Spark sums up; the driver gets the counts, a table of fixed size, and of each text the selected words only.
    """
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    some = None
    for k in (0, 1):
        part = known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id", F.lit(9)), "id").limit(rows)
        some = part if some is None else some.unionByName(part)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [text_features(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "w": [m[0].astype(np.int32).tobytes() for m in made], "n": [m[1].astype(np.int32).tobytes() for m in made]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby("toxic"):
                number = np.bincount(np.frombuffer(b"".join(part["w"]), np.int32), minlength=FEATURES)
                word = np.flatnonzero(number)
                yield pd.DataFrame({"toxic": k, "word": word, "number": number[word]})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(some), "id")  # 2 * rows ids at most
    made = texts.mapInPandas(features, "id long, toxic int, w binary, n binary")
    made = materialize(made.groupBy("id").agg(F.min(F.struct("toxic", "w", "n")).alias("x")).select("id", "x.*"), "features")  # repeated rows count once
    toxic = made.select("toxic").toPandas()["toxic"].to_numpy(int)
    if len(set(toxic)) < 2:
        return None
    sums = made.mapInPandas(counted, "toxic int, word int, number long").groupBy("toxic", "word").agg(F.sum("number").alias("number")).toPandas()
    number = [np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)]
    for k in (0, 1):
        own = sums[sums["toxic"] == k]
        number[k][own["word"].to_numpy(int)] = own["number"].to_numpy()
    wanted = OrdinalModel().selects(number[0] + number[1], number[1], (toxic == 1).mean()) | _marked(number, toxic)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, times = ([np.frombuffer(x, np.int32) for x in batch[c]] for c in ("w", "n"))
            kept = [wanted[w] for w in words]
            yield batch.assign(w=[w[k].tobytes() for w, k in zip(words, kept)], n=[n[k].tobytes() for n, k in zip(times, kept)])

    got = made.mapInPandas(chosen, "id long, toxic int, w binary, n binary").orderBy("id").toPandas()
    made = [(np.frombuffer(w, np.int32).astype(np.int64), np.frombuffer(n, np.int32)) for w, n in zip(got["w"], got["n"])]
    toxic = got["toxic"].to_numpy(int)
    weight = np.array([share[t] for t in toxic]) / np.bincount(toxic, minlength=2)[toxic]
    return OrdinalModel().fit([m[0] for m in made], _grades(made, toxic), weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row of (doc_id, text); labels has (doc_id, toxic 0/1).

    severity is the expected grade, 0 to 2; p_toxic is P(grade >= 1); grade is the number of thresholds j with P(grade >= j) >= ``threshold``; toxic
    is grade >= 1. Defined cases: null text scores as an empty one; without rows of both labels everything is clean (severity 0);
    repeated rows score alike; texts of any length are read whole; a null doc_id is kept; labels of unknown ids or with other values are ignored; other
    columns are ignored, whatever their names; no rows give no rows.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            if not len(batch):
                continue
            if model is None:
                above = np.zeros((len(batch), GRADES - 1))
            else:
                above = model.above(np.array([model.w[text_features(t)[0]].sum() for t in batch["text"]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "severity": above.sum(1), "p_toxic": above[:, 0], "grade": (above >= threshold).sum(1)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(score, "doc_id long, severity double, p_toxic double, grade int").withColumn("toxic", (F.col("grade") >= 1).cast("int"))
