"""Nearest points of large clouds through a k-d tree whose leaves hold a bounded number of points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.hashing import uniform
from pointmill.functions.scratch import materialize

XYZ = ("x", "y", "z")
#: Points of a leaf, about; a cell of more than twice as many is split again.
LEAF = 1024
#: Points of a cell that its splits are taken from, the most cells it is split into at once, and rows of a task.
SAMPLE, CELLS, PART = 16_384, 1024, 32_768
#: Rounds of splitting; their cells' numbers fill 60 bits. A cell that is still too large is met whole.
ROUNDS = 6
#: Boxes under one box of the next level.
FAN = 32
#: Squared distances are compared after rounding to nine places.
TIE = 2e-9


def splits(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes, places) of a binary tree over sampled points, by the median of the longest side; node i has the children 2i + 1 (up to the place) and 2i + 2. Axis -1 ends a branch."""
    depth = max(1, int(np.ceil(np.log2(cells))))
    axes, places = np.full(2**depth - 1, -1), np.zeros(2**depth - 1)
    parts = {0: points}
    for node in range(2**depth - 1):
        own = parts.pop(node, None)
        if own is None or len(own) < 2:
            continue
        spread = own.max(0) - own.min(0)
        axis = int(spread.argmax())
        if spread[axis] <= 0:
            continue
        values = np.sort(own[:, axis])
        place = values[(len(values) - 1) // 2]
        if place == values[-1]:
            place = values[values < place].max()  # something must lie beyond
        axes[node], places[node] = axis, place
        parts[2 * node + 1], parts[2 * node + 2] = own[own[:, axis] <= place], own[own[:, axis] > place]
    return axes, places


def cell_of(points: np.ndarray, axes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The leaf of each point, numbered from left to right, so that near numbers are near cells."""
    node, number, depth = np.zeros(len(points), int), np.zeros(len(points), int), int(np.log2(len(axes) + 1))
    for _ in range(depth):
        inner = (node >= 0) & (node < len(axes))
        axis = np.where(inner, axes[np.where(inner, node, 0)], -1)
        right = (axis >= 0) & (points[np.arange(len(points)), np.maximum(axis, 0)] > places[np.where(inner, node, 0)])
        number = 2 * number + right
        node = np.where(axis >= 0, 2 * node + 1 + right, -1)
    return number


class Boxes:
    """Levels of boxes, each over FAN boxes of the level below, which lie one after the other."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray):
        self.levels = [(lows, highs)]
        while len(self.levels[-1][0]) > FAN:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    @staticmethod
    def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        rest = np.maximum(0, np.maximum(low - x, x - high))
        return (rest * rest).sum(-1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """For each point a leaf that is near: the nearest box of each level among those of the box above."""
        node = np.zeros(len(x), int)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[level]
            children = np.minimum(node[:, None] * FAN + np.arange(FAN), len(low) - 1)
            node = children[np.arange(len(x)), self._gap(x[:, None], low[children], high[children]).argmin(1)]
        return node

    def within(self, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) pairs whose squared distance may be at most ``square``."""
        point, node = np.arange(len(x)), np.zeros(len(x), int)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[level]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            point = np.repeat(point, FAN)
            there = child < len(low)
            point, child = point[there], child[there]
            hit = self._gap(x[point], low[child], high[child]) <= square[point]
            point, node = point[hit], child[hit]
        return point, node

    def reach(self, x: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which k points must lie, by the far corners of the leaves."""
        low, high = self.levels[0]
        out = np.full(len(x), np.inf)
        for i, p in enumerate(x):
            far = (np.maximum(np.abs(p - low), np.abs(p - high)) ** 2).sum(1)
            order = np.argsort(far)
            at = np.searchsorted(np.cumsum(counts[order]), k)
            out[i] = far[order[at]] if at < len(order) else np.inf
        return out


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _in_parts(df: DataFrame, by: list[str], spread: list[str], size: int = PART) -> DataFrame:
    """``df`` with __part, and __parts, the number of parts of about ``size`` rows of each group."""
    n = df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias("__parts"))
    return df.join(n, by).withColumn("__part", F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int"))


def _for_parts(df: DataFrame, dealt: DataFrame, by: list[str]) -> DataFrame:
    """``df`` once for each part of its group in ``dealt``."""
    parts = dealt.select(*by, "__parts").distinct()
    return df.join(parts, by).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def _met(left: DataFrame, right: DataFrame, by: list[str], f: Callable, schema: T.StructType) -> DataFrame:
    """f on the rows of equal ``by`` of both sides."""
    right = right.withColumnsRenamed({c: "__r_" + c for c in by})
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy(*by).cogroup(right.groupBy(*("__r_" + c for c in by))).applyInPandas(f, schema)


def _splits_of(by: list[str], place: list[str], leaf: int) -> Callable:
    def build(part: pd.DataFrame) -> pd.DataFrame:
        cells = min(CELLS, max(2, int(part["__n"].iloc[0]) // leaf), max(2, len(part) // 8))
        axes, places = splits(part[place].to_numpy(float), cells)
        return part[by].iloc[:1].assign(axes=[axes], places=[places])

    return build


def _assign(schema: T.StructType, place: list[str]) -> Callable:
    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cell = np.zeros(len(left), np.int64)
        if len(right) and len(left):
            cell = cell_of(left[place].to_numpy(float), np.asarray(right["axes"].iloc[0]), np.asarray(right["places"].iloc[0]))
        return left.assign(__leaf=left["__leaf"] * CELLS + cell)[schema.names]

    return assign


class Tree:
    """The points ``others`` (keys, n_pt, n_x, n_y, n_z) in leaves: clouds are the rows of equal ``keys``.

    Of equal points those of the k + 1 smallest n_pt are kept, unless ``all_copies``; no other can be among the k nearest. A cell of too many points is split by medians of a bounded sample of it,
    into up to CELLS cells at once, until all are small; so dense places get small cells, whatever share of the cloud they hold.
    """

    def __init__(self, others: DataFrame, keys: list[str], k: int, leaf: int = LEAF, all_copies: bool = False):
        self.keys, self.k, place = keys, k, [f"n_{c}" for c in XYZ]
        cells = others.select(*keys, "n_pt", *(F.col(c).cast("double").alias(c) for c in place))
        for c in place:
            cells = cells.filter(F.col(c).isNotNull() & ~F.isnan(c))
        if not all_copies:
            rank = F.row_number().over(W.partitionBy(*keys, *place).orderBy("n_pt"))
            cells = cells.withColumn("__r", rank).filter(F.col("__r") <= k + 1).drop("__r")
        cells = materialize(cells.withColumn("__leaf", F.lit(0).cast("long")), "cells")
        by = [*keys, "__leaf"]
        before = None
        for round_ in range(ROUNDS):
            large = materialize(cells.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > 2 * leaf), "large")
            n = large.count()
            most = large.agg(F.max("__n")).first()[0]
            if not n or (n, most) == before:
                break
            before = (n, most)
            sample = cells.join(large, by).filter(uniform(round_, "n_pt", "__leaf") * F.col("__n") < SAMPLE)
            kinds = T.StructType([*_fields(cells, by), T.StructField("axes", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.DoubleType()))])
            trees = materialize(sample.groupBy(*by).applyInPandas(_splits_of(by, place, leaf), kinds), "splits")
            dealt = materialize(_in_parts(cells.join(large.select(*by), by), by, ["n_pt"]), "dealt")
            schema = T.StructType(_fields(cells, [*by, "n_pt", *place]))
            down = _met(dealt.drop("__parts"), _for_parts(trees, dealt, by), [*by, "__part"], _assign(schema, place), schema)
            rest = cells.join(large.select(*by), by, "left_anti").withColumn("__leaf", F.col("__leaf") * CELLS)
            cells = materialize(down.select(*cells.columns).unionByName(rest.select(*cells.columns)), "cells")
        self.cells = cells
        boxes = cells.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in place), F.count("*").alias("n"))
        corner = lambda n: F.array(*(F.col(f"{n}_{c}") for c in place))
        packed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__leaf", corner("lo").alias("lo"), corner("hi").alias("hi"), "n"))).alias("b"))
        packed = packed.select(*keys, F.col("b.__leaf").alias("leaves"), F.flatten("b.lo").alias("lo"), F.flatten("b.hi").alias("hi"), F.col("b.n").alias("counts"))
        self.boxes = materialize(packed, "boxes")

    def _to_leaves(self, points: DataFrame, ids: list[str], square: str | None, also: list[str]) -> DataFrame:
        """``points`` with __leaf: a near leaf of each, or all leaves but that one, __home, within the squared distance ``square`` (null: within which k others must lie)."""
        own = [*self.keys, *ids, *XYZ, *also]
        schema = T.StructType([*_fields(points, own), T.StructField("__leaf", T.LongType())])
        k = self.k

        def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return left[own].iloc[:0].assign(__leaf=np.empty(0, np.int64))
            head = right.iloc[0]
            leaves, tree = np.asarray(head["leaves"], np.int64), Boxes(np.reshape(head["lo"], (-1, 3)).astype(float), np.reshape(head["hi"], (-1, 3)).astype(float))
            x = left[list(XYZ)].to_numpy(float)
            if square is None:
                return left[own].assign(__leaf=leaves[tree.home(x)])
            far = left[square].to_numpy(float).copy()
            open_ones = np.flatnonzero(np.isnan(far))
            far[open_ones] = tree.reach(x[open_ones], np.asarray(head["counts"]), k + 1)
            point, leaf = tree.within(x, far * (1 + 1e-12) + TIE)
            out = left[own].iloc[point].assign(__leaf=leaves[leaf])
            return out[out["__leaf"] != out["__home"]] if "__home" in also else out

        dealt = _in_parts(points.select(*own), self.keys, ids)
        return _met(dealt.drop("__parts"), _for_parts(self.boxes, dealt, self.keys), [*self.keys, "__part"], find, schema)

    def _in_leaves(self, asked: DataFrame, ids: list[str], k: int | None, square: str | None) -> DataFrame:
        """Each asked point with the k nearest points of its leaf, or with those within its squared distance."""
        by, n_cols = [*self.keys, "__leaf"], ["n_pt", *(f"n_{c}" for c in XYZ)]
        own = [*self.keys, *ids, *XYZ]
        schema = T.StructType([*_fields(asked, own), T.StructField("__leaf", T.LongType()), *_fields(self.cells, n_cols), T.StructField("d2", T.DoubleType())])

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            empty = left[[*own, "__leaf"]].iloc[:0].join(pd.DataFrame({c: [] for c in [*n_cols, "d2"]}))
            if not len(left) or not len(right):
                return empty
            x, y, pt = left[list(XYZ)].to_numpy(float), right[n_cols[1:]].to_numpy(float), right["n_pt"].to_numpy()
            found = []
            for at in range(0, len(x), 256):
                d = np.zeros((len(x[at : at + 256]), len(y)))
                for c in range(3):
                    d += (x[at : at + 256, None, c] - y[None, :, c]) ** 2
                good = np.isfinite(d)
                if ids == ["pt"]:
                    good &= left["pt"].to_numpy()[at : at + 256, None] != pt
                if square is not None:
                    good &= d <= left[square].to_numpy(float)[at : at + 256, None] * (1 + 1e-12) + TIE
                elif k < len(y):  # what rounds to the k-th value or less
                    last = np.partition(np.where(good, d, np.inf), k - 1, axis=1)[:, k - 1]
                    good &= d <= last[:, None] + TIE
                i, j = np.nonzero(good)
                found.append((i + at, j, d[i, j]))
            i, j, d = (np.concatenate(z) for z in zip(*found))
            if k is not None:
                order = np.lexsort((pt[j], np.floor(d * 1e9 + 0.5), i))
                i, j, d = i[order], j[order], d[order]
                start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, int)
                rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                i, j, d = i[rank < k], j[rank < k], d[rank < k]
            out = left[[*own, "__leaf"]].iloc[i].reset_index(drop=True)
            return out.join(right[n_cols].iloc[j].reset_index(drop=True)).assign(d2=d)

        dealt = _in_parts(asked, by, ids)
        return _met(dealt.drop("__parts"), _for_parts(self.cells, dealt, by), [*by, "__part"], meet, schema)

    def nearest(self, points: DataFrame, ids: list[str]) -> DataFrame:
        """(keys, ids, x, y, z, n_pt, n_x, n_y, n_z, d2): for each point what may be among its k nearest; the k nearest are among them.

        A near leaf gives each point k others and a distance; the leaves that lie as near are visited too, and no other.
        """
        own = [*self.keys, *ids, *XYZ]
        first = materialize(self._in_leaves(materialize(self._to_leaves(points.select(*own), ids, None, []), "homes"), ids, self.k, None), "near")
        last = first.groupBy(*own).agg(F.first("__leaf").alias("__home"), F.when(F.count("*") == self.k, F.max("d2")).alias("__far"))
        left = materialize(points.select(*own).join(last.select(*self.keys, *ids, "__home", "__far"), [*self.keys, *ids], "left"), "bounds")
        left = left.withColumn("__home", F.coalesce("__home", F.lit(-1).cast("long")))
        second = self._in_leaves(materialize(self._to_leaves(left, ids, "__far", ["__home", "__far"]), "visits"), ids, self.k, None)
        return first.drop("__leaf").unionByName(second.drop("__leaf"))

    def within(self, points: DataFrame, ids: list[str], square: str) -> DataFrame:
        """(keys, ids, x, y, z, n_pt, n_x, n_y, n_z, d2): all others in the tree within the squared distance in the column ``square``."""
        asked = materialize(self._to_leaves(points, ids, square, [square]), "visits")
        return self._in_leaves(asked, ids, None, square).drop("__leaf")
