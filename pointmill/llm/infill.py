"""Operator 12: fill-in-middle transformation of whole texts by displacement scatter, and its inverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.llm.common import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in hundredths, of texts that are transformed, and of those in the order suffix, prefix, middle.
RATE, SPM_RATE = 90, 20
#: Bytes of text that are taken together; they bound memory, not results. A longer text comes alone.
_CHUNK = 1 << 24
_PLAIN, _PSM, _SPM = range(3)
_FORMS = pa.array(["plain", "psm", "spm"])
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8).reshape(3, -1)
_WIDTH = _MARKS.shape[1]
#: The parts 0 prefix, 1 middle, 2 suffix in the order in which a form has them.
_ORDER = {_PSM: (0, 2, 1), _SPM: (2, 0, 1)}
#: The mark before each part.
_MARK_OF = (0, 2, 1)


def hash_groups(key: Column, groups: int = 4) -> list[Column]:
    """The first 8-digit groups of the hexadecimal sha256 of ``key`` as unsigned integers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(groups)]


def _flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and where each value starts, with the end behind."""
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if bounds[-1] == bounds[0]:
        return np.empty(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _text(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _shifts(starts: np.ndarray, shift: np.ndarray, total: int) -> np.ndarray:
    """The shift of every byte: differences are noted where parts start and summed up. Parts are given in the order of their starts; of several
    with one start, all but the last are empty and add up."""
    difference = np.zeros(total + 1, np.int64)
    np.add.at(difference, starts, np.diff(shift, prepend=0))
    return np.cumsum(difference[:-1])


def _layout(edges: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose parts lie at ``edges`` (n, 4): the place of each part in the output (n, 3), the bounds of the outputs, and the places of the marks (n, 3)."""
    size = np.diff(edges, axis=1)
    length = size.sum(1) + np.where(form == _PLAIN, 0, 3 * _WIDTH)
    bounds = np.append(0, np.cumsum(length))
    place, mark = edges[:, :3] - edges[:, :1] + bounds[:-1, None], np.zeros_like(size)
    for f, order in _ORDER.items():
        rows = np.flatnonzero(form == f)
        at = bounds[rows]
        for part in order:
            mark[rows, _MARK_OF[part]] = at
            place[rows, part] = at + _WIDTH
            at = place[rows, part] + size[rows, part]
    return place, bounds, mark


def scatter(data: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of the texts in ``data``: cut after ``low`` and ``high`` code points of the UTF-8 bytes. (bytes, bounds, places of cuts in bytes (n, 2))."""
    points = np.flatnonzero((data & 0xC0) != 0x80)  # where code points start
    first = np.searchsorted(points, bounds[:-1])
    points = np.append(points, len(data))
    inner = np.stack([points[first + low], points[first + high]], 1)
    edges = np.column_stack([bounds[:-1], inner, bounds[1:]])
    place, outer, mark = _layout(edges, form)
    shift = _shifts(edges[:, :3].ravel(), (place - edges[:, :3]).ravel(), len(data))
    out = np.empty(outer[-1], np.uint8)
    out[np.arange(len(data)) + shift] = data
    marked = mark[form != _PLAIN]
    for k in range(3):
        out[marked[:, k, None] + np.arange(_WIDTH)] = _MARKS[k]
    return out, outer, edges


def gather(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs: the marks, which stand once each, give the parts, and every byte is taken from where the transformation put it."""
    marked = np.flatnonzero(form != _PLAIN)
    mark = np.zeros((len(form), 3), np.int64)
    for k in range(3):
        hit = np.ones(max(0, len(data) - _WIDTH + 1), bool)
        for j in range(_WIDTH):
            hit &= data[j : len(data) - _WIDTH + 1 + j] == _MARKS[k, j]
        at = np.flatnonzero(hit)
        text = np.searchsorted(bounds, at, "right") - 1
        good = (form[text] != _PLAIN) & (at + _WIDTH <= bounds[text + 1])
        at, text = at[good], text[good]
        if len(at) != len(marked) or (text != marked).any():
            raise ValueError("an output without each mark once")
        mark[marked, k] = at
    start, end = np.repeat(bounds[:-1, None], 3, 1), np.repeat(bounds[:-1, None], 3, 1)
    end[:, 0] = bounds[1:]  # a plain text is all prefix
    start[:, 1:] = end[:, 1:] = bounds[1:, None]
    for f, order in _ORDER.items():
        rows = np.flatnonzero(form == f)
        ends = [*(mark[rows, _MARK_OF[part]] for part in order[1:]), bounds[rows + 1]]
        for part, stop in zip(order, ends):
            start[rows, part] = mark[rows, _MARK_OF[part]] + _WIDTH
            end[rows, part] = stop
    size = end - start
    inner = np.append(0, np.cumsum(size.sum(1)))
    begin = inner[:-1, None] + np.cumsum(size, 1) - size  # the parts in the text
    source = np.arange(inner[-1]) + _shifts(begin.ravel(), (start - begin).ravel(), int(inner[-1]))
    return data[source], inner


def _runs(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about _CHUNK bytes."""
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _CHUNK, "right")))
        yield start, stop
        start = stop


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, salt: str = "1:") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text of (doc_id, text).

    The text has n code points and is cut in two places that hashes of ``salt`` and the doc_id give. Plain texts stay as they are: empty ones, those that hold
    a mark, and by hash all but ``rate`` of a hundred. Others come as prefix, suffix, middle or, ``spm_rate`` of a hundred, as suffix, prefix, middle, each part behind its mark.

    Defined cases: a null text counts as empty; a null doc_id is hashed as an empty string and stays null; rows that repeat a doc_id are cut by the same hashes; texts of
    any length come whole; other columns are ignored; no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    key = F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), key.alias("key"))
    h = dict(zip(("h1", "h2", "h3", "h4"), hash_groups(F.col("key"))))
    cut = [h[c] % (F.col("n") + 1) for c in ("h1", "h2")]
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(m)
    form = F.when((F.col("n") == 0) | marked | (h["h3"] % 100 >= rate), _PLAIN).when(h["h4"] % 100 < spm_rate, _SPM).otherwise(_PSM)
    rows = rows.select("doc_id", "text", "n", F.least(*cut).alias("low"), F.greatest(*cut).alias("high"), form.cast("int").alias("form"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            for start, stop in _runs(text):
                part = batch.slice(start, stop - start)
                low, high, form = (part.column(c).to_numpy() for c in ("low", "high", "form"))
                data, bounds = _flat(text.slice(start, stop - start))
                out, outer, _ = scatter(data, bounds, low, high, form)
                plain = pa.array(form == _PLAIN)
                counts = [pc.if_else(plain, pa.scalar(None, pa.int64()), pa.array(x)) for x in (low, high - low)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n"), _FORMS.take(pa.array(form)), *counts, _text(out, outer)], schema=schema)

    return rows.mapInArrow(transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, text: str = "restored") -> DataFrame:
    """``outputs`` with the text that each ``output`` of the given ``form`` was made of, in the column ``text``.

    Defined cases: a null output gives null; a form other than psm and spm counts as plain; an output of these forms without each mark once is an error; a column named ``text`` is
    replaced; all others stay; no rows give no rows.
    """
    kept = [c for c in outputs.columns if c != text]
    inner, kind = unused(outputs, "output_of_rows"), unused(outputs, "form_of_rows")
    code = F.when(F.col("output").isNull(), _PLAIN).when(F.col("form") == "psm", _PSM).when(F.col("form") == "spm", _SPM).otherwise(_PLAIN)
    source = outputs.select(*kept, F.col("output").alias(inner), code.cast("int").alias(kind))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(inner)
            whole = pc.fill_null(given.cast(pa.binary()), b"")
            rest = batch.drop_columns([inner, kind])
            for start, stop in _runs(whole):
                found, bounds = gather(*_flat(whole.slice(start, stop - start)), batch.column(kind).slice(start, stop - start).to_numpy())
                found = pc.if_else(given.slice(start, stop - start).is_valid(), _text(found, bounds), pa.scalar(None, pa.string()))
                yield rest.slice(start, stop - start).append_column(text, found)

    return source.mapInArrow(back, T.StructType([*source.drop(inner, kind).schema, T.StructField(text, T.StringType())]))
