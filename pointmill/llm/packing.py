"""Operator 8: best-fit packing of token sequences, certified by dual-feasible-function bounds and repacked where gaps remain."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pointmill.llm.common import materialize

LENGTH = 2048
#: Pieces that are packed together in one task.
PART_PIECES = 2500
ROUNDS = 4
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: A text that holds this is encoded whole: special tokens are found before anything is split.
_SPECIAL = b"<|"
#: Words in the table, and bytes of text that are taken together; they bound memory, not results.
_WORDS, _CHUNK = 250_000, 1 << 21

# What a byte is: 0 other (control, beyond Latin-1), 1 white space, 2 letter, 3 digit, 4 apostrophe, 5 other ASCII mark.
_OTHER, _SPACE, _LETTER, _DIGIT, _APOSTROPHE, _MARK = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Latin-1 letters from 0xC0 up are this byte and a second one; the two of multiplication and division are no letters.
_LATIN = 0xC3
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
#: (byte, next byte) kinds between which the tokenizer always cuts, so that what stands on either side has its ids whatever is beyond: before
#: a word, around digits, behind letters, and before letters unless an apostrophe may form a contraction with them.
_CUTS = np.zeros((6, 6), bool)
_CUTS[_SPACE, :] = True
_CUTS[:, _SPACE] = False
_CUTS[_DIGIT, 2:] = _CUTS[2:, _DIGIT] = _CUTS[_LETTER, 3:] = True
_CUTS[_MARK, _LETTER] = True
_CUTS = _CUTS.ravel()
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with Latin-1 letters in lower case, as the tokenizer has them, and their kinds."""
    low, kind = _LOWER[data], _KIND[data]
    lead = np.flatnonzero(data[:-1] == _LATIN)
    lead = lead[_SECOND[data[lead + 1]]]
    second = data[lead + 1]
    low[lead + 1] = np.where(second < 0x9F, second + np.uint8(32), second)
    kind[lead] = kind[lead + 1] = _LETTER
    return low, kind


def _bytes(words: pa.Array) -> list[bytes]:
    _, offsets, data = words.buffers()
    data, at = data.to_pybytes(), np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return [data[i:j] for i, j in zip(at, at[1:])]


class _Ids:
    """Token ids of texts by a table of the segments between sure cuts, white space left out; only segments that are new are encoded."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.starts, self.ids, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4"), 0

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _add(self, words: list[bytes], ids: np.ndarray, stops: np.ndarray) -> None:
        """Enter words whose ids stand one after the other in ``ids``, up to ``stops``."""
        n = len(self.words)
        while len(self.starts) < n + len(words) + 1:
            self.starts = np.append(self.starts, np.zeros_like(self.starts))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + len(words) + 1] = self.used + stops
        self.words.update(zip(words, range(n, n + len(words))))
        self.used += len(ids)

    def _learn(self, new: list[bytes]) -> None:
        """Words of Latin-1 letters are encoded in one call: each is one word to the tokenizer, so the tokens that end a word tell them apart."""
        plain, rest = [], []
        for word in new:
            (plain if _PLAIN(word) else rest).append(word)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            self._add(plain, ids, np.flatnonzero(self.ends[ids]) + 1)
        for word in rest:
            ids = self.encode(word)
            self._add([word], ids, np.array([len(ids)]))

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts that ``bounds`` cuts ``data`` into, one after the other, and where each text's ids stop."""
        data, kind = _kinds(data)
        cut = np.empty(len(data), bool)
        cut[1:] = _CUTS[kind[:-1] * np.uint8(6) + kind[1:]]
        full = bounds[:-1][bounds[:-1] < bounds[1:]]
        inside = kind != _SPACE
        cut[full] = inside[full]
        at = np.flatnonzero(cut)
        if not len(at):
            return np.empty(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        words = data[inside]
        offsets = np.append((np.cumsum(inside, dtype=np.int32) - np.int32(1))[at], np.int32(len(words)))
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(words)]).dictionary_encode()
        found = _bytes(coded.dictionary)
        known = np.fromiter(map(self.words.get, found, itertools.repeat(-1)), np.int64, len(found))
        if (known < 0).any():
            if len(self.words) + (known < 0).sum() > _WORDS:
                self._clear()
                known[:] = -1
            missing = np.flatnonzero(known < 0)
            self._learn([found[i] for i in missing.tolist()])
            known[missing] = [self.words[found[i]] for i in missing.tolist()]
        number = known[coded.indices.to_numpy()]
        first = self.starts[number]
        size = self.starts[number + 1] - first
        stops = np.cumsum(size)
        ids = self.ids[np.arange(stops[-1]) + np.repeat(first - (stops - size), size)]
        return ids, np.append(0, stops)[np.searchsorted(at, bounds[1:])]


@functools.cache
def _ids(path: str) -> _Ids:
    """One table for all tasks of a Python worker."""
    return _Ids(path)


def _chunks(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about _CHUNK bytes of text; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _CHUNK, "right")))
        yield start, stop
        start = stop


def token_ids(ids: _Ids, text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text without nulls, in no special order within a run of rows."""
    for start, stop in _chunks(text):
        part = text.slice(start, stop - start)
        special = pc.match_substring(part, _SPECIAL)
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        for i in whole:
            yield start + i, ids.encode(part[int(i)].as_py())
        rest = pc.filter(part, pc.invert(special))
        rows = np.setdiff1d(np.arange(stop - start), whole, assume_unique=True) + start
        if not len(rows):
            continue
        bounds = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1]
        data = np.frombuffer(rest.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        flat, stops = ids.texts(data, bounds - bounds[0])
        at = 0
        for row, end in zip(rows.tolist(), stops.tolist()):
            yield row, flat[at:end]
            at = end


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): token ids and ``end_id`` of every whole text, cut only above ``length``.

    A null text counts as empty (one piece of the end id); rows with a null doc_id are kept.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = _ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for row, own in token_ids(ids, batch.column("text").cast(pa.binary())):
                n, view = len(own) + 1, memoryview(own).cast("B")
                for k, at in enumerate(range(0, n, length)):
                    size = min(length, n - at)
                    crc = zlib.crc32(view[4 * at : 4 * (at + size)])
                    out.append((row, k, at, size, zlib.crc32(end, crc) if at + size == n else crc))
            if out:
                rows, *columns = (pa.array(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip((batch.column("doc_id").take(rows), *columns), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int = LENGTH) -> int:
    """A number of bins that no packing can beat: the best of the dual feasible functions u_e (drop below e, fill above C - e)
    and f_k (round (k + 1) * size down to multiples of C), of which the plain volume bound is the case e = 0."""
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    weight = np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))
    number = np.concatenate(([0], np.cumsum(count)))
    e = np.arange(1, capacity // 2 + 1)
    big = number[-1] - number[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    best = max(best, int((big + -(-middle // capacity)).max()))
    x = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each size, and the number of bins."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # distinct free rooms, sorted
    open_bins: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            room, b, n = capacity, n, n + 1
        else:
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        bins[i], offsets[i] = b, capacity - room
        if room := room - size:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append(b)
    return bins, offsets, n


def pack(items: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``items`` with a column length <= ``length``, plus (sequence_id, offset): sequences are gapless from offset 0.

    Hash partitions of about ``part_pieces`` items are packed best-fit decreasing on their own. A partition whose bins equal its lower
    bound is certified: its bins are final, but for the emptiest one. The others keep only their full bins. What is left is exchanged:
    dealt anew into fewer partitions and packed again, for ``rounds`` rounds; the last packing stands. Any number of equal
    lengths (repeated rows, ties) spreads evenly, since items are dealt by a random id. No rows give no rows.
    """
    left = materialize(items.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    more = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__done", T.BooleanType())]
    schema = T.StructType(left.schema.fields + more)
    done = None
    for k in range(rounds):
        parts = max(1, -(-left.count() // part_pieces))
        last = k + 1 == rounds or parts == 1
        dealt = left.withColumn("__part", F.pmod(F.xxhash64("__id", F.lit(k)), F.lit(parts)))
        packed = materialize(dealt.groupBy("__part").applyInPandas(_repack(k, last, length), schema), "packed")
        final = packed.filter("__done").drop("__done", "__id")
        done = final if done is None else done.unionByName(final)
        left = packed.filter("NOT __done").drop("__done", "sequence_id", "offset")
        if last or left.isEmpty():
            return done
    return done


def _repack(k: int, last: bool, length: int):
    """Packs one partition of round k and tells which of its rows are final."""

    def repack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__id", ignore_index=True)
        sizes = part["length"].to_numpy(np.int64)
        bins, offset, n = best_fit(sizes, length)
        fill = np.bincount(bins, weights=sizes, minlength=n)
        stays = np.full(n, n <= lower_bound(sizes, length))
        stays[fill.argmin()] = False
        number = (np.int64(k) << 56) + (np.int64(key[0]) << 24) + bins
        return part.drop(columns="__part").assign(sequence_id=number, offset=offset, __done=last | (stays | (fill == length))[bins])

    return repack


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, tokenizer, length), length)
