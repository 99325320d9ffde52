"""Operator 11: SentencePiece byte-pair encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from pointmill.llm.common import unused

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text, or ids, that are taken together; they bound memory, not results. A longer text comes alone.
_CHUNK = 1 << 21
#: Rounds after which the words that still have pairs, long ones without a sure cut, go to a queue; either way gives the same symbols.
ROUNDS = 64
_NONE = np.iinfo(np.int32).max
_SPACE = "▁"


class PieceModel:
    """Tables of a BPE model file: symbols of characters, ranks of pairs, sure cuts, bytes of ids."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind, kinds = proto.normalizer_spec, proto.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.remove_extra_whitespaces or norm.precompiled_charsmap or kind.treat_whitespace_as_suffix)
        if kind.model_type != kind.BPE or not kind.byte_fallback or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation")
        self.size = len(proto.pieces)
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        self.is_silent = np.zeros(self.size, bool)
        pieces: dict[str, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.is_byte[i] = i, True
                self.bytes.append(bytes([value]))
            elif p.type == kinds.NORMAL:
                pieces[p.piece] = i
                self.bytes.append(p.piece.replace(_SPACE, " ").encode())
            else:
                self.is_silent[i] = p.type == kinds.CONTROL
                self.bytes.append(b"" if self.is_silent[i] else kind.unk_surface.encode())
        self.piece_bytes = pa.array(self.bytes, pa.binary())
        self.is_space = np.array([b[:1] == b" " and not silent for b, silent in zip(self.bytes, self.is_byte)])
        self.is_space[[i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN]] = False

        # A symbol is a piece's id, a number from ``size`` for a character that stands in pieces only, or ``base`` + code point for any other character.
        chars = sorted({c for p in pieces for c in p})
        symbols = dict(pieces)
        for c in chars:
            symbols.setdefault(c, self.size + len(symbols))
        self.base = max(symbols.values(), default=0) + 1
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.base)
        self.char_class = np.zeros(0x110000, np.int16)
        for k, c in enumerate(chars):
            self.symbol[ord(c)], self.char_class[ord(c)] = symbols[c], k + 1
        self.classes = len(chars) + 1
        self.inside = np.zeros(self.classes * self.classes, bool)  # neighbours within some piece; between any others no piece can stand
        scores = sorted({-proto.pieces[i].score for i in pieces.values()})
        rank_of = {s: k for k, s in enumerate(scores)}
        pairs = []
        for p, i in pieces.items():
            at = self.char_class[np.frombuffer(p.encode("utf-32-le"), "<u4")].astype(np.int64)
            self.inside[at[:-1] * self.classes + at[1:]] = True
            pairs += [(symbols[p[:j]] * self.base + symbols[p[j:]], rank_of[-proto.pieces[i].score], i) for j in range(1, len(p)) if p[:j] in symbols and p[j:] in symbols]
        pairs.sort()
        keys, ranks, merged = (zip(*pairs)) if pairs else ((), (), ())
        self.pairs = {divmod(k, self.base): (r, i) for k, r, i in pairs}
        self.keys = np.append(np.array(keys, np.int64), np.iinfo(np.int64).max)
        self.ranks, self.merged = np.append(np.array(ranks, np.int32), np.int32(_NONE)), np.append(np.array(merged, np.int32), np.int32(0))
        # Runs of spaces merge after all else where they share the worst score; then a run falls, from the left, into stretches of the longest one.
        runs = [p for p in pieces if len(p) > 1 and set(p) == {_SPACE}]
        last = {rank_of[-proto.pieces[pieces[p]].score] for p in runs} == {len(scores) - 1}
        self.run = max(map(len, runs)) if last and not any(_SPACE * 2 in p and p not in runs for p in pieces) else 0
        if self.run and any(self._run(n) != [self.run] * (n // self.run) + self._run(n % self.run) for n in range(4 * self.run)):
            self.run = 0

    def _run(self, spaces: int) -> list[int]:
        """Lengths of the pieces that so many spaces merge into."""
        symbols = np.full(spaces, self.symbol[ord(_SPACE)])
        return [len(self.bytes[i]) for i in self._queue(symbols, self._rank(symbols, np.zeros(spaces, int), np.arange(spaces)))]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs in the tables; the last place stands for pairs that do not merge."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        at[(self.keys[at] != key) | (a >= self.base) | (b >= self.base)] = len(self.keys) - 1
        return at

    def words(self, chars: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Starts of the stretches that merge on their own: at the starts ``texts``, where no piece has the two neighbours, and after each longest run of spaces."""
        cut = np.zeros(len(chars), bool)
        kind = self.char_class[chars].astype(np.int32)
        cut[1:] = ~self.inside[kind[:-1] * np.int32(self.classes) + kind[1:]]
        cut[texts] = True
        if self.run:
            space = chars == ord(_SPACE)
            start = space.copy()
            start[1:] &= ~space[:-1] | cut[1:]
            at = np.flatnonzero(space)
            first = np.maximum.accumulate(np.where(start, np.arange(len(chars)), 0))[at]
            cut[at[(at - first) % self.run == 0]] = True
        return np.flatnonzero(cut)

    def merge(self, symbols: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all words, one after the other, and their number in each word.

        In each round every word merges the pairs of its lowest rank at once, the leftmost where they overlap, up to the first whose new neighbours would come
        before the next pair in line; that is the order of a queue by rank, then place. Words without pairs leave; after ``rounds`` rounds the queue itself takes the rest.
        """
        words = len(starts)
        number = np.arange(words)  # of the words still there
        size = np.diff(np.append(starts, len(symbols)))
        sizes, done = np.zeros(words, np.int64), []
        own = np.repeat(number, size)
        rank = self._rank(symbols, own, np.arange(len(symbols)))
        while len(number):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            live = low < _NONE
            if not live.all():
                out = ~np.repeat(live, size)
                done.append((number[~live], symbols[out]))
                sizes[number[~live]] = size[~live]
                symbols, rank = symbols[~out], rank[~out]
                number, size, low = number[live], size[live], low[live]
                own = np.repeat(np.arange(len(number)), size)
                if not len(number):
                    break
            if not rounds:
                for i, (a, n) in enumerate(zip((np.cumsum(size) - size).tolist(), size.tolist())):
                    part = self._queue(symbols[a : a + n], rank[a : a + n])
                    done.append((number[i : i + 1], part))
                    sizes[number[i]] = len(part)
                break
            rounds -= 1
            at = np.flatnonzero(rank == low[own])
            place = np.arange(len(at))
            run = np.append(True, at[1:] != at[:-1] + 1)
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            new = self.merged[self.pair(symbols[at], symbols[at + 1])]
            word = own[at]
            if len(at) > len(number):  # some word has several
                before = np.where(at > 0, symbols[at - 1], 0)
                joined = np.append(False, at[1:] == at[:-1] + 2)
                before[joined] = new[:-1][joined[1:]]
                has = (at > 0) & (own[at - 1] == word)
                left = np.where(has, self.ranks[self.pair(before, new)], _NONE)
                after = np.minimum(at + 2, len(symbols) - 1)
                has = (at + 2 < len(symbols)) & (own[after] == word)
                right = np.where(has, self.ranks[self.pair(new, symbols[after])], _NONE)
                sooner = np.cumsum(np.minimum(left, right) <= low[word])
                earlier = np.append(0, sooner[:-1])
                first = np.append(True, word[1:] != word[:-1])
                kept = earlier == earlier[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
                at, new, word = at[kept], new[kept], word[kept]
            symbols[at] = new
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, rank, own = symbols[stays], rank[stays], own[stays]
            size = size - np.bincount(word, minlength=len(number))
            at = at - np.arange(len(at))
            rank[at] = self._rank(symbols, own, at)
            at = at[at > 0] - 1
            rank[at] = self._rank(symbols, own, at)
        stops = np.cumsum(sizes)
        flat = np.empty(stops[-1] if words else 0, np.int32)
        for numbers, part in done:
            length = sizes[numbers]
            ends = np.cumsum(length)
            flat[np.arange(len(part)) + np.repeat((stops - sizes)[numbers] - (ends - length), length)] = part
        return flat, sizes

    def _queue(self, symbols: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The merged symbols of one word, pair by pair from a queue."""
        symbol, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, symbol[i], symbol[i + 1]) for i, r in enumerate(rank.tolist()) if r < _NONE]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j == n or symbol[j] != b:
                continue
            symbol[i], symbol[j], after[i] = self.pairs[a, b][1], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (found := self.pairs.get((symbol[k], symbol[after[k]]))):
                    heapq.heappush(queue, (found[0], k, symbol[k], symbol[after[k]]))
        return np.array([s for s in symbol if s is not None], np.int32)

    def _rank(self, symbols: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places ``at``."""
        after = np.minimum(at + 1, len(symbols) - 1)
        found = self.ranks[self.pair(symbols[at], symbols[after])]
        found[(own[at] != own[after]) | (at + 1 >= len(symbols))] = _NONE
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's ids stop. Every different word is merged once."""
        parts = [_SPACE + t.replace(" ", _SPACE) if t else "" for t in texts]
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4").astype(np.int32)
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        if not len(chars):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        starts = self.words(chars, (ends - lengths)[lengths > 0])
        offsets = (np.append(starts, len(chars)) * 4).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars)]).dictionary_encode()
        _, at, data = coded.dictionary.buffers()
        at = np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1] // 4
        flat, sizes = self.merge(self.symbol[np.frombuffer(data, np.int32)[: at[-1]]], at[:-1].astype(np.int64))
        flat, sizes = self._with_bytes(flat, sizes)
        number = coded.indices.to_numpy()
        size = sizes[number]
        stops = np.cumsum(size)
        ids = flat[np.arange(stops[-1]) + np.repeat((np.cumsum(sizes) - sizes)[number] - (stops - size), size)]
        return ids, np.append(0, stops)[np.searchsorted(starts, ends)]

    def _with_bytes(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the ids of their bytes."""
        other = np.flatnonzero(flat >= self.size)
        if not len(other):
            return flat, sizes
        codes = flat[other] - self.base
        inner = codes < 0  # stands in pieces only
        if inner.any():
            known = {int(self.symbol[c]): c for c in np.flatnonzero(self.char_class)}
            codes[inner] = [known[int(s)] for s in flat[other[inner]]]
        data = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        more = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        width = np.ones(len(flat), np.int64)
        width[other] = more
        out = np.repeat(flat, width)
        out[np.repeat(flat >= self.size, width)] = self.byte_id[data]
        per_word = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(per_word, weights=width, minlength=len(sizes)).astype(np.int64)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The texts of the id lists that begin at ``starts``: bytes of the pieces, spaces for their marks, without the space before the first piece."""
        ends = np.append(starts[1:], len(ids))
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.size):
            raise ValueError("an id that the model does not have")
        taken = self.piece_bytes.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = taken.buffers()[2].to_pybytes() if len(ids) and at[-1] else b""
        loud = np.append(np.where(self.is_silent[ids], len(ids), np.arange(len(ids))), len(ids)) if len(ids) else np.zeros(1, np.int64)
        first = np.minimum.accumulate(loud[::-1])[::-1][starts]  # the first piece that is heard
        strip = np.zeros(len(starts), bool)
        there = first < ends
        strip[there] = self.is_space[ids[first[there]]]
        out = []
        for i, (a, b, off) in enumerate(zip(at[starts].tolist(), at[ends].tolist(), strip.tolist())):
            try:
                out.append(data[a + off : b].decode())
            except UnicodeDecodeError:
                out.append(self._loose(ids[starts[i] : ends[i]])[off:])
        return pa.array(out, pa.string())

    def _loose(self, ids: np.ndarray) -> str:
        """A text whose byte ids are no UTF-8: each byte that begins no character becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes[i]
                continue
            while run:
                try:
                    out.append(run.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    run = run[e.start + 1 :]
            run = b""
            if i is not None:
                out.append(self.bytes[i].decode())
        return "".join(out)


@functools.cache
def _model(path: str) -> PieceModel:
    """One set of tables for all tasks of a Python worker."""
    return PieceModel(path)


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about _CHUNK in all, by their running totals."""
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _CHUNK, "right")))
        yield start, stop
        start = stop


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the sentencepiece library gives them without begin or end ids and without sampling.

    Texts are cut into words between neighbours that no piece holds, and each different word of a run of rows is merged once.

    Defined cases: null and empty texts have no ids; rows with a null doc_id and rows that repeat one are kept as they are; texts of any length come whole
    (a very long word without sure cuts goes through a queue); malformed UTF-8 counts as U+FFFD; other columns are ignored; no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            for start, stop in _runs(np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))):
                ids, stops = own.encode([t.decode("utf-8", "replace") for t in text.slice(start, stop - start).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), lists], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL, text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in the column ``text``.

    Defined cases: null lists give null, lists without ids the empty text; begin and end ids are silent, the unknown id gives the model's surface; bytes that
    are no UTF-8 give U+FFFD; an id that the model does not have is an error; a column named ``text`` is replaced; all others stay; no rows give no rows.
    """
    kept = [c for c in encoded.columns if c != text]
    inner = unused(encoded, "ids_of_rows")
    source = encoded.select(*kept, F.col("ids").cast("array<int>").alias(inner))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            lists = batch.column(inner)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            rest = batch.drop_columns([inner])
            for start, stop in _runs(np.cumsum(sizes)):
                part, size = lists.slice(start, stop - start), sizes[start:stop]
                found = own.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(size) - size)
                found = pc.if_else(part.is_valid(), found, pa.scalar(None, pa.string()))
                yield rest.slice(start, stop - start).append_column(text, found)

    return source.mapInArrow(decode, T.StructType([*source.drop(inner).schema, T.StructField(text, T.StringType())]))
