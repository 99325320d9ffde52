"""Operator 5: license scan: phrases, and an exact set-similarity join of lines and of word windows across lines with license templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# One-sentence notices of public licenses, as (label, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)
CONTAINMENT = 0.8
#: A word, once A-Z is lower-cased: in UTF-8, all bytes of characters beyond ASCII are 0x80 or more.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def places(all_words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Word positions from 0 where the phrase's words stand consecutively."""
    found, at, n = [], -1, len(phrase)
    try:
        while True:
            at = all_words.index(phrase[0], at + 1)
            if all_words[at : at + n] == phrase:
                found.append(at)
    except ValueError:
        return found


class TemplateIndex:
    """Prefix index of templates for an exact set-similarity join of a text's lines with them.

    Template words stand in the order of their corpus frequency, rarest first. A line that reaches t of a template's n words must hold one
    of its first n - t + 1 (prefix filter), must have t words (length filter), and if its first shared word is at place i of the
    template, n - i must be t or more (position filter). What passes is intersected.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], containment: float):
        self.templates, self.spans, self.index = [], [], defaultdict(list)
        for label, text in templates:
            order = sorted(set(words(text)), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, math.ceil(containment * len(order) - 1e-9))
            for place, word in enumerate(order[: len(order) - need + 1]):
                self.index[word].append((len(self.templates), place))
            self.templates.append((label, order, need))
            self.spans.append(math.ceil(len(words(text)) / containment - 1e-9))
        self.prefixes = frozenset(self.index)

    def matches(self, line: set[bytes]) -> dict[int, float]:
        """Template number -> containment, for those of the threshold or more."""
        first: dict[int, int] = {}
        for word in self.prefixes & line:
            for k, place in self.index[word]:
                first[k] = min(place, first.get(k, place))
        found = {}
        for k, place in first.items():
            _, order, need = self.templates[k]
            if len(line) >= need and len(order) - place >= need:
                shared = sum(w in line for w in order[place:])
                if shared >= need:
                    found[k] = shared / len(order)
        return found


    def windows(self, own: list[bytes], present: set[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template number, first word, last word, containment) of notices that stand anywhere in a text's words.

        A window is as long as the template's words and the share of others that the threshold leaves room for. It is judged at every
        place where a word of the template stands; of windows that overlap, the first of the largest containment is given.
        """
        for k in self.matches(present):
            _, order, need = self.templates[k]
            wanted, counts, left = frozenset(order), Counter(), 0
            at = [i for i, w in enumerate(own) if w in wanted]
            best: tuple[int, int, int] | None = None
            for right, i in enumerate(at):
                counts[own[i]] += 1
                while i - at[left] >= self.spans[k] or counts[own[at[left]]] > 1:
                    counts[own[at[left]]] -= 1
                    if not counts[own[at[left]]]:
                        del counts[own[at[left]]]
                    left += 1
                if len(counts) < need:
                    continue
                if best is not None and at[left] > best[1]:
                    yield k, best[0], best[1], best[2] / len(order)
                    best = None
                if best is None or len(counts) > best[2]:
                    best = at[left], i, len(counts)
            if best is not None:
                yield k, best[0], best[1], best[2] / len(order)


def word_frequencies(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each wanted word stands; partitions send one row a word at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(wanted.intersection(words(text)))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


_ROW = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<block:int,label:string,score:double>>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for every row of (doc_id, text).

    n_base counts all places of the base phrases; first_word and last_word are the smallest and largest of their starts. blocks lists every
    line that holds at least ``containment`` of the distinct words of a template, and every notice wrapped over lines of which none does, by
    its first line; labels adds their labels. score is 1 with a base
    phrase, else the best containment found, else 0. Documents stay where they are: only the words' frequencies are shuffled.

    Defined cases: null text counts as empty; a text without words has zeros, nulls and empty strings; repeated rows get equal results;
    a null doc_id is kept; lines of any length and number are read whole; other columns are ignored.
    """
    wanted = frozenset(w for _, text in templates for w in words(text))
    index = TemplateIndex(templates, word_frequencies(docs, wanted), containment)
    phrases = [(words(phrase), label) for phrase, label in PHRASES]

    def scan_one(text: str | None) -> tuple:
        own = words(text)
        present = set(own)
        found = {label: places(own, phrase) for phrase, label in phrases if present.issuperset(phrase)}
        base = sorted(label for label, at in found.items() if at)
        starts = [i for at in found.values() for i in at]
        blocks = []
        if not index.prefixes.isdisjoint(present):
            ends, whole = [], set()
            for b, line in enumerate((text or "").split("\n")):
                line_words = words(line)
                ends.append(len(line_words) + (ends[-1] if ends else 0))
                for k, score in index.matches(set(line_words)).items():
                    blocks.append({"block": b, "label": index.templates[k][0], "score": score})
                    whole.add((k, b))
            for k, first, last, score in index.windows(own, present):
                b, end = bisect_right(ends, first), bisect_right(ends, last)
                if b < end and not any((k, i) in whole for i in range(b, end + 1)):
                    blocks.append({"block": b, "label": index.templates[k][0], "score": score})
        labels = sorted({*base, *(b["label"] for b in blocks)})
        score = 1.0 if starts else max((b["score"] for b in blocks), default=0.0)
        return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, blocks

    names = [x.split()[0] for x in _ROW.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([scan_one(text) for text in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, "doc_id long, " + _ROW)
