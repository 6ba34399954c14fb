r"""Licence notices in texts, exact and with a bounded number of errors.

Texts are lower-cased (A-Z) and cut into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, joined by single spaces; all matching is on that form, so
punctuation and line breaks inside a notice don't matter.

1. Exact phrases are looked up as whole words.
2. A notice of m characters may have k = m // ``CHARACTERS_PER_ERROR`` errors.  It is cut into k + 1 pieces: whatever the k errors are, one
   piece stands unchanged (pigeonhole).  One Aho-Corasick automaton finds the pieces of all notices; a piece at its place gives a window
   in which the whole notice must lie, k characters of room on either side.
3. In the windows (overlapping ones joined) the regex library searches the notice with at most k insertions, deletions and
   substitutions, from one word's start to a word's end, and an exact tail (a version) where the notice has one.  So every text that holds a
   notice within its errors gets its label; places that overlap are reported once.

Odd inputs: a null text counts as empty: no words, no places, labels '' and score 0.  Empty tables give empty tables; repeated rows and ids
are all returned; other columns are ignored.  Very long texts are scanned whole, in time linear in the text and its windows.  Ties of
equal places: all are reported.  Memory: one text at a time, in a few copies.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import slices
from .words import text_bytes, translated

CHARACTERS_PER_ERROR = 12

# The phrases that are looked up exactly, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices that are looked up with errors (label, words, and what must follow unchanged).
NOTICES = (
    ("mit", "under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person", ""),
    ("apache-2", "apache license version", "2"),
    ("gpl-2", "gnu general public license version", "2"),
    ("gpl-3", "gnu general public license version", "3"),
    ("lgpl", "gnu lesser general public license", ""),
    ("agpl", "gnu affero general public license", ""),
    ("bsd", "redistribution and use in source and binary forms", ""),
    ("mpl-2", "mozilla public license version", "2"),
    ("epl", "eclipse public license", ""),
    ("cc-by-nc", "cc by nc", ""),
    ("cc-by-nc", "creative commons attribution noncommercial", ""),
    ("cc-by-sa", "cc by sa", ""),
    ("cc-by-sa", "creative commons attribution sharealike", ""),
    ("all-rights-reserved", "all rights reserved", ""),
)


class Notice(NamedTuple):
    label: str
    words: str
    tail: str
    errors: int
    pattern: regex.Pattern


class Place(NamedTuple):
    """Words ``start`` up to ``end`` hold a notice with so many errors."""

    label: str
    start: int
    end: int
    errors: int
    score: float


def pieces(words: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, each with its place."""
    cuts = [len(words) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str, str], ...] = NOTICES):
        self.notices = []
        parts: defaultdict[str, list[tuple[int, int]]] = defaultdict(list)  # of a notice (its number, the piece's place) or a phrase (-1 - its number, 0)
        for k, (label, words, tail) in enumerate(notices):
            errors = len(words) // CHARACTERS_PER_ERROR
            ending = f" {regex.escape(tail)}" if tail else ""
            self.notices.append(Notice(label, words, tail, errors, regex.compile(f"(?e)(?<= )(?:{regex.escape(words)}){{e<={errors}}}{ending}(?= )")))
            for at, piece in pieces(words, errors):
                parts[piece].append((k, at))
        self.phrases = phrases
        for k, (words, _) in enumerate(phrases):
            parts[f" {words} "].append((-1 - k, 0))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in parts.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, str]], list[Place]]:
        """Of a translated text: the number of words, (word, label) of each exact phrase, and the places of notices."""
        words = raw.split()
        text = " " + b" ".join(words).decode() + " "
        exact: list[tuple[int, str]] = []
        windows: defaultdict[int, list[list[int]]] = defaultdict(list)
        for last, (size, uses) in self.automaton.iter(text):
            start = last - size + 1
            for k, at in uses:
                if k < 0:
                    exact.append((start, self.phrases[-1 - k][1]))
                    continue
                n = self.notices[k]
                # One character more on either side, for the spaces around the notice.
                low, high = max(start - at - n.errors - 1, 0), start - at + len(n.words) + n.errors + (len(n.tail) + 1 if n.tail else 0) + 1
                own = windows[k]
                if own and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], low), max(own[-1][1], high)
                else:
                    own.append([low, high])
        found: list[tuple[int, int, int, Notice]] = []
        for k, own in windows.items():
            n = self.notices[k]
            for low, high in own:
                for m in n.pattern.finditer(text[low:high]):
                    found.append((low + m.start(), low + m.end(), sum(m.fuzzy_counts), n))
        number = _WordNumbers(text)
        exact.sort()
        out_exact = [(number.of(at + 1), label) for at, label in exact]
        number = _WordNumbers(text)
        places = []
        for start, end, errors, n in sorted(found, key=lambda f: (f[0], f[1], f[3].label)):
            first = number.of(start)
            places.append(Place(n.label, first, first + text.count(" ", start, end) + 1, errors, 1 - errors / (n.errors + 1)))
        return len(words), out_exact, places


class _WordNumbers:
    """The number of the word that starts at a place, for places in rising order: spaces are counted once."""

    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, 0

    def of(self, place: int) -> int:
        self.n += self.text.count(" ", self.at, place)
        self.at = place
        return self.n - 1


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


PHRASE_TYPE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
PLACE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())]))


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, n_words, phrases (word, label; by word), places (label, start, end, errors, score; words from 0, ``end`` exclusive)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for b in batches:
            got = [scan(bytes(raw)) for some in slices(b.column(1)) for raw in text_bytes(translated(some))]
            phrases = pa.array([[{"word": w, "label": k} for w, k in g[1]] for g in got], PHRASE_TYPE)
            places = pa.array([[p._asdict() for p in g[2]] for g in got], PLACE_TYPE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), phrases, places], names=["id", "n_words", "phrases", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    phrases, places = "array<struct<word: bigint, label: string>>", "array<struct<label: string, start: bigint, end: bigint, errors: bigint, score: double>>"
    return rows.mapInArrow(per_batch, f"id {kind}, n_words bigint, phrases {phrases}, places {places}").withColumnRenamed("id", id_col)


def license_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``find_notices``: the id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best place's; 1 with an exact phrase)."""
    base = F.col("phrases.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        id_col, "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.word").alias("first_word"), F.array_max("phrases.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("places.label"))).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("places.score"), F.lit(0.0))).alias("score"), "places",
    )
