r"""Personal data by candidate generation and gradient boosting.

1. Base spans: fixed patterns per kind (e-mail address, IPv4 address, card number, phone number), leftmost and
   non-overlapping, with their own validity tests.  They always stay.
2. High-recall generators propose further, overlapping spans: spelled-out addresses (also with a bare "at" or "dot"), phone numbers
   without a plus sign (every run of digit groups of a plausible length, also inside longer rows of numbers), card numbers
   with other separators, IPv6 addresses, whole or with ``::``.
3. Boosted trees judge each proposal by its format and by the words around it; the scores are calibrated, and the threshold
   is the lowest with the precision asked for.  Trees, calibration and thresholds have examples of their own, parted by text.  Of proposals that overlap a base span none is
   kept; of those that overlap each other the likeliest.

The trees are trained on examples made here from a seeded grammar (no labelled spans exist), once, on
the driver; the model is a few kilobytes and goes out with the function.

Offsets are code points, ends exclusive.  All scans are linear in the text, also on long runs of
digits or letters; hits in great number are kept in sorted lists.  Odd inputs: a null text counts as empty; the pipeline form leaves it null.
An empty table gives an empty table.  Repeated rows and ids are all returned.  Other columns are ignored (in the pipeline form kept, whatever their
names).  Of proposals with equal scores the first counts.  Memory: one text and its proposals, ``BATCH`` of them with their features at a time.
Only a proposed domain of more than ``MOST_DOMAIN`` characters (no such name exists) ends early.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import BoostedTrees
from .shared import numbered

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
#: Proposals that are judged together.
BATCH = 20_000
Span = tuple[int, int, int]  # start, end, index of the kind

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't start inside a run of digits whose start failed, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                end = m.end()
                out.append((start, end, 0))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


# Proposals.  Each pattern starts at a mark or a digit and has bounded parts, so it is linear too.
#: The words are those of the four languages.
_AT_WORD = re.compile(r"[\[({<]\s?(?:at|AT|At|arroba|arobase|ät)\s?[\])}>]|\s@\s|(?<=[A-Za-z0-9])\s(?:at|AT|arroba|arobase|klammeraffe)\s(?=[A-Za-z0-9])")
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|punto|point)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto|point)\s|\s?\.\s?")
#: Characters of a whole domain name, at most.
MOST_DOMAIN = 253
_AT_SIGN = re.compile(r"\s@\s|[\[({<]")
_DOT_WORD = re.compile(r"[\s\[({<](?:dot|DOT|Dot|punkt|punto|point)[\s\])}>]")
_COMMON_END = re.compile(r"[\s.\])}>](?:com|org|net|edu|info|de|at|ch|fr|es|uk|eu|io|mx|be)$", re.I)
_REGION = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20()./-]{0,2}\+?\(?[0-9]){6,}(?![0-9A-Za-z])")
_GROUP = re.compile(r"\+?\(?[0-9]+")
MOST_DIGITS = 19
_SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_SIX_SHORT = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])")


def proposals(text: str) -> list[Span]:
    out: list[Span] = []
    for m in _AT_WORD.finditer(text):
        start = m.start()
        stop = start - 1 if start and text[start - 1] == " " and m[0][0] != " " else start
        start = stop
        while start and text[start - 1] in _LOCAL_CHARS:  # up to the blank or bracket behind the mark before, so no character is read twice
            start -= 1
        at = first = m.end() + (text[m.end() : m.end() + 1] == " ")
        label = _LABEL.match(text, at) if start < stop else None
        while label and label.end() - first <= MOST_DOMAIN:  # the domain may end after each label but the first
            if at > first:
                out.append((start, label.end(), 0))
            dot = _DOT.match(text, label.end())
            at = dot.end() if dot else at
            label = _LABEL.match(text, at) if dot else None
    for m in _REGION.finditer(text):
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        sizes = [len(_NOT_DIGIT.sub("", text[x:y])) for x, y in groups]
        whole = sum(sizes) <= MOST_DIGITS
        # All runs of whole groups with so many digits: at most MOST_DIGITS from each start.
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                n += sizes[j]
                if n > MOST_DIGITS:
                    break
                full = whole and i == 0 and j == len(groups) - 1
                if 12 <= n and (full or luhn(_NOT_DIGIT.sub("", text[start : groups[j][1]]))):
                    out.append((start, groups[j][1], 2))
                if 7 <= n <= 15 and (full or n >= 9):
                    out.append((start, groups[j][1], 3))
    if ":" in text:
        out += [(m.start(), m.end(), 1) for m in _SIX.finditer(text)]
        out += [(m.start(), m.end(), 1) for m in _SIX_SHORT.finditer(text) if m.end() - m.start() > 2]
    return out


_CUES = (
    re.compile(r"e-?mail|mailto|contact|kontakt|write|correo|courriel", re.I),
    re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    re.compile(r"card|visa|credit|karte|carte|tarjeta|payment|\bcc\b", re.I),
    re.compile(r"phone|\btel|call|mobile|fax|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|whatsapp|appel|llam|\bruf", re.I),
)
_OTHER = re.compile(r"isbn|issn|order|invoice|version|\bno\.|page|serial|ref|total|\$|€|£|date|doi|id\b", re.I)
CONTEXT = 32


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    s, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _NOT_DIGIT.sub("", s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    left, right = before[-1:], text[end : end + 1]
    near = text[end : end + 3]
    return [
        float(kind), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        s.count(" "), s.count("-"), s.count("."), s.count("/"), float("(" in s), float(s[:1] == "+"), float(luhn(digits) if 12 <= len(digits) <= 19 else 0),
        float(s[:1] == "0"), *[float(bool(c.search(before))) for c in _CUES], float(bool(_OTHER.search(before))),
        float(left.isspace() or not left), float(right.isspace() or not right or right in ",.;)"), len(set(digits)),
        float(bool(re.fullmatch(r"(19|20)\d\d[-./]?\d\d?[-./]?\d\d?", s))), float(len(groups) in (3, 4) and groups[-1] == 4 and groups[-3] == 3),
        float(kind == 0 and bool(_AT_SIGN.search(s))), float(kind == 0 and bool(_DOT_WORD.search(s))), float(kind == 0 and bool(_COMMON_END.search(s))),
        float(kind == 0 and bool(re.match(r"[A-Za-z0-9]+[._%+-]+[A-Za-z0-9]|[A-Za-z]+[0-9]", s))), float(". " in s), float(kind == 1 and "::" in s), float(kind == 1 and s.count(":")),
        float(bool(re.match(r"[\x20.)/-]{1,2}[+(]?[0-9]", near))), float(bool(re.search(r"[0-9][\x20.(/-]{1,2}$", before))), float(len(groups) > 1 and groups[-1] > 6),
    ]


def examples(n: int = 8000, seed: int = 17) -> list[tuple[str, Span, int]]:
    """Texts with a proposal each and whether it is personal data, from a seeded grammar."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        pairs = rng.choice([" ", "-", " "]).join([f"0{rng.randint(1, 9)}", *(d(2) for _ in range(4))])
        north = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]
        centre = [f"0{d(3)}/{d(6)}", f"0{d(4)} / {d(3)} {d(3)}", f"0{d(2)} {d(3)} {d(4)}", f"01{d(2)} {d(7)}", f"(0{d(2)}) {d(4)}-{d(4)}", f"0{d(2)} / {d(7)}", f"0{d(4)} {d(5)}"]
        west = [pairs, pairs, f"020 {d(4)} {d(4)}", f"07{d(3)} {d(3)} {d(3)}", f"00{rng.randint(30, 99)} {d(4)} {d(6)}"]
        south = [f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"({d(2)}) {d(4)}-{d(4)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}"]
        return rng.choice(rng.choice([north, centre, west, south]))

    cues = (["email:", "mail me at", "contact", "Kontakt:", "schreiben Sie an", "correo", "courriel"], ["ip", "server", "host"], ["card", "Visa", "credit card no", "Karte", "payment by"], ["call", "tel.", "phone:", "Telefon", "mobile", "fax", "Handy", "appelez", "llame al"])
    others = ["ISBN", "order", "invoice", "version", "total", "ref", "pages", "serial", "no.", "id", "on", "in", "about", "sold", "from", "Umsatz", "Nr.", "vom", "en", "folio", "years", "between", "Bestellung"]
    out = []
    while len(out) < n:
        kind = rng.choice((0, 1, 2, 3, 3))
        if rng.random() < 0.5:
            local = rng.choice([f"{w()}.{w()}", w(), f"{w()}{d(2)}", f"{w()}_{w()}", f"{w()[0]}.{w()}"])
            end = rng.choice(["com", "org", "net", "de", "fr", "es", "edu", "info"])
            bare = f"{local} {rng.choice(['at', 'AT', 'arroba', 'arobase'])} {w()} {rng.choice(['dot', 'DOT', 'punto', 'point', 'punkt'])} {end}"
            groups = [rng.choice(["2001", "db8", "0", "fe80", "1a2b", "ff00", "42", d(4)]) for _ in range(8)]
            cut = rng.randint(1, 4)
            made = (
                rng.choice([f"{local}{rng.choice([' [at] ', '(at)', ' (at) ', '[AT]', ' @ '])}{w()}{rng.choice(['.', ' [dot] ', '(dot)', ' dot '])}{end}", bare]),
                rng.choice([":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[: rng.randint(1, 3)])]),
                rng.choice([".", "/", "  "]).join(re.findall("....", card())),
                phone(),
            )[kind]
            cue, right = (rng.choice(cues[kind]) if rng.random() < 0.8 else w()), 1
        else:
            made = (
                rng.choice([f"{w()} {rng.choice(['@', '[at]', '<at>'])} {w()}{rng.choice(['. ', ' . '])}{w()}", f"{w()} at {w()}. {w()}", f"{w()} at {w()}.{rng.choice(['com', 'org', 'de'])}", f"{w()} at {d(2)}.{d(2)}", f"{w()} at {w()} point {w()}", f"{w()} @ {d(1)}.{d(2)}"]),
                rng.choice([":".join(d(2) for _ in range(8)), f"{rng.choice('abcdef')}::{rng.choice('abcdef')}", f"{d(2)}::{d(2)}", f"::{rng.choice(['add', 'bad', 'feed'])}", f"{rng.choice(['ace', 'deed'])}::"]),
                rng.choice([d(13), d(16), " ".join(d(4) for _ in range(4)), ".".join(d(4) for _ in range(4)), "978-" + d(1) + "-" + d(4) + "-" + d(4) + "-" + d(1)]),
                rng.choice([d(8), d(10), f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(4)} {d(4)}", f"{d(1)} {d(3)} {d(3)}", d(7), " ".join([f"{rng.randint(1, 9)}{d(1)}", *(d(2) for _ in range(rng.randint(3, 5)))]), f"{rng.randint(1, 9)}{d(rng.randint(0, 2))} {d(3)} {d(3)}", " ".join(str(rng.randint(1850, 2030)) for _ in range(rng.randint(2, 4)))]),
            )[kind]
            cue, right = (rng.choice(others) if rng.random() < 0.7 else w()), 0
        if kind >= 2 and rng.random() < 0.25:  # numbers of several kinds side by side: the exact parts are right, all else is wrong
            parts = [(rng.choice([f"+{rng.randint(1, 99)} {phone()}", phone()]), 3), (rng.choice([card(), " ".join(re.findall("....", card()))]), 2), (".".join(str(rng.randint(0, 255)) for _ in range(4)), 1)]
            rng.shuffle(parts)
            text = f"{w()} {w()} {' '.join(p for p, _ in parts[: rng.choice((2, 2, 3))])} {w()}"
            parts = [p for p in parts if p[0] in text]
            exact = {(text.index(p), text.index(p) + len(p), k) for p, k in parts}
            out += [(text, p, int(p in exact)) for p in proposals(text)]
            continue
        lead = f"{w()} {w()} {cue} "
        text = f"{lead}{made}{rng.choice([' ', ', ', '. '])}{w()} {w()}"
        if right or kind != 2 or not luhn(_NOT_DIGIT.sub("", made)):
            exact = {(len(lead), len(lead) + len(made), kind)} if right else set()
            out += [(text, p, int(p in exact)) for p in proposals(text)]
    return out


class Judge:
    """The trees with a threshold for each kind."""

    def __init__(self, model: BoostedTrees, thresholds: list[float]):
        self.model, self.thresholds = model, thresholds

    def accepted(self, text: str, base: list[Span]) -> list[Span]:
        """Of the proposals beside the base spans those above their threshold; of overlapping ones the likeliest.  In sorted lists, so hits in great number cost little."""
        taken = _joined(base)
        found = [p for p in proposals(text) if not taken.meets(p)]
        if not found:
            return []
        score = np.concatenate([self.model.probability(np.array([features(text, p) for p in found[k : k + BATCH]])) for k in range(0, len(found), BATCH)])
        least = np.array(self.thresholds)[[p[2] for p in found]]
        out, own = [], _Intervals([], [])
        for k in sorted(np.flatnonzero(score >= least).tolist(), key=lambda k: (-score[k], found[k])):
            if not own.meets(found[k]):
                own.add(found[k])
                out.append(found[k])
        return out


class _Intervals(NamedTuple):
    """Stretches that don't overlap, in order."""

    starts: list[int]
    ends: list[int]

    def meets(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[1]) - 1  # the last that starts before the span's end
        return k >= 0 and self.ends[k] > span[0]

    def add(self, span: Span) -> None:
        k = bisect_left(self.starts, span[0])
        self.starts.insert(k, span[0])
        self.ends.insert(k, span[1])


def _joined(spans: list[Span]) -> _Intervals:
    """Spans in order of their starts, overlapping ones as one stretch."""
    out = _Intervals([], [])
    for s, e, _ in spans:
        if out.ends and s < out.ends[-1]:
            out.ends[-1] = max(out.ends[-1], e)
        else:
            out.starts.append(s)
            out.ends.append(e)
    return out


@lru_cache(maxsize=1)
def trained_judge(precision: float = PRECISION) -> Judge:
    data = examples()
    x = np.array([features(t, s) for t, s, _ in data])
    y = np.array([r for *_, r in data], float)
    # Proposals of one text follow each other; all of a text are in one part: two to learn from, one to calibrate, one for the thresholds.
    part = np.cumsum([k == 0 or data[k][0] != data[k - 1][0] for k in range(len(data))]) % 4
    model = BoostedTrees().fit(x[part < 2], y[part < 2], x[part == 2], y[part == 2])
    held = part == 3
    p, y, kind = model.probability(x[held]), y[held], x[held, 0]
    thresholds = []
    for k in range(len(KINDS)):
        own = kind == k
        order = np.sort(np.unique(np.concatenate([p[own], [0.5, 0.9]])))
        good = [t for t in order if t >= 0.5 and (y[own & (p >= t)].mean() if (own & (p >= t)).any() else 1.0) >= precision]
        thresholds.append(float(good[0]) if good else 1.1)
    return Judge(model, thresholds)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", judge: Judge | None = None) -> DataFrame:
    """Columns: the id, n_email, n_ip, n_card, n_phone and base_sha256 (of the base spans), spans (all, as kind:start:end)."""
    judge = judge or trained_judge()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for k, c in enumerate(counts):
                    c.append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + judge.accepted(text, base), key=lambda s: (s[0], s[2]))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    out = rows.mapInArrow(per_batch, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes one mark, of its first span's kind."""
    out, at = [], 0
    runs: list[list[int]] = []
    for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e, k])
    for s, e, k in runs:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", judge: Judge | None = None) -> DataFrame:
    """``docs`` with the spans replaced in the text; ``length_col``, if there, is the new length.  Columns as they were."""
    judge = judge or trained_judge()
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    rows = numbered(docs)

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(at):
                text = t.as_py()
                if text:
                    base = base_spans(text)
                    if spans := base + judge.accepted(text, base):
                        text = redacted(text, spans)
                texts.append(text)
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, b.column(at).type)
            if length_at is not None:
                kind = arrays[length_at].type
                arrays[length_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return rows.mapInArrow(per_batch, rows.schema).toDF(*docs.columns)
