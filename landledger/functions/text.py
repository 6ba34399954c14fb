"""Folding, slugs, hashes and term matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def lit(value) -> Column:
    return F.lit(value)


def _german(c: Column) -> Column:
    """Case folded with umlauts and sharp s written out."""
    c = F.lower(c)
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Case folded, umlauts written out, punctuation to spaces, spaces squashed.  Null stays null."""
    return squash(F.regexp_replace(_german(c), r"(?U)[^\w\s]", " "))


def slugify(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit("_"))


def text_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def fold(c: Column) -> Column:
    """For term matching in prose: hyphens, slashes and line breaks become spaces, underscores stay.  Null gives ''."""
    return F.coalesce(squash(F.translate(_german(c), "-/\n", "   ")), F.lit(""))


def fold_ascii(c: Column) -> Column:
    """For identity: accents off, everything but digits and a-z to spaces."""
    plain = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "äöüáàâéèêíìîóòôúùûçñ", "aouaaaeeeiiiooouuucn")
    return F.coalesce(F.trim(F.regexp_replace(plain, "[^0-9a-z]+", " ")), F.lit(""))


def place_slug(c: Column) -> Column:
    return F.replace(fold_ascii(c), F.lit(" "), F.lit("-"))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether a folded text holds one of the folded terms, as a plain substring.  False for null.

    Each term is looked for by itself, which takes far less than one pattern of them all: give a column, not an expression that each would work out.
    """
    found = [F.contains(text, F.lit(t)) for t in terms]
    return F.coalesce(reduce(or_, found), F.lit(False))


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """The first of ``terms`` that the text holds, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms])


def whole_words(text: Column, terms: Sequence[str]) -> Column:
    """Sorted terms that stand as whole words in a normalised text, whose words are set apart by single spaces."""
    # Bound to a name, so that the text is normalised once and not for each term.
    padded = F.transform(F.array(F.concat(F.lit(" "), text, F.lit(" "))), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(f" {x} ")), F.lit(x)) for x in sorted(terms)])))
    return F.get(padded, F.lit(0))


def matches_search(needle: str, *fields: Column) -> Column:
    """Case-insensitive substring over the fields joined by spaces; an empty needle fits all."""
    if not needle.strip():
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.strip().lower()))
