"""Numbers, prices and areas as German listings write them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, normalize_text

# What a number looks like, and the words that scale it.
NUMBER = "\\d{1,3}(?:[    ]\\d{3})+(?:,\\d+)?(?![\\d.])|\\d[\\d.,]*\\d|\\d"
SCALE = r"\s*(k|tsd\.?|tausend|mio\.?|million(?:en)?)\b"
GROUPING = "    "
AREA_UNITS = (("m\\s*²|m2\\b|quadratmeter", 1.0), ("hektar\\b|\\bha\\b", 10_000.0), ("tagwerk\\b", 3_407.0), ("\\bqm\\b", 1.0))
RENT = r"\b(?:kalt|warm|nettokalt|monats|grund)miete\b|\bmietpreis\b|\bzur miete\b|\bzu vermieten\b|\bmtl\b|\bmonatlich\b|\bmonat\b"


def token_value(token: Column) -> Column:
    """The value of one number: a comma is the decimal sign, dots group thousands if all groups have three digits."""
    def value(t: Column) -> Column:
        whole = F.replace(F.regexp_extract(t, r"^(.*),", 1), F.lit("."), F.lit(""))
        whole = F.when(whole == "", F.lit("0")).otherwise(F.replace(whole, F.lit(","), F.lit("")))
        with_comma = F.concat(whole, F.lit("."), F.regexp_extract(t, r",([^,]*)$", 1)).try_cast("double")
        grouped = F.replace(t, F.lit("."), F.lit("")).try_cast("double")
        return F.when(F.contains(t, F.lit(",")), with_comma).when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), grouped).otherwise(t.try_cast("double"))

    return bound(F.translate(token, GROUPING, ""), value)


def _scale(after: Column) -> Column:
    said = F.regexp_replace(F.lower(F.regexp_extract(after, rf"(?i)^{SCALE}", 1)), r"\.", "")
    return bound(said, lambda word: F.when(word.isin("k", "tsd", "tausend"), F.lit(1_000.0)).when(word.isin("mio", "million", "millionen"), F.lit(1_000_000.0)).otherwise(F.lit(1.0)))


def _first(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the first number and what follows it, both looked for once."""
    token, after = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")), F.regexp_extract(text, rf"(?s)^.*?(?:{NUMBER})(.*)$", 1)
    return bound(F.struct(token.alias("token"), after.alias("after")), lambda x: body(x["token"], x["after"]))


def german_number(text: Column) -> Column:
    return _first(text, lambda token, after: token_value(token) * _scale(after))


def price_type(text: Column, value: Column | None = None) -> Column:
    """``value`` is ``price_value`` of the text, where it is known."""
    known = price_value(text) if value is None else value

    def kind(n: Column) -> Column:
        return (
            F.when(n.rlike(RENT), "rent")
            .when(n.rlike("verkehrswert|mindestgebot"), "auction_min")
            .when(F.contains(n, F.lit("auf anfrage")), "on_request")
            .when(n.rlike(r"\bvb\b|\bvhb\b|verhandlungsbasis"), "negotiable")
            .when(known.isNull(), "unknown")
            .otherwise("asking")
        )

    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").otherwise(bound(normalize_text(F.trim(text)), kind))


def price_value(text: Column) -> Column:
    """Null unless a currency, a scale word or four digits speak for a price; percentages are passed over."""
    fused = F.regexp_extract(text, r"(?i)(\d[\d.,]*\d|\d)\s*t\s*€", 1)
    plain = F.regexp_replace(text, rf"(?i)(?:{NUMBER})\s*(?:%|prozent\b)", " ")
    trusted = lambda token, scale: text.rlike(r"(?i)€|eur\b|euro\b") | (scale != 1.0) | (F.length(F.regexp_replace(token, r"\D", "")) >= 4)
    scaled = lambda token, after: bound(_scale(after), lambda scale: F.when(trusted(token, scale), token_value(token) * scale))
    return bound(fused, lambda number: F.when(number != "", token_value(number) * 1_000).otherwise(_first(plain, scaled)))


def parse_price(text: Column) -> Column:
    return bound(price_value(text), lambda value: F.struct(value.alias("value"), price_type(text, value).alias("kind")))


def parse_area(text: Column) -> Column:
    """Square metres; a unit right after the number goes before one elsewhere, none means square metres."""
    def unit(where: Column) -> Column:
        return F.coalesce(*[F.when(where.rlike(f"(?i){p}"), F.lit(f)) for p, f in AREA_UNITS])

    def area(token: Column, after: Column) -> Column:
        factor = F.coalesce(unit(F.substring(after, 1, 40)), unit(text), F.lit(1.0))
        grouped = F.replace(token, F.lit(","), F.lit("")).try_cast("double")
        return bound(factor, lambda f: F.when((f == 1.0) & token.rlike(r"^\d{1,3}(?:,\d{3})+$"), grouped).otherwise(token_value(token) * f))

    return _first(text, area)


def prices_equivalent(a: Column, b: Column, percent: float) -> Column:
    close = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * (percent / 100.0)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def to_number(text: Column, default: float | None) -> Column:
    """A query parameter: German decimal comma (with one, points group thousands), anything else that isn't a finite number gives the default."""
    t = F.regexp_replace(F.trim(text), r"[\s\u00a0]", "")
    comma = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) == 1
    t = F.replace(F.when(comma, F.replace(t, F.lit("."), F.lit(""))).otherwise(t), F.lit(","), F.lit("."))
    v = t.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default).cast("double")).otherwise(v)


def to_int(text: Column, default: int | None) -> Column:
    """Towards zero."""
    return F.coalesce(to_number(text, None).cast("bigint"), F.lit(default).cast("bigint"))


def to_bool(text: Column, default: bool = False) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(F.lower(F.trim(text)).isin("1", "true", "on", "yes", "ja", "an"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
