"""German date phrases.  ``today`` is a parameter: results don't depend on the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, normalize_text

# Fixed values.
MONTHS = {"januar": 1, "jaenner": 1, "februar": 2, "maerz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12}


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    """Null for dates that don't exist."""
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def german_date(text: Column, today: Column) -> Column:
    """The day that a phrase names: relative phrases, calendar weeks (their Monday), written months, dotted dates, ISO dates."""
    raw = F.trim(text)
    return bound(F.struct(raw.alias("raw"), normalize_text(raw).alias("norm")), lambda x: _day(x["raw"], x["norm"], today))


def _day(raw: Column, n: Column, today: Column) -> Column:
    ago = r"vor\s+(\d{1,6})\s+(tag|woche|monat)(?:en|e|n)?\b"
    k, unit = _int(n, ago, 1), F.regexp_extract(n, ago, 2)
    relative = F.when(n == "heute", today).when(n == "gestern", F.date_sub(today, 1)).when(unit == "tag", F.date_sub(today, k)).when(unit == "woche", F.date_sub(today, k * 7)).when(unit == "monat", F.add_months(today, -k))
    kw = r"(?i)\bkw\s*(\d{1,2})\s*/\s*(\d{4})\b"
    week, year = _int(raw, kw, 1), _int(raw, kw, 2)
    monday = F.date_add(F.to_date(F.date_trunc("week", F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(4)))), (week - 1) * 7)
    # A 53rd week exists only where its Thursday is still in the year.
    by_week = F.when((week >= 1) & (F.year(F.date_add(monday, 3)) == year), monday)
    named = r"\b(\d{1,2})\.\s*([A-Za-zÀ-ÿ]+)\s+(\d{4})\b"
    month = F.element_at(F.create_map(*[F.lit(x) for p in MONTHS.items() for x in p]), normalize_text(F.regexp_extract(raw, named, 2)))
    dotted = r"\b(\d{1,2})\.(\d{1,2})\.(\d{2,4})\b"
    written = F.regexp_extract(raw, dotted, 3)
    y = written.try_cast("int") + F.when(F.length(written) == 2, F.when(written.try_cast("int") < 70, 2000).otherwise(1900)).otherwise(0)
    iso = F.to_date(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1).try_cast("date"))
    return (
        F.when(n.isin("heute", "gestern") | (unit != ""), relative)
        .when(week.isNotNull(), by_week)
        .when(month.isNotNull(), _date(_int(raw, named, 3), month, _int(raw, named, 1)))
        .when(written != "", _date(y, _int(raw, dotted, 2), _int(raw, dotted, 1)))
        .otherwise(iso)
    )


def days_since(ts: Column, now: Column) -> Column:
    """Fractional days, never below 0; null if unknown."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))
