"""What a German reader sees: numbers, money, distances, dates, weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "k. A."
MONTH_NAMES = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


def number(c: Column, digits: int = 0) -> Column:
    return F.coalesce(F.translate(F.format_number(F.bround(c, digits), digits), ",.", ".,"), F.lit(MISSING))


def euro(c: Column) -> Column:
    return F.when(c.isNull(), MISSING).otherwise(F.concat(number(c), F.lit(" €")))


def euro_short(c: Column) -> Column:
    return F.when(c.isNull(), MISSING).when(F.abs(c) >= 1e6, F.concat(number(c / 1e6, 2), F.lit(" Mio."))).when(F.abs(c) >= 1e3, F.concat(number(c / 1e3), F.lit(" Tsd."))).otherwise(number(c))


def square_metres(c: Column) -> Column:
    return F.when(c.isNull(), MISSING).otherwise(F.concat(number(c), F.lit(" m²")))


def kilometres(c: Column, unknown: str = MISSING) -> Column:
    return F.when(c.isNull(), unknown).otherwise(F.concat(number(c, 1), F.lit(" km")))


def driving(c: Column) -> Column:
    return kilometres(c, "nicht geprüft")


def percent(c: Column) -> Column:
    """Of a number in percent, with its sign."""
    return F.when(c.isNull(), MISSING).otherwise(F.concat(F.when(c > 0, "+").otherwise(""), number(c, 1), F.lit(" %")))


def date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy"), F.lit(MISSING))


def month_year(c: Column) -> Column:
    return F.coalesce(F.concat(F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(c)), F.lit(" "), F.year(c).cast("string")), F.lit(MISSING))


def date_time(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy HH:mm"), F.lit(MISSING))


def month(c: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(c)), F.lit(MISSING))


def minutes(c: Column) -> Column:
    return F.when(c.isNull(), "nicht geprüft").otherwise(F.concat(number(c), F.lit(" min")))


def points(c: Column) -> Column:
    """A score without decimals."""
    return number(F.bround(c, 0))


# Words for states and tiers.
STATUS_WORDS = {
    "discovered": "Entdeckt", "verified": "Verifiziert", "active": "Aktiv", "price_changed": "Preis geändert", "stale": "Veraltet", "foreclosure": "Zwangsversteigerung", "off_market_signal": "Off-Market-Signal",
    "removed": "Entfernt", "expired": "Anzeige abgelaufen", "sold": "Verkauft",
}
TIER_WORDS = {"light": "leicht", "medium": "mittel", "heavy": "schwer", "complete": "Kernsanierung", "unknown": "unbekannt"}


def _word(c: Column, words: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c), c, F.lit("unbekannt"))


def status(c: Column) -> Column:
    return _word(c, STATUS_WORDS)


def tier(c: Column) -> Column:
    return _word(c, TIER_WORDS)


def week_label(c: Column) -> Column:
    return F.concat(F.lit("KW "), F.lpad(F.weekofyear(c).cast("string"), 2, "0"), F.lit(" / "), F.extract(F.lit("YEAROFWEEK"), c).cast("string"))


def relative_days(days: Column) -> Column:
    n = F.floor(days)
    months, years = F.floor(n / 30), F.floor(n / 365)
    return (
        F.when(n.isNull(), MISSING).when(n <= 0, "heute").when(n == 1, "gestern").when(n < 31, F.concat(F.lit("vor "), n.cast("string"), F.lit(" Tagen")))
        .when(months == 1, "vor einem Monat").when(months < 12, F.concat(F.lit("vor "), months.cast("string"), F.lit(" Monaten")))
        .when(years <= 1, "vor einem Jahr").otherwise(F.concat(F.lit("vor "), years.cast("string"), F.lit(" Jahren")))
    )


def one_line(c: Column, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)
