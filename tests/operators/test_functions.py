"""Golden facts of the expressions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from landledger.functions import dates, geo, german_format, listings, numbers, text, towns, urls


def each(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, value, kind",
    [
        ("750.000,00 €", 750000.0, "asking"), ("750k", 750000.0, "asking"), ("0,75 Mio", 750000.0, "asking"), ("750", None, "unknown"), ("Preis auf Anfrage", None, "on_request"), ("450 000 € VB", 450000.0, "negotiable"),
        ("Verkehrswert 420.000 EUR", 420000.0, "auction_min"), ("Kaltmiete 1.250 € VB", 1250.0, "rent"), ("3,57 % Provision, Kaufpreis 450.000 €", 450000.0, "asking"), ("750 T€", 750000.0, "asking"), (None, None, "unknown"), (" ", None, "unknown"),
    ],
)
def test_prices(spark, raw, value, kind):
    r = spark.createDataFrame([(raw,)], "v string").select(numbers.parse_price(F.col("v")).alias("p")).first()["p"]
    assert (r["value"], r["kind"]) == (value, kind)


def test_areas(spark):
    assert each(spark, ["5.000 m²", "5000 qm", "0,5 ha", "1 Hektar", "1 Tagwerk", "1,608 m²", "2,125 ha", "ca. 150", "", None, "viel"], numbers.parse_area) == [5000.0, 5000.0, 5000.0, 10000.0, 3407.0, 1608.0, 21250.0, 150.0, None, None, None]


def test_dates(spark):
    today = F.lit("2026-09-03").cast("date")
    got = each(spark, ["heute", "vor 3 Tagen", "vor 1 Monat", "KW 34/2026", "KW 53/2025", "12. März 2026", "1.2.69", "1.2.70", "31.02.2026", "2026-03-12T10:00:00", "bald", None], lambda c: dates.german_date(c, today))
    assert got == [date(2026, 9, 3), date(2026, 8, 31), date(2026, 8, 3), date(2026, 8, 17), None, date(2026, 3, 12), date(2069, 2, 1), date(1970, 2, 1), None, date(2026, 3, 12), None, None]


def test_text_and_urls(spark):
    assert each(spark, ["Größe, Öd-Hof!", None], text.normalize_text) == ["groesse oed hof", None]
    assert each(spark, ["a/b-c\nd_e", None], text.fold) == ["a b c d_e", ""]
    assert each(spark, ["HTTP://user@WWW.Ex.de:80/A/b/?utm_x=1&b=2&a=1#f", "https://x.de", "x", None], urls.canonical_url) == ["https://ex.de/A/b?a=1&b=2#f", "https://x.de", None, None]
    assert each(spark, ["Neubau, Stall", "Installation"], lambda c: text.whole_words(text.normalize_text(c), ["stall", "neubau"])) == [["neubau", "stall"], []]


def test_geo_and_formats(spark):
    assert each(spark, [80.0, 80.1, None], lambda c: geo.within_driving(c, 80.0), "double") == [True, False, None]
    assert each(spark, [80.0, None], lambda c: geo.within_air(c, 80.0), "double") == [True, False]
    assert each(spark, ["0000000000000000", "ffffffffffffffff", "xyz"], lambda c: geo.hamming64(c, F.lit("0000000000000001"))) == [1, 63, None]
    assert each(spark, [1234567.5, None], german_format.euro, "double") == ["1.234.568 €", "k. A."]
    assert each(spark, [0.0, 1.5, 12.0, 100.0, 800.0], german_format.relative_days, "double") == ["heute", "gestern", "vor 12 Tagen", "vor 3 Monaten", "vor 2 Jahren"]
    assert each(spark, [date(2026, 1, 1), date(2025, 12, 29)], german_format.week_label, "date") == ["KW 01 / 2026", "KW 01 / 2026"]


def test_places_of_odd_layouts(spark):
    lines = ("83620 Feldkirchen-Westerham", "Vogtareuth (Landkreis Rosenheim)", "Sacherl bei Bad Aibling", "Rosenheim (Kreis), Bayern", "Musterstraße 12, 83024 Rosenheim", "")
    want = ((None, "83620", "Feldkirchen-Westerham", None), (None, None, "Vogtareuth", "Rosenheim"), (None, None, "Bad Aibling", None), (None, None, "Rosenheim", "Rosenheim"), ("Musterstraße 12", "83024", "Rosenheim", None), (None, None, None, None))
    place = listings.parse_location(F.col("t"))
    got = spark.createDataFrame([(t,) for t in lines], "t string").select(*[place[c].alias(c) for c in ("street", "postcode", "town", "district")]).collect()
    assert [tuple(r) for r in got] == list(want)


def test_towns_in_texts(spark):
    texts = ("Bad Aibling", "Hauptstr. 5, 83043 Bad Aibling", "Fuerstenfeldbruck", "bei 83022", "Vogtareuth bei Rosenheim")
    want = (("Bad Aibling", "83043"), ("Bad Aibling", "83043"), (None, None), ("Rosenheim", "83022"), ("Vogtareuth", "83569"))
    got = towns.lookup_towns(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("town.name", "town.postcode").collect()
    assert [tuple(r) for r in got] == list(want)
