from datetime import date

from pyspark.sql import functions as F

from landledger.functions import listings as ls
from landledger.functions.sql import register
from landledger.functions.towns import lookup_towns
from landledger.operators.normalize import normalize_listings
from landledger.sources.files import RAW_FIELDS


def test_places(spark):
    cases = {
        "83620 Feldkirchen-Westerham": (None, "83620", "Feldkirchen-Westerham", None), "Vogtareuth (Landkreis Rosenheim)": (None, None, "Vogtareuth", "Rosenheim"), "Sacherl bei Bad Aibling": (None, None, "Bad Aibling", None),
        "Rosenheim (Kreis), Bayern": (None, None, "Rosenheim", "Rosenheim"), "Musterstraße 12, 83024 Rosenheim": ("Musterstraße 12", "83024", "Rosenheim", None), "": None, None: None,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string").select("i", ls.parse_location(F.col("t")).alias("l")).orderBy("i")
    assert [None if r["l"] is None else tuple(r["l"]) for r in df.collect()] == list(cases.values())
    found = spark.createDataFrame([("Hof in 83569 Vogtareuth zu haben",), ("Preis 45000 Euro, 83022  Rosenheim",), ("nichts",)], "t string").select(ls.find_location(F.col("t")).alias("x"))
    assert [r["x"] for r in found.collect()] == ["83569 Vogtareuth", "83022 Rosenheim", None]


def test_towns(spark):
    df = spark.createDataFrame([("Bad Aibling",), ("Hauptstr. 5, 83043 Bad Aibling",), ("Fuerstenfeldbruck",), ("bei 83022",), (None,)], "q string")
    got = [r["town"] and r["town"]["name"] for r in lookup_towns(df, "q").collect()]
    assert got == ["Bad Aibling", "Bad Aibling", None, "Rosenheim", None]


def test_listing(spark):
    empty = dict.fromkeys(RAW_FIELDS)
    rows = [
        {**empty, "url": "u1", "title": "Vierseithof", "description": "Anwesen in Alleinlage mit Stadel, von privat. Denkmal.", "price_raw": "750.000 €", "land_raw": "5.000 m²", "living_raw": "180 qm", "rooms_raw": "7", "year_raw": "1890", "location_raw": "Musterstraße 12, 83024 Rosenheim", "source_date_raw": "vor 3 Tagen"},
        {**empty, "url": "u2", "title": "Haus", "price_raw": "750", "year_raw": "not a year", "source_date_raw": "irgendwann"},
        {**empty, "url": "u3", "title": "Wohnung zu vermieten", "description": "Kaution", "price_raw": "1.200 €"},
    ]
    df = spark.createDataFrame([tuple(r[f] for f in RAW_FIELDS) for r in rows], ", ".join(f"{f} string" for f in RAW_FIELDS))
    a, b, c = normalize_listings(df, F.lit("2026-09-03").cast("date")).orderBy("url").collect()
    assert (a["price"], a["price_type"], a["land_sqm"], a["living_sqm"], a["year_built"], a["street"], a["postcode"], a["town"], a["source_date"]) == (750000.0, "asking", 5000.0, 180.0, 1890, "Musterstraße 12", "83024", "Rosenheim", date(2026, 8, 31))
    assert a["property_type"] == "vierseithof" and a["outbuildings"] == ["stadel"] and a["building_features"] == ["alleinlage"] and a["is_private_seller"] and a["is_monument"] and a["hidden_signals"] == ["privatverkauf"]
    assert a["evidence"]["price"]["quote"] == "750.000 €" and a["warnings"] == []
    assert b["price"] is None and len(b["warnings"]) == 4 and c["price_type"] == "rent" and "mietobjekt" in c["exclusion_flags"]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT ll_band(101, 100, 116) AS b, ll_normalize('Öd-Hof!') AS n, round(ll_haversine_km(47.907, 11.84, 47.907, 11.84), 3) AS k, ll_token_set_ratio('a b', 'b a') AS t, ll_within_driving(NULL, 5) AS w").first()
    assert tuple(r) == ("within_hard", "oed hof", 0.0, 100.0, None)
