"""Parameters, breakdowns, prompts, SQL functions and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from landledger import cli
from landledger.functions import geo, listings, numbers, sql
from landledger.operators import score, triage
from landledger.search_profile import SHIPPED


def test_parameters(spark):
    rows = ["1.234,5", "12,5", "3.5", " 1 000 ", "nan", "inf", "x", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select(numbers.to_number(F.col("t"), -1.0), numbers.to_int(F.col("t"), 7), numbers.clamp(numbers.to_number(F.col("t"), 0.0), 5.0, 100.0)).collect()
    assert [r[0] for r in out] == [1234.5, 12.5, 3.5, 1000.0, -1.0, -1.0, -1.0, -1.0, -1.0]
    assert [r[1] for r in out] == [1234, 12, 3, 1000, 7, 7, 7, 7, 7] and [r[2] for r in out][:4] == [100.0, 12.5, 5.0, 100.0]
    flags = spark.createDataFrame([("Ja",), ("on ",), ("0",), (None,)], "t string")
    assert [r[0] for r in flags.select(numbers.to_bool(F.col("t"), True)).collect()] == [True, True, False, True]


def test_places_in_text_and_geocoding(spark):
    texts = ["Lage: 83569 Vogtareuth\nLandkreis Rosenheim, ruhig", "83022 Rosenheim (Kreis Rosenheim)", "95000 Euro, dann 83024 Bad Aibling", "595.000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(listings.find_location(F.col("t"))).collect()] == ["83569 Vogtareuth, Landkreis Rosenheim", "83022 Rosenheim, Kreis Rosenheim", "83024 Bad Aibling", None, None]
    places = spark.createDataFrame([("Weg  2", "83024", " Au ", "Rosenheim"), ("Weg 2", None, None, None), (None, None, "Au", "Au"), (None, None, None, None)], "street string, postcode string, town string, district string")
    assert [r[0] for r in places.select(geo.geocode_queries()).collect()] == [["Weg 2, 83024 Au", "83024 Au", "Au", "83024", "Rosenheim"], ["Weg 2"], ["Au"], []]
    one = spark.range(1).select(geo.geocode_key(F.lit("  Bad  Aibling "), F.lit("DE")), geo.route_key(F.lit(47.12345), F.lit(11.0), F.lit(48.0), F.lit(12.99999)), geo.geocode_precision(F.lit("Village"), F.lit(None).cast("string"), F.lit("place")), geo.geocode_precision(F.lit(None).cast("string"), F.lit("track"), F.lit("highway")))
    assert tuple(one.first()) == ("de:bad aibling", "47.1235,11.0000->48.0000,13.0000", "town", "street")


def test_breakdowns_and_prompts(spark):
    df = spark.createDataFrame([(1, ((1.5, ("a", 2)), ["x", "y"]))], "property_id long, b struct<fit:struct<land:double,more:struct<k:string,n:int>>,flags:array<string>>")
    assert {(r["path"], r["value"]) for r in score.flat_breakdown(df, "b").collect()} == {("fit › land", "1.5"), ("fit › more › k", "a"), ("fit › more › n", "2"), ("flags", "x, y")}
    p = spark.createDataFrame([(1, "Hof", "x" * 9000, None, 5.0)], "property_id long, title string, description string, driving_km double, price double")
    text = p.select(triage.review_prompt(p, SHIPPED)).first()[0]
    dossier = json.loads(text.split("\n\nAntworte")[0].removeprefix("Objektdossier:\n"))
    assert dossier["titel"] == "Hof" and dossier["fahrstrecke_geprueft"] is False and len(dossier["beschreibung"]) == 6000
    v = spark.createDataFrame([('{"offer_kind": "rent", "offer_probabilities": {"rent": 0.9}}',)], "t string").select(triage.parse_verdict(F.col("t")).alias("v"))
    back = v.select(triage.from_evidence(F.create_map(F.lit("triage"), triage.to_evidence(F.col("v"), F.lit(None).cast("string")))).alias("b")).first()["b"]
    assert back["offer_kind"] == "rent" and back["offer_probabilities"] == {"rent": 0.9}


def test_sql_functions(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names)) >= 12
    r = spark.sql("SELECT ll_slug('Schöner Hof!') AS a, ll_euro(1234567.0D) AS b, ll_km(42.34D) AS c, ll_is_web_url('upload:1') AS d, ll_week(TIMESTAMP'2026-09-01') AS e, ll_euro(NULL) AS f").first()
    assert tuple(r) == ("schoener_hof", "1.234.567 €", "42,3 km", False, "KW 36 / 2026", "k. A.")


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "results_page" in capsys.readouterr().out
    assert cli.main(["config", "--name", "shipped"]) == 0 and SHIPPED.profile_hash in capsys.readouterr().out
    base = f"file://{tmp_path}"
    (tmp_path / "a.csv").write_text("Titel,URL\nHof,https://x/1\n")
    assert cli.main(["read", "csv", f"{base}/raw", "--option", f"path={base}/a.csv", "--source", "mine"]) == 0
    assert spark.read.parquet(f"{base}/raw").first()["source_key"] == "mine" and json.loads(capsys.readouterr().out)["enumerates"] is False
    tables = tmp_path / "t"
    spark.createDataFrame([(1, None), (2, None)], "property_id long, merged_into_id long").write.parquet(f"file://{tables}/property")
    spark.createDataFrame([(1, 5, "https://d/1", None)], "property_id long, document_id long, url string, local_path string").write.parquet(f"file://{tables}/document")
    assert cli.main(["delete-property", f"file://{tables}", "1", f"{base}/less"]) == 0 and spark.read.parquet(f"{base}/less/document").count() == 0
    assert cli.main(["documents", f"file://{tables}", f"{base}/docs"]) == 0 and spark.read.parquet(f"{base}/docs").first()["document_href"] == "https://d/1"
    assert cli.main(["backup", f"file://{tables}", f"{base}/copy"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"document": 1, "property": 2}
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
