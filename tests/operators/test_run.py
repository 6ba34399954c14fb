"""Runs from files to the report: what is new, known, merged, cheaper, gone; counters; a run that comes again."""

import json
from datetime import datetime, timedelta

from landledger import cli
from landledger.operators import run
from landledger.search_profile import SHIPPED
from landledger.sources import files
from landledger.sources.portals import Reading

NOW = datetime(2026, 9, 1)
HEAD = "Titel;Beschreibung;Verkaufspreis;Grundstuecksgroesse;living_area;year_built;zip;city;URL"


def listing(k, price, **more):
    f = {"title": f"Hofstelle {k}", "text": "Bauernhof in Alleinlage mit Stadel", "land": 5000 + 700 * k, "living": 150 + 9 * k, "year": 1850 + k, "zip": 83000 + k, "town": f"Au {k}", "url": f"https://a.de/expose/{k}"} | more
    return f"{f['title']};{f['text']};{price} €;{f['land']} m²;{f['living']} m²;{f['year']};{f['zip']};{f['town']};{f['url']}"


def reading(spark, path, lines, whole=True):
    path.write_text("\n".join([HEAD, *lines]), encoding="utf-8")
    got = files.read_delimited(spark, f"file://{path}")
    return Reading(got, got.select("url") if whole else None)


def test_two_runs(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    sources = spark.createDataFrame([(1, "a", "primary", 0.9, None), (2, "b", "discovery", 0.4, None)], "source_id long, source_key string, role string, reliability double, ttl_days int")
    first = {
        "a": reading(spark, tmp_path / "a.csv", [listing(k, 300_000 + k) for k in range(8)] + [listing(20, 900, text="Haus zu vermieten, Kaltmiete", title="Mietwohnung")]),
        "b": reading(spark, tmp_path / "b.csv", [listing(3, 300_003, url="https://b.de/expose/x3"), listing(30, 100_000, url="https://b.de/expose/x30")], whole=False),
    }
    one = run.Run(spark, base, sources, SHIPPED, 1, NOW, 4).whole(first, towns=["Au 1", "Nirgends"])
    assert one.counters["read"] == {"rows": 11, "listings": 11, "warned": one.counters["read"]["warned"]} and one.counters["known"] == {"rows": 11, "known": 0, "refused": 1}
    assert one.counters["resolve"] == {"rows": 10, "new": 9, "merged": 1}  # the portal's copy of listing 3 is one property with it
    assert [r["observed"] for r in one.digest.towns] == [1, 0] and len(one.digest.entries) > 0
    # Eight days later: 0 is gone, 1 is cheaper, 9 is new, and another portal brings 5.
    second = {
        "a": reading(spark, tmp_path / "a2.csv", [listing(k, 300_000 + k - (50_000 if k == 1 else 0)) for k in range(1, 10) if k != 8]),
        "b": reading(spark, tmp_path / "b2.csv", [listing(5, 300_005, url="https://b.de/expose/x5")], whole=False),
    }
    for _ in range(2):  # the second run comes again, as after a failure
        r = run.Run(spark, base, sources, SHIPPED, 2, NOW + timedelta(days=8), 4)
        two = r.whole(second)
    assert two.counters["known"] == {"rows": 9, "known": 7, "refused": 0} and two.counters["duplicates"]["duplicates"] == 1
    assert two.counters["resolve"]["new"] == 1
    by_url = {u["url"]: u["property_id"] for u in r.source_rows().collect()}
    snap = {p["property_id"]: p for p in r.store.snapshot().collect()}
    assert len(snap) == 10 and by_url["https://b.de/expose/x3"] == by_url["https://a.de/expose/3"] and by_url["https://b.de/expose/x5"] == by_url["https://a.de/expose/5"]
    state = lambda k: snap[by_url[f"https://a.de/expose/{k}"]]
    assert (state(0)["listing_status"], state(1)["listing_status"], state(1)["price"], state(1)["price_reduction_count"]) == ("removed", "active", 250_001.0, 1)
    kinds = sorted(j["change_kind"] for j in spark.read.parquet(f"{base}/journal").filter("run_id = 2").collect())
    assert kinds == ["first_seen", "price_change", "removed", "source_change"]
    assert spark.read.parquet(f"{base}/report").count() >= 1
    stages = [(s["run_id"], s["stage"]) for s in run.stage_log(spark, base).collect()]
    assert stages[0] == (2, "read") and len([s for s in stages if s[0] == 2]) == len(two.counters)
    assert {e["category"] for e in two.digest.entries} >= {"price_change", "new"}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("\n".join([HEAD, listing(1, 300_000)]), encoding="utf-8")
    registry = [{"source_id": 1, "source_key": "a", "role": "primary", "reliability": 0.9, "kind": "csv", "options": {"path": f"file://{tmp_path}/a.csv"}}]
    (tmp_path / "registry.json").write_text(json.dumps(registry))
    base = f"file://{tmp_path}/base"
    assert cli.main(["run", base, f"{tmp_path}/registry.json", "1"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["resolve"]["new"] == 1
    assert cli.main(["report", base, f"file://{tmp_path}/out"]) == 0 and "# KW" in spark.read.parquet(f"file://{tmp_path}/out").first()["markdown"]
    assert cli.main(["stages", base]) == 0 and '"read"' in capsys.readouterr().out
