from landledger.sources import files

RSS = """<rss><channel><item><title>Hof A</title><link>https://x.de/a</link><description>alt</description><pubDate>Mon</pubDate></item><item><title>ohne</title></item></channel></rss>"""
MAP = """<urlset><url><loc>https://x.de/expose/1</loc></url><url><loc>https://x.de/blog/2</loc></url></urlset>"""
CSV = "﻿Titel;Preis;Grundstück;Ort;Notiz;Bilder;URL\nHof;750.000 €;5.000 m²;Au;alt;https://i/1|https://i/2;https://x.de/1\nohne;1;;;;;\n"


def test_files(spark, tmp_path):
    for name, body in (("f.xml", RSS), ("m.xml", MAP), ("l.csv", CSV)):
        (tmp_path / name).write_text(body)
    feed = files.read_feed(spark, f"file://{tmp_path}/f.xml").collect()
    assert [(r["url"], r["title"]) for r in feed] == [("https://x.de/a", "Hof A")]
    listed, seen = files.read_sitemap(spark, f"file://{tmp_path}/m.xml", "/expose/")
    assert listed.count() == 1 and seen.count() == 2
    rows = files.read_delimited(spark, f"file://{tmp_path}/l.csv").collect()
    assert len(rows) == 1 and rows[0]["price_raw"] == "750.000 €" and rows[0]["town"] == "Au" and rows[0]["extra"] == {"Notiz": "alt"} and rows[0]["image_urls"] == ["https://i/1", "https://i/2"]


def test_pages(spark):
    html = "<html><head><title>Hof | Portal</title><meta property='og:image' content='/b.jpg'></head><body><h1>Hofstelle in Au</h1><p>Kaufpreis: 750.000 €</p><p>Wohnfläche</p><p>180 m²</p><script>x</script><img src='/a.jpg'></body></html>"
    links = "".join(f"<a href='/expose/{i}'>x</a>" for i in range(12))
    df = spark.createDataFrame([(1, "https://x.de/expose/1", html), (2, "https://x.de/liste", links), (3, "https://x.de/login", "<h1>Anmelden</h1>"), (4, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in files.lift_pages(df).collect()}
    assert got[1]["title"] == "Hofstelle in Au" and got[1]["fields"] == {"price_raw": "750.000 €", "living_raw": "180 m²"} and got[1]["images"] == ["https://x.de/b.jpg", "https://x.de/a.jpg"]
    assert [got[i]["page_kind"] for i in (1, 2, 3, 4)] == ["listing", "index", "utility", "listing"]


def test_court_tables(spark):
    html = "<table><tr><th>Foo</th></tr><tr><td>x</td></tr></table><table><tr><th>Aktenzeichen</th><th>Amtsgericht</th><th>Objekt</th><th>Verkehrswert</th></tr><tr><td>1 K 2/26</td><td>Rosenheim</td><td><a href='/d/1'>Hof</a></td><td>420.000</td></tr><tr><td>2 K 3/26</td><td>Traunstein</td></tr></table>"
    got = files.lift_court_tables(spark.createDataFrame([("https://z.de", html), ("https://y.de", None)], "url string, html string")).orderBy("url").collect()
    assert [(r["url"], r["external_id"], r["title"], r["location_raw"]) for r in got] == [("https://z.de/d/1", "1 K 2/26", "Hof", "Rosenheim"), ("https://z.de/index.php?az=2%20K%203/26", "2 K 3/26", None, "Traunstein")]
