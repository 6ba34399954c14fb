"""Pages, registers, portals and pastes on small made-up inputs."""

import pytest

from landledger.sources import files, portals


def test_page_facts_survive_bad_links_and_read_all_layouts():
    page = """<title>Hof in Au | Maklerhaus</title><meta property="og:site_name" content="Maklerhaus"><a href="http://[x">bad</a><a href="/a/1">one</a><img src="http://[y"><img src="b.jpg">
    <h1>Schöner Hof in Au - Maklerhaus</h1><dl><dt>Kaufpreis</dt><dd></dd><dd>450.000 €</dd></dl><p>Wohnfläche 120 m²</p><p>Grundstück: 5.000 m²</p><p>Kaltmiete: 900 €</p><p>5 Zimmer, hell</p><p>Baujahr: unbekannt</p><p>Lage: 83024 Rosenheim</p>"""
    f = files.page_facts("https://www.maklerhaus.de/x", page)
    assert f["title"] == "Schöner Hof in Au" and f["n_links"] == 2 and f["images"] == ["https://www.maklerhaus.de/b.jpg"]
    assert f["fields"] == {"living_raw": "120 m²", "land_raw": "5.000 m²", "price_raw": "Kaltmiete: 900 €", "rooms_raw": "5", "location_raw": "83024 Rosenheim"}
    assert files.page_facts("http://[z", page)["title"] == "Schöner Hof in Au"


def test_declared_kinds(spark):
    listing = '<script type="application/ld+json">{"@graph": [{"@type": ["House"], "name": "Hofstelle am See"}]}</script><h1>Portal</h1>'
    index = '<script type="application/ld+json">[{"@type": "Product", "name": "Alle"}, {"@type": "SearchResultsPage"}]</script><script type="application/ld+json">{broken</script>'
    cards = "".join(f'<a href="/immobilien/{k}">x</a>' for k in range(12))
    rows = [(1, "http://a/1", listing + cards), (2, "http://a/2", index), (3, "http://a/3", cards), (4, "http://a/4", "<h1>Merkliste</h1>"), (5, "http://a/suche.html?x=1", "<h1>Hof</h1>"), (6, "http://a/forschungssuche", "<h1>Hof</h1>"), (7, None, None)]
    out = {r["page_id"]: (r["page_kind"], r["title"]) for r in files.lift_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out[1] == ("listing", "Hofstelle am See")
    assert [out[k][0] for k in (2, 3, 4, 5, 6, 7)] == ["index", "index", "utility", "utility", "listing", "listing"]


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Titel;Beschreibung;URL;Notiz\n"Hof; groß";"zwei\nZeilen ""mit"" Strich";https://x/1;n\n', encoding="utf-8")
    r = files.read_delimited(spark, f"file://{tmp_path}/a.csv").collect()
    assert len(r) == 1 and r[0]["title"] == "Hof; groß" and r[0]["description"] == 'zwei\nZeilen "mit" Strich' and r[0]["extra"] == {"Notiz": "n"}


def test_feed_fields_and_details(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:media="m"><channel><item><title>Hof</title><link>https://x/1</link><guid isPermaLink="false">g1</guid><plz>83024</plz><enclosure url="https://x/a.jpg" type="image/jpeg"/></item><item><title>Suche</title><link>https://x/suche</link></item><item><title>B</title><guid>https://x/2</guid></item></channel></rss>'
    )
    feed = files.read_feed(spark, f"file://{tmp_path}/f.xml", fields={"plz": "postcode", "title": "url"})
    rows = {r["url"]: r for r in feed.collect()}
    assert set(rows) == {"https://x/1", "https://x/2"} and rows["https://x/1"]["postcode"] == "83024" and rows["https://x/1"]["image_urls"] == ["https://x/a.jpg"] and rows["https://x/1"]["external_id"] == "g1"
    details = spark.createDataFrame([("https://x/1", "Seite", "450.000 €")], "url string, description string, price_raw string")
    out = {r["url"]: r for r in files.merge_details(feed, details).collect()}
    assert (out["https://x/1"]["title"], out["https://x/1"]["description"], out["https://x/1"]["price_raw"], out["https://x/1"]["warnings"]) == ("Hof", "Seite", "450.000 €", [])
    assert out["https://x/2"]["warnings"] == ["detail page not read"]


def test_sitemaps(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>https://x/a.xml</loc></sitemap><sitemap><loc>https://x/gone.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "a.xml").write_text("<urlset>" + "".join(f"<url><loc>https://x/{'hof' if k % 2 else 'blog'}/{k}</loc></url>" for k in range(10)) + "</urlset>")
    got = portals.read_source(spark, "s", "sitemap", {"path": f"{base}/i.xml", "path_of": {"https://x/a.xml": f"{base}/a.xml"}, "pattern": "/hof/"})
    assert got.listings.count() == 5 and got.enumerated.count() == 10 and got.incomplete == "not read: https://x/gone.xml" and not portals.proves_absence(got, "primary")
    got = portals.read_source(spark, "s", "sitemap", {"path": f"{base}/a.xml", "max_pages": 3})
    assert got.listings.count() == 3 and got.incomplete == "stopped after 3 pages"
    got = portals.read_source(spark, "s", "sitemap", {"path": f"{base}/a.xml"})
    assert portals.proves_absence(got, "local") and not portals.proves_absence(got, "discovery") and got.listings.columns[-1] == "source_key"
    with pytest.raises(ValueError, match="no reader"):
        portals.read_source(spark, "s", "nothing", {})


def test_register(spark):
    row = lambda k, title, region: f'<tr><td><a href="/d/objekte/{k:06d}/index.html">{title}</a></td><td>{region}</td></tr>'
    html = "<table>" + row(1, "Hofstelle in Reichenschwand - Leuzenberg", "Mittelfranken") + row(2, "Bauernhaus in Rosenheim, Oberbayern", "Oberbayern") + row(2, "Bauernhaus in Rosenheim, Oberbayern", "Oberbayern") + row(3, "Pfarrhof in Neumarkt-Sankt Veit", "Ober Bayern?") + row(4, "Stadl in Fernort", "Schwaben") + "<tr><td>Kopf</td></tr></table>"
    rows = portals.register_rows(spark.createDataFrame([("https://r.de/", html), ("https://r.de/2", None)], "url string, html string"))
    assert {(r["external_id"], r["town"]) for r in rows.collect()} == {("000001", "Reichenschwand"), ("000002", "Rosenheim"), ("000003", "Neumarkt-Sankt Veit"), ("000004", "Fernort")}
    kept = portals.in_scope(rows, towns={"Fernort": False, "Rosenheim": True})
    assert {r["external_id"] for r in kept.collect()} == {"000002", "000003"}


def test_portal(spark):
    result = '<a href="/immobilien/hof-12345">a</a><a href="/immobilien/hof-12345?x">a</a><a href="/immobilien/hof-99999">b</a><a href="/andere/77777">c</a>'
    detail = '<h1>Hof in Vogtareuth</h1><p>Kaufpreis: 1 €</p><script>var dataLayer = [{"postal_code": "83569", "locality": "Vogtareuth", "features": 3}]</script>'
    schema = "facet string, page int, url string, html string"
    pages = [("haus", 1, "https://p/1", result), ("haus", 0, "https://p/immobilien/hof-12345", detail), ("haus", 0, "https://p/immobilien/hof-55555", detail)]
    got = portals.portal_listings(spark.createDataFrame(pages, schema))
    r = got.listings.collect()
    assert len(r) == 1 and (r[0]["external_id"], r[0]["postcode"], r[0]["town"], r[0]["price_raw"]) == ("12345", "83569", "Vogtareuth", "1 €") and got.incomplete == "1 named listings not there"
    assert portals.portal_listings(spark.createDataFrame([*pages, ("haus", 6, "https://p/6", result)], schema)).incomplete == "stopped after 5 pages"
    assert portals.portal_listings(spark.createDataFrame(pages[1:], schema)).incomplete == "no result pages"


def test_cards_and_search(spark):
    html = '<ul><li class="aditem top"><img src="x"><a href="/s/1">Hof <b>A</b></a><p>450.000 € VB</p></li><li class="aditem"><p>kein Link</p></li><li class="aditem"><a href="http://[x">B</a></li></ul>'
    df = spark.createDataFrame([("https://k.de", html), ("https://k.de/2", html), ("https://k.de/3", "<article><a href='/s/9'>C</a> VB</article>"), ("https://k.de/4", None)], "url string, html string")
    assert {tuple(r) for r in portals.result_cards(df).collect()} == {("https://k.de/s/1", "Hof A", "450.000 € VB"), ("https://k.de/s/9", "C", "VB")}
    hits = spark.createDataFrame([("https://a", "t", "s"), ("https://a", "u", "s"), ("upload:1", "v", "s")], "url string, title string, snippet string")
    assert [tuple(r) for r in portals.search_stubs(hits).collect()] == [("https://a", "t", "s")]


def test_pastes(spark):
    text = "Merkliste\nSchöne Hofstelle in Vogtareuth\nWohnŧäche: 180 m²\nPŧege und Grundŧäche nach Absprache\nhttps://x/bild.JPG\n"
    rows = [("https://x.de/expose/schoene-hofstelle-in-vogtareuth.html", text), ("manual:1", "Menü\n12345\nEin Hof\n"), ("manual:2", "<html><h1>Hof</h1><p>Kaufpreis: 5.000 €</p></html>"), ("manual:3", "<html><noscript>Please enable JavaScript</noscript><p>Bitte JavaScript einschalten</p></html>"), ("manual:4", "<p>Are you a robot? captcha</p>"), ("manual:5", None)]
    out = {r["url"]: r for r in portals.pasted(spark.createDataFrame(rows, "url string, text string")).collect()}
    first = out[rows[0][0]]
    assert first["title"] == "Schöne Hofstelle in Vogtareuth" and first["living_raw"] == "180 m²" and first["warnings"] == ["ŧ read as fl"] and first["image_urls"] == ["https://x/bild.JPG"] and first["refused"] is None
    assert out["manual:1"]["title"] == "Ein Hof" and out["manual:2"]["price_raw"] == "5.000 €" and out["manual:3"]["refused"] == "needs scripts" and out["manual:4"]["refused"] == "bot wall" and out["manual:5"]["title"] is None
    assert portals.recover_ligatures("Łódź ist schön") == ("Łódź ist schön", {})


def test_places(spark):
    names = ["Vogtareuth", "Bad Aibling", "Neumarkt-Sankt Veit", "Rott am Inn", "Merkliste", "3 Zimmer", "kaufen", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(portals.reads_like_a_place(df["n"])).collect()] == [True] * 4 + [False] * 4


def test_table_functions(spark):
    from landledger.functions import table_functions

    assert table_functions.register(spark) == ["ll_page", "ll_court", "ll_labelled"]
    court = "<table><tr><th>Aktenzeichen</th><th>Objekt</th><th>Verkehrswert</th></tr><tr><td>K 1/26</td><td><a href='/x'>Hof</a></td><td>90.000 €</td></tr><tr><td></td></tr></table>"
    rows = [(1, "https://a.de/1", "<title>Hof</title><p>Kaufpreis: 450.000 €</p>"), (2, "https://a.de/2", None), (3, "https://a.de/3", "".join(f'<a href="/immobilien/{k}">x</a>' for k in range(12))), (4, "https://b.de", court)]
    spark.createDataFrame(rows, "id int, url string, html string").createOrReplaceTempView("fetched")
    got = {r["id"]: r for r in spark.sql("SELECT p.id, l.* FROM fetched p, LATERAL ll_page(p.url, p.html) l").collect()}
    assert set(got) == {1, 3, 4} and got[1]["fields"] == {"price_raw": "450.000 €"} and got[3]["page_kind"] == "index" and all(r["error"] is None for r in got.values())
    lifted = {r["id"]: r for r in files.lift_pages(spark.table("fetched"), id_col="id").collect()}
    assert all(got[k][c] == lifted[k][c] for k in got for c in ("title", "text", "n_links", "siblings", "images", "fields", "page_kind"))
    assert [tuple(r) for r in spark.sql("SELECT l.url, l.external_id, l.price_raw FROM fetched p, LATERAL ll_court(p.url, p.html) l").collect()] == [("https://b.de/x", "K 1/26", "90.000 €")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM ll_labelled('Wohnfläche: 120 m²\nnichts')").collect()] == [("living_raw", "120 m²")]


def test_bulletins_name_issue_and_day(spark):
    issues = spark.createDataFrame([("https://g.de/a.pdf", "Amtsblatt KW 12 / 2026 vom 20.03.2026"), ("https://g.de/kw7.pdf", "Blatt")], "url string, label string")
    pages = spark.createDataFrame([("https://g.de/a.pdf", 1, "Hofstelle zu verkaufen"), ("https://g.de/kw7.pdf", 2, "alte Hofstelle"), ("https://g.de/a.pdf", 3, "nichts")], "url string, page int, text string")
    got = {r["url"]: r for r in files.bulletin_listings(issues, pages, ["hofstelle", "stadel"]).collect()}
    assert set(got) == {"https://g.de/a.pdf#page=1", "https://g.de/kw7.pdf#page=2"}
    first = got["https://g.de/a.pdf#page=1"]
    assert (first["issue"], first["source_date_raw"], first["document_url"]) == ("KW 12 / 2026", "20.03.2026", "https://g.de/a.pdf") and got["https://g.de/kw7.pdf#page=2"]["issue"] == "kw7"
