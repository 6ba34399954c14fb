"""Readers of files: delimited text, feeds, sitemaps, fetched pages.  All give columns of raw listings, everything textual."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text

RAW_FIELDS = ("url", "title", "description", "price_raw", "land_raw", "living_raw", "usable_raw", "rooms_raw", "year_raw", "location_raw", "postcode", "town", "external_id", "contact_name", "contact_kind", "contact_detail", "source_date_raw")
# Folded headers and the field they stand for.
HEADERS = {
    "url": "url", "link": "url", "quelle url": "url", "titel": "title", "title": "title", "ueberschrift": "title", "beschreibung": "description", "description": "description",
    "preis": "price_raw", "price": "price_raw", "kaufpreis": "price_raw", "verkaufspreis": "price_raw",
    "grundstueck": "land_raw", "grundstuecksflaeche": "land_raw", "grundstuecksgroesse": "land_raw", "grundstueck qm": "land_raw", "grund": "land_raw", "land": "land_raw",
    "wohnflaeche": "living_raw", "wohnflaeche qm": "living_raw", "living": "living_raw", "living area": "living_raw", "nutzflaeche": "usable_raw", "usable": "usable_raw", "usable area": "usable_raw",
    "zimmer": "rooms_raw", "rooms": "rooms_raw", "baujahr": "year_raw", "year": "year_raw", "year built": "year_raw",
    "lage": "location_raw", "adresse": "location_raw", "address": "location_raw", "location": "location_raw", "strasse": "location_raw", "street": "location_raw",
    "plz": "postcode", "postleitzahl": "postcode", "postcode": "postcode", "zip": "postcode", "postal code": "postcode", "ort": "town", "stadt": "town", "town": "town", "city": "town",
    "id": "external_id", "externe id": "external_id", "external id": "external_id", "objektnummer": "external_id", "objekt nr": "external_id",
    "kontakt": "contact_name", "contact": "contact_name", "kontaktname": "contact_name", "ansprechpartner": "contact_name", "telefon": "contact_detail", "email": "contact_detail",
    "datum": "source_date_raw", "date": "source_date_raw", "bilder": "images", "images": "images", "image urls": "images", "fotos": "images",
}


def _folded(header: str) -> str:
    h = header.lstrip("﻿").strip().lower()
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        h = h.replace(a, b)
    return " ".join(re.sub(r"[^\w\s]", " ", h).replace("_", " ").split())


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TSV with a header in any of the known words.  The separator is the commonest of comma, semicolon and tab in the header.

    Unknown columns go to ``extra``; rows without a URL are dropped; images are split at semicolons, bars and spaces before a URL.
    """
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        first = head[0][0] if head else ""
        sep = max(",;\t", key=first.count)
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    used: dict[str, str] = {}
    extra = []
    for c in raw.columns:
        f = HEADERS.get(_folded(c))
        if f and f not in used:
            used[f] = c
        else:
            extra.append(c)
    cols = [F.trim(F.col(f"`{used[f]}`")).alias(f) if f in used else F.lit(None).cast("string").alias(f) for f in RAW_FIELDS]
    images = F.filter(F.split(F.col(f"`{used['images']}`"), r"[;|]|\s+(?=https?://)"), lambda x: F.trim(x) != "") if "images" in used else F.array().cast("array<string>")
    rest = F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if extra else F.create_map().cast("map<string,string>")
    out = raw.select(*cols, F.transform(F.coalesce(images, F.array().cast("array<string>")), F.trim).alias("image_urls"), rest.alias("extra"))
    return out.filter(F.coalesce(F.col("url"), F.lit("")) != "")


#: Raw fields that a feed's own element may fill.
MAPPABLE = ("postcode", "town", "location_raw", "price_raw", "land_raw", "living_raw", "usable_raw", "rooms_raw", "year_raw", "contact_name", "contact_detail")


def read_feed(spark: SparkSession, path: str, atom: bool = False, fields: dict[str, str] | None = None) -> DataFrame:
    """RSS items or Atom entries as raw listings with their images; entries without a link or with a portal function's are dropped.

    ``fields``: an element's name to the raw field that its text fills, of ``MAPPABLE`` only.
    """
    from ..functions.urls import looks_like_utility

    wanted = {k: v for k, v in (fields or {}).items() if v in MAPPABLE}
    more = "".join(f", `{k}` struct<_VALUE: string>" for k in wanted)
    media = "enclosure array<struct<_url: string, _type: string>>, `media:content` array<struct<_url: string, _medium: string>>, `media:thumbnail` array<struct<_url: string>>"
    if atom:
        schema = f"title string, id string, updated string, summary string, link array<struct<_href: string, _rel: string>>, {media}{more}"
        raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
        link = F.coalesce(F.try_element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"], F.get("link", 0)["_href"])
        cols = {"url": link, "title": F.col("title"), "description": F.col("summary"), "source_date_raw": F.col("updated"), "external_id": F.col("id")}
    else:
        schema = f"title string, link string, guid struct<_VALUE: string, _isPermaLink: string>, description string, pubDate string, {media}{more}"
        raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
        guid = F.col("guid._VALUE")
        cols = {"url": F.coalesce("link", F.when(guid.rlike("^https?://"), guid)), "title": F.col("title"), "description": F.col("description"), "source_date_raw": F.col("pubDate"), "external_id": guid}
    none = F.array().cast("array<string>")
    pictures = F.concat(
        F.coalesce(F.transform(F.filter("enclosure", lambda x: F.coalesce(x["_type"], F.lit("image/")).startswith("image/")), lambda x: x["_url"]), none),
        F.coalesce(F.transform(F.filter("`media:content`", lambda x: F.coalesce(x["_medium"], F.lit("image")) == "image"), lambda x: x["_url"]), none), F.coalesce(F.transform("`media:thumbnail`", lambda x: x["_url"]), none),
    )
    own = {v: F.trim(F.col(f"`{k}`._VALUE")) for k, v in wanted.items()}
    out = raw.select(*[(F.trim(c) if n == "url" else c).alias(n) for n, c in cols.items()], F.array_distinct(F.array_compact(pictures)).alias("image_urls"), *[c.alias(n) for n, c in own.items()])
    return out.filter((F.coalesce(F.col("url"), F.lit("")) != "") & ~looks_like_utility(F.col("url")))


# A detail page fills what its feed entry leaves open; the entry keeps its identity, headline and date.
FEED_OWNS = ("url", "external_id", "title", "source_date_raw")


def merge_details(entries: DataFrame, details: DataFrame) -> DataFrame:
    """``details``: url and raw fields of the pages.  An entry whose page is missing gets a warning."""
    names = [c for c in details.columns if c not in FEED_OWNS]
    d = details.select("url", *[F.col(c).alias(f"_d_{c}") for c in names], F.lit(True).alias("_found"))
    out = entries.join(d, "url", "left")
    cols = [F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_d_{c}")).alias(c) if c in entries.columns else F.col(f"_d_{c}").alias(c) for c in names]
    kept = [c for c in entries.columns if c not in names]
    return out.select(*kept, *cols, F.array_compact(F.array(F.when(F.col("_found").isNull(), "detail page not read"))).alias("warnings"))


def read_sitemap(spark: SparkSession, path: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(listing URLs, all enumerated URLs): what the pattern leaves out was still seen."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).filter("loc is not null")
    seen = raw.select(F.trim("loc").alias("url"), F.col("lastmod").alias("source_date_raw"))
    return (seen.filter(F.col("url").rlike(pattern)) if pattern else seen), seen.select("url")


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("url"))


# Labels of a page's facts and the field each stands for.
LABELS = {
    "kaufpreis": "price_raw", "preis": "price_raw", "verkaufspreis": "price_raw", "kaufpreisvorstellung": "price_raw", "preisvorstellung": "price_raw", "angebotspreis": "price_raw", "verhandlungsbasis": "price_raw", "verkauf": "price_raw", "price": "price_raw",
    "verkehrswert": "price_raw", "kaltmiete": "price_raw", "warmmiete": "price_raw", "nettokaltmiete": "price_raw", "monatsmiete": "price_raw", "mietpreis": "price_raw", "miete": "price_raw",
    "grundstück": "land_raw", "grundstueck": "land_raw", "grundstücksfläche": "land_raw", "grundstuecksflaeche": "land_raw", "grundstücksgröße": "land_raw", "grundstuecksgroesse": "land_raw", "grundstücksgrösse": "land_raw", "grundstücksfl": "land_raw", "land": "land_raw",
    "wohnfläche": "living_raw", "wohnflaeche": "living_raw", "wohnfl": "living_raw", "gesamtwohnfläche": "living_raw", "gesamtwohnflaeche": "living_raw", "living": "living_raw",
    "nutzfläche": "usable_raw", "nutzflaeche": "usable_raw", "gesamtnutzfläche": "usable_raw", "gesamtnutzflaeche": "usable_raw", "wohn-/nutzfläche": "usable_raw", "wohn-/nutzflaeche": "usable_raw", "wohn- und nutzfläche": "usable_raw", "wohn- und nutzflaeche": "usable_raw", "usable": "usable_raw",
    "zimmer": "rooms_raw", "zimmeranzahl": "rooms_raw", "anzahl zimmer": "rooms_raw", "anzahl der zimmer": "rooms_raw", "anzahl räume": "rooms_raw", "rooms": "rooms_raw", "baujahr": "year_raw", "year": "year_raw",
    "ort": "location_raw", "lage": "location_raw", "standort": "location_raw", "adresse": "location_raw", "address": "location_raw", "plz": "postcode",
}
#: Their meaning is lost if only the value is kept.
KEPT_LABELS = ("kaltmiete", "warmmiete", "nettokaltmiete", "monatsmiete", "mietpreis", "miete", "verhandlungsbasis")
#: As often a value as a label: only before a colon.
COLON_ONLY = ("verkauf", "land", "living", "usable", "ort", "lage")
#: What a value must look like to be one.
SHAPES = {
    "price_raw": re.compile(r"\d|anfrage|\bvb\b|\bvhb\b", re.I), "land_raw": re.compile(r"\d.*(?:m²|m2|qm|ha\b|hektar|tagwerk)", re.I), "living_raw": re.compile(r"\d.*(?:m²|m2|qm)", re.I), "usable_raw": re.compile(r"\d.*(?:m²|m2|qm)", re.I),
    "rooms_raw": re.compile(r"^\D{0,4}\d{1,2}(?:[.,]\d)?\b"), "year_raw": re.compile(r"\b1[0-9]{3}\b|\b20[0-9]{2}\b"), "location_raw": re.compile(r"[A-Za-zÄÖÜäöü]{3}"), "postcode": re.compile(r"\b\d{5}\b"),
}
MOST_BLANKS, MOST_VALUE = 4, 120
_ROOMS = re.compile(r"^(\d{1,2}(?:[.,]5)?)[ -](?:Zimmer|Zi\.?)(?:\b|$)")
_INLINE = re.compile("^(" + "|".join(sorted((re.escape(k) for k in LABELS if k not in COLON_ONLY), key=len, reverse=True)) + r")[ \t]+(?=\S)(.*)$", re.I)


def labelled_fields(lines: list[str]) -> dict[str, str]:
    """Facts of a page's lines in four layouts, the surest first: "label: value", "label value" on a line, the value on the next line that
    isn't blank, and a bare number of rooms.  A value must have its field's shape; the first of a field counts.  ``lines`` may hold blank ones."""
    out: dict[str, str] = {}

    def take(label: str, value: str) -> None:
        field = LABELS.get(label)
        value = " ".join(value.split())
        if field and field not in out and value and len(value) <= MOST_VALUE and SHAPES[field].search(value):
            out[field] = f"{label.capitalize()}: {value}" if label in KEPT_LABELS else value

    clean = [" ".join(x.split()) for x in lines]
    for x in clean:
        label, colon, value = x.partition(":")
        if colon:
            take(label.strip().lower(), value)
    for x in clean:
        m = _INLINE.match(x)
        if m:
            take(m[1].lower(), m[2])
    for k, x in enumerate(clean):
        label = x.rstrip(":").strip().lower()
        if label in LABELS and label not in COLON_ONLY or (x.endswith(":") and label in LABELS):
            take(label, next((y for y in clean[k + 1 : k + 2 + MOST_BLANKS] if y), ""))
    for x in clean:
        m = _ROOMS.match(x)
        if m and "rooms_raw" not in out:
            out["rooms_raw"] = m[1]
    return out


def join_url(base: str | None, href: str) -> str | None:
    """The address of a link, or nothing where it isn't one (a page's bad link must not fail the rest)."""
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


# What pages declare themselves to be.
LISTING_TYPES = ("realestatelisting", "product", "offer", "singlefamilyresidence", "house", "apartment", "residence", "accommodation")
INDEX_TYPES = ("searchresultspage", "collectionpage", "itemlist")
NESTED = ("@graph", "mainEntity", "mainEntityOfPage")
LD_DEPTH = 6


def declared(blobs: list[str]) -> tuple[set[str], str]:
    """Types that a page's JSON-LD names for itself, and the first name of a thing on offer.  What a list's entries are doesn't count."""
    types: set[str] = set()
    name = ""
    for blob in blobs:
        try:
            todo = [(json.loads(blob), 0)]
        except ValueError:
            continue
        while todo:
            x, depth = todo.pop(0)
            if depth > LD_DEPTH:
                continue
            if isinstance(x, list):
                todo = [(y, depth + 1) for y in x] + todo
            elif isinstance(x, dict):
                kinds = x.get("@type")
                own = {k.casefold() for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}
                types |= own
                if not name and own & set(LISTING_TYPES) and isinstance(x.get("name"), str):
                    name = x["name"].strip()
                todo = [(x[k], depth + 1) for k in NESTED if k in x] + todo
    return types, name


_SUFFIX = re.compile(r"^(.+?)\s*[|–—·-]\s*([^|–—·-]+)$")
LONGEST_SUFFIX, LEAST_TITLE = 40, 8


def _bare(s: str) -> str:
    return re.sub("[^a-z0-9]", "", s.casefold().translate(str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"})))


def without_site_name(title: str, site: str, host: str) -> str:
    """A headline without the site's own name behind its last dash or bar; other endings are part of it."""
    m = _SUFFIX.match(title)
    if not m:
        return title
    head, tail = m[1].strip(), _bare(m[2])
    named = tail and (tail == _bare(site) or tail in _bare(host.removeprefix("www.")))
    return head if named and len(m[2].strip()) <= LONGEST_SUFFIX and len(head) >= LEAST_TITLE else title


class _Page(HTMLParser):
    """Title, headline, og fields, links, images and visible lines of one page."""

    SKIP, BLOCK = ("script", "style", "noscript", "template"), ("p", "br", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "article", "section", "nav", "ul", "table", "dt", "dd")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.where, self.parts = 0, [], []
        self.title, self.h1, self.og, self.links, self.images, self.ld, self.next = "", "", {}, [], [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.ld.append("")
            self.where.append("ld")
        if tag == "link" and (a.get("rel") or "").lower() == "next" and a.get("href"):
            self.next = a["href"]
        if tag in self.BLOCK:
            self.parts.append("\n")
        if tag in ("title", "h1"):
            self.where.append(tag)
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])
        if tag == "meta" and (a.get("property") or "").startswith("og:") and a.get("content"):
            self.og.setdefault(a["property"][3:], a["content"])

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.BLOCK:
            self.parts.append("\n")
        if self.where and self.where[-1] in (tag, "ld" if tag == "script" else tag):
            self.where.pop()

    def handle_data(self, data):
        if self.where and self.where[-1] == "ld":
            self.ld[-1] += data
        if self.skip:
            return
        if self.where and self.where[-1] == "title":
            self.title += data
            return
        if self.where and self.where[-1] == "h1":
            self.h1 += data
        self.parts.append(data)

    def lines(self, blank: bool = False) -> list[str]:
        return [s for s in (" ".join(x.split()) for x in "".join(self.parts).split("\n")) if s or blank]


def page_facts(url: str, html: str) -> dict:
    p = _Page()
    p.feed(html)
    p.close()
    one = lambda s: " ".join(s.split())
    types, name = declared(p.ld)
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    title = one(name) or one(p.h1) or one(p.og.get("title", "")) or one(p.title)
    groups: dict[str, set] = {}
    for h in p.links:
        full = join_url(url, h)
        if full is not None:
            full = full.split("#")[0].split("?")[0].rstrip("/")
            groups.setdefault(full.rpartition("/")[0], set()).add(full)
    images = list(dict.fromkeys(i for i in (join_url(url, i) for i in ([p.og["image"]] if "image" in p.og else []) + p.images) if i))
    return {
        "title": without_site_name(title, p.og.get("site_name", ""), host), "text": "\n".join(p.lines()), "n_links": len(p.links), "siblings": max(map(len, groups.values()), default=0), "images": images,
        "fields": labelled_fields(p.lines(blank=True)), "declared": "index" if types & set(INDEX_TYPES) else "listing" if types & set(LISTING_TYPES) else None,
    }


def lift_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page's title, visible text, links, largest group of sibling links, images and labelled fields, and whether it is a listing, an index or a utility page."""

    def per_batch(batches):
        for b in batches:
            facts = [page_facts(u, h or "") for u, h in zip(b["url"], b["html"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], **{k: [f[k] for f in facts] for k in ("title", "text", "n_links", "siblings", "images", "fields", "declared")}})

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(per_batch, f"id {rows.schema['id'].dataType.simpleString()}, url string, title string, text string, n_links int, siblings int, images array<string>, fields map<string,string>, declared string")
    return out.withColumn("page_kind", page_kind(F.col("url"), F.col("title"), F.col("siblings"), F.col("declared"))).withColumnRenamed("id", id_col)


class _Tables(HTMLParser):
    """Tables as rows of (is header, text, first link) cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = [tag == "th", "", None]
            self.tables[-1][-1].append(self.cell)
        elif tag == "a" and self.cell is not None and self.cell[2] is None:
            self.cell[2] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1] += data


# Headers of court tables.
COURT_HEADERS = {"aktenzeichen": "external_id", "amtsgericht": "court", "objekt": "title", "verkehrswert": "price_raw", "termin": "auction_date", "versteigerungstermin": "auction_date", "ort": "town", "lage": "town"}


def court_rows(html: str, base: str) -> list[dict]:
    """Rows of the tables whose header names a file number; columns go by their header, missing cells are missing fields."""
    p = _Tables()
    p.feed(html or "")
    out = []
    for table in p.tables:
        if not table:
            continue
        names = [COURT_HEADERS.get(_folded(c[1])) for c in table[0]]
        if "external_id" not in names:
            continue
        for row in table[1:]:
            got = {n: " ".join(c[1].split()) for n, c in zip(names, row, strict=False) if n and c[1].strip()}
            link = next((c[2] for c in row if c[2]), None)
            if not got.get("external_id"):
                continue
            url = (join_url(base, link) if link else None) or f"{(base or '').rstrip('/')}/index.php?az={got['external_id'].replace(' ', '%20')}"
            out.append({"url": url, **{k: got.get(k) for k in ("external_id", "title", "price_raw", "auction_date")}, "location_raw": ", ".join(x for x in (got.get("court"), got.get("town")) if x) or None})
    return out


def lift_court_tables(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Raw listings of court registers, one row per table row."""
    names = ("url", "external_id", "title", "price_raw", "auction_date", "location_raw")

    def per_batch(batches):
        for b in batches:
            rows = [r for u, h in zip(b["url"], b["html"], strict=True) for r in court_rows(h, u)]
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="object") for n in names})

    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(per_batch, ", ".join(f"{n} string" for n in names))


def merge_document_text(listings: DataFrame, documents: DataFrame) -> DataFrame:
    """``documents``: url, title, text (already extracted).  What the page says goes first; a document only fills holes."""
    d = documents.groupBy("url").agg(F.min_by("title", "title").alias("_t"), F.min_by("text", "title").alias("_x"))
    return listings.join(d, "url", "left").withColumns({"title": F.coalesce("title", "_t"), "description": F.coalesce("description", "_x")}).drop("_t", "_x")


def search_queries(terms: list[str], regions: list[str], most_terms: int = 5) -> list[str]:
    """The queries of a web or portal search: core term by region."""
    return [f"{t} {r}".strip() for t in terms[:most_terms] for r in (regions or [""])]


def enabled(config: DataFrame) -> DataFrame:
    """Sources are only used once their terms were read: a date and an excerpt."""
    return config.filter(F.col("enabled") & F.col("terms_checked_at").isNotNull() & (F.coalesce(F.col("terms_excerpt"), F.lit("")) != ""))


INDEX_LINKS = 10


# Headlines of a portal's functions.
UTILITY_HEADINGS = (
    "merkliste", "merkzettel", "favoriten", "suchagent", "login", "anmelden", "abmelden", "registrieren", "registrierung", "impressum", "datenschutz", "datenschutzerklaerung", "agb", "kontakt", "benutzermenue", "menue", "navigation", "startseite", "homepage",
    "suche", "seite nicht gefunden",
)


def page_kind(url: Column, title: Column, siblings: Column, declares: Column | None = None) -> Column:
    """Utility by address or headline, then what the page declares (index before listing), then index by ten sibling links, else listing."""
    from ..functions.urls import looks_like_utility

    heading = normalize_text(title).isin(*UTILITY_HEADINGS)
    out = F.when(looks_like_utility(url) | F.coalesce(heading, F.lit(False)), "utility")
    if declares is not None:
        out = out.when(declares.isNotNull(), declares)
    return out.when(siblings >= INDEX_LINKS, "index").otherwise("listing")


# What a page says when its listing is gone.
GONE_WORDS = "nicht mehr verfügbar|nicht mehr online|wurde deaktiviert|bereits verkauft|no longer available"


def liveness(status: Column, body: Column) -> Column:
    """gone, alive or unknown_alive of a fetched page; a network error (null) says nothing against it."""
    return F.when(status.isNull(), "alive").when(status.isin(404, 410), "gone").when(status >= 400, "unknown_alive").when(F.lower(body).rlike(GONE_WORDS), "gone").otherwise("alive")


def bot_wall(body: Column) -> Column:
    return F.coalesce(F.lower(F.substring(body, 1, 5000)).rlike("captcha|are you a robot|access denied|zugriff verweigert|checking your browser|cf-challenge"), F.lit(False))


def bulletin_hits(pages: DataFrame, terms: list[str], around: int = 80) -> DataFrame:
    """``pages``: url, page, text.  One row per page and term that occurs, with a snippet."""
    found = pages.select("url", "page", "text", F.explode(F.array(*map(F.lit, terms))).alias("term")).withColumn("_at", F.expr("instr(lower(text), lower(term))")).filter("_at > 0")
    return found.select(F.concat("url", F.lit("#page="), F.col("page").cast("string")).alias("url"), "page", "term", F.expr(f"substring(text, greatest(1, _at - {around}), least(_at, {around + 1}) - 1 + length(term) + {around})").alias("snippet"))


# How a bulletin names its issue and day.
ISSUE, DAY = r"(?i)(KW\s*\d{1,2}(?:\s*/\s*\d{2,4})?)", r"(\d{1,2}\.\d{1,2}\.\d{2,4})"


def bulletin_listings(issues: DataFrame, pages: DataFrame, terms: list[str]) -> DataFrame:
    """Raw listings of a bulletin's hits, one a page and term.

    ``issues``: url, label (the text of its link); ``pages``: url, page, text.  Issue and day come from the label, else from the address; a
    bulletin piles up and takes nothing back, so its reading enumerates nothing.
    """
    said = lambda pattern: F.coalesce(*[F.when(F.regexp_extract(c, pattern, 1) != "", F.regexp_extract(c, pattern, 1)) for c in ("label", "url")])
    dated = issues.select("url", said(ISSUE).alias("issue"), said(DAY).alias("source_date_raw")).dropDuplicates(["url"])
    hits = bulletin_hits(pages, terms).withColumn("document_url", F.regexp_extract("url", r"^(.*)#page=[^#]*$", 1))
    out = hits.join(dated.withColumnRenamed("url", "document_url"), "document_url", "left")
    return out.select("url", F.concat_ws(" – ", "term", F.coalesce("issue", "source_date_raw")).alias("title"), F.col("snippet").alias("description"), "source_date_raw", "document_url", "page", "term", "issue")


def source_registry(config: DataFrame, state: DataFrame) -> DataFrame:
    """Upsert by key: configuration overwrites, run health stays, what the configuration lacks is kept."""
    health = [c for c in state.columns if c not in config.columns]
    out = config.alias("c").join(state.alias("s"), "key", "full")
    return out.select("key", *[F.coalesce(f"c.{c}", f"s.{c}").alias(c) if c in state.columns else F.col(f"c.{c}") for c in config.columns if c != "key"], *[F.col(f"s.{c}") for c in health])
