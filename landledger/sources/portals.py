"""Portals, registers and pasted texts, and the registry of readers.

Pages are given as tables (url, html): fetching is no part of this library.  A reader takes (spark, options) and returns raw listings
with ``source_key``; what it looked at without returning it is in ``enumerated``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from . import files


class Reading(NamedTuple):
    """Raw listings, the URLs that were looked at (null: the source lists no inventory), and why the list isn't whole (null: it is)."""

    listings: DataFrame
    enumerated: DataFrame | None = None
    incomplete: str | None = None


Reader = Callable[[SparkSession, dict], Reading]
READERS: dict[str, Reader] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return add


def read_source(spark: SparkSession, source_key: str, kind: str, options: dict) -> Reading:
    """By the reader's name.  An unknown one is an error."""
    if kind not in READERS:
        raise ValueError(f"no reader called {kind!r}; there are {sorted(READERS)}")
    got = READERS[kind](spark, options)
    return got._replace(listings=got.listings.withColumn("source_key", F.lit(source_key)))


def proves_absence(got: Reading, role: str) -> bool:
    """Whether what a reading lacks is gone: a whole inventory, from a source that may prove things."""
    return got.enumerated is not None and got.incomplete is None and role in ("primary", "local")


@reader("csv")
def _csv(spark: SparkSession, options: dict) -> Reading:
    return Reading(files.read_delimited(spark, options["path"], options.get("sep")))


@reader("feed")
def _feed(spark: SparkSession, options: dict) -> Reading:
    return Reading(files.read_feed(spark, options["path"], options.get("atom", False), options.get("entry_field_map")))


@reader("sitemap")
def _sitemap(spark: SparkSession, options: dict) -> Reading:
    return read_sitemaps(spark, options["path"], options.get("path_of", {}), options.get("pattern"), options.get("max_pages", MOST_PAGES))


@reader("court")
def _court(spark: SparkSession, options: dict) -> Reading:
    rows = files.lift_court_tables(spark.read.parquet(options["pages"]))
    return Reading(rows, rows.select("url"))


@reader("monuments")
def _monuments(spark: SparkSession, options: dict) -> Reading:
    rows = register_rows(spark.read.parquet(options["pages"]))
    return Reading(in_scope(rows, tuple(options.get("regions", REGIONS)), options.get("towns")), rows.select("url"))


@reader("portal")
def _portal(spark: SparkSession, options: dict) -> Reading:
    return portal_listings(spark.read.parquet(options["pages"]), options.get("max_pages", MOST_RESULT_PAGES))


@reader("cards")
def _cards(spark: SparkSession, options: dict) -> Reading:
    return Reading(result_cards(spark.read.parquet(options["pages"])))


@reader("bulletin")
def _bulletin(spark: SparkSession, options: dict) -> Reading:
    return Reading(files.bulletin_hits(spark.read.parquet(options["pages"]), options["terms"]))


@reader("search")
def _search(spark: SparkSession, options: dict) -> Reading:
    return Reading(search_stubs(spark.read.parquet(options["results"])))


@reader("paste")
def _paste(spark: SparkSession, options: dict) -> Reading:
    return Reading(pasted(spark.read.parquet(options["texts"])))


MOST_PAGES, MOST_SITEMAPS, SITEMAP_DEPTH = 200, 50, 3


def read_sitemaps(spark: SparkSession, root: str, path_of: dict[str, str], pattern: str | None = None, max_pages: int = MOST_PAGES, most_files: int = MOST_SITEMAPS, depth_limit: int = SITEMAP_DEPTH) -> Reading:
    """A sitemap or an index of them (``path_of``: a listed URL to the file that holds it), to a depth and a number of files.

    All URLs count as looked at, the pattern and the budget choose what is returned; a file that can't be had, or a budget that ends, leaves it incomplete.
    """
    todo, seen, pages, why = [(root, 0)], set(), None, None
    while todo and len(seen) <= most_files:
        path, depth = todo.pop(0)
        seen.add(path)
        _, all_ = files.read_sitemap(spark, path)
        pages = all_ if pages is None else pages.union(all_)
        for r in files.sitemap_index(spark, path).limit(most_files + 1).collect():
            below = path_of.get(r["url"])
            if below is None or depth == depth_limit:
                why = f"not read: {r['url']}"
            elif below not in seen:
                todo.append((below, depth + 1))
    why = "too many sitemaps" if todo else why
    pages = pages.filter("url is not null").distinct()
    chosen = pages.filter(F.col("url").rlike(pattern)) if pattern else pages
    if chosen.limit(max_pages + 1).count() > max_pages:
        why = f"stopped after {max_pages} pages"
    return Reading(chosen.orderBy("url").limit(max_pages), pages, why)


# The register's links, and the regions it names.
_OBJECT = re.compile(r"/objekte/(\d{6})/index\.html")
_TOWN = re.compile(r"\bin\s+([^,]+?)(?=\s[-–—]\s|,|$)", re.I)
ALL_REGIONS = ("Oberbayern", "Niederbayern", "Oberpfalz", "Oberfranken", "Mittelfranken", "Unterfranken", "Schwaben")
REGIONS = ("Oberbayern", "Niederbayern", "Schwaben")


def register_rows(pages: DataFrame) -> DataFrame:
    """Rows of a monument register's tables: url, external_id, title, town (from the title), region (last column); an object once."""
    names = ("url", "external_id", "title", "town", "region")

    def per_batch(batches):
        for b in batches:
            out = []
            for base, text in zip(b["url"], b["html"], strict=True):
                p = files._Tables()
                p.feed(text or "")
                for row in (r for t in p.tables for r in t):
                    hit = next((m for c in row if c[2] and (m := _OBJECT.search(c[2]))), None)
                    if hit:
                        title = next((" ".join(c[1].split()) for c in row if c[2] and _OBJECT.search(c[2])), "")
                        town = _TOWN.search(title)
                        out.append((files.join_url(base, next(c[2] for c in row if c[2] and _OBJECT.search(c[2]))), hit[1], title, town[1].strip() if town else None, " ".join(row[-1][1].split()) or None))
            yield pd.DataFrame(out, columns=list(names), dtype="object")

    rows = pages.select("url", "html").mapInPandas(per_batch, ", ".join(f"{n} string" for n in names))
    return rows.filter("url is not null").groupBy("external_id").agg(F.min(F.struct("url", "title", "town", "region")).alias("r")).select("r.url", "external_id", "r.title", "r.town", "r.region")


def in_scope(rows: DataFrame, regions: tuple[str, ...] = REGIONS, towns: dict[str, bool] | None = None) -> DataFrame:
    """Rows worth fetching: a region that is known and not asked for drops a row, and so does a town known to be out of reach.  What can't be told stays."""
    other = F.col("region").isin(*ALL_REGIONS) & ~F.col("region").isin(*regions)
    out = rows.filter(~F.coalesce(other, F.lit(False)))
    if towns:
        near = F.try_element_at(F.create_map(*[F.lit(x) for kv in towns.items() for x in kv]), F.col("town"))
        out = out.filter(F.coalesce(near, F.lit(True)))
    return out


MOST_RESULT_PAGES = 5
_DETAIL = r"/immobilien/[^\"\'?#]*?(\d{5,})"
_BLOB_PLACE = r"\"{}\"\s*:\s*\"([^\"]*)\""


def blob_place(html: Column) -> dict[str, Column]:
    """Postcode and town from a page's script data, where they are texts."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return {"postcode": some(F.regexp_extract(html, _BLOB_PLACE.format("postal_code"), 1)), "town": some(F.regexp_extract(html, _BLOB_PLACE.format("locality"), 1))}


def portal_listings(pages: DataFrame, max_pages: int = MOST_RESULT_PAGES) -> Reading:
    """``pages``: facet, page (from 1), url, html of result pages (page > 0) and detail pages (page = 0).

    Result pages up to ``max_pages`` of a facet name details by number, each once; details become raw listings with the number as external id and the
    place from the script data.  A facet with more pages, or a named detail that isn't there, leaves the reading incomplete.
    """
    named = pages.filter((F.col("page") > 0) & (F.col("page") <= max_pages)).select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_DETAIL), F.lit(1)))).alias("external_id")).distinct()
    details = pages.filter("page = 0").withColumn("external_id", F.regexp_extract("url", _DETAIL, 1)).filter("external_id <> ''").groupBy("external_id").agg(F.min(F.struct("url", "html")).alias("d")).select("external_id", "d.url", "d.html")
    got = named.join(details, "external_id")
    facts = files.lift_pages(got, id_col="external_id").select("external_id", F.col("url"), "title", F.col("text").alias("description"), F.col("images").alias("image_urls"), "fields", "page_kind")
    place = got.select("external_id", *[c.alias(n) for n, c in blob_place(F.col("html")).items()])
    out = facts.join(place, "external_id").select("*", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in ("price_raw", "land_raw", "living_raw", "usable_raw", "rooms_raw", "year_raw", "location_raw")]).drop("fields")
    state = pages.agg(F.max("page").alias("last"), F.count_if(F.col("page") > 0).alias("n")).first()
    missing = named.join(details, "external_id", "left_anti").count()
    why = "no result pages" if not state["n"] else f"stopped after {max_pages} pages" if state["last"] > max_pages else f"{missing} named listings not there" if missing else None
    return Reading(out, out.select("url"), why)


class _Cards(files._Page):
    """Cards of a result page: elements whose class names the card, else articles."""

    def __init__(self, mark: str) -> None:
        super().__init__()
        self.mark, self.depth, self.cards = mark, 0, []
        self.stack: list[tuple[str, bool]] = []

    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in self.VOID:
            begins = not self.depth and (self.mark in (a.get("class") or "") if self.mark else tag == "article")
            self.stack.append((tag, begins))
            if begins:
                self.depth = len(self.stack)
                self.cards.append({"href": None, "title": "", "text": "", "in_link": False})
        if self.depth and tag == "a" and a.get("href") and self.cards[-1]["href"] is None:
            self.cards[-1].update(href=a["href"], in_link=True)

    def handle_endtag(self, tag):
        if self.depth and tag == "a":
            self.cards[-1]["in_link"] = False
        while self.stack and any(t == tag for t, _ in self.stack):
            t, begins = self.stack.pop()
            if begins:
                self.depth = 0
            if t == tag:
                break

    def handle_data(self, data):
        if self.depth:
            self.cards[-1]["text"] += " " + data
            if self.cards[-1]["in_link"]:
                self.cards[-1]["title"] += data


_PRICE = re.compile(r"\d[\d.\s]*(?:,\d+)?\s*(?:€|EUR)(?:\s*VB)?|\bVB\b", re.I)


def card_rows(html: str, base: str, mark: str = "aditem") -> list[tuple]:
    """(url, title, price_raw) of a result page's cards; a card without a link is none."""
    for m in (mark, ""):
        p = _Cards(m)
        p.feed(html or "")
        if p.cards:
            break
    out = []
    for c in p.cards:
        url = files.join_url(base, c["href"]) if c["href"] else None
        if url:
            price = _PRICE.search(" ".join(c["text"].split()))
            out.append((url, " ".join(c["title"].split()) or None, price[0].strip() if price else None))
    return out


def result_cards(pages: DataFrame, mark: str = "aditem") -> DataFrame:
    """Stub listings of result pages, a URL once."""

    def per_batch(batches):
        for b in batches:
            yield pd.DataFrame([r for u, h in zip(b["url"], b["html"], strict=True) for r in card_rows(h, u, mark)], columns=["url", "title", "price_raw"], dtype="object")

    return pages.select("url", "html").mapInPandas(per_batch, "url string, title string, price_raw string").groupBy("url").agg(F.min("title").alias("title"), F.min("price_raw").alias("price_raw"))


def search_stubs(results: DataFrame) -> DataFrame:
    """Answers of a web search (url, title, snippet) as stubs: a page on the web once, nothing but its headline and snippet."""
    ok = results.filter(F.col("url").rlike("^https?://"))
    return ok.groupBy("url").agg(F.min("title").alias("title"), F.min("snippet").alias("description"))


# Ligatures, and stems of words that are spelled with one.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
STEMS = (
    "fläch", "flach", "pflicht", "pfleg", "pflanz", "pflast", "flur", "fliese", "flügel", "fluss", "flieg", "flug", "flex", "aufl", "einfl", "find", "profit", "finanz", "firm", "fisch", "fix", "grafi", "defini",
    "effizien", "offizi", "offen", "öffn", "öffentl", "stoff", "griff", "treff", "schaff", "hoff", "pfeff", "trefflich", "stoffl",
)
_WORD = re.compile(r"[^\W\d_]+")


def recover_ligatures(text: str) -> tuple[str, dict[str, str]]:
    """Spelled-out ligatures, and which stray letters were read as which.

    A letter above Latin-1 inside words is read as the one ligature that makes the most of its words hold a known stem around it; without a
    single best reading it stays.
    """
    for glyph, plain in LIGATURES.items():
        text = text.replace(glyph, plain)
    words: dict[str, set[str]] = {}
    for word in set(_WORD.findall(text)):
        for ch in word:
            if ord(ch) > 0xFF:
                words.setdefault(ch, set()).add(word.lower())
    read: dict[str, str] = {}
    for glyph, of in words.items():
        votes = {}
        for plain in ("ffi", "ffl", "ff", "fi", "fl"):
            # the stem must reach over the whole ligature: with it left out, the stem breaks apart
            votes[plain] = sum(any(w.replace(glyph.lower(), "\0").find(s.replace(plain, "\0", 1)) >= 0 for s in STEMS if plain in s) for w in of)
        best = max(votes.values())
        if best and sum(v == best for v in votes.values()) == 1:
            read[glyph] = max(votes, key=votes.get)
    for glyph, plain in read.items():
        text = text.replace(glyph, plain)
    return text, read


_NEEDS_SCRIPT = re.compile(r"javascript|enable cookies|noscript", re.I)
LEAST_TEXT, MOST_SHELL, LONGEST_TITLE, LEAST_SLUG = 80, 600, 160, 18


def headline_by_slug(lines: list[str], url: str) -> str | None:
    """The line that the last part of the URL spells, on at least eighteen characters."""
    slug = re.sub(r"[^a-z0-9]+", "", re.sub(r"\.[a-z]+$", "", (url or "").rstrip("/").rpartition("/")[2].casefold()))
    for x in lines:
        bare = re.sub(r"[^a-z0-9]+", "", "".join({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.get(c, c) for c in x.casefold()))
        if len(bare) >= LEAST_SLUG and len(slug) >= LEAST_SLUG and (slug.startswith(bare) or bare.startswith(slug)):
            return x
    return None


def paste_facts(url: str, text: str) -> dict:
    """A pasted page or text as a raw listing; ``refused`` says why it is none (a bot wall, or a page that its scripts should fill)."""
    if text.lstrip().startswith("<"):
        f = files.page_facts(url, text)
        out = {"title": f["title"], "description": f["text"], "images": f["images"], "fields": f["fields"], "warnings": []}
    else:
        clean, read = recover_ligatures(text)
        lines = [x.strip() for x in clean.splitlines()]
        some = [x for x in lines if x]
        plain = [x for x in some if any(c.isalpha() for c in x) and files._folded(x) not in files.UTILITY_HEADINGS and not _NEEDS_SCRIPT.search(x)]
        title = headline_by_slug(some, url) or (plain or some or [None])[0]
        if title and len(title) > LONGEST_TITLE:
            title = title[:LONGEST_TITLE].rstrip() + "..."
        pictures = list(dict.fromkeys(re.findall(r"https?://\S+?\.(?:jpe?g|png|webp)\b", clean, re.I)))
        out = {"title": title, "description": clean.strip() or None, "images": pictures, "fields": files.labelled_fields(lines), "warnings": [f"{g} read as {p}" for g, p in sorted(read.items())]}
    body = out["description"] or ""
    shell = not out["fields"] and (len(body) < LEAST_TEXT or (len(body) < MOST_SHELL and bool(_NEEDS_SCRIPT.search(body))))
    wall = re.search("captcha|are you a robot|access denied|zugriff verweigert|checking your browser", body[:5000], re.I)
    out["refused"] = "bot wall" if wall else "needs scripts" if shell and text.lstrip().startswith("<") else None
    return out


def pasted(texts: DataFrame) -> DataFrame:
    """``texts``: url, text.  Raw listings with warnings and ``refused``."""
    names = ("title", "description", "images", "fields", "warnings", "refused")

    def per_batch(batches):
        for b in batches:
            facts = [paste_facts(u, t or "") for u, t in zip(b["url"], b["text"], strict=True)]
            yield pd.DataFrame({"url": b["url"], **{n: [f[n] for f in facts] for n in names}})

    out = texts.select("url", "text").mapInPandas(per_batch, "url string, title string, description string, images array<string>, fields map<string,string>, warnings array<string>, refused string")
    return out.select("url", "title", "description", F.col("images").alias("image_urls"), *[F.try_element_at("fields", F.lit(f)).alias(f) for f in ("price_raw", "land_raw", "living_raw", "usable_raw", "rooms_raw", "year_raw", "location_raw")], "warnings", "refused")


def reads_like_a_place(c: Column) -> Column:
    """A short name in capitals-first words, without digits, that isn't a portal's function."""
    shape = c.rlike(r"^(?:[A-ZÄÖÜ][a-zäöüß]+\.?)(?:[ -](?:an|am|im|in|bei|ob|der|dem|a\.d\.|[A-ZÄÖÜ][a-zäöüß]+))*$")
    return F.coalesce(shape & (F.length(c) <= 40) & ~normalize_text(c).isin(*files.UTILITY_HEADINGS), F.lit(False))
