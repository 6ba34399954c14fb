"""Table functions of a session: pages, court tables and labelled lines read in SQL, next to their other columns by LATERAL.

    SELECT p.page_id, l.title, l.fields['price_raw'] FROM pages p, LATERAL ll_page(p.url, p.html) l WHERE l.page_kind = 'listing'

A page that can't be read gives one row with ``error``, so one bad page fails no query.  Null texts give no row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PAGE = "title string, text string, n_links int, siblings int, images array<string>, fields map<string,string>, declared string, page_kind string, error string"
COURT = "url string, external_id string, title string, price_raw string, auction_date string, location_raw string, error string"


class Page:
    """What ``files.lift_pages`` reads of a page, one row."""

    def eval(self, url: str, html: str):
        from ..sources import files

        if html is None:
            return
        try:
            f = files.page_facts(url, html)
        except (ValueError, RecursionError) as e:
            yield (None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        kind = f["declared"] or ("index" if f["siblings"] >= files.INDEX_LINKS else "listing")
        yield (f["title"], f["text"], f["n_links"], f["siblings"], f["images"], f["fields"], f["declared"], kind, None)


class Court:
    """The listings of a court's table, one row each."""

    def eval(self, url: str, html: str):
        from ..sources import files

        if html is None:
            return
        try:
            rows = files.court_rows(html, url)
        except (ValueError, RecursionError) as e:
            yield (None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for r in rows:
            yield (r["url"], r["external_id"], r["title"], r["price_raw"], r["auction_date"], r["location_raw"], None)


class Labelled:
    """field and value of each labelled line of a text."""

    def eval(self, text: str):
        from ..sources import files

        for field, value in files.labelled_fields((text or "").splitlines()).items():
            yield field, value


def register(spark: SparkSession) -> list[str]:
    """Define the table functions for the session; gives their names."""
    made = {"ll_page": F.udtf(Page, returnType=PAGE), "ll_court": F.udtf(Court, returnType=COURT), "ll_labelled": F.udtf(Labelled, returnType="field string, value string")}
    for name, f in made.items():
        spark.udtf.register(name, f)
    return list(made)
