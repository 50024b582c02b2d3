"""Captured result pages -> listing cards; scans -> deduped listings.

Elements are found in a parsed tree (``sources.htmltree``) inside one
``mapInPandas`` step that returns raw texts; all rules on those texts (URL
allowlist, id, price, location test) are built-in expressions.

* cards are ``<article>`` elements, or on a page without any the anchors of
  listings themselves; a card needs a link: the first anchor whose href names
  a listing (``/recommerce/forsale/item/``, ``/bap/`` or ``finnkode=``), else
  the first anchor at all;
* the href is made absolute against the site root and must pass the host
  allowlist; the id comes from the URL;
* title: first ``h2``/``h3``/``data-testid="ad-title"`` text, else the link text;
* price: first of ``data-testid*="price"``, class ``t3``, span containing "kr";
* location: of five places in order, the first whose text passes the location rule;
* image: first ``img`` ``src`` (else ``data-src``), kept if allowed;
* description: first ``data-testid="description"`` or ``p`` text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import listing_id_from_url, location_text, parse_price
from pricelens.functions.urls import absolute_url, image_url_allowed, safe_listing_url
from pricelens.operators.attach import attach
from pricelens.params import ALLOWED_EXACT_HOSTS, ALLOWED_HOST_SUFFIXES, MIN_DETAIL_DESCRIPTION
from pricelens.sources.htmltree import Element, parse

_CARD = "page_id long, query string, page_num long, pos int, href string, heading string, link_text string, price_text string, locations array<string>, src string, description string"
#: What an href of a listing contains.
_LISTING_HREFS = ("/recommerce/forsale/item/", "/bap/", "finnkode=")


def _text(e: Element | None) -> str:
    return e.text() if e is not None else ""


def _card(card: Element) -> dict | None:
    """Raw texts of a card, None without a link."""
    a = card if card.tag == "a" else (
        card.first(lambda e: e.tag == "a" and any(h in e.get("href") for h in _LISTING_HREFS)) or card.first(lambda e: e.tag == "a"))
    if a is None or not a.get("href"):
        return None

    def between(e: Element) -> bool:
        return e.tag == "span" and e.parent.elements()[-1] is e and any(x.tag == "div" and "between" in x.get("class") for x in e.ancestors())

    places = (lambda e: e.get("data-testid") == "location", lambda e: "location" in e.get("class"), lambda e: "address" in e.get("class"),
              lambda e: e.tag == "span" and "text-caption" in e.get("class"), between)
    img = card.first(lambda e: e.tag == "img")
    return {
        "href": a.get("href"), "link_text": a.text(),
        "heading": _text(card.first(lambda e: e.tag in ("h2", "h3") or e.get("data-testid") == "ad-title")),
        "price_text": _text(card.first(lambda e: "price" in e.get("data-testid") or "t3" in e.classes() or (e.tag == "span" and "kr" in e.text().lower()))),
        "locations": [_text(card.first(p)) for p in places],
        "src": (img.get("src") or img.get("data-src")) if img is not None else "",
        "description": _text(card.first(lambda e: e.get("data-testid") == "description" or e.tag == "p")),
    }


def _raw_cards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in _CARD.split(", ")]
    for f in frames:
        for part in (f.iloc[i:i + 200] for i in range(0, len(f), 200)):
            rows = []
            for page_id, query, num, html in part.itertuples(index=False):
                root = parse(html)
                cards = [e for e in root.walk() if e.tag == "article"] or [
                    e for e in root.walk() if e.tag == "a" and (_LISTING_HREFS[0] in e.get("href") or e.get("id").startswith("bap-"))]
                rows += [{"page_id": page_id, "query": query, "page_num": num, "pos": pos, **c} for pos, c in enumerate(map(_card, cards)) if c]
            if rows:
                yield pd.DataFrame(rows, columns=names)


def page_cards(pages: DataFrame, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> DataFrame:
    """Listing cards of captured result pages: ``(page_id, query, page_num, pos,
    id, title, price_nok, url, location, image_urls, description)``."""
    raw = pages.select("page_id", "query", F.col("page_num").cast("long").alias("page_num"), "html").mapInPandas(_raw_cards, _CARD)
    src = F.col("src")
    images = F.when((src != "") & image_url_allowed(src, exact, suffixes), F.array(src)).otherwise(F.array().cast("array<string>"))
    out = raw.select(
        "page_id", "query", "page_num", "pos",
        safe_listing_url(absolute_url(F.col("href")), exact, suffixes).alias("url"),
        F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("link_text")).alias("title"),
        parse_price(F.col("price_text")).alias("price_nok"),
        F.coalesce(*[location_text(F.col("locations")[i]) for i in range(5)]).alias("location"),
        images.alias("image_urls"), "description")
    return (out.filter(F.col("url").isNotNull() & (F.col("title") != ""))
            .withColumn("id", listing_id_from_url("url")))


def page_links(pages: DataFrame, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> DataFrame:
    """Every anchor of every page: absolute URL, allowlisted URL and listing id."""
    a = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(r"<a\b[^>]*\shref=\"([^\"]*)\""), 1)).alias("pos", "href"))
    absu = absolute_url(F.col("href"))
    safe = safe_listing_url(absu, exact, suffixes)
    return a.select("page_id", "pos", "href", absu.alias("abs_url"), safe.alias("safe_url"),
                    F.when(safe.isNotNull(), listing_id_from_url(safe)).alias("listing_id"))


def dedupe_scan(cards: DataFrame, completeness: DataFrame | None = None) -> DataFrame:
    """First sighting of each id within a scan (by page, then position), as a
    partial aggregate; with ``completeness`` pages after the stop page, which
    the scan never loaded, are left out."""
    if completeness is not None:
        cards = (attach(cards, completeness.select("scan_id", "stop_page"), "scan_id", "id", "inner")
                 .filter(F.col("page_num") <= F.col("stop_page")).drop("stop_page"))
    rest = [c for c in cards.columns if c not in ("scan_id", "id", "page_num", "pos")]
    first = F.min(F.struct("page_num", "pos", *rest)).alias("f")
    return cards.groupBy("scan_id", "id").agg(first).select("scan_id", "id", "f.*")


def scan_completeness(cards: DataFrame, pages_loaded: DataFrame) -> DataFrame:
    """Per scan: complete iff some page after page 1 added no new id.

    ``pages_loaded`` lists ``(scan_id, page_num)`` of every page that loaded
    (a failed page is absent: skipped, not counted as empty).  The scan stops
    at the first such page, so later pages are ignored; ``pages_scanned`` is
    the page count up to and including the stop page."""
    first = (cards.groupBy("scan_id", "id").agg(F.min(F.struct("page_num", "pos")).alias("f"))
             .groupBy("scan_id", F.col("f.page_num").alias("page_num"))
             .agg(F.count(F.lit(1)).alias("new_ids")))
    per_page = (pages_loaded.select("scan_id", "page_num").distinct()
                .join(first, ["scan_id", "page_num"], "left")
                .withColumn("new_ids", F.coalesce("new_ids", F.lit(0))))
    empty_after_first = (F.col("page_num") > 1) & (F.col("new_ids") == 0)
    return per_page.groupBy("scan_id").agg(
        F.bool_or(empty_after_first).alias("complete"),
        F.coalesce(F.min(F.when(empty_after_first, F.col("page_num"))), F.max("page_num"))
        .alias("stop_page"))


def _detail(root: Element) -> tuple[str, str | None]:
    """Description and location of a detail page.

    The description is the first of five places (in order) with more than
    ``MIN_DETAIL_DESCRIPTION`` characters, else what stands beside the
    "Beskrivelse" heading in its section; the location the first of four
    places with a text, else what follows a label "Sted"."""

    def says(e: Element, word: str) -> bool:
        return word in e.text().lower() and not any(word in c.text().lower() for c in e.elements())

    pre = lambda e: "whitespace-pre-wrap" in e.classes()
    places = (lambda e: e.get("data-testid") == "description", lambda e: e.get("data-testid") == "ad-description-text",
              lambda e: e.tag == "div" and pre(e) and any(x.tag == "section" and x.first(lambda y: y.tag == "h2") for x in e.ancestors()),
              pre, lambda e: e.tag == "div" and "description" in e.get("class"))
    description = next((t for t in (_text(root.first(p)) for p in places) if len(t) > MIN_DETAIL_DESCRIPTION), "")
    if not description and (h := root.first(lambda e: e.tag in ("h2", "h3") and says(e, "beskrivelse"))) is not None:
        parent = next((x for x in h.ancestors() if x.tag == "section"), h.parent)
        description = parent.text().replace(h.text(), "", 1).strip()

    def after(tag: str, other: str, adjacent: bool) -> Element | None:
        for e in root.walk():
            if e.tag == tag and says(e, "sted"):
                found = [x for x in (e.siblings_after()[:1] if adjacent else e.siblings_after()) if x.tag == other]
                if found:
                    return found[0]
        return None

    def labelled() -> Element | None:
        for e in root.walk():
            if e.tag in ("dt", "th", "span", "div") and e.text() == "Sted" and e.siblings_after():
                return e.siblings_after()[0]
        return None

    spots = (lambda: root.first(lambda e: e.get("data-testid") == "object-address"),
             lambda: root.first(lambda e: e.tag == "span" and e.get("data-testid") == "location"),
             lambda: after("dt", "dd", True), lambda: after("th", "td", False), labelled)
    location = next((t for t in (_text(p()) for p in spots) if t), None)
    return description, location and location.split("\n")[0].strip()


def _raw_details(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        got = [(i, *_detail(parse(html))) for i, html in f.itertuples(index=False)]
        yield pd.DataFrame(got, columns=["page_id", "detail_description", "detail_location"])


def detail_fields(pages: DataFrame) -> DataFrame:
    """Description and location read from captured detail pages."""
    return pages.select("page_id", "html").mapInPandas(_raw_details, "page_id long, detail_description string, detail_location string")


def enrich_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Detail description replaces the card text when non-empty; the detail
    location is used only when the card had none."""
    j = listings.join(details, "page_id", "left")
    return (j.withColumn("description", F.coalesce(F.nullif(F.col("detail_description"), F.lit("")),
                                                   F.col("description")))
            .withColumn("location", F.coalesce(F.nullif(F.col("location"), F.lit("")),
                                               F.col("detail_location")))
            .drop("detail_description", "detail_location"))


def gallery(existing: Column, candidates: Column, exact=ALLOWED_EXACT_HOSTS,
            suffixes=ALLOWED_HOST_SUFFIXES, max_images: int = 8, min_width: int = 100) -> Column:
    """Gallery images from detail-page candidates ``array<struct<src, width>>``.

    In page order: skip blank sources and sources already seen (the existing
    images and every URL taken so far), skip thumbnails narrower than
    ``min_width`` (unknown width passes), upgrade the size segment, keep it if
    allowed.  The first ``max_images`` replace the existing list only when there
    is at least one.  What doesn't depend on the images seen is judged first;
    the fold stops at ``max_images``, so it is linear, and runs once."""
    from pricelens.functions.text import upgrade_image_url
    none = F.array().cast("array<string>")
    wide = lambda c: ~F.coalesce((c["width"] > 0) & (c["width"] < min_width), F.lit(False))
    named = F.filter(candidates, lambda c: (F.coalesce(c["src"], F.lit("")) != "") & wide(c))
    upgraded = F.transform(named, lambda c: F.struct(c["src"].alias("src"), upgrade_image_url(c["src"]).alias("up")))
    fit = F.filter(upgraded, lambda c: image_url_allowed(c["up"], exact, suffixes))
    zero = F.struct(F.coalesce(existing, none).alias("seen"), none.alias("out"))

    def step(acc, c):
        take = (F.size(acc["out"]) < max_images) & ~F.array_contains(acc["seen"], c["src"])
        return F.when(take, F.struct(F.array_append(acc["seen"], c["up"]).alias("seen"), F.array_append(acc["out"], c["up"]).alias("out"))).otherwise(acc)

    out = F.aggregate(fit, zero, step)["out"]
    return F.transform(F.array(out), lambda o: F.when(F.size(o) > 0, o).otherwise(F.coalesce(existing, none)))[0]
