"""Listings by board type: selector rules evaluated on the page row.

Each board type is a short list of formats. The formats of a type are tried in
order and the first that yields listings wins; the last one reads a page that
shows a single job. A comma in a selector means "first in document order".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import page as pg
from ..functions import urls
from ..functions.page import Page, empty_if_null, first, let, listing
from ..sources.dom import CONTENT, WHOLE

# Selectors of a page that shows one job.
# ats: title, description, location
DETAIL_PAGES = {
    "greenhouse": ("#header h1.app-title, #app_body h1", "#content div#app_body, #content .section", ".location"),
    "lever": ("div.posting-headline h2", "div.content", "div.posting-categories .location"),
    "ashby": (
        "h1",
        "div[class*='posting'], main, article",
        ".ashby-job-posting-brief-details, span[class*='location']",
    ),
    "workday": (
        "h1[data-automation-id='jobPostingHeader'], h1",
        "div[data-automation-id='jobPostingDescription'], div[class*='job-description'], main",
        "span[data-automation-id='location'], dd[data-automation-id='locations']",
    ),
    "avature": ("h1.title, h1", ".article__body, main, article", ".list-item-location, .job-location"),
    "oracle_hcm": (
        "h1[class*='job-title'], h1",
        "[class*='job-description'], main",
        "[aria-label='Locations'], [class*='location']",
    ),
}
# Card containers of unknown boards, in order of trust.
GENERIC_CARDS = [
    "li[class*='job']",
    "div[class*='job']",
    "article[class*='job']",
    "tr[class*='job']",
    "li[class*='position']",
    "div[class*='position']",
    "li[class*='opening']",
    "div[class*='opening']",
    "div[class*='posting']",
]
# Selectors inside the cards of the board types below, and their hosts.
GREENHOUSE_NEW, GREENHOUSE_OLD = "https://job-boards.greenhouse.io", "https://boards.greenhouse.io"
IBM_HOST = "https://careers.ibm.com"


def _each(cards: Column, build) -> Column:
    return F.array_compact(F.transform(cards, build))


def _with_link(page: Page, card: Column, css: str, build) -> Column:
    """``build`` on the first link of a card; no link, no listing."""
    return let(page.select_one(css, card), lambda a: F.when(a.isNotNull(), build(a)))


def middle_segment(details: Column) -> Column:
    """Second part of a dotted details line, or the whole line when undotted."""
    parts = F.transform(F.split(F.replace(details, F.lit("•"), F.lit("·")), "·"), urls.strip)
    return let(parts, lambda p: F.when(F.size(p) >= 2, F.get(p, 1)).otherwise(details))


def _greenhouse(page: Page, base: Column) -> list[Column]:
    def row(card: Column) -> Column:
        def build(a: Column) -> Column:
            lines = F.transform(page.select("p", a), lambda p: page.text(p))
            url = urls.prefix_host(GREENHOUSE_NEW, a["href"])
            return let(
                lines,
                lambda ls: listing(F.coalesce(first(ls), page.text(a)), empty_if_null(F.get(ls, 1)), url),
            )

        return _with_link(page, card, "a[href]", build)

    def opening(card: Column) -> Column:
        return _with_link(
            page,
            card,
            "a[href]",
            lambda a: listing(
                page.text(a), page.text_of(".location", card), urls.prefix_host(GREENHOUSE_OLD, a["href"])
            ),
        )

    openings = F.flatten(F.transform(page.select("section.level-0"), lambda s: page.select("div.opening", s)))
    return [_each(page.select("tr.job-post"), row), _each(openings, opening)]


def _lever(page: Page, base: Column) -> list[Column]:
    def posting(card: Column) -> Column:
        def build(a: Column) -> Column:
            title = let(page.select_one("h5", a), lambda h: F.coalesce(page.text(h), page.text(a)))
            return listing(title, page.text_of(".location, .sort-by-location", card), a["href"])

        return _with_link(page, card, "a.posting-title[href]", build)

    return [_each(page.select("div.posting"), posting)]


def _around(page: Page, node: Column, test) -> Column:
    """Nearest ancestor that passes ``test``: parent numbers are followed, a node's depth is the work."""
    up = lambda n: F.get(page.nodes, n["parent"])
    climbed = F.aggregate(
        F.sequence(F.lit(1), F.greatest(node["depth"], F.lit(1))),
        up(node),
        lambda n, _: F.when(n.isNull() | test(n), n).otherwise(up(n)),
    )
    return let(climbed, lambda n: F.when(n.isNotNull() & test(n), n))


def _ashby(page: Page, base: Column) -> list[Column]:
    def brief(card: Column) -> Column:
        link = F.coalesce(
            _around(page, card, lambda n: (n["tag"] == "a") & n["href"].isNotNull()), page.select_one("a[href]", card)
        )
        url = urls.resolve(base, empty_if_null(link["href"]))
        location = let(page.text_of(".ashby-job-posting-brief-details", card), middle_segment)
        return let(
            page.select_one(".ashby-job-posting-brief-title", card),
            lambda t: F.when(t.isNotNull(), listing(page.text(t), location, url)),
        )

    return [_each(page.select("div.ashby-job-posting-brief"), brief)]


def _workday(page: Page, base: Column) -> list[Column]:
    places = "dd[data-automation-id='locations'], dl[data-automation-id='workerSubType'], span[class*='location']"

    def titled(a: Column) -> Column:
        box = F.coalesce(_around(page, a, lambda n: n["tag"] == "li"), _around(page, a, lambda n: n["tag"] == "div"))
        location = let(box, lambda b: F.when(b.isNotNull(), page.text_of(places, b)))
        return listing(page.text(a), empty_if_null(location), urls.resolve(base, empty_if_null(a["href"])))

    def item(card: Column) -> Column:
        spans = page.select("span", card)
        last = let(spans, lambda s: F.when(F.size(s) > 0, let(F.element_at(s, -1), lambda n: page.text(n))))
        return _with_link(
            page,
            card,
            "a[href]",
            lambda a: let(
                page.text(a),
                lambda t: F.when(F.length(t) >= 3, listing(t, empty_if_null(last), urls.resolve(base, a["href"]))),
            ),
        )

    return [_each(page.select("a[data-automation-id='jobTitle']"), titled), _each(page.select("li[class]"), item)]


def _avature(page: Page, base: Column) -> list[Column]:
    def result(card: Column) -> Column:
        return _with_link(
            page,
            card,
            "h3 a.link[href], .article__header__text__title a[href]",
            lambda a: listing(
                page.text(a),
                page.text_of(".list-item-location, .article__header__text__subtitle span", card),
                urls.resolve(base, a["href"]),
            ),
        )

    return [_each(page.select("article.article--result"), result)]


def _oracle_hcm(page: Page, base: Column) -> list[Column]:
    def tile(card: Column) -> Column:
        def location(items: Column) -> Column:
            labelled = F.transform(items, lambda li: page.select_one("[aria-label='Locations']", li))
            place = let(first(F.array_compact(labelled)), lambda n: F.when(n.isNotNull(), page.text(n)))
            fallback = let(first(items), lambda n: F.when(n.isNotNull(), page.text(n)))
            return let(place, lambda t: F.coalesce(F.when(t != "", t), fallback, F.lit("")))

        link = page.select_one("a.job-grid-item__link[href], a[href*='/job/']", card)
        url = let(link, lambda a: F.when(a.isNull(), base).when(a["href"] == "", "").otherwise(urls.resolve(base, a["href"])))
        summary = page.text_of("[class*='job-tile__description'], [class*='job-description']", card)
        return let(
            page.select_one("span.job-tile__title, [class*='job-tile__title']", card),
            lambda t: F.when(
                t.isNotNull(),
                listing(page.text(t), let(page.select("li.job-list-item__job-info-item", card), location), url, summary),
            ),
        )

    return [_each(page.select("div.job-tile"), tile)]


def _ibm(page: Page, base: Column) -> list[Column]:
    def card_listing(card: Column) -> Column:
        return _with_link(
            page,
            card,
            "h3.article__header__text__title a.link",
            lambda a: listing(
                page.text(a),
                page.text_of("span.card-item-location", card),
                urls.prefix_host(IBM_HOST, empty_if_null(a["href"])),
            ),
        )

    return [_each(page.select("article.article--card"), card_listing)]


def _generic(page: Page, base: Column) -> list[Column]:
    def card_listing(card: Column) -> Column:
        def build(a: Column) -> Column:
            title = let(page.text(a, " "), lambda t: F.when(t != "", t).otherwise(page.text(card, " ")))
            place = first(
                page.where(
                    lambda n: n["tag"].isin("span", "div", "p")
                    & F.concat(n["classes"], n["id"]).rlike(rules.GENERIC_LOCATION_CLASS),
                    card,
                )
            )
            location = let(place, lambda n: F.when(n.isNotNull(), page.text(n, " ")))
            return listing(title, empty_if_null(location), urls.resolve(base, a["href"]))

        return _with_link(page, card, "a[href]", build)

    def cards(rest: list[str]) -> Column:
        """First selector with two cards; the last one is taken as it is."""
        here = page.select(rest[0])
        if len(rest) == 1:
            return here
        return let(here, lambda c: F.when(F.size(c) >= 2, c).otherwise(cards(rest[1:])))

    return [_each(cards(GENERIC_CARDS), card_listing), F.array(_whole_page(page, base))]


def _whole_page(page: Page, base: Column) -> Column:
    title = F.coalesce(page.select_one("h1"), page.select_one("h2"))
    body = F.coalesce(page.select_one("main"), page.select_one("article"), page.select_one("body"))
    text = let(body, lambda n: F.when(n.isNotNull(), page.text(n, " ")))
    return listing(
        let(title, lambda n: F.when(n.isNotNull(), page.text(n, " ")).otherwise("Unknown Position")),
        F.lit(""),
        base,
        empty_if_null(text),
    )


def _detail_page(ats: str, page: Page, base: Column) -> Column:
    title, description, location = DETAIL_PAGES[ats]
    text = page.text_of(description, sep=" ")
    place = page.text_of(location)
    if ats == "ashby":
        place = let(place, middle_segment)
    job = let(
        page.select_one(title),
        lambda t: F.when(t.isNotNull(), listing(page.text(t), place, base, text)),
    )
    return F.array_compact(F.array(job))


BOARDS = {
    "greenhouse": _greenhouse,
    "lever": _lever,
    "ashby": _ashby,
    "workday": _workday,
    "avature": _avature,
    "oracle_hcm": _oracle_hcm,
    "ibm": _ibm,
    "generic": _generic,
}


def board_listings(ats: str) -> Column:
    """``ARRAY<listing>`` of the current page row read as a board of one type."""
    page = Page(F.col("nodes"), F.col("texts"), CONTENT if ats == rules.GENERIC else WHOLE)
    base = F.col("url")
    formats = BOARDS[ats](page, base)
    if ats in DETAIL_PAGES:
        formats.append(_detail_page(ats, page, base))

    def first_filled(rest: list[Column]) -> Column:
        if len(rest) == 1:
            return rest[0]
        return let(rest[0], lambda found: F.when(F.size(found) > 0, found).otherwise(first_filled(rest[1:])))

    return first_filled(formats)


def rule_listings(types: list[str] | None = None) -> Column:
    """``ARRAY<listing>`` of the current page row, read as a board of its type ``ats``; one branch per type."""
    found = F.when(F.lit(False), F.array().cast(f"ARRAY<{pg.LISTING}>"))
    for ats in types or list(BOARDS):
        found = found.when(F.col("ats") == ats, board_listings(ats))
    return found


def by_rules(
    parsed: DataFrame, types: list[str] | None = None, carry: tuple[str, ...] = (), max_chars: int | None = None
) -> DataFrame:
    """Listings of pages whose ``ats`` is known: one pass, one branch per type.

    ``parsed(page_id, url, ats, nodes, texts)`` to ``(page_id, url, ats, ord,
    title, description, location, job_url)``. ``types`` limits the branches,
    ``carry`` names page columns to keep. Descriptions are whole unless
    ``max_chars`` cuts them.
    """
    return numbered(parsed.select("page_id", "url", "ats", *carry, rule_listings(types).alias("jobs")), carry, max_chars)


def numbered(found: DataFrame, carry: tuple[str, ...] = (), max_chars: int | None = None) -> DataFrame:
    """The listings of pages ``(page_id, url, ats, *carry, jobs)`` one per row, in their order."""
    description = F.substring("job.description", 1, max_chars) if max_chars else F.col("job.description")
    return (
        found.select("page_id", "url", "ats", *carry, F.posexplode_outer("jobs").alias("ord", "job"))
        .filter(F.col("job").isNotNull())
        .select(
            "page_id",
            "url",
            "ats",
            *carry,
            (F.col("ord") + 1).cast("long").alias("ord"),
            "job.title",
            description.alias("description"),
            "job.location",
            F.col("job.url").alias("job_url"),
        )
    )
