"""Job listings from parsed pages: any board, and direct links to known boards.

Per-link work (card, title, location) is an expression over the page row.
Choosing among links (groups, minimum counts, first of duplicates) is windows
over small link rows, all partitioned by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import page as pg
from ..functions import urls
from ..functions.text import let
from ..sources.dom import LINE_CHARS, LINE_TAGS, WHOLE

HEADINGS = ("h1", "h2", "h3", "h4")


# --- location from a text -----------------------------------------------------
def location_from_text(text: Column) -> Column:
    """The location part of a separated line, or a short location-like text."""
    is_place = lambda s: s.rlike(rules.BOARD_LOCATION_TEXT) & (F.length(s) < 60)
    separators = F.array(*[F.lit(s) for s in rules.LOCATION_SEPARATORS])

    def located(t: Column, sep: Column) -> Column:
        parts = F.transform(F.split(F.replace(t, sep, F.lit("\x01")), "\x01"), urls.strip)
        part = pg.empty_if_null(pg.first(F.filter(parts, is_place)))
        return F.when(sep.isNotNull(), part).when(is_place(t), t).otherwise("")

    return let(text, lambda t: let(pg.first(F.filter(separators, t.contains)), lambda sep: located(t, sep)))


# --- any board -------------------------------------------------------------------
def _card(page: pg.Page, anchor: Column) -> Column:
    """The smallest element that stands for one job.

    The link itself if it holds a heading; otherwise the nearest ancestor that
    holds a heading or other text, unless a layout element comes first.
    """

    def step(state: Column, _: Column) -> Column:
        def look(n: Column) -> Column:
            own = F.when((n["pre"] == anchor["parent"]) & (anchor["tlen"] > 0), 1).otherwise(0)
            stop = n["tag"].isin(rules.CARD_STOP_TAGS)
            card = stop | (n["heads"] > 0) | (n["kids"] - own > 0)
            hit = F.when(stop, anchor["parent"]).when(card, n["pre"])
            return F.struct(n["parent"].alias("at"), hit.alias("hit"))

        over = state["hit"].isNotNull() | (state["at"] < 0)
        return F.when(over, state).otherwise(let(page.node(state["at"]), look))

    start = F.struct(anchor["parent"].alias("at"), F.lit(None).cast("int").alias("hit"))
    climbed = F.aggregate(F.sequence(F.lit(1), anchor["depth"]), start, step, lambda s: s["hit"])
    return page.node(F.when(anchor["heads"] > 0, anchor["pre"]).otherwise(F.coalesce(climbed, anchor["parent"])))


def _is_title(text: Column, max_chars: int | None) -> Column:
    good = (text != "") & ~text.rlike(rules.BOARD_NAV_NOISE)
    return good & (F.length(text) <= max_chars) if max_chars else good


def _card_title(page: pg.Page, found: Column, card: Column, anchor: Column, max_chars: int | None) -> Column:
    """First heading of each level among those ``found`` in the card, else the link text, else the first real text."""

    def usable(text: Column) -> Column:
        return let(text, lambda t: F.when(_is_title(t, max_chars), t))

    def by_level(found: Column) -> Column:
        def of_level(tag: Column) -> Column:
            heading = pg.first(F.filter(found, lambda h: h["tag"] == tag))
            return let(heading, lambda h: usable(page.text(h)))

        levels = F.transform(F.array(*[F.lit(tag) for tag in HEADINGS]), of_level)
        return F.when(F.size(found) > 0, pg.first(F.array_compact(levels)))

    piece = pg.first(
        F.filter(page.pieces(card), lambda t: (t["noise"] <= page.level) & _is_title(t["s"], max_chars) & (F.length(t["s"]) > 4))
    )
    return F.coalesce(let(found, by_level), usable(page.text(anchor, " ")), piece["s"], F.lit(""))


def board_links(max_title: int | None = rules.MAX_TITLE_CHARS) -> Column:
    """Job links of the current page row with their title and location.

    A longer text than ``max_title`` is no title (None: any length is one).
    """
    page = pg.board_page()
    base = F.col("url")

    def job(anchor: Column, headings: Column, places: Column, lines: Column, site: Column) -> Column:
        def with_card(card: Column) -> Column:
            place = pg.first(page.ranked(places, "place_rank", card))
            line = pg.first(F.filter(page.ranked(lines, "line_rank", card), lambda location: location != ""))
            location = let(
                place,
                lambda p: F.when(p.isNotNull(), location_from_text(page.text(p))).otherwise(pg.empty_if_null(line)),
            )
            return F.struct(
                anchor["pre"].alias("pre"),
                anchor["href"].alias("href"),
                urls.canonical(urls.resolve_in(site, anchor["href"])).alias("job_url"),
                _card_title(page, page.ranked(headings, "head_rank", card), card, anchor, max_title).alias("title"),
                location.alias("location"),
            )

        return let(_card(page, anchor), with_card)

    def links(domain: Column) -> Column:
        return page.where(lambda n: (n["tag"] == "a") & n["href"].isNotNull() & urls.is_job_url(n["href"], domain))

    headings = page.where(lambda n: n["tag"].isin(*HEADINGS))
    places = page.where(lambda n: F.concat(n["classes"], n["id"]).rlike(rules.BOARD_LOCATION_CLASS))
    short = page.where(lambda n: n["tag"].isin(*LINE_TAGS) & n["tlen"].between(1, LINE_CHARS))
    lines = F.transform(short, lambda n: location_from_text(page.text(n)))
    found = let(urls.netloc(base), links)

    def jobs(anchors: Column) -> Column:
        """Page-wide lists are bound once, and only when there is a link at all."""
        described = let(
            F.struct(headings.alias("headings"), places.alias("places"), lines.alias("lines"), urls.split(base).alias("site")),
            lambda c: F.transform(anchors, lambda a: job(a, c["headings"], c["places"], c["lines"], c["site"])),
        )
        return F.when(F.size(anchors) > 0, described)

    return let(found, jobs)


def universal(
    parsed: DataFrame,
    min_jobs: int = rules.MIN_BOARD_LINKS,
    carry: tuple[str, ...] = (),
    max_title: int | None = rules.MAX_TITLE_CHARS,
) -> DataFrame:
    """Listings of any job board: ``(page_id, url, ord, title, description, location, job_url)``.

    ``carry`` names page columns to keep; ``grouped_links`` says which links count, ``board_links``
    what ``max_title`` is.
    """
    found = parsed.select("page_id", "url", *carry, board_links(max_title).alias("links"))
    return grouped_links(found, min_jobs, carry)


def grouped_links(
    found: DataFrame, min_jobs: int = rules.MIN_BOARD_LINKS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Listings among the ``board_links`` of each page, ``found(page_id, url, *carry, links)``.

    Links are grouped by their leading path. The biggest group of at least
    ``min_jobs`` links decides; groups with the same top-level path join it.
    Without any such group every job link counts. The first link to a job wins,
    even when it turns out to have no title.
    """
    links = (
        found.select("page_id", "url", *carry, F.inline_outer("links"))
        .filter(F.col("pre").isNotNull())
        .withColumn("pattern", urls.base_pattern(F.col("href")))
        .repartition("page_id")
    )
    group = Window.partitionBy("page_id", "pattern")
    page = Window.partitionBy("page_id")
    counted = links.withColumn("n", F.count(F.lit(1)).over(group)).withColumn("since", F.min("pre").over(group))
    is_group = F.col("n") >= min_jobs
    # Bigger groups first, then the group seen first.
    best = F.min(F.when(is_group, F.struct((-F.col("n")).alias("n"), "since", "pattern"))).over(page)
    chosen = counted.withColumn("best", best).filter(
        F.col("best").isNull()
        | (is_group & (urls.base_pattern(F.col("pattern")) == urls.base_pattern(F.col("best.pattern"))))
    )
    in_order = [F.when(F.col("best").isNull(), 0).otherwise(-F.col("n")),
                F.when(F.col("best").isNull(), 0).otherwise(F.col("since")), F.col("pre")]
    once = chosen.withColumn(
        "nth", F.row_number().over(Window.partitionBy("page_id", "job_url").orderBy(*in_order))
    ).filter((F.col("nth") == 1) & (F.col("title") != ""))
    return once.select(
        "page_id",
        "url",
        *carry,
        F.row_number().over(page.orderBy(*in_order)).cast("long").alias("ord"),
        "title",
        F.lit("").alias("description"),
        "location",
        "job_url",
    )


# --- boards embedded in a page ------------------------------------------------------
def embedded_board(html: Column) -> Column:
    """First known board URL in a double-quoted ``src``: ``STRUCT<board_url, ats>`` or NULL."""
    options = []
    for ats, pattern in rules.EMBED_PATTERNS:
        url = F.regexp_extract(html, pattern, 1)
        named = urls.strip_embed(url) if ats == "ashby" else url
        options.append(F.when(html.rlike(pattern), F.struct(named.alias("board_url"), F.lit(ats).alias("ats"))))
    return F.coalesce(*options)


# --- direct links ----------------------------------------------------------------------
UUID_RULE = len(rules.DIRECT_LINK_PATTERNS) + 1


def link_rules(href: Column) -> Column:
    """Numbers of all link rules an href satisfies; self-hosted links come last."""
    hits = [F.when(href.rlike(p), i) for i, (_, p) in enumerate(rules.DIRECT_LINK_PATTERNS, 1)]
    hits.append(F.when(urls.is_uuid_href(href), UUID_RULE))
    return F.array_compact(F.array(*hits))


def _link_title(page: pg.Page, anchor: Column, children: Column) -> Column:
    texts = F.transform(children, lambda n: page.text(n))
    good = F.filter(texts, lambda t: (t != "") & ~t.rlike(rules.LINK_NAV_NOISE) & (F.length(t) > 3))
    own = urls.strip(F.regexp_replace(page.text(anchor), rules.LINK_TRAILING_NOISE, ""))
    return F.coalesce(pg.first(good), own)


def _section_heading(page: pg.Page, anchor: Column) -> Column:
    """Text of the nearest heading ahead of the link that is not around it; the page pass left a pointer to it."""
    return F.when(anchor["label"] >= 0, page.text(page.node(anchor["label"])))


def _link_location(page: pg.Page, anchor: Column, children: Column, title: Column) -> Column:
    marked = pg.first(page.where(lambda n: n["classes"].rlike(rules.LINK_LOCATION_CLASS), anchor))
    by_class = let(marked, lambda n: F.when(n.isNotNull(), page.text(n)))
    later = F.transform(F.slice(children, 2, F.greatest(F.size(children) - 1, F.lit(0))), lambda n: page.text(n))
    fits = F.filter(
        later,
        lambda t: (t != "")
        & (t != title)
        & ~t.rlike(rules.LINK_NAV_NOISE)
        & (F.length(t) > 1)
        & (t.rlike(rules.LINK_LOCATION_HINT) | (F.length(t) < 40)),
    )
    heading = let(_section_heading(page, anchor), lambda h: F.when(h.rlike(rules.LINK_LOCATION_HINT), h))
    not_empty = lambda c: let(c, lambda t: F.when(t != "", t))
    return F.coalesce(not_empty(by_class), pg.first(fits), heading, F.lit(""))


def matched_links() -> Column:
    """Links of the current page row that satisfy a link rule, noise included."""
    page = pg.Page(F.col("nodes"), F.col("texts"), WHOLE)
    base = F.col("url")

    def job(anchor: Column) -> Column:
        children = page.where(lambda n: n["tag"].isin("span", "div", "p"), anchor)
        href = anchor["href"]
        origin = F.concat(urls.scheme(base), F.lit("://"), urls.netloc(base))
        full = F.when(href.startswith("/"), F.concat(origin, href)).otherwise(href)

        def finish(title: Column, kids: Column) -> Column:
            return F.struct(
                anchor["pre"].alias("pre"),
                link_rules(href).alias("rules"),
                urls.canonical(full).alias("job_url"),
                title.alias("title"),
                F.when(title != "", _link_location(page, anchor, kids, title)).alias("location"),
            )

        return let(children, lambda kids: let(_link_title(page, anchor, kids), lambda title: finish(title, kids)))

    any_rule = "|".join(f"(?:{p})" for p in [*(p for _, p in rules.DIRECT_LINK_PATTERNS), rules.UUID_HREF])
    anchors = page.where(lambda n: (n["tag"] == "a") & n["href"].rlike(any_rule))
    return let(anchors, lambda found: F.when(F.size(found) > 0, F.transform(found, job)))


def _rule_ats(rule: Column) -> Column:
    names = [ats for ats, _ in rules.DIRECT_LINK_PATTERNS] + [rules.GENERIC]
    return F.element_at(F.array(*[F.lit(n) for n in names]), rule)


def direct_links(
    parsed: DataFrame, min_links: int = rules.MIN_DIRECT_LINKS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Listings linked from a page: ``(page_id, url, ats, ord, title, description, location, job_url)``.

    ``carry`` names page columns to keep; ``ruled_links`` says which links count.
    """
    found = parsed.select("page_id", "url", *carry, matched_links().alias("links"))
    return ruled_links(found, min_links, carry)


def ruled_links(
    found: DataFrame, min_links: int = rules.MIN_DIRECT_LINKS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Listings among the ``matched_links`` of each page, ``found(page_id, url, *carry, links)``.

    A rule needs ``min_links`` matching links, counted before duplicates and
    untitled links are dropped; the first rule with any listing wins the page.
    """
    links = (
        found.select("page_id", "url", *carry, F.inline_outer("links"))
        .filter(F.col("pre").isNotNull())
        .withColumn("rule", F.explode_outer("rules"))
        .repartition("page_id")
    )
    per_rule = Window.partitionBy("page_id", "rule")
    titled = links.withColumn("n", F.count(F.lit(1)).over(per_rule)).filter(
        (F.col("n") >= min_links) & (F.col("title") != "")
    )
    winner = titled.withColumn("first_rule", F.min("rule").over(Window.partitionBy("page_id"))).filter(
        F.col("rule") == F.col("first_rule")
    )
    nth = F.row_number().over(Window.partitionBy("page_id", "job_url").orderBy("pre"))
    return winner.withColumn("nth", nth).filter(F.col("nth") == 1).select(
        "page_id",
        "url",
        *carry,
        _rule_ats(F.col("rule")).alias("ats"),
        F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).cast("long").alias("ord"),
        "title",
        F.lit("").alias("description"),
        "location",
        "job_url",
    )
