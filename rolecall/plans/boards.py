"""End to end over tables: careers pages to listings, listings to matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..operators import boards as board_rules
from ..functions import urls
from ..operators import discover, enrich, extract, match, skew
from ..sources import dom

RAW, RENDERED, BOARD = "raw", "rendered", "board"


def _generic(careers: DataFrame) -> DataFrame:
    return careers.filter(F.col("ats") == rules.GENERIC).select("careers_url")


def read_pages(snapshots: DataFrame, mode: str = "universal") -> DataFrame:
    """Everything that any decision needs of a page, in one pass over the pages; written.

    ``snapshots(page_id, url, stage, html)`` to ``(page_id, url, stage, ats, embedded,
    links, jobs)``: the board embedded in a raw or rendered page, the direct links
    on it, and what a rendered page or a board lists, by the all-purpose extractor or
    (``mode='by_ats'``) by the rules of the types that its URL may stand for, a row each.
    HTML and elements end here: all that follows moves small rows. Of several
    snapshots of a (url, stage) the one of the smallest page_id counts.
    """
    if mode not in ("universal", "by_ats"):
        raise ValueError(f"unknown mode {mode!r}")
    careers, listing = F.col("stage").isin(RAW, RENDERED), F.col("stage").isin(RENDERED, BOARD)
    pages = snapshots.withColumn("embedded", F.when(careers, extract.embedded_board(F.col("html"))))
    parsed = dom.parse(pages, ("page_id", "url", "stage", "embedded"))
    keys = ["page_id", "url", "stage", "embedded"]
    if mode == "universal":
        read = parsed.withColumn("ats", F.lit(None).cast("string")).select(
            *keys, "ats", F.when(careers, extract.matched_links()).alias("links"), F.when(listing, extract.board_links()).alias("jobs")
        )
    else:
        types = F.array_distinct(F.array(urls.detect_ats(F.col("url")), *_embed_types(), F.when(F.col("stage") == RENDERED, rules.GENERIC)))
        types = F.when(listing, F.array_compact(types))
        typed = parsed.select(*keys, "nodes", "texts", F.posexplode_outer(types).alias("nth", "ats"))
        once = careers & (F.coalesce("nth", F.lit(0)) == 0)
        read = typed.select(*keys, "ats", F.when(once, extract.matched_links()).alias("links"), board_rules.rule_listings().alias("jobs"))
    read = skew.materialize(read)
    first = read.groupBy("url", "stage").agg(F.min("page_id").alias("page_id")).select("page_id")
    return read.join(first, "page_id", "left_semi")


def _embed_types() -> list[Column]:
    """Types of the boards that the page's URL would be taken for if it were embedded somewhere."""
    source = F.concat(F.lit('src="'), F.col("url"), F.lit('"'))
    return [F.when(source.rlike(pattern), ats) for ats, pattern in rules.EMBED_PATTERNS]


def board_decisions(careers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``decided`` for the pages of ``snapshots(page_id, url, stage, html)``."""
    pages = read_pages(snapshots)
    return decided(careers, pages, linked_listings(careers, pages))


def decided(careers: DataFrame, pages: DataFrame, linked: DataFrame) -> DataFrame:
    """Where the listings of each careers page come from.

    ``careers(careers_url, ats)`` distinct, ``read_pages`` and ``linked_listings`` of
    them to ``(careers_url, final_url, ats, kind, page_id)``. A known board
    is read itself. An unknown page is tried in this order: a board embedded
    in the raw page, direct links on it, the same two on the rendered page,
    and finally the rendered page as a board of its own.
    """
    known = careers.filter(F.col("ats") != rules.GENERIC).select(
        "careers_url", _option(0, F.col("careers_url"), F.col("ats"), BOARD, F.lit(None).cast("long")).alias("option")
    )
    rendered = F.when(F.col("stage") == RENDERED, 2).otherwise(0)
    embedded = (
        pages.filter(F.col("embedded").isNotNull())
        .select("url", "stage", F.col("embedded").alias("b"))
        .distinct()
        .join(_generic(careers).withColumnRenamed("careers_url", "url"), "url", "left_semi")
        .select("url", _option(rendered + 1, F.col("b.board_url"), F.col("b.ats"), BOARD, F.lit(None).cast("long")).alias("option"))
    )
    by_links = (
        linked.filter(F.col("ord") == 1)
        .select("url", _option(rendered + 2, F.col("url"), F.col("ats"), "links", F.col("page_id")).alias("option"))
    )
    own = _generic(careers).select(
        F.col("careers_url").alias("url"),
        _option(F.lit(5), F.col("careers_url"), F.lit(rules.GENERIC), RENDERED, F.lit(None).cast("long")).alias("option"),
    )
    options = known.unionByName(
        embedded.unionByName(by_links).unionByName(own).withColumnRenamed("url", "careers_url")
    )
    return options.groupBy("careers_url").agg(F.min("option").alias("o")).select(
        "careers_url", "o.final_url", "o.ats", "o.kind", "o.page_id"
    )


def _option(priority: Column, final_url: Column, ats: Column, kind: str, page_id: Column) -> Column:
    fields = [F.lit(priority) if isinstance(priority, int) else priority, final_url, ats, F.lit(kind), page_id]
    names = ["priority", "final_url", "ats", "kind", "page_id"]
    return F.struct(*[f.alias(n) for f, n in zip(fields, names)])


def linked_listings(careers: DataFrame, pages: DataFrame) -> DataFrame:
    """Direct-link listings of unknown pages among ``read_pages``, with the ``stage`` they came from."""
    asked = _generic(careers).withColumnRenamed("careers_url", "url")
    found = pages.filter(F.size("links") > 0).select("page_id", "url", "stage", "links").join(asked, "url", "left_semi")
    return extract.ruled_links(found, carry=("stage",))


def paged_listings(board_pages: DataFrame) -> DataFrame:
    """Listings of boards that go over several pages, numbered through all pages that count.

    ``board_pages(page_id, board_id, ats, url, page, status, html)``. Pages count up to
    the first failed or missing one and the first without a next link; their
    listings, read by the rules of the board type, follow each other.
    """
    parsed = dom.parse(board_pages, ("page_id", "board_id", "ats", "url", "page", "status"))
    found = skew.materialize(
        parsed.select("page_id", "board_id", "page", "status", discover.next_page_link().isNotNull().alias("has_next"))
    )
    good = discover.page_prefix(found).select("page_id", "board_id", "page")
    jobs = skew.materialize(
        board_rules.by_rules(parsed, carry=("board_id", "page")).join(good.select("page_id"), "page_id", "left_semi")
    )
    counts = good.join(jobs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), "page_id", "left")
    # One row per page: even a long board is a small window.
    ahead = F.sum(F.coalesce("n", F.lit(0))).over(
        Window.partitionBy("board_id").orderBy("page", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select("page_id", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return jobs.join(starts, "page_id").select(
        "board_id", "ats", F.col("board_id").alias("source_url"), (F.col("ord") + F.col("ahead")).alias("ord"),
        "title", "description", "location", F.col("job_url").alias("url"),
    )


def listings(
    careers: DataFrame,
    snapshots: DataFrame,
    mode: str = "universal",
    board_pages: DataFrame | None = None,
    lost: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Listings of every careers page, and error rows of those without any.

    ``listings(board_id, ats, source_url, ord, title, description, location,
    url)`` keyed by the careers page, ``errors(careers_url, stage, message)``.
    ``mode='by_ats'`` reads boards with the rules of their type instead of the
    all-purpose extractor. Boards in ``board_pages`` (see ``paged_listings``) are read
    over all their pages instead. ``lost(url, stage, message)`` names pages that no
    fetch attempt brought in: their error is that. Results come from one written table.
    """
    careers = careers.select("careers_url", "ats").distinct()
    pages = read_pages(snapshots, mode)
    linked = skew.materialize(linked_listings(careers, pages))
    decisions = skew.materialize(decided(careers, pages, linked))
    stage = F.when(F.col("kind") == RENDERED, RENDERED).otherwise(BOARD)
    wanted = decisions.filter(F.col("kind") != "links").select(F.col("final_url").alias("url"), stage.alias("stage"), "ats").distinct()
    if mode == "universal":
        chosen = pages.select("page_id", "url", "stage", F.col("jobs").alias("links"))
        read = extract.grouped_links(chosen.join(wanted, ["url", "stage"], "left_semi"), carry=("stage",))
    else:
        chosen = pages.select("page_id", "url", "stage", "ats", "jobs").join(wanted, ["url", "stage", "ats"], "left_semi")
        read = board_rules.numbered(chosen, carry=("stage",))
    read = read.withColumnRenamed("url", "final_url")
    jobs = ["ord", "title", "description", "location", "job_url"]
    from_pages = skew.spread_lookup(
        decisions.filter(F.col("kind") != "links").select("careers_url", "final_url", "ats", stage.alias("stage")),
        read.select("final_url", "stage", *jobs),
        ["final_url", "stage"],
        ["careers_url"],
    )
    from_links = decisions.filter(F.col("kind") == "links").join(linked.select("page_id", *jobs), "page_id")
    columns = ["careers_url", "ats", *jobs]
    found = from_pages.select(*columns).unionByName(from_links.select(*columns))
    shaped = found.select(
        F.col("careers_url").alias("board_id"),
        "ats",
        F.col("careers_url").alias("source_url"),
        *jobs[:-1],
        F.col("job_url").alias("url"),
    )
    if board_pages is not None:
        paged = board_pages.select("board_id").distinct()
        whole = paged_listings(board_pages.join(careers.select(F.col("careers_url").alias("board_id")), "board_id", "left_semi"))
        shaped = shaped.join(paged, "board_id", "left_anti").unionByName(whole)
    out = skew.materialize(shaped)
    return out, empty_boards(decisions, out, lost)


def empty_boards(decisions: DataFrame, found: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """Error rows of careers pages that gave no listing, or (stage fetch) whose page is ``lost``."""
    with_jobs = found.select(F.col("board_id").alias("careers_url")).distinct()
    message = F.concat(
        F.lit("No jobs found on "),
        "final_url",
        F.lit(" (ATS: "),
        "ats",
        F.lit("). The page structure may have changed or this may not be a job board."),
    )
    empty = decisions.join(with_jobs, "careers_url", "left_anti")
    if lost is None:
        return empty.select("careers_url", F.lit("extract").alias("stage"), message.alias("message"))
    reasons = lost.groupBy(F.col("url").alias("final_url")).agg(F.min("message").alias("_lost"))
    known = skew.spread_lookup(empty, reasons, ["final_url"], ["careers_url"], "left")
    stage = F.when(F.col("_lost").isNotNull(), "fetch").otherwise("extract")
    return known.select("careers_url", stage.alias("stage"), F.coalesce("_lost", message).alias("message"))


def scrape(
    requests: DataFrame,
    probes: DataFrame,
    homepages: DataFrame,
    snapshots: DataFrame | None = None,
    mode: str = "universal",
    attempts: DataFrame | None = None,
    board_pages: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(careers, listings, errors)`` of a table of requested URLs.

    ``careers(request_id, url, careers_url, via)`` ties requests to boards, so a
    board asked for by many requests is read once and its rows are not copied.
    Instead of ``snapshots`` the crawl's ``attempts`` may be given, of which the good
    ones are chosen (``discover.chosen_snapshots``); ``failures(base, reason)`` are
    sites whose discovery broke down.
    """
    lost = None
    if snapshots is None:
        snapshots, lost = discover.chosen_snapshots(attempts)
        lost = skew.materialize(lost)
    broken = []
    if failures is not None:
        broken = [discover.failed_discoveries(requests, failures)]
        down = failures.select("base").distinct()
        requests = discover.normalized(requests).join(down, "base", "left_anti").select(*requests.columns)
    careers = skew.materialize(discover.careers_urls(requests, probes, homepages))
    typed = discover.crawl_plan(careers).select("careers_url", "ats")
    found, empty = listings(typed, snapshots, mode, board_pages, lost)
    failed = skew.spread_lookup(careers, empty, ["careers_url"], ["request_id"]).select("request_id", "stage", "message")
    errors = discover.invalid_requests(requests).unionByName(failed)
    for more in broken:
        errors = errors.unionByName(more)
    return careers, found, errors


def match_requests(
    careers: DataFrame,
    found: DataFrame,
    detail_pages: DataFrame,
    resumes: DataFrame,
    top_k: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Enrich the listings and rank them for every résumé.

    ``resumes(request_id, resume_id, resume_text)`` names the request each
    résumé came with; ``detail_pages(page_id, url, html)`` are fetched job pages,
    read by the rules of each board type that lists them. With a column ``command`` they are
    attempts: the first command (raw, then rendered) that brought any page counts. Of several
    pages of a URL the first with a text counts, by page_id. Matches carry ``ats``,
    ``source_url`` and the listing as ``job``. ``max_chars`` cuts detail texts.
    """
    boards = found.select("url", "ats").distinct()
    order = F.array_position(F.array(*map(F.lit, rules.FETCH_COMMANDS)), F.col("command")) if "command" in detail_pages.columns else F.lit(0)
    tried = detail_pages.select("page_id", "url", order.alias("step"), "html").filter(F.coalesce("html", F.lit("")) != "")
    first = tried.groupBy("url").agg(F.min("step").alias("step"))
    # Every page is parsed where it lies; what a board type makes of it follows the small rows.
    parsed = dom.parse(tried, ("url", "page_id", "step"))
    texts = skew.materialize(enrich.texts_by_type(parsed, max_chars, ("page_id", "step")))
    details = texts.join(first, ["url", "step"]).join(boards, "url")
    details = details.withColumn("detail", enrich.text_of_type(F.col("ats"))).filter("detail is not null")
    once = details.groupBy("url", "ats").agg(F.min_by("detail", "page_id").alias("detail"))
    full = skew.materialize(enrich.descriptions(found, once))
    pairs = skew.spread_lookup(
        resumes.select("request_id", "resume_id"),
        careers.select("request_id", F.col("careers_url").alias("board_id")),
        ["request_id"],
        ["resume_id"],
    )
    return match.attach_jobs(match.score_jobs(resumes, full, pairs, top_k), full)
