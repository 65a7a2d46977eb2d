"""From requested URLs to careers pages, and from crawl attempts to snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import page as pg
from ..functions import urls
from ..functions.text import let
from ..sources.dom import WHOLE
from . import skew

#: Pages that a task is left with, on average, if there are more tasks than four a core.
PAGES_A_TASK = 2_000


# --- careers page of a request ------------------------------------------------------
def normalized(requests: DataFrame) -> DataFrame:
    """Add ``full_url`` and ``base`` (NULL when the URL names no host)."""
    full = requests.withColumn("full_url", urls.normalize_url(F.col("url")))
    return full.withColumn("base", urls.base_url(F.col("full_url")))


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Error rows ``(request_id, stage, message)`` of URLs without a host."""
    message = F.concat(F.lit("Invalid input URL: "), "url", F.lit(" — Invalid URL: "), "full_url")
    return normalized(requests).filter(F.col("base").isNull()).select(
        "request_id", F.lit("discover").alias("stage"), message.alias("message")
    )


def candidate_paths(bases: DataFrame) -> DataFrame:
    """``(base, path_ord, candidate)``: the usual careers paths of each site."""
    paths = F.array(*[F.lit(p) for p in rules.CANDIDATE_PATHS])
    return bases.select("base", F.posexplode(paths).alias("path_ord", "path")).select(
        "base", "path_ord", F.concat("base", "path").alias("candidate")
    )


def answered_probes(probes: DataFrame) -> DataFrame:
    """``(base, careers_url)`` of every site with a candidate that answered below status 400, the first of its paths.

    ``probes(candidate, status, final_url)``; a probe that failed has no row. A
    candidate is split into site and path once, so sites are not multiplied by paths.
    """
    order = F.create_map(*[F.lit(x) for i, p in enumerate(rules.CANDIDATE_PATHS) for x in (p, i)])
    site = F.concat(urls.scheme(F.col("candidate")), F.lit("://"), urls.netloc(F.col("candidate")))
    split = probes.filter(F.col("status") < 400).select("candidate", site.alias("base"), "final_url")
    path = F.substring(F.col("candidate"), F.length("base") + 1, F.length("candidate"))
    known = split.filter(F.col("candidate").startswith(F.col("base"))).withColumn("place", F.try_element_at(order, path))
    first = known.filter(F.col("place").isNotNull()).groupBy("base").agg(F.min(F.struct("place", "final_url")).alias("first"))
    return first.select("base", F.col("first.final_url").alias("careers_url"))


def first_probe(bases: DataFrame, probes: DataFrame) -> DataFrame:
    """``answered_probes`` of the sites in ``bases``."""
    return answered_probes(probes).join(bases.select("base"), "base", "left_semi")


def _best_link(base: Column) -> Column:
    page = pg.Page(F.col("nodes"), F.col("texts"), WHOLE)

    def candidate(anchor: Column) -> Column:
        def scored(full: Column) -> Column:
            score = F.when(urls.netloc(full) == urls.netloc(base), 2).otherwise(1)
            bonus = F.when(full.rlike(rules.CAREERS_TAIL), 2).otherwise(0)
            return F.struct((-(score + bonus)).alias("rank"), anchor["pre"].alias("pre"), full.alias("full"))

        return let(urls.resolve(base, anchor["href"]), scored)

    links = page.where(
        lambda n: (n["tag"] == "a")
        & n["href"].isNotNull()
        & F.concat(n["href"], F.lit(" "), page.text(n)).rlike(rules.CAREERS_LINK)
    )
    return F.array_min(F.transform(links, candidate))


def best_links(homepages: DataFrame) -> DataFrame:
    """``(base, careers_url)``: best careers-looking link of each parsed homepage.

    ``homepages(base, nodes, texts)``. Same-site links and URLs ending in
    careers or jobs score higher; the first in the document wins ties. A site
    with several snapshots of its homepage has the best link of all of them.
    """
    best = homepages.select("base", _best_link(F.col("base")).alias("best")).filter(F.col("best").isNotNull())
    once = best.groupBy("base").agg(F.min("best").alias("best"))
    return once.select("base", F.col("best.full").alias("careers_url"))


def careers_urls(requests: DataFrame, probes: DataFrame, homepages: DataFrame) -> DataFrame:
    """``(request_id, url, careers_url, via)`` for every valid request.

    Requests are read once. A site asked for by very many of them is one row of
    the other side, so a skewed join splits the requests.
    """
    valid = normalized(requests).filter(F.col("base").isNotNull()).withColumn(
        "already", urls.is_careers_url(F.col("full_url"))
    )
    probed = answered_probes(probes).withColumnRenamed("careers_url", "probed")
    linked = best_links(homepages).withColumnRenamed("careers_url", "linked")
    joined = valid.join(probed.join(linked, "base", "full"), "base", "left")
    direct = F.when(F.col("already"), F.col("full_url"))
    via = (
        F.when(F.col("already"), "input")
        .when(F.col("probed").isNotNull(), "probe")
        .when(F.col("linked").isNotNull(), "link")
        .otherwise("base")
    )
    return joined.select(
        "request_id", "url", F.coalesce(direct, "probed", "linked", "base").alias("careers_url"), via.alias("via")
    )


def crawl_plan(careers: DataFrame) -> DataFrame:
    """Add ``ats`` and how to fetch it; the strategy table has one row per board type."""
    strategies = careers.sparkSession.createDataFrame(
        rules.CRAWL_STRATEGIES,
        "ats STRING, strategy STRING, ai_targeted BOOLEAN, browser BOOLEAN, network_idle BOOLEAN",
    )
    return careers.withColumn("ats", urls.detect_ats(F.col("careers_url"))).join(F.broadcast(strategies), "ats")


# --- snapshots ------------------------------------------------------------------------
def is_spa(html: Column, chars: int | None = None) -> Column:
    """Markers of a page rendered in the browser, anywhere or in the first ``chars`` characters."""
    return (F.substring(html, 1, chars) if chars else html).rlike(rules.SPA_MARKER)


def is_thick(chars: Column, generic: Column) -> Column:
    """Enough characters to be a real page; unknown sites need more."""
    return chars >= F.when(generic, rules.MIN_CHARS_GENERIC).otherwise(rules.MIN_CHARS)


def choose_snapshot(attempts: DataFrame) -> DataFrame:
    """The attempt to keep per URL: ``(url, command, attempt, ai_targeted, chars)``.

    ``attempts(url, generic, browser, wants_ai, command, attempt, ai_targeted,
    chars, spa)``. Commands escalate; browser sites skip ``get``. A rendered
    page of full size replaces a ``get`` page that only bootstraps a browser
    app. A cleaned pass that yields nothing is repeated raw without a final
    size check. One aggregation per URL, combined before its shuffle.
    """
    get, fetch, stealth = rules.FETCH_COMMANDS
    generic = F.col("generic")
    own_pass = F.col("ai_targeted") == F.col("wants_ai")
    raw_pass = F.col("wants_ai") & ~F.col("ai_targeted")
    enough = F.col("chars") >= F.when(generic & (F.col("command") == get), rules.MIN_CHARS_GENERIC).otherwise(
        rules.MIN_CHARS
    )
    usable = ~(F.col("browser") & (F.col("command") == get))
    facts = F.struct("attempt", "chars", "spa", "command", "ai_targeted")

    def earliest(name: str, test: Column) -> Column:
        return F.min(F.when(test & usable, facts)).alias(name)

    firsts = []
    for command in rules.FETCH_COMMANDS:
        is_command = F.col("command") == command
        firsts.append(earliest(f"own_{command}", own_pass & enough & is_command))
        firsts.append(earliest(f"raw_{command}", raw_pass & enough & is_command))
    rendered = own_pass & (F.col("command") == fetch) & (F.col("chars") >= rules.MIN_CHARS_GENERIC)
    per_url = attempts.groupBy("url").agg(
        F.max("generic").alias("generic"), F.min(F.when(rendered, facts)).alias("rendered"), *firsts
    )

    def final(name: str) -> Column:
        return F.when(is_thick(F.col(f"{name}.chars"), generic), F.col(name))

    own_get = F.when(generic & F.col(f"own_{get}.spa"), F.coalesce("rendered", final(f"own_{get}"))).otherwise(
        final(f"own_{get}")
    )
    raw = [F.col(f"raw_{c}") for c in (get, fetch, stealth)]
    kept = F.coalesce(own_get, final(f"own_{fetch}"), final(f"own_{stealth}"), *raw)
    return per_url.select("url", kept.alias("kept")).filter(F.col("kept").isNotNull()).select(
        "url", "kept.command", "kept.attempt", "kept.ai_targeted", "kept.chars"
    )


def chosen_snapshots(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(snapshots, errors)`` of crawl attempts that still carry their page.

    ``attempts(page_id, url, stage, generic, browser, wants_ai, command, attempt,
    ai_targeted, html)`` to ``snapshots(page_id, url, stage, html)``, one per (url,
    stage), and ``errors(url, stage, message)`` where no attempt is good enough.
    Only sizes and markers are grouped, and markers are looked for in ``get`` pages alone, the only ones
    they matter for. Pages are joined by page_id: they move once and unsorted, past hash tables of the chosen
    ids, and are left in even tasks for what comes next. ``snapshots`` is not written: read it once.
    """
    key = F.concat_ws("\n", "stage", "url")
    spa = F.when(F.col("command") == rules.FETCH_COMMANDS[0], is_spa(F.col("html")))
    sized = attempts.select(
        "page_id", key.alias("url"), F.col("url").alias("page_url"), "stage", "generic", "browser", "wants_ai", "command",
        "attempt", "ai_targeted", F.length(F.coalesce("html", F.lit(""))).cast("long").alias("chars"),
        F.coalesce(spa, F.lit(False)).alias("spa"),
    )
    sized = skew.materialize(sized)
    same = ["url", "command", "attempt", "ai_targeted"]
    kept = sized.join(choose_snapshot(sized).select(*same), same, "left_semi")
    kept = skew.materialize(kept.groupBy("url").agg(F.min("page_id").alias("page_id")))
    # An inner join with distinct ids: a semi join would be pushed below the deal, and adaptive execution, which
    # sizes tasks by their bytes, would then leave a few tasks for the long step of parsing.
    spark = attempts.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, kept.count() // PAGES_A_TASK)
    deal = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = attempts.select("page_id", "url", "stage", "html").repartition(deal, "page_id")
    ids = kept.select("page_id").repartition(deal, "page_id").distinct()
    snapshots = pages.join(ids.hint("shuffle_hash"), "page_id").coalesce(tasks)
    lost = sized.select("url", "page_url", "stage").distinct().join(kept, "url", "left_anti")
    message = F.concat(F.lit("No usable page among the fetch attempts for "), "page_url")
    return snapshots, lost.select(F.col("page_url").alias("url"), "stage", message.alias("message"))


def failed_discoveries(requests: DataFrame, failures: DataFrame) -> DataFrame:
    """Error rows of requests whose site is in ``failures(base, reason)``: probing itself broke down."""
    asked = normalized(requests).filter(F.col("base").isNotNull())
    met = skew.spread_lookup(asked, failures.groupBy("base").agg(F.min("reason").alias("reason")), ["base"], ["request_id"])
    message = F.concat(F.lit("Failed to discover careers page for "), "url", F.lit(": "), "reason")
    return met.select("request_id", F.lit("discover").alias("stage"), message.alias("message"))


# --- paging and scrolling -------------------------------------------------------------
def next_page_link() -> Column:
    """Href of the next-page link of the current page row, or NULL."""
    page = pg.Page(F.col("nodes"), F.col("texts"), WHOLE)
    return page.select_one("a.paginationNextLink")["href"]


def page_prefix(board_pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages ``1..n`` of each board up to the first missing, failed or last page.

    ``board_pages(board_id, page, status, has_next, ...)``. The first failed page,
    the first without a next link and the first gap are each one aggregate per
    board, combined before its shuffle, so a board of any length is no window.
    """
    pages = board_pages.filter(F.col("page") >= 1)
    if max_pages:
        pages = pages.filter(F.col("page") <= max_pages)
    failed = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.col("page"))
    ends = F.when(~F.coalesce("has_next", F.lit(False)), F.col("page"))
    marks = pages.groupBy("board_id").agg(F.min(failed).alias("_bad"), F.min(ends).alias("_last"), F.min("page").alias("_first"))
    here = pages.select("board_id", "page").distinct()
    after = here.select("board_id", (F.col("page") - 1).alias("page"))
    gaps = here.join(after, ["board_id", "page"], "left_anti").groupBy("board_id").agg(F.min("page").alias("_whole"))
    limits = marks.join(gaps, "board_id").select(
        "board_id",
        F.when(F.col("_first") == 1, F.least("_whole", F.col("_bad") - 1, "_last")).otherwise(0).alias("_to"),
    )
    joined = skew.spread_lookup(pages, limits, ["board_id"], ["page"])
    return joined.filter(F.col("page") <= F.col("_to")).select(*board_pages.columns)


def scroll_stop(rounds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(url, stop_round, tiles)``: first round that showed nothing new.

    ``rounds(url, round, tiles)``; each round meets the one before it by key, so
    a page of any number of rounds is no window.
    """
    seen = rounds.filter(F.col("round") >= 1)
    if max_rounds:
        seen = seen.filter(F.col("round") <= max_rounds)
    before = seen.select("url", (F.col("round") + 1).alias("round"), F.col("tiles").alias("_before"))
    met = seen.join(before, ["url", "round"], "left")
    same = F.col("tiles") == F.coalesce("_before", F.lit(0))
    here = F.struct("round", "tiles")
    stops = met.groupBy("url").agg(F.coalesce(F.min(F.when(same, here)), F.max(here)).alias("stop"))
    return stops.select("url", F.col("stop.round").alias("stop_round"), F.col("stop.tiles").alias("tiles"))
