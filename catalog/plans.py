"""Queries of the end-to-end plans over planted crawl tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.operators import discover
from rolecall.plans import boards as plan

from . import matching, planted
from .planted import CARDS_SQL
from .registry import query, table


def P():
    return F.col("page_id")


# Every page stands for one company. Remainder 0: board embedded in the raw
# page; 1: direct links on it; 2: board embedded in the rendered page only;
# 3: links on the rendered page only; 4: rendered page is the board; 5: the
# request names a board. Cards as in planted.py, so some boards are empty.
SITES_SQL = f"""{CARDS_SQL},
sites AS (SELECT page_id, page_id % 7 % 6 AS kind, n,
    CASE WHEN page_id % 7 % 6 = 5 THEN 'https://boards.greenhouse.io/c' || page_id
         ELSE 'https://c' || page_id || '.example.org/careers' END AS careers_url,
    CASE page_id % 7 % 6 WHEN 0 THEN 'https://jobs.lever.co/c' || page_id
         WHEN 2 THEN 'https://jobs.ashbyhq.com/c' || page_id WHEN 5 THEN 'https://boards.greenhouse.io/c' || page_id
         ELSE 'https://c' || page_id || '.example.org/careers' END AS final_url,
    CASE page_id % 7 % 6 WHEN 0 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 5 THEN 'greenhouse'
      ELSE CASE WHEN page_id % 7 % 6 IN (1, 3) AND n >= 3 THEN 'greenhouse' ELSE 'generic' END END AS ats
  FROM bare),
found AS (
  SELECT s.careers_url AS board_id, s.ats, CAST(c.k AS BIGINT) AS ord, 'Engineer ' || s.page_id || ' ' || c.k AS title,
    c.place AS location,
    CASE WHEN s.kind IN (1, 3) THEN 'https://boards.greenhouse.io/acme' || s.page_id || '/jobs/' || s.page_id || c.k
         ELSE regexp_extract(s.final_url, '^(https://[^/]+)', 1) || '/jobs/' || s.page_id || '-' || c.k END AS url
  FROM sites s JOIN cards c USING (page_id)
  WHERE s.kind NOT IN (1, 3) OR s.n >= 3)"""


def _careers_url():
    k = P().cast("string")
    return F.when(P() % 7 % 6 == 5, F.concat(F.lit("https://boards.greenhouse.io/c"), k)).otherwise(
        F.concat(F.lit("https://c"), k, F.lit(".example.org/careers"))
    )


def snapshots(spark, sf):
    pages = table(spark, sf, "pages")
    kind = P() % 7 % 6
    links, cards = planted.cards(planted.LINK_CARD), planted.board_block()
    lever = planted.fill('<iframe src="https://jobs.lever.co/c{p}?x=1"></iframe>', P())
    ashby = planted.fill('<iframe src="https://jobs.ashbyhq.com/c{p}/embed"></iframe>', P())
    raw_block = F.when(kind == 0, lever).when(kind == 1, links).otherwise("<p>Loading</p>")
    rendered_block = F.when(kind == 2, ashby).when(kind == 3, links).when(kind == 4, cards).otherwise("<p>Nothing</p>")
    board_url = (
        F.when(kind == 0, planted.fill("https://jobs.lever.co/c{p}", P()))
        .when(kind == 2, planted.fill("https://jobs.ashbyhq.com/c{p}", P()))
        .when(kind == 5, planted.fill("https://boards.greenhouse.io/c{p}", P()))
    )

    def stage(name, number, block, url):
        shown = pages.withColumn("url", url).withColumn("html", planted.page_html(block)).filter(F.col("url").isNotNull())
        return shown.select((P() * 3 + number).alias("page_id"), "url", F.lit(name).alias("stage"), "html")

    return (
        stage("raw", 0, raw_block, _careers_url())
        .unionByName(stage("rendered", 1, rendered_block, _careers_url()))
        .unionByName(stage("board", 2, cards, board_url))
    )


def careers(spark, sf):
    asked = table(spark, sf, "pages").select(P().alias("request_id"), _careers_url().alias("careers_url"))
    return discover.crawl_plan(asked)


@query(
    "board_decisions",
    f"""WITH {SITES_SQL} SELECT careers_url, final_url, ats,
        CASE WHEN kind IN (0, 2, 5) THEN 'board' WHEN kind IN (1, 3) AND n >= 3 THEN 'links' ELSE 'rendered' END AS kind FROM sites""",
)
def board_decisions(spark, sf):
    asked = careers(spark, sf).select("careers_url", "ats")
    return plan.board_decisions(asked, snapshots(spark, sf)).select("careers_url", "final_url", "ats", "kind")


@query("scraped_listings", f"WITH {SITES_SQL} SELECT board_id, ats, ord, title, location, url FROM found")
def scraped_listings(spark, sf):
    found, _ = plan.listings(careers(spark, sf), snapshots(spark, sf))
    return found.select("board_id", "ats", "ord", "title", "location", "url")


@query(
    "empty_board_errors",
    f"""WITH {SITES_SQL} SELECT careers_url, 'extract' AS stage, 'No jobs found on ' || final_url || ' (ATS: ' || ats
        || '). The page structure may have changed or this may not be a job board.' AS message
        FROM sites WHERE careers_url NOT IN (SELECT board_id FROM found)""",
)
def empty_board_errors(spark, sf):
    _, errors = plan.listings(careers(spark, sf), snapshots(spark, sf))
    return errors


# --- the whole way ------------------------------------------------------------------
# One résumé per company: the user's words of a conversation plus skills; each
# job page shows skills that depend on the job.
SKILLS = "python docker kubernetes airflow kafka spark terraform grafana golang rust postgres redis"
DETAIL_WORDS = "'" + SKILLS + " ' || repeat('skill' || ord || ' area' || (length(title) % 7) || ' ', 15)"
END_SQL = f"""{SITES_SQL},
jobs AS (SELECT board_id, ord, title, rtrim({DETAIL_WORDS}) AS description, location, url FROM found),
said AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
resumes AS (SELECT p.page_id AS resume_id, coalesce(s.t, '') || chr(10) || 'python kafka skill' || (p.page_id % 5 + 1) || ' area3'
    || chr(10) || '2019 - 2021' AS resume_text FROM pages p LEFT JOIN said s ON s.conv_id = p.page_id),
pairs AS (SELECT s.page_id AS resume_id, s.careers_url AS board_id FROM sites s WHERE s.careers_url IN (SELECT board_id FROM found))"""
END_MATCH = matching._with(
    END_SQL, matching.JOB_TF, matching.RESUME_TF, matching.DF, matching.SIZES, matching.PAIR, matching.YEARS,
    matching.SCORED, matching.KEYWORDS,
)


def _whole_way(spark, sf):
    """Requests to ranked matches: discovery, extraction, enrichment and scoring.

    Requests name bare domains, or a board. Of even companies a probe finds the careers
    page (behind failed ones and one too late in the order), of odd ones the homepage links it.
    Detail pages come from several attempts: some raw ones are empty and the rendered one
    counts, others are good and the rendered one must not count.
    """
    pages = table(spark, sf, "pages")
    site = planted.fill("https://c{p}.example.org", P())
    named = F.when(P() % 7 % 6 == 5, _careers_url()).when(P() % 4 < 2, planted.fill("c{p}.example.org", P())).otherwise(site)
    asked = pages.select(P().alias("request_id"), named.alias("url"))
    answers = [("/careers", 404, "/x"), ("/jobs", 301, "/careers"), ("/en/jobs", 200, "/wrong"), ("/blog", 200, "/wrong")]
    tried = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(a, ("path", "status", "to"))]) for a in answers])
    probes = pages.filter(P() % 2 == 0).select(site.alias("base"), F.inline(tried)).select(
        F.concat("base", "path").alias("candidate"), "status", F.concat("base", "to").alias("final_url")
    )
    home = pages.filter(P() % 2 == 1).withColumn("base", site).withColumn(
        "html", F.replace("html", F.lit("<footer>"), F.lit('<p><a href="/about">About</a><a href="/careers">Careers</a></p><footer>'))
    )
    found_for, found, _ = plan.scrape(asked, probes, plan.dom.parse(home, ("page_id", "base")), snapshots(spark, sf))
    words = F.concat(
        F.lit(SKILLS + " "),
        F.repeat(
            F.concat(F.lit("skill"), F.col("ord").cast("string"), F.lit(" area"), (F.length("title") % 7).cast("string"), F.lit(" ")), 15
        ),
    )
    page = F.concat(F.lit("<html><body><main><nav>x</nav>"), words, F.lit("</main>"))
    empty = F.col("ord") % 2 == 0
    wrong = F.concat(F.lit("<main>"), F.repeat(F.lit("wrong words "), 50))
    detail_pages = found.select(F.xxhash64("url").alias("page_id"), "url", F.lit("get").alias("command"), F.when(empty, "").otherwise(page).alias("html"))
    detail_pages = detail_pages.unionByName(
        found.select(F.xxhash64("url", F.lit(1)).alias("page_id"), "url", F.lit("fetch").alias("command"), F.when(empty, page).otherwise(wrong).alias("html"))
    )
    said = (
        table(spark, sf, "conversations")
        .filter(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
        .select(F.col("conv_id").alias("page_id"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("t"))
    )
    resumes = pages.join(said, "page_id", "left").select(
        P().alias("request_id"),
        P().alias("resume_id"),
        F.concat(
            F.coalesce("t", F.lit("")), F.lit("\npython kafka skill"), (P() % 5 + 1).cast("string"), F.lit(" area3\n2019 - 2021")
        ).alias("resume_text"),
    )
    return plan.match_requests(found_for, found, detail_pages, resumes)


@query("scrape_enrich_match", END_MATCH + matching.RANKED)
def scrape_enrich_match(spark, sf):
    return _whole_way(spark, sf).select(
        "resume_id", "board_id", "ord", "score", "score_pct",
        F.array_join("matched_keywords", " ").alias("matched_keywords"),
        F.array_join("missing_keywords", " ").alias("missing_keywords"),
        "explanation", "rank",
    )


@query(
    "match_results",
    END_MATCH
    + """ SELECT l.resume_id, l.board_id, l.ord, f.ats, f.board_id AS source_url, f.title, f.location, f.url,
          md5(j.description) AS description, l.score,
          CAST(row_number() OVER (PARTITION BY l.resume_id, l.board_id ORDER BY l.score DESC, l.ord) AS INT) AS rank
          FROM listed l JOIN found f USING (board_id, ord) JOIN jobs j USING (board_id, ord)""",
)
def match_results(spark, sf):
    """The whole match: the listing nested as ``job``, with its board type and source."""
    return _whole_way(spark, sf).select(
        "resume_id", "board_id", "ord", "ats", "source_url", "job.title", "job.location", "job.url",
        F.md5("job.description").alias("description"), "score", "rank",
    )


# --- pages of a board, fetch attempts, errors -------------------------------------------
# Page p is page p % 4 + 1 of board p // 4; some have failed, some have no next link.
PAGED_SQL = f"""{CARDS_SQL},
numbered AS (SELECT page_id, page_id // 4 AS b, page_id % 4 + 1 AS page, page_id % 6 AS n,
    page_id % 7 <> 0 AS has_next, page_id % 11 <> 0 AS ok FROM pages),
walked AS (SELECT *, bool_and(ok) OVER w AND page = row_number() OVER w
      AND coalesce(bool_and(has_next) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS good
    FROM numbered WINDOW w AS (PARTITION BY b ORDER BY page)),
counted AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY b ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM walked WHERE good)"""


@query(
    "paged_board",
    f"""WITH {PAGED_SQL} SELECT 'https://careers.ibm.com/search/' || b AS board_id, CAST(ahead + k AS BIGINT) AS ord,
        'Engineer ' || page_id || ' ' || k AS title, place AS location,
        'https://careers.ibm.com/job/' || page_id || '-' || k AS url
        FROM counted JOIN (SELECT page_id, k, place FROM cards) USING (page_id)""",
)
def paged_board(spark, sf):
    return plan.paged_listings(_paged(spark, sf)).select("board_id", "ord", "title", "location", "url")


def _paged(spark, sf, path="search"):
    card = '<article class="article--card"><h3 class="article__header__text__title"><a class="link" href="/job/{p}-{k}">Engineer {p} {k}</a></h3><span class="card-item-location">{place}</span></article>'
    following = F.when(P() % 7 != 0, '<a class="paginationNextLink" href="?next">Next</a>').otherwise("")
    board = F.concat(F.lit(f"https://careers.ibm.com/{path}/"), F.floor(P() / 4).cast("string"))
    pages = planted.pages_with(spark, sf, F.concat(planted.cards(card), following), board)
    return pages.select(
        "page_id", board.alias("board_id"), F.lit("ibm").alias("ats"), "url", (P() % 4 + 1).cast("int").alias("page"),
        F.when(P() % 11 == 0, 404).otherwise(200).alias("status"), "html",
    )


# Three attempts at each board: too small, good, and good with other jobs. Of every
# fifth board all are too small; every ninth site could not be probed at all.
def _attempts(spark, sf):
    pages = table(spark, sf, "pages")
    url = planted.fill("https://jobs.lever.co/c{p}", P())
    padded = F.concat(planted.page_html(planted.board_block()), F.repeat(F.lit("<!-- -->"), 400))
    other = F.replace(padded, F.lit("Engineer"), F.lit("Wrong"))

    def attempt(number, command, html):
        shown = pages.select("page_id", F.when(P() % 5 == 0, "<p>x</p>").otherwise(html).alias("html"))
        return shown.select(
            (P() * 3 + number).alias("page_id"), url.alias("url"), F.lit("board").alias("stage"), F.lit(False).alias("generic"),
            F.lit(False).alias("browser"), F.lit(False).alias("wants_ai"), F.lit(command).alias("command"),
            F.lit(number).alias("attempt"), F.lit(False).alias("ai_targeted"), "html",
        )

    first, second, third = attempt(0, "get", F.lit("<p>wait</p>")), attempt(1, "fetch", padded), attempt(2, "stealthy-fetch", other)
    return first.unionByName(second).unionByName(third)


def _from_attempts(spark, sf):
    pages = table(spark, sf, "pages")
    url = F.when(P() % 8 == 7, "/nowhere").otherwise(planted.fill("https://jobs.lever.co/c{p}", P()))
    url = F.when(P() % 9 == 4, planted.fill("https://down{p}.example.org", P())).otherwise(url)
    asked = pages.select(P().alias("request_id"), url.alias("url"))
    down = pages.filter(P() % 9 == 4).select(
        planted.fill("https://down{p}.example.org", P()).alias("base"), F.lit("timed out").alias("reason")
    )
    none = spark.createDataFrame([], "candidate STRING, status INT, final_url STRING")
    home = plan.dom.parse(spark.createDataFrame([], "page_id LONG, base STRING, html STRING"), ("page_id", "base"))
    return plan.scrape(asked, none, home, attempts=_attempts(spark, sf), failures=down)


ASKED = "page_id % 9 <> 4 AND page_id % 8 <> 7"


@query(
    "chosen_listings",
    f"""WITH {CARDS_SQL} SELECT 'https://jobs.lever.co/c' || page_id AS board_id, CAST(k AS BIGINT) AS ord,
        'Engineer ' || page_id || ' ' || k AS title, place AS location, 'https://jobs.lever.co/jobs/' || page_id || '-' || k AS url
        FROM cards WHERE {ASKED} AND page_id % 5 <> 0""",
)
def chosen_listings(spark, sf):
    """Listings from the attempt that counts, of boards asked for."""
    _, found, _ = _from_attempts(spark, sf)
    return found.select("board_id", "ord", "title", "location", "url")


@query(
    "request_errors",
    f"""SELECT page_id AS request_id, 'discover' AS stage,
          'Failed to discover careers page for https://down' || page_id || '.example.org: timed out' AS message
          FROM pages WHERE page_id % 9 = 4
        UNION ALL SELECT page_id, 'discover', 'Invalid input URL: /nowhere — Invalid URL: https:///nowhere'
          FROM pages WHERE page_id % 8 = 7 AND page_id % 9 <> 4
        UNION ALL SELECT page_id, 'fetch', 'No usable page among the fetch attempts for https://jobs.lever.co/c' || page_id
          FROM pages WHERE {ASKED} AND page_id % 5 = 0
        UNION ALL SELECT page_id, 'extract', 'No jobs found on https://jobs.lever.co/c' || page_id
          || ' (ATS: lever). The page structure may have changed or this may not be a job board.'
          FROM pages WHERE {ASKED} AND page_id % 5 <> 0 AND page_id % 6 = 0""",
)
def request_errors(spark, sf):
    """Errors of every stage, each with its own cause."""
    _, _, errors = _from_attempts(spark, sf)
    return errors.select("request_id", "stage", "message")


# --- boards by their type, some over several pages ---------------------------------------
@query(
    "scraped_by_type",
    f"""WITH {PAGED_SQL},
        lever AS (SELECT 'https://jobs.lever.co/c' || page_id AS board_id, 'lever' AS ats, CAST(k AS BIGINT) AS ord,
          'Engineer ' || page_id || ' ' || k AS title, place AS location, 'https://jobs.lever.co/c' || page_id || '/' || k AS url FROM cards)
        SELECT * FROM lever UNION ALL
        SELECT 'https://careers.ibm.com/jobs/' || b, 'ibm', CAST(ahead + k AS BIGINT),
          'Engineer ' || page_id || ' ' || k, place, 'https://careers.ibm.com/job/' || page_id || '-' || k
        FROM counted JOIN (SELECT page_id, k, place FROM cards) USING (page_id)""",
)
def scraped_by_type(spark, sf):
    """Requests for boards of two types, read by the rules of their type; one type goes over several pages."""
    pages = table(spark, sf, "pages")
    lever = planted.fill("https://jobs.lever.co/c{p}", P())
    board = F.concat(F.lit("https://careers.ibm.com/jobs/"), F.floor(P() / 4).cast("string"))
    asked = pages.select(P().alias("request_id"), lever.alias("url")).unionByName(
        pages.select((P() + 1000000).alias("request_id"), board.alias("url"))
    )
    card = '<div class="posting"><a class="posting-title" href="https://jobs.lever.co/c{p}/{k}"><h5>Engineer {p} {k}</h5><span class="sort-by-location">{place}</span></a></div>'
    shots = planted.pages_with(spark, sf, planted.cards(card), lever).select("page_id", "url", F.lit("board").alias("stage"), "html")
    none = spark.createDataFrame([], "candidate STRING, status INT, final_url STRING")
    home = plan.dom.parse(spark.createDataFrame([], "page_id LONG, base STRING, html STRING"), ("page_id", "base"))
    _, found, _ = plan.scrape(asked, none, home, shots, mode="by_ats", board_pages=_paged(spark, sf, "jobs"))
    return found.select("board_id", "ats", "ord", "title", "location", "url")
