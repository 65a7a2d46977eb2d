"""Queries of discovery and crawl-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall import rules
from rolecall.operators import discover, enrich
from rolecall.sources import dom

from . import recipes
from .registry import query, table
from .urls import HOST, WITH, full_urls, requests

PATHS_SQL = "paths(path_ord, path) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(rules.CANDIDATE_PATHS)) + ")"
# Every site answers each candidate path, or not, by its name length and key.
PROBES_SQL = f"""
bases AS (SELECT min(request_id) AS k, base FROM (SELECT request_id,
    split_part(full_url, '://', 1) || '://' || {HOST} AS base FROM full_urls) GROUP BY base),
{PATHS_SQL},
probes AS (SELECT base, path_ord, base || path AS candidate, base || path || '/final' AS final_url,
    [200, 301, 404, 500, -1][(k * 7 + path_ord * 13 + length(base)) % 5 + 1] AS status FROM bases, paths),
answered AS (SELECT base, min_by(final_url, path_ord) AS probed FROM probes WHERE status BETWEEN 0 AND 399 AND k % 3 <> 0 GROUP BY base)
"""
PROBES_SQL = PROBES_SQL.replace("probes AS (SELECT base,", "probes AS (SELECT k, base,")


def bases(spark, sf):
    return full_urls(spark, sf).groupBy("base").agg(F.min("request_id").alias("k"))


def probes(spark, sf):
    """A third of the sites answer no probe at all."""
    sites = bases(spark, sf)
    keyed = discover.candidate_paths(sites).join(sites, "base")
    pick = (F.col("k") * 7 + F.col("path_ord") * 13 + F.length("base")) % 5 + 1
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 301, 404, 500, -1)]), pick.cast("int"))
    return keyed.filter(F.col("k") % 3 != 0).withColumn("status", status).filter(F.col("status") >= 0).select(
        "candidate", "status", F.concat("candidate", F.lit("/final")).alias("final_url")
    )


@query("first_probe", f"{WITH}, {PROBES_SQL} SELECT base, probed AS careers_url FROM answered")
def first_probe(spark, sf):
    return discover.first_probe(bases(spark, sf).select("base"), probes(spark, sf))


# Homepages: every page, with links planted ahead of its footer.
LINK_HOST = "https://' || 'site' || page_id || '.example.org"


def homepages(spark, sf):
    pages = table(spark, sf, "pages")
    k = F.col("page_id").cast("string")
    base = F.concat(F.lit("https://site"), k, F.lit(".example.org"))
    links = F.concat(
        F.lit('<p><a href="/about">About</a><a href="https://other.example.com/careers/">Work</a>'),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="/people/jobs/'), k, F.lit('">Open roles</a>'))).otherwise(""),
        F.when(F.col("page_id") % 3 == 1, F.lit('<a href="company/careers">Team</a><a href="/jobs">Jobs</a>')).otherwise(""),
        F.lit('<a href="/us">We are hiring</a></p><footer>'),
    )
    marked = pages.withColumn("html", F.replace("html", F.lit("<footer>"), links)).withColumn("base", base)
    return dom.parse(marked, ("page_id", "base"))


BEST_LINK_SQL = """CASE page_id % 3 WHEN 0 THEN 'https://other.example.com/careers/'
    WHEN 1 THEN 'https://site' || page_id || '.example.org/company/careers' ELSE 'https://other.example.com/careers/' END"""


@query(
    "best_home_link",
    f"SELECT 'https://site' || page_id || '.example.org' AS base, {BEST_LINK_SQL} AS careers_url FROM pages",
)
def best_home_link(spark, sf):
    return discover.best_links(homepages(spark, sf))


@query(
    "careers_urls",
    f"""{WITH}, {PROBES_SQL},
    all_requests AS (
      SELECT request_id, url, full_url, split_part(full_url, '://', 1) || '://' || {HOST} AS base FROM full_urls
      UNION ALL
      SELECT 100000000 + page_id, 'site' || page_id || '.example.org', 'https://site' || page_id || '.example.org',
             'https://site' || page_id || '.example.org' FROM pages),
    linked AS (SELECT 'https://site' || page_id || '.example.org' AS base, {BEST_LINK_SQL} AS linked FROM pages),
    flagged AS (SELECT *, regexp_matches(full_url, '{rules.BOARD_DOMAINS}')
        OR regexp_matches(regexp_extract(full_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '{rules.CAREERS_PATH}') AS already FROM all_requests)
    SELECT request_id, url, CASE WHEN already THEN full_url ELSE coalesce(probed, linked, base) END AS careers_url,
      CASE WHEN already THEN 'input' WHEN probed IS NOT NULL THEN 'probe' WHEN linked IS NOT NULL THEN 'link' ELSE 'base' END AS via
    FROM flagged LEFT JOIN answered USING (base) LEFT JOIN linked USING (base)""",
)
def careers_urls(spark, sf):
    sites = table(spark, sf, "pages").select(
        (F.col("page_id") + 100000000).alias("request_id"),
        F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".example.org")).alias("url"),
    )
    asked = requests(spark, sf).unionByName(sites)
    return discover.careers_urls(asked, probes(spark, sf), homepages(spark, sf))


# Crawl attempts: one URL per run of twelve events.
ATTEMPTS_SQL = """
attempts AS (
  SELECT event_id // 12 AS url, (event_id // 12) % 3 = 0 AS generic, (event_id // 12) % 5 = 1 AS browser,
    (event_id // 12) % 2 = 1 AND (event_id // 12) % 3 <> 0 AS wants_ai,
    CASE event_type WHEN 'click' THEN 'get' WHEN 'view' THEN 'get' WHEN 'error' THEN 'stealthy-fetch' ELSE 'fetch' END AS command,
    CAST(event_id % 12 + 1 AS INT) AS attempt,
    (event_id // 12) % 2 = 1 AND (event_id // 12) % 3 <> 0 AND event_id % 12 < 6 AS ai_targeted,
    CAST(floor(value * 30) AS BIGINT) AS chars, user_id % 2 = 0 AS spa
  FROM events)"""


def attempts(spark, sf):
    e = table(spark, sf, "events")
    site = F.floor(F.col("event_id") / 12)
    wants = (site % 2 == 1) & (site % 3 != 0)
    command = (
        F.when(F.col("event_type").isin("click", "view"), "get")
        .when(F.col("event_type") == "error", "stealthy-fetch")
        .otherwise("fetch")
    )
    return e.select(
        site.alias("url"),
        (site % 3 == 0).alias("generic"),
        (site % 5 == 1).alias("browser"),
        wants.alias("wants_ai"),
        command.alias("command"),
        (F.col("event_id") % 12 + 1).cast("int").alias("attempt"),
        (wants & (F.col("event_id") % 12 < 6)).alias("ai_targeted"),
        F.floor(F.col("value") * 30).cast("long").alias("chars"),
        (F.col("user_id") % 2 == 0).alias("spa"),
    )


@query(
    "choose_snapshot",
    f"""WITH {ATTEMPTS_SQL},
    ok AS (SELECT *, CASE command WHEN 'get' THEN 0 WHEN 'fetch' THEN 1 ELSE 2 END AS c FROM attempts
           WHERE NOT (browser AND command = 'get')
             AND chars >= CASE WHEN generic AND command = 'get' THEN 3000 ELSE 2000 END),
    own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, command ORDER BY attempt) AS r
              FROM ok WHERE ai_targeted = wants_ai) WHERE r = 1),
    raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, command ORDER BY attempt) AS r
              FROM ok WHERE wants_ai AND NOT ai_targeted) WHERE r = 1),
    rendered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt) AS r
              FROM attempts WHERE ai_targeted = wants_ai AND command = 'fetch' AND chars >= 3000) WHERE r = 1),
    options AS (
      SELECT rd.url, rd.command, rd.attempt, rd.ai_targeted, rd.chars, 0 AS p
        FROM own o JOIN rendered rd USING (url) WHERE o.generic AND o.spa AND o.command = 'get'
      UNION ALL
      SELECT url, command, attempt, ai_targeted, chars, 1 + c FROM own
        WHERE chars >= CASE WHEN generic THEN 3000 ELSE 2000 END
      UNION ALL SELECT url, command, attempt, ai_targeted, chars, 10 + c FROM raw)
    SELECT url, command, attempt, ai_targeted, chars FROM
      (SELECT *, row_number() OVER (PARTITION BY url ORDER BY p) AS r FROM options) WHERE r = 1""",
)
def choose_snapshot(spark, sf):
    return discover.choose_snapshot(attempts(spark, sf))


@query(
    "page_prefix",
    """WITH board_pages AS (
      SELECT o_orderkey // 130 AS board_id, CAST(o_orderkey % 130 + 1 AS INT) AS page,
        CASE WHEN (o_orderkey * 31 + o_custkey) % 67 = 0 THEN 404 ELSE 200 END AS status,
        (o_orderkey * 17 + o_custkey) % 97 <> 0 AS has_next
      FROM orders WHERE (o_orderkey + o_custkey) % 101 <> 0),
    marks AS (
      SELECT board_id,
        coalesce(min(page) FILTER (WHERE status NOT BETWEEN 200 AND 299), 1000) AS bad,
        coalesce(min(page) FILTER (WHERE NOT has_next), 1000) AS last FROM board_pages GROUP BY board_id),
    gaps AS (
      SELECT b.board_id, min(i) AS gap FROM (SELECT DISTINCT board_id FROM board_pages) b, range(1, 132) t(i)
      WHERE NOT EXISTS (SELECT 1 FROM board_pages p WHERE p.board_id = b.board_id AND p.page = i) GROUP BY b.board_id)
    SELECT board_id, page FROM board_pages JOIN marks USING (board_id) JOIN gaps USING (board_id)
    WHERE page < bad AND page < gap AND page <= last""",
)
def page_prefix(spark, sf):
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pages = o.filter((key + cust) % 101 != 0).select(
        F.floor(key / 130).alias("board_id"),
        (key % 130 + 1).cast("int").alias("page"),
        F.when((key * 31 + cust) % 67 == 0, 404).otherwise(200).alias("status"),
        ((key * 17 + cust) % 97 != 0).alias("has_next"),
    )
    return discover.page_prefix(pages).select("board_id", "page")


@query(
    "scroll_stop",
    """WITH RECURSIVE rounds AS (
      SELECT event_id // 40 AS url, CAST(event_id % 40 + 1 AS INT) AS round,
        CAST(count(*) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY event_id // 40 ORDER BY event_id) AS BIGINT) AS tiles
      FROM events),
    walk AS (
      SELECT url, round, tiles, tiles = 0 AS stopped FROM rounds WHERE round = 1
      UNION ALL
      SELECT r.url, r.round, r.tiles, r.tiles = w.tiles FROM walk w JOIN rounds r ON r.url = w.url AND r.round = w.round + 1
      WHERE NOT w.stopped)
    SELECT url, max(round) AS stop_round, max_by(tiles, round) AS tiles FROM walk GROUP BY url""",
)
def scroll_stop(spark, sf):
    e = table(spark, sf, "events")
    from pyspark.sql import Window

    block = F.floor(F.col("event_id") / 40)
    shown = F.count(F.when(F.col("event_type") != "view", 1)).over(Window.partitionBy("url").orderBy("round"))
    rounds = e.select(block.alias("url"), (F.col("event_id") % 40 + 1).cast("int").alias("round"), "event_type")
    return discover.scroll_stop(rounds.select("url", "round", shown.alias("tiles")))


# Listings with every second description blanked; details for six sevenths.
DETAIL_SQL = f"""{recipes.JOBS_SQL},
listed AS (SELECT board_id, ord, title, CASE WHEN ord % 2 = 0 THEN '' ELSE description END AS description, location,
    'https://jobs.example.com/' || board_id || '/' || CAST(ord // 40 AS VARCHAR) AS url FROM jobs),
details AS (SELECT url, max_by(description, ord) AS detail FROM
    (SELECT j.description, l.ord, l.url FROM listed l JOIN jobs j USING (ord) WHERE l.ord % 7 <> 0) GROUP BY url),
needy AS (SELECT l.*, length(trim(l.description, E' \\t\\n\\r\\f\\v')) < 100 AS need FROM listed l),
filled AS (SELECT n.board_id, n.ord, n.title, n.location, n.url, n.need,
    CASE WHEN n.need AND coalesce(d.detail, '') <> '' THEN d.detail ELSE n.description END AS description
  FROM needy n LEFT JOIN details d USING (url))"""


def listed(spark, sf):
    j = recipes.jobs(spark, sf)
    return j.withColumn("description", F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("description"))).withColumn(
        "url",
        F.concat(F.lit("https://jobs.example.com/"), "board_id", F.lit("/"), F.floor(F.col("ord") / 40).cast("string")),
    )


def details(spark, sf):
    j = recipes.jobs(spark, sf).filter(F.col("ord") % 7 != 0)
    url = F.concat(F.lit("https://jobs.example.com/"), "board_id", F.lit("/"), F.floor(F.col("ord") / 40).cast("string"))
    return j.groupBy(url.alias("url")).agg(F.max_by("description", "ord").alias("detail"))


@query("needs_description", f"WITH {DETAIL_SQL} SELECT board_id, ord, need FROM needy")
def needs_description(spark, sf):
    return listed(spark, sf).select("board_id", "ord", enrich.needs_description(F.col("description")).alias("need"))


@query("attach_details", f"WITH {DETAIL_SQL} SELECT board_id, ord, url, md5(description) AS description FROM filled")
def attach_details(spark, sf):
    return enrich.attach_details(listed(spark, sf), details(spark, sf)).select(
        "board_id", "ord", "url", F.md5("description").alias("description")
    )


@query(
    "rebuild_listings",
    f"""WITH {DETAIL_SQL},
    short AS (SELECT board_id, url, max(ord) AS o FROM filled WHERE need GROUP BY ALL),
    long AS (SELECT board_id, url, max(ord) AS o FROM filled WHERE NOT need GROUP BY ALL),
    busy AS (SELECT DISTINCT board_id FROM filled WHERE need)
    SELECT f.board_id, f.ord, p.title, md5(p.description) AS description, f.url FROM filled f
      LEFT JOIN short s USING (board_id, url) LEFT JOIN long l USING (board_id, url) LEFT JOIN busy b USING (board_id)
      JOIN filled p ON p.ord = CASE WHEN b.board_id IS NULL THEN f.ord ELSE coalesce(s.o, l.o) END""",
)
def rebuild_listings(spark, sf):
    return enrich.descriptions(listed(spark, sf), details(spark, sf)).select(
        "board_id", "ord", "title", F.md5("description").alias("description"), "url"
    )


@query(
    "enrichment_stats",
    f"WITH {DETAIL_SQL} SELECT board_id, count(*) FILTER (WHERE need) AS needing, count(*) AS total FROM needy GROUP BY board_id",
)
def enrichment_stats(spark, sf):
    return enrich.enrichment_stats(listed(spark, sf))
