"""Queries of the URL operators over URLs derived from ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.functions import urls
from rolecall.operators import discover

from .registry import query, table

# One of eight board URLs or a bare company site, in four spellings.
TEMPLATES = [
    "boards.greenhouse.io/acme{k}/jobs/{k}?gh_src=a",
    "jobs.lever.co/acme{k}/5f1f-{k}/",
    "jobs.ashbyhq.com/acme{k}#top",
    "acme{k}.myworkdayjobs.com/en-US/careers/job/Oslo/{k}",
    "acme{k}.avature.net/careers/JobDetail/Clerk/{k}?source=x",
    "acme{k}.fa.oraclecloud.com/hcmUI/CandidateExperience/en/job/{k}",
    "careers.ibm.com/job/{k}/clerk",
    "www.acme{k}.com/about/openings/{k}//",
    "acme{k}.example.org",
]
REQUESTS_SQL = """
requests AS (
  SELECT c_custkey AS request_id, CASE c_custkey % 4
    WHEN 0 THEN 'https://' || tail WHEN 1 THEN tail WHEN 2 THEN '//' || tail ELSE '  http://' || tail || ' ' END AS url
  FROM (SELECT c_custkey, replace(CASE c_custkey % 9 {cases} END, '{{k}}', CAST(c_custkey AS VARCHAR)) AS tail FROM customer)),
full_urls AS (SELECT request_id, url, CASE WHEN contains(trim(url), '://') THEN trim(url)
    WHEN starts_with(trim(url), '//') THEN 'https:' || trim(url) ELSE 'https://' || trim(url) END AS full_url FROM requests)
""".format(cases=" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES)))
WITH = f"WITH {REQUESTS_SQL}"
HOST = "split_part(split_part(split_part(split_part(full_url, '://', 2), '/', 1), '?', 1), '#', 1)"
PATH = r"regexp_extract(full_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def requests(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    tail = F.replace(F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (k % 9 + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    url = (
        F.when(k % 4 == 0, F.concat(F.lit("https://"), tail))
        .when(k % 4 == 1, tail)
        .when(k % 4 == 2, F.concat(F.lit("//"), tail))
        .otherwise(F.concat(F.lit("  http://"), tail, F.lit(" ")))
    )
    return c.select(k.alias("request_id"), url.alias("url"))


def full_urls(spark, sf):
    return discover.normalized(requests(spark, sf))


@query("request_source", WITH + " SELECT request_id, url FROM requests")
def request_source(spark, sf):
    return requests(spark, sf)


@query("normalize_url", WITH + " SELECT request_id, full_url FROM full_urls")
def normalize_url(spark, sf):
    return full_urls(spark, sf).select("request_id", "full_url")


@query("base_url", WITH + f" SELECT request_id, split_part(full_url, '://', 1) || '://' || {HOST} AS base FROM full_urls")
def base_url(spark, sf):
    return full_urls(spark, sf).select("request_id", "base")


@query(
    "is_careers_url",
    WITH + " SELECT request_id, request_id % 9 <> 8 AS careers FROM requests",  # all templates but the bare site
)
def is_careers_url(spark, sf):
    return full_urls(spark, sf).select("request_id", urls.is_careers_url(F.col("full_url")).alias("careers"))


# Board types of the templates, by hand.
ATS_SQL = "['greenhouse', 'lever', 'ashby', 'workday', 'avature', 'oracle_hcm', 'ibm', 'generic', 'generic'][request_id % 9 + 1]"


@query("detect_ats", WITH + f" SELECT request_id, {ATS_SQL} AS ats FROM requests")
def detect_ats(spark, sf):
    return full_urls(spark, sf).select("request_id", urls.detect_ats(F.col("full_url")).alias("ats"))


@query(
    "canonical_url",
    WITH + " SELECT request_id, rtrim(split_part(full_url, '?', 1), '/') AS canonical FROM full_urls",
)
def canonical_url(spark, sf):
    return full_urls(spark, sf).select("request_id", urls.canonical(F.col("full_url")).alias("canonical"))


@query(
    "url_base_pattern",
    WITH
    + f""", parts AS (SELECT request_id, full_url, {HOST} AS host, split_part(full_url, '://', 1) AS scheme,
            list_filter(string_split({PATH}, '/'), lambda s: s <> '') AS p FROM full_urls)
          SELECT request_id, CASE WHEN len(p) = 0 THEN full_url ELSE
            scheme || '://' || host || '/' || array_to_string(p[1:least(len(p) - 1, 2)], '/') END AS pattern FROM parts""",
)
def url_base_pattern(spark, sf):
    return full_urls(spark, sf).select("request_id", urls.base_pattern(F.col("full_url")).alias("pattern"))


@query(
    "is_job_url",
    # The lever template has no job word, only a number that counts from five digits on.
    WITH
    + """ SELECT request_id, request_id % 2 = 0 AND request_id % 9 <> 8
          AND (request_id % 9 NOT IN (1, 2) OR request_id % 9 = 1 AND request_id >= 10000) AS job FROM requests""",
)
def is_job_url(spark, sf):
    domain = F.when(F.col("request_id") % 2 == 0, urls.netloc(F.col("full_url"))).otherwise("elsewhere.example.com")
    return full_urls(spark, sf).select("request_id", urls.is_job_url(F.col("full_url"), domain).alias("job"))


# Every link of a page that is one word below the root, written in four ways.
LINK = '<a[^>]*href="/([^"/?#:]*[A-Za-z][^"/?#:]*)"'


@query(
    "resolve_href",
    f"""WITH links AS (
          SELECT page_id, url, unnest(regexp_extract_all(html, '{LINK}', 1)) AS w,
                 generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) AS k FROM pages),
        parts AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[^?#]*', 0) AS page FROM links)
        SELECT page_id, k, CASE k % 4 WHEN 0 THEN origin || '/' || w
            WHEN 1 THEN CASE WHEN page = origin THEN origin || '/' ELSE regexp_replace(page, '[^/]*$', '') END || w
            WHEN 2 THEN regexp_extract(url, '^[a-z]+', 0) || '://cdn.example.com/' || w
            ELSE page || '?q=' || w END AS resolved FROM parts""",
)
def resolve_href(spark, sf):
    found = table(spark, sf, "pages").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("at", "w")
    )
    k = F.col("at") + 1
    href = (
        F.when(k % 4 == 0, F.concat(F.lit("/"), "w"))
        .when(k % 4 == 1, F.col("w"))
        .when(k % 4 == 2, F.concat(F.lit("//cdn.example.com/"), "w"))
        .otherwise(F.concat(F.lit("?q="), "w"))
    )
    return found.select("page_id", k.cast("long").alias("k"), urls.resolve(F.col("url"), href).alias("resolved"))


@query(
    "fixed_host_href",
    WITH + r""" SELECT request_id, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://boards.greenhouse.io' || url END AS href FROM requests""",
)
def fixed_host_href(spark, sf):
    return requests(spark, sf).select(
        "request_id", urls.prefix_host("https://boards.greenhouse.io", F.col("url")).alias("href")
    )


@query(
    "self_hosted_href",
    """SELECT c_custkey AS request_id, CAST('0x' || left(md5(c_name), 1) AS INT) % 3 = 0 AS self_hosted FROM customer""",
)
def self_hosted_href(spark, sf):
    """Identifiers from customer names: below one segment, below two, or a name in their place."""
    m = F.md5("c_name")
    uuid = F.concat_ws("-", *(F.substring(m, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kind = F.conv(F.substring(m, 1, 1), 16, 10).cast("int") % 3
    href = F.when(kind == 0, F.concat(F.lit("/careers/"), uuid)).when(kind == 1, F.concat(F.lit("/a/b/"), uuid)).otherwise(
        F.concat(F.lit("/careers/"), "c_name")
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), urls.is_uuid_href(href).alias("self_hosted"))


@query(
    "strip_fragment_and_embed",
    WITH
    + """ SELECT request_id, split_part(full_url, '#', 1) AS no_fragment, split_part(full_url, '#', 1) AS no_embed FROM full_urls""",
)
def strip_fragment_and_embed(spark, sf):
    bare = urls.strip_fragment(F.col("full_url"))
    return full_urls(spark, sf).select(
        "request_id",
        bare.alias("no_fragment"),
        urls.strip_embed(F.concat(bare, F.when(F.col("request_id") % 2 == 0, "/embed").otherwise(""))).alias("no_embed"),
    )


@query(
    "crawl_plan",
    WITH
    + f""", plans(ats, strategy, ai_targeted, browser, network_idle) AS (VALUES
          ('greenhouse', 'standard', true, false, false), ('lever', 'standard', true, false, false),
          ('avature', 'standard', true, false, false), ('ashby', 'browser', true, true, true),
          ('workday', 'browser', true, true, true), ('oracle_hcm', 'scroll', false, true, true),
          ('ibm', 'paginate', false, true, true), ('generic', 'generic', false, false, true))
        SELECT request_id, full_url AS careers_url, p.* FROM full_urls JOIN plans p ON p.ats = {ATS_SQL}""",
)
def crawl_plan(spark, sf):
    careers = full_urls(spark, sf).select("request_id", F.col("full_url").alias("careers_url"))
    return discover.crawl_plan(careers)


@query(
    "candidate_paths",
    WITH
    + f", bases AS (SELECT DISTINCT split_part(full_url, '://', 1) || '://' || {HOST} AS base FROM full_urls), "
    + """paths(path_ord, path) AS (VALUES (0, '/careers'), (1, '/jobs'), (2, '/work-with-us'), (3, '/join-us'),
         (4, '/about/careers'), (5, '/company/careers'), (6, '/company/jobs'), (7, '/en/careers'), (8, '/en/jobs'))
         SELECT base, path_ord, base || path AS candidate FROM bases, paths""",
)
def candidate_paths(spark, sf):
    return discover.candidate_paths(full_urls(spark, sf).select("base").distinct())


@query(
    "invalid_requests",
    """SELECT c_custkey AS request_id, 'discover' AS stage,
         'Invalid input URL: /' || c_name || ' — Invalid URL: https:///' || c_name AS message FROM customer""",
)
def invalid_requests(spark, sf):
    broken = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("/"), "c_name").alias("url"))
    return discover.invalid_requests(broken)
