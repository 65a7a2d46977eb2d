"""Queries of page-level and extraction operators over planted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.functions import page as pg
from rolecall.operators import boards, discover, enrich, extract
from rolecall.sources import dom, tables

from . import planted
from .planted import CARDS_SQL, ORIGIN_SQL
from .registry import query, table


def P():
    return F.col("page_id")


@query("page_source", "SELECT page_id, url, CAST(length(html) AS INT) AS n_chars FROM pages")
def page_source(spark, sf):
    return tables.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


# The page's own heading, entities decoded.
HEADING_SQL = "regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"
for _entity, _char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
    HEADING_SQL = f"regexp_replace({HEADING_SQL}, '&{_entity};?', '{_char}', 'g')"


def _tag_count(tag: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '<{tag}[ >]')) AS BIGINT)"


@query(
    "dom_nodes",
    f"SELECT page_id, {_tag_count('p')} AS n_p, {_tag_count('a')} AS n_a, {_tag_count('li')} AS n_li, {_tag_count('h1')} AS n_h1 FROM pages",
)
def dom_nodes(spark, sf):
    nodes = dom.nodes(dom.parse(table(spark, sf, "pages")))
    counts = [F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("p", "a", "li", "h1")]
    return nodes.groupBy("page_id").agg(*counts)


@query(
    "page_anchors",
    """SELECT page_id, href, count(*) AS n FROM
       (SELECT page_id, replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '&amp;', '&') AS href FROM pages) GROUP BY ALL""",
)
def page_anchors(spark, sf):
    nodes = dom.nodes(dom.parse(table(spark, sf, "pages")))
    links = nodes.filter((F.col("tag") == "a") & F.col("href").isNotNull())
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    "noise_free_anchors",
    f"WITH {CARDS_SQL} SELECT page_id, CAST(3 * n AS BIGINT) AS n_links FROM bare",
)
def noise_free_anchors(spark, sf):
    parsed = planted.parsed(spark, sf, planted.board_block())
    shown = pg.board_page().where(lambda n: (n["tag"] == "a") & n["href"].isNotNull())
    return parsed.select("page_id", F.size(shown).cast("long").alias("n_links"))


@query(
    "heading_text",
    f"SELECT page_id, trim({HEADING_SQL}) AS heading FROM pages",
)
def heading_text(spark, sf):
    parsed = dom.parse(table(spark, sf, "pages"))
    return parsed.select("page_id", pg.Page(F.col("nodes"), F.col("texts")).text_of("h1").alias("heading"))


@query("spa_marker", "SELECT page_id, page_id % 3 <> 2 AS spa FROM pages")
def spa_marker(spark, sf):
    """A marker at the start of one third of the pages, far behind the start of another; the rest has none."""
    shell = F.lit('<div id="app"></div>')
    html = F.when(P() % 3 == 0, F.concat(shell, F.col("html"))).when(
        P() % 3 == 1, F.concat(F.col("html"), F.repeat(F.lit("<!-- -->"), 2000), shell)
    ).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", discover.is_spa(html).alias("spa"))


@query(
    "thin_content",
    "SELECT page_id, length(html) >= CASE WHEN page_id % 2 = 0 THEN 3000 ELSE 2000 END AS thick FROM pages",
)
def thin_content(spark, sf):
    return table(spark, sf, "pages").select("page_id", discover.is_thick(F.length("html"), P() % 2 == 0).alias("thick"))


EMBEDS = [
    '<iframe src="https://jobs.ashbyhq.com/acme{p}/embed?version=2"></iframe>',
    '<script src="https://boards.greenhouse.io/embed/acme{p}?for=x"></script>',
    '<iframe src="https://jobs.lever.co/acme{p}"></iframe>',
    '<iframe src="https://acme{p}.myworkdayjobs.com/site"></iframe><iframe src="https://jobs.lever.co/second{p}"></iframe>',
    '<iframe src="https://acme{p}.avature.net/careers"></iframe>',
    '<iframe src="https://acme{p}.fa.oraclecloud.com/hcmUI"></iframe>',
    "<iframe src='https://jobs.lever.co/single{p}'></iframe>",
]
EMBEDDED = [
    ("https://jobs.ashbyhq.com/acme{p}", "ashby"),
    ("https://boards.greenhouse.io/embed/acme{p}", "greenhouse"),
    ("https://jobs.lever.co/acme{p}", "lever"),
    ("https://jobs.lever.co/second{p}", "lever"),
    ("https://acme{p}.avature.net/careers", "avature"),
    ("https://acme{p}.fa.oraclecloud.com/hcmUI", "oracle_hcm"),
]


def _choice_sql(values) -> str:
    return "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(
    "embedded_board",
    f"""SELECT page_id, replace({_choice_sql([u for u, _ in EMBEDDED])}, '{{p}}', CAST(page_id AS VARCHAR)) AS board_url,
        {_choice_sql([a for _, a in EMBEDDED])} AS ats FROM pages WHERE page_id % 7 < 6""",
)
def embedded_board(spark, sf):
    block = planted.fill("", P())
    for i, template in enumerate(EMBEDS):
        block = F.when(P() % 7 == i, planted.fill(template, P())).otherwise(block)
    found = planted.pages_with(spark, sf, block).select("page_id", extract.embedded_board(F.col("html")).alias("b"))
    return found.filter(F.col("b").isNotNull()).select("page_id", "b.board_url", "b.ats")


@query(
    "next_page_link",
    "SELECT page_id, '/page/' || (page_id + 1) AS next_url FROM pages WHERE page_id % 4 <> 0",
)
def next_page_link(spark, sf):
    link = F.when(
        P() % 4 != 0, F.concat(F.lit('<a class="btn paginationNextLink" href="/page/'), (P() + 1).cast("string"), F.lit('">Next</a>'))
    ).otherwise('<a class="paginationNextLinkOff" href="/none">x</a>')
    parsed = planted.parsed(spark, sf, link)
    return parsed.select("page_id", discover.next_page_link().alias("next_url")).filter(F.col("next_url").isNotNull())


# Lines made of the page's own title, a place and its URL, separated in the ways that boards do.
TITLE_SQL = "regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[/|•·]', '', 'g')"


@query(
    "location_from_text",
    f"""WITH t AS (SELECT page_id, {TITLE_SQL} AS title FROM pages)
       SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'New York, NY' WHEN 1 THEN ''
         WHEN 2 THEN CASE WHEN length('Remote ' || title) < 60 THEN 'Remote ' || title ELSE '' END ELSE '' END AS location FROM t""",
)
def location_from_text(spark, sf):
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[/|•·]", "")
    text = (
        F.when(P() % 4 == 0, F.concat(title, F.lit(" • New York, NY • "), "url"))
        .when(P() % 4 == 1, F.concat(title, F.lit(" | Night shift")))
        .when(P() % 4 == 2, F.concat(F.lit("Remote "), title))
        .otherwise(title)
    )
    return table(spark, sf, "pages").select("page_id", extract.location_from_text(text).alias("location"))


@query(
    "universal_listings",
    f"""WITH {CARDS_SQL} SELECT page_id, CAST(k AS BIGINT) AS ord, 'Engineer ' || page_id || ' ' || k AS title, place AS location,
        {ORIGIN_SQL} || '/jobs/' || page_id || '-' || k AS job_url FROM cards""",
)
def universal_listings(spark, sf):
    found = extract.universal(planted.parsed(spark, sf, planted.board_block()))
    return found.select("page_id", "ord", "title", "location", "job_url")


@query(
    "universal_text_cards",
    f"""WITH {CARDS_SQL} SELECT page_id, CAST(k AS BIGINT) AS ord, 'Engineer ' || page_id || ' ' || k AS title,
          CASE WHEN k = 2 THEN '' ELSE place END AS location,
          {ORIGIN_SQL} || '/openings/team/' || page_id || '-' || k AS job_url FROM cards WHERE n >= 2
        UNION ALL
        SELECT page_id, CAST(1 AS BIGINT), 'Engineer ' || page_id || ' 1', 'Berlin', {ORIGIN_SQL} || '/openings/team/' || page_id || '-1'
        FROM cards WHERE n = 1
        UNION ALL
        SELECT page_id, CAST(1 + n AS BIGINT), 'Lone job', '', {ORIGIN_SQL} || '/careers/lone' FROM bare WHERE n < 2""",
)
def universal_text_cards(spark, sf):
    """Cards without headings; a lone link of another group counts only when no group exists."""
    card = F.concat(
        planted.cards('<div><p>Engineer {p} {k}</p><p class="geo{k}">{place}</p><a href="/openings/team/{p}-{k}">Apply now</a></div>'),
        F.lit('<div><b><a href="/careers/lone">Lone job</a></b></div>'),
    )
    # The second card's place names no location although its class announces one.
    card = F.replace(card, F.lit('<p class="geo2">New York, NY</p>'), F.lit('<p class="geo2">HQ</p><p>Paris</p>'))
    return extract.universal(planted.parsed(spark, sf, card)).select("page_id", "ord", "title", "location", "job_url")


@query(
    "direct_links",
    f"""WITH {CARDS_SQL} SELECT page_id, 'greenhouse' AS ats, CAST(k AS BIGINT) AS ord, 'Engineer ' || page_id || ' ' || k AS title,
        place AS location, 'https://boards.greenhouse.io/acme' || page_id || '/jobs/' || page_id || k AS job_url FROM cards WHERE n >= 2""",
)
def direct_links(spark, sf):
    """One more link repeats the first job: it counts for the minimum, not as a listing."""
    again = planted.fill('<a href="https://boards.greenhouse.io/acme{p}/jobs/{p}1">Again</a>', P())
    block = F.concat(planted.cards(planted.LINK_CARD), F.when(P() % 6 > 0, again).otherwise(""))
    found = extract.direct_links(planted.parsed(spark, sf, block))
    return found.select("page_id", "ats", "ord", "title", "location", "job_url")


@query(
    "self_hosted_links",
    f"""WITH {CARDS_SQL} SELECT page_id, 'generic' AS ats, CAST(k AS BIGINT) AS ord, 'Engineer ' || page_id || ' ' || k AS title,
        'Remote jobs' AS location, {ORIGIN_SQL} || '/careers/0a1b2c3d-1111-2222-3333-00000000000' || k AS job_url FROM cards WHERE n >= 3""",
)
def self_hosted_links(spark, sf):
    block = F.concat(F.lit("<div><h2>Remote jobs</h2><h3>Later</h3></div>"), planted.cards(planted.UUID_CARD))
    found = extract.direct_links(planted.parsed(spark, sf, block))
    return found.select("page_id", "ats", "ord", "title", "location", "job_url")


# --- board types -------------------------------------------------------------------
TITLE = "'Engineer ' || page_id || ' ' || k"
# name: (page url, card, page shown when there are no cards, expected url of a
# card, expected place of a card, description of a card, detail description)
BOARD_PAGES = {
    "lever": (
        "https://jobs.lever.co/acme",
        '<div class="posting"><a class="posting-title" href="/acme/{p}-{k}"><h5>Engineer {p} {k}</h5></a><span class="sort-by-location">{place}</span></div>',
        '<div class="posting-headline"><h2>Engineer {p} 0</h2></div><div class="content"><p>Text of</p><p>{p}</p></div>'
        '<div class="posting-categories"><i class="location">Oslo</i></div>',
        "'/acme/' || page_id || '-' || k",
    ),
    "ashby": (
        "https://jobs.ashbyhq.com/acme",
        '<a href="/acme/{p}-{k}"><div class="ashby-job-posting-brief x"><h3 class="ashby-job-posting-brief-title">Engineer {p} {k}</h3>'
        '<div class="ashby-job-posting-brief-details"><p>Core • {place} • Full time</p></div></div></a>',
        '<h1>Engineer {p} 0</h1><span class="big-location">Core · Oslo</span><main><p>Text of</p><p>{p}</p></main>',
        "'https://jobs.ashbyhq.com/acme/' || page_id || '-' || k",
    ),
    "workday": (
        "https://acme.myworkdayjobs.com/site",
        '<ul><li class="c"><a data-automation-id="jobTitle" href="/jobs/{p}-{k}">Engineer {p} {k}</a><dl><dd data-automation-id="locations">{place}</dd></dl></li></ul>',
        "",
        "'https://acme.myworkdayjobs.com/jobs/' || page_id || '-' || k",
    ),
    "avature": (
        "https://acme.avature.net/careers",
        '<article class="article article--result"><h3 class="article__header__text__title"><a class="link" href="JobDetail/{p}/{k}">Engineer {p} {k}</a></h3>'
        '<div class="article__header__text__subtitle"><span>{place}</span></div></article>',
        '<h1 class="title">Engineer {p} 0</h1><b class="job-location">Oslo</b><div class="article__body"><p>Text of</p><p>{p}</p></div>',
        "'https://acme.avature.net/JobDetail/' || page_id || '/' || k",
    ),
    "oracle_hcm": (
        "https://acme.fa.oraclecloud.com/hcmUI/CandidateExperience",
        '<div class="job-tile"><a class="job-grid-item__link" href="/hcmUI/job/{p}{k}"></a><span class="job-tile__title">Engineer {p} {k}</span>'
        '<li class="job-list-item__job-info-item">Posted today</li><li class="job-list-item__job-info-item"><div aria-label="Locations">{place}</div></li></div>',
        '<h1 class="job-title">Engineer {p} 0</h1><b aria-label="Locations">Oslo</b><main><p>Text of</p><p>{p}</p></main>',
        "'https://acme.fa.oraclecloud.com/hcmUI/job/' || page_id || k",
    ),
    "ibm": (
        "https://careers.ibm.com/search",
        '<article class="article--card"><h3 class="article__header__text__title"><a class="link" href="/job/{p}-{k}">Engineer {p} {k}</a></h3>'
        '<span class="card-item-location">{place}</span></article>',
        "",
        "'https://careers.ibm.com/job/' || page_id || '-' || k",
    ),
}


def _board_query(name, page_url, card, empty, url_sql):
    details = (
        f""" UNION ALL SELECT page_id, CAST(1 AS BIGINT), 'Engineer ' || page_id || ' 0', 'Text of ' || page_id, 'Oslo', '{page_url}'
             FROM bare WHERE n = 0"""
        if empty
        else ""
    )
    where = ""
    if name == "workday":  # without cards the menu items of the page are not listings, but its heading is
        details = f""" UNION ALL SELECT page_id, CAST(1 AS BIGINT), trim({HEADING_SQL}),
             '', '', '{page_url}' FROM bare WHERE n = 0"""

    @query(
        f"{name}_board",
        f"""WITH {CARDS_SQL} SELECT page_id, CAST(k AS BIGINT) AS ord, {TITLE} AS title, '' AS description, place AS location,
            {url_sql} AS job_url FROM cards {where} {details}""",
    )
    def run(spark, sf):
        block = F.concat(planted.cards(card), F.when(P() % 6 == 0, planted.fill(empty, P())).otherwise(""))
        pages = planted.pages_with(spark, sf, block, F.lit(page_url)).withColumn("ats", F.lit(name))
        found = boards.by_rules(dom.parse(pages, ("page_id", "url", "ats")), [name])
        return found.select("page_id", "ord", "title", "description", "location", "job_url")

    return run


for _name, _spec in BOARD_PAGES.items():
    _board_query(_name, *_spec)


@query(
    "greenhouse_board",
    f"""WITH {CARDS_SQL} SELECT page_id, CAST(k AS BIGINT) AS ord, {TITLE} AS title, '' AS description, place AS location,
          CASE WHEN page_id % 4 < 2 THEN 'https://job-boards.greenhouse.io' ELSE 'https://boards.greenhouse.io' END
            || '/acme/jobs/' || page_id || k AS job_url FROM cards
        UNION ALL SELECT page_id, CAST(1 AS BIGINT), 'Engineer ' || page_id || ' 0', 'Text of ' || page_id, 'Oslo',
          'https://boards.greenhouse.io/acme' FROM bare WHERE n = 0""",
)
def greenhouse_board(spark, sf):
    """Both formats of the board and the page of a single job."""
    rows = '<table><tr class="job-post"><td><a href="/acme/jobs/{p}{k}"><p>Engineer {p} {k}</p><p>{place}</p></a></td></tr></table>'
    items = '<section class="level-0"><div class="opening"><a href="/acme/jobs/{p}{k}">Engineer {p} {k}</a><span class="location">{place}</span></div></section>'
    one = (
        '<div id="header"><h1 class="app-title">Engineer {p} 0</h1><i class="location">Oslo</i></div>'
        '<div id="content"><div id="app_body"><p>Text of</p><p>{p}</p></div></div>'
    )
    block = F.when(P() % 6 == 0, planted.fill(one, P())).when(P() % 4 < 2, planted.cards(rows)).otherwise(planted.cards(items))
    pages = planted.pages_with(spark, sf, block, F.lit("https://boards.greenhouse.io/acme")).withColumn("ats", F.lit("greenhouse"))
    found = boards.by_rules(dom.parse(pages, ("page_id", "url", "ats")), ["greenhouse"])
    return found.select("page_id", "ord", "title", "description", "location", "job_url")


@query(
    "generic_cards",
    f"""WITH {CARDS_SQL} SELECT page_id, CAST(k AS BIGINT) AS ord, {TITLE} AS title, '' AS description, place AS location,
          {ORIGIN_SQL} || '/open/' || page_id || '-' || k AS job_url FROM cards WHERE n >= 2
        UNION ALL SELECT page_id, CAST(1 AS BIGINT), 'Single ' || page_id, 'Text of ' || page_id, '', url FROM bare WHERE n < 2""",
)
def generic_cards(spark, sf):
    """Cards by class name; with fewer than two the page is one listing."""
    card = '<div class="position-card"><a href="/open/{p}-{k}">Engineer <b>{p} {k}</b></a><span id="cityname">{place}</span></div>'
    one = planted.fill("<h1>Single {p}</h1><main><p>Text of</p><p>{p}</p></main>", P())
    block = F.concat(planted.cards(card), F.when(P() % 6 < 2, one).otherwise(""))
    pages = planted.pages_with(spark, sf, block).withColumn("ats", F.lit("generic"))
    found = boards.by_rules(dom.parse(pages, ("page_id", "url", "ats")), ["generic"])
    return found.select("page_id", "ord", "title", "description", "location", "job_url")


@query(
    "description_text",
    """SELECT page_id, rtrim(repeat('skill' || page_id || ' ', CAST(30 + page_id % 900 AS INT))) AS description FROM pages""",
)
def description_text(spark, sf):
    """Type-specific selector, fallback past a notice, and the generic list."""
    words = F.concat(F.lit("skill"), P().cast("string"), F.lit(" "))
    body = F.repeat(words, (P() % 900 + 30).cast("int"))
    notice = F.repeat(F.lit("Apply now and share this job. "), 10)
    block = (
        F.when(P() % 4 == 0, F.concat(F.lit('<div class="content big">'), body, F.lit("</div>")))
        .when(P() % 4 == 1, F.concat(F.lit('<div data-automation-id="jobPostingDescription">'), body, F.lit("</div>")))
        .when(
            P() % 4 == 2,
            F.concat(F.lit('<div class="content">'), notice, F.lit('</div><div class="posting-content">'), body, F.lit("</div>")),
        )
        .otherwise(F.concat(F.lit("<main><nav>Menu</nav>"), body, F.lit("</main>")))
    )
    ats = F.when(P() % 4 == 0, "lever").when(P() % 4 == 1, "workday").when(P() % 4 == 2, "lever").otherwise("ibm")
    pages = planted.pages_with(spark, sf, block).withColumn("ats", ats)
    parsed = dom.parse(pages, ("page_id", "ats"))
    return parsed.select("page_id", enrich.description_of_page().alias("description"))
