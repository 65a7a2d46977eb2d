"""Job cards planted into the real pages, and the rows they must come back as.

A page gets ``page_id % 6`` cards ahead of its article. Card ``k`` of page ``p``
is a template filled with p, k and a place, so the oracle states the expected
listing from (p, k) alone while the engine has to find it in the HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.sources import dom

from .registry import table

PLACES = ["Berlin", "New York, NY", "Remote", "London, UK", "Austin, TX"]
# Rows (page_id, url, html, n, k, place) of every planted card.
CARDS_SQL = """
cards AS (
  SELECT page_id, url, html, page_id % 6 AS n, k,
         ['Berlin', 'New York, NY', 'Remote', 'London, UK', 'Austin, TX'][k] AS place
  FROM pages, LATERAL (SELECT unnest(range(1, page_id % 6 + 1)) AS k) t),
bare AS (SELECT page_id, url, html, page_id % 6 AS n FROM pages)"""
ORIGIN_SQL = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def fill(template: str, p: Column, k: Column | None = None) -> Column:
    text = F.replace(F.lit(template), F.lit("{p}"), p.cast("string"))
    if k is None:
        return text
    place = F.element_at(F.array(*[F.lit(x) for x in PLACES]), k)
    return F.replace(F.replace(text, F.lit("{k}"), k.cast("string")), F.lit("{place}"), place)


def cards(template: str, n: Column | None = None) -> Column:
    """All cards of a page as one string."""
    p = F.col("page_id")
    n = (p % 6).cast("int") if n is None else n
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(numbers, lambda k: fill(template, p, k)), "\n")


def page_html(block: Column) -> Column:
    return F.replace("html", F.lit("<article>"), F.concat(block, F.lit("<article>")))


def pages_with(spark, sf: str, block: Column, url: Column | None = None) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("html", page_html(block))
    return pages if url is None else pages.withColumn("url", url)


# A board in the layout the all-purpose extractor reads: duplicates with and
# without a query, buttons, a menu link, a foreign link, a place that is none.
BOARD_CARD = """<div class="row"><h3>Engineer {p} {k}</h3><span class="location">Core • {place} • Full time</span>
<a href="/jobs/{p}-{k}?src=x">Apply now</a></div><div class="row"><a href="/jobs/{p}-{k}">Apply</a></div>
<div class="row"><h3>Elsewhere</h3><a href="https://elsewhere.example.com/jobs/{p}-{k}">Apply</a></div>"""
BOARD_HEAD = """<nav><a href="/jobs/menu">All jobs</a><a href="/jobs/more">More jobs</a></nav><div class="board">"""


def board_block(n: Column | None = None) -> Column:
    return F.concat(F.lit(BOARD_HEAD), cards(BOARD_CARD, n), F.lit("</div>"))


LINK_CARD = """<p><a href="https://boards.greenhouse.io/acme{p}/jobs/{p}{k}?gh_src=1"><span>Apply</span>
<span>Engineer {p} {k}</span><span class="city">{place}</span></a></p>"""
UUID_CARD = """<p><a href="/careers/0a1b2c3d-1111-2222-3333-00000000000{k}">Engineer {p} {k} → Apply</a></p>"""


def parsed(spark, sf: str, block: Column, url: Column | None = None) -> DataFrame:
    return dom.parse(pages_with(spark, sf, block, url))
