"""Descriptions for listings that came without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import page as pg
from ..functions import urls
from ..functions.text import let
from ..sources.dom import CONTENT
from . import skew


def needs_description(description: Column) -> Column:
    return F.length(urls.strip(F.coalesce(description, F.lit("")))) < rules.MIN_DESCRIPTION_CHARS


def _first_text(page: pg.Page, selectors: list[str]) -> list[Column]:
    """The text of each selector's element if it is long enough and does not open with a notice."""

    def usable(text: Column) -> Column:
        good = (F.length(text) > rules.MIN_DETAIL_CHARS) & ~F.substring(text, 1, 100).rlike(rules.DESCRIPTION_NOISE)
        return F.when(good, text)

    return [let(page.select_one(s), lambda n: F.when(n.isNotNull(), let(page.text(n, " "), usable))) for s in selectors]


def description_of_page(ats: str | None = None, max_chars: int | None = None) -> Column:
    """Description text of the current detail-page row, or the empty string.

    Selectors are tried in list order, the ones of the board type first. Texts
    are whole; ``max_chars`` cuts them (``rules.MAX_DESCRIPTION_CHARS`` is the
    usual cut of job sites).
    """
    page = pg.Page(F.col("nodes"), F.col("texts"), CONTENT)
    specific = {k: v for k, v in rules.DESCRIPTION_SELECTORS.items() if k != rules.GENERIC and ats in (None, k)}
    by_type = F.when(F.lit(False), F.lit(""))
    for name, selectors in specific.items():
        by_type = by_type.when(F.col("ats") == name, F.coalesce(*_first_text(page, selectors)))
    text = F.coalesce(by_type, *_first_text(page, rules.DESCRIPTION_SELECTORS[rules.GENERIC]), F.lit(""))
    return F.substring(text, 1, max_chars) if max_chars else text


def detail_texts(
    parsed: DataFrame, max_chars: int | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(url, ats, *carry, detail)`` of parsed detail pages ``(url, ats, nodes, texts)``, found texts only."""
    found = parsed.select("url", "ats", *carry, description_of_page(max_chars=max_chars).alias("detail"))
    return found.filter(F.col("detail") != "")


def texts_by_type(parsed: DataFrame, max_chars: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(url, *carry, texts, place)`` of pages whose board type is not known yet.

    ``place`` says which of the different ``texts`` the selectors of each board type
    come to (``text_of_type`` reads it).
    """
    page = pg.Page(F.col("nodes"), F.col("texts"), CONTENT)

    def found(ats: str) -> Column:
        text = F.coalesce(*_first_text(page, rules.DESCRIPTION_SELECTORS[ats]))
        return F.struct(F.lit(ats).alias("key"), (F.substring(text, 1, max_chars) if max_chars else text).alias("value"))

    def parted(entries: Column) -> Column:
        def numbered(texts: Column) -> Column:
            places = F.transform(entries, lambda e: F.struct(e["key"], F.array_position(texts, e["value"]).cast("int")))
            return F.struct(texts.alias("texts"), F.map_from_entries(places).alias("place"))

        return let(F.array_distinct(F.transform(entries, lambda e: e["value"])), numbered)

    every = F.filter(F.array(*map(found, rules.DESCRIPTION_SELECTORS)), lambda e: e["value"].isNotNull())
    return parsed.select("url", *carry, let(every, parted).alias("_found")).select("url", *carry, "_found.*")


def text_of_type(ats: Column) -> Column:
    """Of a row of ``texts_by_type``, the text for a board type: its own, or that of any page."""
    own, other = (F.try_element_at("texts", F.try_element_at("place", k)) for k in (ats, F.lit(rules.GENERIC)))
    return F.coalesce(own, other)


def attach_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Fill short descriptions from ``details(url, detail)``, one row per URL.

    With a column ``ats`` in both tables, a detail counts for its board type only.
    Only listings that need one take part in the join; the others pass by it.
    """
    need = needs_description(F.col("description"))
    keys = ["url", "ats"] if {"ats"} <= set(details.columns) & set(listings.columns) else ["url"]
    asked = skew.spread_lookup(listings.filter(need), details, keys, ["board_id", "ord"], "left")
    filled = F.when(F.coalesce(F.col("detail"), F.lit("")) != "", F.col("detail")).otherwise(F.col("description"))
    answered = asked.withColumn("description", filled).select(*listings.columns)
    return answered.unionByName(listings.filter(~need))


def descriptions(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Enriched listings in their order: ``listings`` columns kept.

    On a board with any short description, listings of one URL all become the
    last short one of that URL (enriched), or the last one that had a text.
    Boards where nothing is missing come back unchanged. Listings are read twice: to find
    the last ones of every (board, URL), and to be rewritten; details meet those last ones only.
    """
    need = needs_description(F.col("description"))
    ats = [c for c in ("ats",) if {"ats"} <= set(details.columns) & set(listings.columns)]
    body = F.struct("title", "description", "location", *ats)

    def last(test: Column) -> Column:
        return F.max_by(F.when(test, body), F.when(test, F.col("ord")))

    per_url = listings.groupBy("board_id", "url").agg(last(need).alias("short"), last(~need).alias("long"))
    per_url = skew.materialize(per_url)
    busy = per_url.filter(F.col("short").isNotNull()).select("board_id").distinct()
    short = per_url.filter(F.col("short").isNotNull()).select("board_id", "url", "short.*")
    found = details.select("url", *ats, "detail")
    filled = skew.spread_lookup(short, found, ["url", *ats], ["board_id"], "left")
    text = F.when(F.coalesce("detail", F.lit("")) != "", F.col("detail")).otherwise(F.col("description"))
    filled = filled.select("board_id", "url", F.struct("title", text.alias("description"), "location").alias("_body"))
    long = per_url.filter(F.col("short").isNull()).select(
        "board_id", "url", F.struct("long.title", "long.description", "long.location").alias("_body")
    )
    chosen = filled.unionByName(skew.spread_lookup(long, busy, ["board_id"], ["url"]))
    joined = skew.spread_lookup(listings, chosen, ["board_id", "url"], ["ord"], "left")
    kept = [
        F.coalesce(F.col(f"_body.{c}"), F.col(c)).alias(c) if c in ("title", "description", "location") else F.col(c)
        for c in listings.columns
    ]
    return joined.select(*kept)


def enrichment_stats(listings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Listings needing a description, and all listings, per board (and type)."""
    keys = keys or [c for c in ("board_id", "ats") if c in listings.columns]
    need = needs_description(F.col("description"))
    return listings.groupBy(*keys).agg(
        F.count_if(need).alias("needing"), F.count(F.lit(1)).alias("total")
    )
