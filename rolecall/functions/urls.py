"""URL operators as native column expressions.

``parse_url`` is avoided on purpose: under ANSI mode it throws on malformed
input, and crawled hrefs are malformed often. One lenient regex splits a URL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import let

_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    """Path without the ``;params`` tail of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_url(url: Column) -> Column:
    u = strip(url)
    return (
        F.when(u.contains("://"), u)
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .otherwise(F.concat(F.lit("https://"), u))
    )


def base_url(url: Column) -> Column:
    """``scheme://netloc``, or NULL when the URL names no host."""
    return F.when(netloc(url) != "", F.concat(scheme(url), F.lit("://"), netloc(url)))


def is_careers_url(url: Column) -> Column:
    """The URL is a known board domain, or its path already looks like careers."""
    return url.rlike(rules.BOARD_DOMAINS) | path(url).rlike(rules.CAREERS_PATH)


def detect_ats(url: Column) -> Column:
    (first, pattern), *rest = rules.ATS_URL_PATTERNS
    ats = F.when(url.rlike(pattern), first)
    for name, pattern in rest:
        ats = ats.when(url.rlike(pattern), name)
    return ats.otherwise(rules.GENERIC)


def _drop_dots(segments: Column) -> Column:
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(s == ".", kept)
        .otherwise(F.concat(kept, F.array(s))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(walked, tail)


def _join_path(base_path: Column, ref_path: Column) -> Column:
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    joined = F.when(ref_path.startswith("/"), ref_path).otherwise(F.concat(base_dir, ref_path))
    last = F.substring_index(joined, "/", -1)
    parts = F.split(joined, "/")
    inner = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: s != "")
    cleaned = F.array_join(_drop_dots(F.concat(inner, F.array(last))), "/")
    return F.concat(F.lit("/"), cleaned)


def split(url: Column) -> Column:
    """Parts of a base URL as a struct, to be computed once per page."""
    return F.struct(
        url.alias("url"),
        scheme(url).alias("scheme"),
        netloc(url).alias("netloc"),
        _part(url, 3).alias("path"),
        _part(url, 4).alias("query"),
    )


def resolve_in(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page whose ``split`` URL is ``base``."""
    r_scheme, r_path, r_query = _part(href, 1), _part(href, 3), _part(href, 4)
    query = F.when((r_path == "") & (r_query == ""), base["query"]).otherwise(r_query)
    fragment = _part(href, 5)
    suffix = F.concat(
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    site = F.concat(base["scheme"], F.lit("://"))
    own = F.when(r_path == "", base["path"]).otherwise(_join_path(base["path"], r_path))
    return (
        F.when(href.startswith("http") | (base["url"] == ""), href)
        .when(href == "", base["url"])
        .when((r_scheme != "") & (F.lower(r_scheme) != base["scheme"]), href)
        .when(netloc(href) != "", F.concat(site, netloc(href), r_path, suffix))
        .otherwise(F.concat(site, base["netloc"], own, suffix))
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base`` (a URL with a host)."""
    return let(split(base), lambda parts: resolve_in(parts, href))


def prefix_host(host: str, href: Column) -> Column:
    """Boards with one fixed host put it in front of anything not absolute."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(host), href))


def canonical(url: Column) -> Column:
    return F.rtrim(F.substring_index(url, "?", 1), F.lit("/"))


def base_pattern(url: Column) -> Column:
    """Grouping key of a job link: at most two leading path segments, never the last."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    depth = F.least(F.size(parts) - 1, F.lit(2))
    kept = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(depth, F.lit(0))), "/"))
    host = netloc(url)
    return (
        F.when(F.size(parts) == 0, url)
        .when(host != "", F.concat(scheme(url), F.lit("://"), host, kept))
        .otherwise(kept)
    )


def is_job_url(href: Column, domain: Column) -> Column:
    host = netloc(href)
    return ((host == "") | (host == domain)) & href.rlike(rules.JOB_URL)


def is_uuid_href(href: Column) -> Column:
    return href.rlike(rules.UUID_HREF)


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def strip_embed(url: Column) -> Column:
    return F.regexp_replace(url, r"/embed$", "")
