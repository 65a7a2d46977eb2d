"""Expressions over one parsed page: selectors, descendants and texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dom import BOARD, PLAIN, WHOLE
from .text import let  # noqa: F401

LISTING = "STRUCT<title: STRING, description: STRING, location: STRING, url: STRING>"


def listing(title: Column, location: Column, url: Column, description: Column | None = None) -> Column:
    return F.struct(
        title.alias("title"),
        (F.lit("") if description is None else description).alias("description"),
        location.alias("location"),
        url.alias("url"),
    )


def first(array: Column) -> Column:
    return F.get(array, 0)


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def inside(node: Column, root: Column) -> Column:
    return (node["pre"] > root["pre"]) & (node["pre"] <= root["end"])


_SIMPLE = re.compile(r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)'(?P<val>[^']*)')?\]|(?P<tag>\w+)")


def _value(node: Column, attr: str) -> Column:
    known = {"class": node["classes"], "id": node["id"], "href": node["href"]}
    return known.get(attr, F.element_at(node["attrs"], F.lit(attr)))


def compound(node: Column, rule: str) -> Column:
    """A rule such as ``div.opening`` or ``a[href*='/job/']`` as a predicate."""
    test = F.lit(True)
    for part in _SIMPLE.finditer(rule):
        if part["tag"]:
            test &= node["tag"] == part["tag"]
        elif part["id"]:
            test &= node["id"] == part["id"]
        elif part["cls"]:
            test &= F.concat(F.lit(" "), node["classes"], F.lit(" ")).contains(f" {part['cls']} ")
        elif part["op"] is None:
            has = node["href"].isNotNull() if part["attr"] == "href" else F.map_contains_key(node["attrs"], part["attr"])
            test &= has
        else:
            value = empty_if_null(_value(node, part["attr"]))
            test &= value.contains(part["val"]) if part["op"] == "*=" else value == part["val"]
    return test


class Page:
    """Handle on the ``nodes`` and ``texts`` of the current row.

    ``level`` is the visibility: elements and text above it do not exist.
    """

    def __init__(self, nodes: Column, texts: Column, level: int = WHOLE):
        self.nodes, self.texts, self.level = nodes, texts, level

    def visible(self, node: Column) -> Column:
        return F.lit(True) if self.level == WHOLE else node["noise"] <= self.level

    def node(self, pre: Column) -> Column:
        return F.get(self.nodes, pre)

    def below(self, root: Column | None) -> Column:
        """Descendants of an element (or all elements) in document order."""
        return self.nodes if root is None else F.slice(self.nodes, root["pre"] + 2, root["end"] - root["pre"])

    def where(self, test: Callable[[Column], Column], root: Column | None = None) -> Column:
        return F.filter(self.below(root), lambda n: self.visible(n) & test(n))

    def ranked(self, found: Column, rank: str, root: Column) -> Column:
        """Of the page-wide list ``found`` that ``rank`` counts, the slice that lies inside an element."""
        before = root[rank]
        return F.slice(found, before + 1, self.node(root["end"])[rank] - before)

    def matches(self, node: Column, rule: str) -> Column:
        """A rule with at most one ancestor step."""
        *above, own = re.sub(r"\s+", " ", rule).split(" ")
        test = compound(node, own)
        if len(above) == 1:
            test &= F.exists(self.nodes, lambda a: compound(a, above[0]) & inside(node, a))
        elif above:  # ancestor chain with the nearest step on the same element
            raise ValueError(f"more than one ancestor step: {rule}")
        return test

    def select(self, css: str, root: Column | None = None) -> Column:
        """All matches of comma-separated alternatives, in document order."""
        options = [r.strip() for r in css.split(",")]

        def test(n: Column) -> Column:
            hit = self.matches(n, options[0])
            for option in options[1:]:
                hit |= self.matches(n, option)
            return hit

        return self.where(test, root)

    def select_one(self, css: str, root: Column | None = None) -> Column:
        return first(self.select(css, root))

    def pieces(self, node: Column) -> Column:
        return F.slice(self.texts, node["t0"] + 1, node["t1"] - node["t0"])

    def text(self, node: Column, sep: str = "") -> Column:
        """Stripped visible text pieces of an element, joined; NULL for no element."""
        shown = F.filter(
            self.pieces(node), lambda t: (t["kind"] == PLAIN) & (F.lit(True) if self.level == WHOLE else t["noise"] <= self.level)
        )
        return F.array_join(F.transform(shown, lambda t: t["s"]), sep)

    def text_of(self, css: str, root: Column | None = None, sep: str = "") -> Column:
        """Text of the first match, or the empty string."""
        return empty_if_null(let(self.select_one(css, root), lambda n: self.text(n, sep)))


def board_page() -> Page:
    return Page(F.col("nodes"), F.col("texts"), BOARD)
