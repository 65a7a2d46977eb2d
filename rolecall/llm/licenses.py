"""Operator 2: licence scans.

One Aho-Corasick automaton runs over the words of a text and finds identifier
tags and notice phrases. What follows a tag is a licence expression: a
shunting-yard parser turns it into postfix order (``with`` binds closest, then
``and``, then ``or``) and a stack evaluates that.

Words are runs of ``0-9``, ``a-z`` and everything from U+0080, with A-Z in lower
case. The automaton sees the words joined by one space, with a space before and
after each phrase, so that phrases match whole consecutive words only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from rolecall.llm.rows import map_texts

#: The phrases that every scan counts, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "creative commons attribution": "cc-by",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Words of the tags that a licence expression follows, and how a tag looks in the text.
TAGS = ("spdx license identifier", "license expression", "license identifier")
TAG = re.compile(r"(?:SPDX-)?License-(?:Identifier|Expression):[\x20\t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[\x20\t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: Labels of identifiers by how they start; others are labelled by the identifier itself.
FAMILIES = (
    ("agpl", "agpl"),
    ("lgpl", "lgpl"),
    ("gpl", "gpl"),
    ("apache", "apache"),
    ("cc-by", "cc-by"),
    ("mit", "mit"),
    ("bsd", "bsd"),
    ("mpl", "mpl"),
    ("epl", "epl"),
    ("isc", "isc"),
    ("bsl", "bsl"),
)
COPYLEFT = {"agpl", "lgpl", "gpl", "mpl", "epl"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Weights of evidence: a valid expression, a counted phrase, another notice, a tag without expression.
WEIGHTS = {"tag": 0.95, "base": 0.9, "notice": 0.6, "bare": 0.3}

_KEEP = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


@dataclass(frozen=True)
class Licence:
    """What an expression asks for: all labels, and whether a choice without copyleft exists."""

    labels: frozenset[str]
    permissive: bool


def words_of(text: str) -> list[bytes]:
    """Words of a text; all bytes of letters beyond ASCII are word bytes."""
    return text.encode("utf-8", "replace").translate(_KEEP).split()


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return next((label for start, label in FAMILIES if name == start or name.startswith((start + "-", start + "+"))), name)


def postfix(text: str) -> list[str]:
    """Postfix order of the longest licence expression at the start of ``text``.

    Shunting-yard. Reading stops before the first token that cannot go on (an
    identifier right after another, an unmatched parenthesis). The result is
    empty if what was read is no whole expression.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # an operand must come next
    depth = at = 0
    while m := TOKEN.match(text, at):
        token = m[1]
        name = token.lower()
        if operand and token == "(":
            waiting.append(token)
            depth += 1
        elif operand and token != ")" and name not in PRECEDENCE:
            out.append(token)
            operand = False
        elif not operand and token == ")" and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif not operand and name in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[name]:
                out.append(waiting.pop())
            waiting.append(name)
            operand = True
        else:
            break
        at = m.end()
    if operand or depth:
        return []
    return out + waiting[::-1]


def evaluate(order: list[str]) -> Licence | None:
    """Value of a postfix expression; ``with`` keeps the licence and drops the exception."""
    stack: list[Licence] = []
    for token in order:
        if token not in PRECEDENCE:
            label = label_of(token)
            stack.append(Licence(frozenset([label]), label not in COPYLEFT))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            choose = left.permissive or right.permissive if token == "or" else left.permissive and right.permissive
            stack.append(Licence(left.labels | right.labels, choose))
    return stack.pop() if stack else None


def automaton() -> ahocorasick.Automaton:
    """Base phrases, notices and tags, each between spaces."""
    machine = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            machine.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    machine.make_automaton()
    return machine


FIELDS = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_base", LongType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", ArrayType(StringType())),
        StructField("labels", ArrayType(StringType())),
        StructField("expressions", ArrayType(StringType())),
        StructField("permissive", BooleanType()),
        StructField("score", DoubleType()),
    ]
)


def scan_text(machine: ahocorasick.Automaton, text: str) -> tuple:
    """One row of ``FIELDS``."""
    words = words_of(text)
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    expressions: list[str] = []
    evidence: set[str] = set()
    tagged = False
    word = at = 0  # words that start before ``at``
    for end, (kind, label, size) in machine.iter(joined):
        start = end - size + 1
        if kind == "tag":
            tagged = True
            continue
        evidence.add(kind)
        labels.add(label)
        if kind == "base":
            # Ends come in order, starts nearly so: count on from the last start, or back to this one.
            word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            base.append(word)
            base_labels.add(label)
    choices: list[bool] = []
    if tagged:
        for m in TAG.finditer(text):
            order = postfix(m[1])
            found = evaluate(order)
            evidence.add("bare" if found is None else "tag")
            if found is not None:
                labels |= found.labels
                expressions.append(" ".join(order))
                choices.append(found.permissive)
    return (
        len(words),
        len(base),
        min(base, default=None),
        max(base, default=None),
        sorted(base_labels),
        sorted(labels),
        expressions,
        all(choices) if choices else None,
        max((WEIGHTS[e] for e in evidence), default=0.0),
    )


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add what each text says about its licence, one row out for each row in.

    ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start, null without any),
    ``base_labels`` and ``labels`` (distinct, sorted arrays), ``expressions`` (the
    valid licence expressions in postfix order), ``permissive`` (whether all of
    these can be met without copyleft; null without any) and ``score``, the
    weight of the strongest evidence. Null and empty texts have no words and
    score 0. Columns of the same names are replaced. No shuffle.
    """

    def make():
        machine = automaton()
        return lambda texts: list(map(list, zip(*(scan_text(machine, x) for x in texts), strict=True)))

    return map_texts(df, make, FIELDS, text, keep)
