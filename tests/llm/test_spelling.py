"""Operator 13 against a plain computation."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolecall.llm import spelling
from rolecall.llm.queries import op13_spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    n = {w: k for w, k in found.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def words(seed, n):
    """Documents of words with spelling variants of several degrees."""
    rnd = random.Random(seed)
    letters = "abcdeéÿ"
    stems = ["".join(rnd.choices(letters, k=rnd.randint(6, 14))) for _ in range(30)]

    def changed(w):
        i, kind = rnd.randrange(len(w) + 1), rnd.randrange(3)
        return w[:i] + ("", rnd.choice(letters), rnd.choice(letters))[kind] + w[i + (kind < 2) :]

    pool = stems * 12 + [changed(w) for w in stems for _ in range(8)] + [changed(changed(w)) for w in stems for _ in range(8)]
    return [" ".join(rnd.choice(pool).replace("a", rnd.choice("aaaA"), 1) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_variants_equal_a_plain_computation(spark):
    rows = list(enumerate(words(1, 150))) + [(None, "Gehäuse gehäuse Straßen straßen"), (7, None), (7, ""), (8, "x" * 5000 + " " + "x" * 5000)]
    chain = ["planning", "plannings", "planningss"]
    whole = next(i for i in range(1000, 2000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in chain))
    rows += [(whole, " ".join(chain[:1] * 300 + chain[1:2] * 30 + chain[2:] * 3))]
    rows += rows[:5]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and ("planningss", "plannings", "planning", 3, 1, 30) in want


def test_query_on_awkward_rows(spark, sf, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    docs = awkward.withColumns({c: F.lit(1) for c in ("word", "n", "key", "form")})
    assert {tuple(r) for r in op13_spelling(spark, sf(documents=docs)).collect()} == plain(rows)


def test_no_words(spark, sf, nothing):
    assert op13_spelling(spark, sf(documents=nothing)).collect() == []
    short = spark.createDataFrame([(1, "short words once onlyone")], "doc_id long, text string")
    assert spelling.variants(short).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_near_words_share_a_key(seed):
    """Whatever edit is made, of two near words the one whose prefix ends first has a pivot key among the other's keys."""
    rnd = random.Random(seed)
    found = ["".join(rnd.choices("abcd", k=rnd.randint(7, 12))) for _ in range(40)]
    for w in found[:]:
        for _ in range(6):
            i = rnd.randrange(len(w) + 1)
            found.append(rnd.choice([w[:i] + "e" + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :]]))
    found = sorted({w for w in found if len(w) >= 7})
    seen = Counter(g for w in found for g in {w[i : i + 2] for i in range(len(w) - 1)})
    ranks = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in seen.items()))}
    grams = {w: spelling.prefix(w, ranks) for w in found}
    pivots = {w: set().union(*(spelling.pivot_keys(w, p) for p in spelling.pivots(grams[w]))) for w in found}
    keys = {w: set().union(*(spelling.prefix_keys(w, p) for _, p in grams[w])) for w in found}
    pairs = [(a, b) for a in found for b in found if is_near(a, b) and grams[a][-1][0] <= grams[b][-1][0]]
    assert len(pairs) > 100 and all(pivots[a] & keys[b] for a, b in pairs)


def test_pivots_are_disjoint_and_cheapest():
    rnd = random.Random(5)
    for _ in range(300):
        places = rnd.sample(range(12), rnd.randint(3, 6))
        grams = sorted((rnd.randrange(50), p) for p in places)
        rank = {p: r for r, p in grams}
        chosen = spelling.pivots(grams)
        pairs = [(rank[a] + rank[b]) for a in places for b in places if b - a >= 2]
        assert chosen[1] - chosen[0] >= 2 and sum(rank[p] for p in chosen) == min(pairs)
