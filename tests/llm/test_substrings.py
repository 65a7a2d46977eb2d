"""Operator 12 against a plain computation."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import substrings
from rolecall.llm.queries import op12_substrings

LETTERS = "abcdefghij é"


def plain(rows, length=substrings.LENGTH):
    """(doc_id, bytes, removed, spans, kept) of each row."""
    order = sorted(range(len(rows)), key=lambda i: (1 << 63 if rows[i][0] is None else rows[i][0], i))
    seen, out = set(), [None] * len(rows)
    for i in order:
        content = (rows[i][1] or "").encode()
        covered = bytearray(len(content))
        for at in range(len(content) - length + 1):
            window = content[at : at + length]
            if window in seen:
                covered[at : at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, gone in zip(content, covered, strict=True) if not gone)
        spans = sum(gone and not (at and covered[at - 1]) for at, gone in enumerate(covered))
        out[i] = (rows[i][0], len(content), sum(covered), spans, kept)
    return out


def texts(seed, n):
    """Passages, copies with a few changed letters, and text of their own, put together."""
    rnd = random.Random(seed)
    some = lambda k: "".join(rnd.choices(LETTERS, k=k))
    passages = [some(rnd.randint(50, 700)) for _ in range(12)]

    def near(text):
        letters = list(text)
        for _ in range(rnd.randint(0, 2)):
            letters[rnd.randrange(len(letters))] = rnd.choice(LETTERS)
        return "".join(letters)

    kinds = [lambda: near(rnd.choice(passages)), lambda: some(rnd.randint(0, 150)), lambda: rnd.choice(passages)]
    return ["".join(rnd.choice(kinds)() for _ in range(rnd.randint(0, 4))) for _ in range(n)]


def awkward(seed):
    rows = [(i if i % 4 else (3, None)[i // 4 % 2], t) for i, t in enumerate(texts(seed, 120))]
    rows += [(500, "x" * 3000), (501, "ab" * 400), (502, "x" * 99), (503, "x" * 100), (504, "\0" * 300 + "a" + "\0" * 300)]
    return rows + [(505, None), (505, ""), (506, rows[1][1]), (506, rows[1][1])]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("hot", [False, True])
def test_removed_bytes_equal_a_plain_computation(spark, monkeypatch, hot):
    """With every repeated anchor hot and small blocks, results are the same."""
    if hot:
        for name, value in (("HOT_SEEN", 1), ("SAMPLED", 1), ("CHUNK", 700), ("CONTEXTS", 1500), ("ROWS", 50)):
            monkeypatch.setattr(substrings, name, value)
    rows = awkward(5)
    found = substrings.clean(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()]
    assert ordered(got) == ordered(plain(rows))


def test_query_and_clashing_columns(spark, sf, awkward=awkward):
    rows = [r for r in awkward(6) if r[0] is not None and r[0] != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("num", "_num", "kept", "spans", "doc", "c0")})
    got = {tuple(r) for r in op12_substrings(spark, sf(documents=docs.coalesce(1))).collect()}
    assert got == {(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain(rows)}
    whole = substrings.clean(docs.coalesce(1))
    assert set(whole.columns) == {*docs.columns, "n_bytes", "n_removed", "n_spans"} and whole.count() == len(rows)
    assert {(r.doc_id, r.text, r.num) for r in whole.collect()} == {(i, t, "x") for i, t in rows}


def test_repeat_groups_are_maximal_and_whole(spark):
    rows = list(enumerate(texts(7, 100))) + [(200, "y" * 400), (201, "y" * 250)]
    contents = {i: t.encode() for i, t in rows}
    groups = defaultdict(list)
    for r in substrings.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        groups[r["repeat"]].append((r["doc_id"], r["start"], r["size"]))
    assert len(groups) > 50
    covered = {i: bytearray(len(t)) for i, t in contents.items()}
    for places in groups.values():
        (string,) = {contents[i][at : at + size] for i, at, size in places}
        everywhere = {(i, at) for i, t in contents.items() for at in range(len(t)) if t.startswith(string, at)}
        assert len(string) >= substrings.LENGTH and len(places) > 1 and everywhere == {p[:2] for p in places}
        for i, at, size in sorted(places)[1:]:
            covered[i][at : at + size] = b"\1" * size
    assert {i: sum(c) for i, c in covered.items()} == {r[0]: r[2] for r in plain(rows)}


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.clean(empty).collect() == [] and substrings.groups(empty).collect() == []


def test_suffix_array_and_intervals():
    rnd = random.Random(3)
    for _ in range(150):
        parts = [bytes(rnd.choices(b"ab\0", k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        symbols, starts, ends = [], [], {}
        for part in parts:
            low = len(symbols)
            symbols += [c + 1 for c in part] + [0] * 7
            starts += range(low, low + len(part))
            ends |= {at: low + len(part) for at in range(low, low + len(part))}
        array, common = substrings.suffix_array(np.array(symbols, np.uint16), np.array(starts))
        found = [symbols[at : ends[at]] for at in array.tolist()]
        assert found == sorted(found)
        for a, b, size in zip(found, found[1:], common.tolist(), strict=False):
            assert a[:size] == b[:size] and a[size : size + 1] != b[size : size + 1] or size == min(len(a), len(b))
        for first, last, size in substrings.intervals(common.tolist(), [-1] * len(found)):
            string = found[first][:size]
            assert [f[:size] == string for f in found] == [first <= i <= last for i in range(len(found))]
