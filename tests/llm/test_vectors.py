"""Operator 11 against a plain computation."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from rolecall.llm import centroids
from rolecall.llm.queries import op11_centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, clusters=16, rounds=3):
    """(vec_id, cluster, distance) of usable rows, and the centroids."""
    usable = [(i, v) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in usable]
    place = lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    at = [p[1] for p in sorted(points, key=place)[:clusters]]

    def assign():
        out = []
        for i, p in points:
            d = [sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in at]
            out.append((i, d.index(min(d)), min(d), p))
        return out

    for _ in range(rounds):
        found = assign()
        at = [
            tuple(sum(x) // len(x) for x in zip(*mine, strict=True)) if (mine := [p for *_, c, _, p in found if c == k]) else old
            for k, old in enumerate(at)
        ]
    return [x[:3] for x in assign()], at


def vectors(n, seed, centers=5):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 3) for _ in range(64)] for _ in range(centers)]
    return [(i, [rnd.gauss(m, 0.3) for m in middle[i % centers]], 1) for i in range(n)]


AWKWARD = [
    (900, None, 1),
    (901, [0.5] * 63, 1),
    (902, [0.5] * 65, 1),
    (903, [0.5] * 63 + [None], 1),
    (904, [0.5] * 63 + [float("nan")], 1),
    (905, [0.5] * 63 + [float("-inf")], 1),
    (906, [], 1),
    (None, [0.25] * 64, None),
    (3, [-0.3] * 64, 1),
    (3, [-0.3] * 64, 1),
    (907, [-1e5] * 64, 1),
]


def test_clusters_equal_a_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    rows = vectors(300, 1) + AWKWARD
    rows += rows[:40]
    found = centroids.fit(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, at = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.members.collect()), key=key) == sorted(want, key=key)
    assert found.centroids == [list(c) for c in at]
    assert found.inertia == [sum(d for _, c, d in want if c == k) for k in range(16)]


def test_query_and_clashing_columns(spark, sf):
    rows = [(*r, "x", 1) for r in vectors(120, 2) + AWKWARD]
    schema = SCHEMA + ", cluster string, _id int"
    got = op11_centroids(spark, sf(embeddings=spark.createDataFrame(rows, schema))).collect()
    want, at = plain(rows)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    inertia = [sum(d for _, c, d in want if c == k) for k in range(len(at))]
    expected = {(i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in want}
    assert len(got) == len(want) and {tuple(r) for r in got} == expected


@pytest.mark.parametrize("rows", [[], AWKWARD[:7], AWKWARD[7:9]])
def test_few_or_no_usable_rows(spark, sf, rows):
    got = op11_centroids(spark, sf(embeddings=spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in got) == sorted((i or -1, c, d) for i, c, d in plain(rows)[0])


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(Exception, match="after scaling"):
        centroids.fit(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA))


@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3), (1, 4), (4, 2)])
def test_hilbert_neighbours_differ_by_one_step(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_rule_out_centroids_and_never_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 10)
    found = centroids.fit(spark.createDataFrame(vectors(400, 3), SCHEMA))
    table = centroids.blocks(centroids.integers(spark.createDataFrame(vectors(400, 3), SCHEMA), "embedding", "vec_id", 64, 64), 64)
    assert centroids.candidate_share(table, found.centroids) < 0.5
    rnd = np.random.default_rng(4)
    for _ in range(200):
        x, at = rnd.integers(-9, 9, (6, 5)), rnd.integers(-9, 9, (7, 5))
        few = centroids.candidates(x.min(0), x.max(0), at)
        best, distance = centroids.nearest(x, at[few])
        every = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (few[best] == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_large_components_are_exact():
    big = centroids.LARGEST
    x, at = np.array([[big, -big], [1, 2]]), np.array([[-big, big], [big, -big + 1]])
    assert centroids.nearest(x, at)[1].tolist() == [1, min((big + 1) ** 2 + (big - 2) ** 2, (big - 1) ** 2 + (big + 1) ** 2)]
