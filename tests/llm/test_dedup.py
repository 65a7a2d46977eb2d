"""Line, exact and near dedup and decontamination against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rolecall.llm import components, decontaminate, exactdedup, linededup, nearsets, queries, simhash


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, n, letters):
    text = list(text)
    for _ in range(n):
        i = random.randrange(len(text)) if text else 0
        kind = random.randrange(3) if text else 0
        if kind == 0:
            text.insert(i, random.choice(letters))
        elif kind == 1:
            del text[i]
        else:
            text[i] = random.choice(letters)
    return "".join(text)


def test_banded_edit_distance():
    random.seed(3)
    for _ in range(3000):
        a = "".join(random.choices("abc", k=random.randint(1, 14)))
        b = edited(a + "a", random.randint(0, 4), "abc")
        for most in range(4):
            d = distance(a, b)
            assert linededup.edits(a, b, most) == (d if d <= most else None)


def test_line_dedup(spark):
    random.seed(5)
    base = ["".join(random.choices("abcdé ", k=random.randint(15, 60))) for _ in range(60)]
    docs = []
    for d in range(120):
        lines = [edited(random.choice(base), random.choice([0, 0, 1, 2, 3]), "abcdé") for _ in range(random.randint(0, 8))]
        docs.append((d, "\n".join(lines) if d % 17 else None))
    got = {r.doc_id: r for r in linededup.clean(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    seen, removed = [], 0
    for d, text in docs:
        left, counts = [], [0, 0, 0]
        for line in (text or "").split("\n"):
            key = line.strip(linededup.SPACE)
            if len(key) < linededup.LEAST_CHARS:
                left.append(line)
                continue
            counts[0] += 1
            if key in seen:
                counts[1] += 1
            elif any(abs(len(o) - len(key)) <= 2 and distance(o, key) <= 2 for o in seen):
                counts[2] += 1
                removed += 1
            else:
                left.append(line)
            seen.append(key)
        want = ("\n".join(left) if text is not None else None, *counts)
        assert (got[d].text, got[d].n_lines, got[d].n_repeated, got[d].n_near) == want
    assert removed > 20


def test_line_dedup_tells_rows_apart(spark):
    """Rows that share an id, or have none, are documents of their own; clashing columns stay."""
    line = "a line that is long enough to be compared with others, number %s"
    rows = [(None, line % "one" + "\n" + line % "twenty"), (2, line % "three hundred"), (2, line % "four thousand" + "\n" + line % "one"),
            (None, line % "three hundred"), (1 << 62, line % "one"), (-5, line % "four thousandd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.withColumns({c: F.lit(c) for c in ("_id", "_row", "_equal", "_near", "_bucket", "_at", "c0")})
    got = linededup.clean(docs).collect()
    assert all(r["_id"] == "_id" and r["c0"] == "c0" for r in got)
    # In order: both rows without an id, -5, both rows of id 2, the last.
    want = [(None, line % "one" + "\n" + line % "twenty"), (None, line % "three hundred"), (-5, line % "four thousandd"), (2, ""), (2, ""), (1 << 62, "")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)


def test_pairs_stay_in_proportion_to_copies(monkeypatch):
    """Lines of a bucket that are all alike meet the first ones only, and themselves."""
    monkeypatch.setattr(linededup, "BLOCK", 50)
    monkeypatch.setattr(linededup, "MANY", 10)
    for n in (8, 200, 1700):
        h1, mark, at = np.arange(n) * 7 + 1, np.full(n, 2 * linededup.sketch("same") + 1), np.arange(n)[::-1].copy()
        pairs = [p for a, b in linededup.partners(h1, mark, at, 2) for p in zip(a.tolist(), b.tolist(), strict=True)]
        place = dict(zip(h1.tolist(), at.tolist(), strict=True))
        for i in range(n):
            mine = sorted(place[b] for a, b in pairs if place[a] == i)
            assert mine == (list(range(i)) if i <= 10 else [0, 1, 2, 3, i]), (n, i)


def test_lines_beyond_the_first_partners_are_found(spark):
    """Letters in another order have the same sketch, so that the first partners of a line are not near it."""
    random.seed(8)
    head, tail = "one common segment of lines ", list("abcdefghijklmnopqrstuvwx")
    others = []
    for _ in range(linededup.MANY + 6):
        random.shuffle(tail)
        others.append(head + "".join(tail) + head)
    docs = [(i, t) for i, t in enumerate(others)] + [(99, others[-1].replace("one", "two", 1))]
    docs += [(100, others[-1][:-1] + "!")]
    got = {r.doc_id: r.n_near for r in linededup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near = {i: int(any(linededup.edits(t, u) is not None for _, u in docs[:k])) for k, (i, t) in enumerate(docs)}
    assert got == near and near[100] == 1


def test_near_copies_are_verified_against_the_first_only(spark, monkeypatch):
    """Lines near to one of their first partners need no other, however many they have."""
    head = "a line of some length that many documents have, number "
    docs = [(i, head + f"{i:02d}") for i in range(60)]
    asked, check = [], linededup.verified

    def counting(*args):
        asked.extend(x.count() for x in args if "b" in getattr(x, "columns", ()))
        return check(*args)

    monkeypatch.setattr(linededup, "verified", counting)
    got = {r.doc_id: r.n_near for r in linededup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: int(i > 0) for i in range(60)} and 59 <= sum(asked) < 60 * 16


def test_near_dedup_leaves_no_sets(spark):
    """Tables of sets are dropped when the pairs they were read for are known."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[:39] + [f"end{i}"])) for i in range(9)]
    found = nearsets.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}
    left = [pq.read_schema(f).names for f in set(folder.rglob("*.parquet")) - before]
    assert left and not any({"_set", "size"} & set(names) for names in left)


def plain_components(prints):
    parent = list(range(len(prints)))

    def end(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, np.int64).view(np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            a, b = end(i), end(int(j))
            parent[max(a, b)] = min(a, b)
    return [end(i) for i in range(len(values))]


def test_pigeonring_links_reach_what_all_links_reach(spark):
    random.seed(6)
    prints = [random.getrandbits(64) for _ in range(150)]
    for _ in range(600):
        x = random.choice(prints)
        for _ in range(random.randint(1, 5)):
            x ^= 1 << random.randrange(64)
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    found = {r.node: r.root for r in roots.collect()}
    want, groups = plain_components(signed), {}
    for p, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(p)
    got = {}
    for p in signed:
        got.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and len(groups) < len(prints)


def test_components_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(50)) and found[300] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints_by_definition():
    random.seed(7)
    for n in (0, 1, 2, 3, 4, 50):
        text = "  ".join(random.choices(["Word", "ÄB", "x", "yz\t"], k=n))
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprints([text])[0]) & (1 << 64) - 1 == want


def test_near_dedup_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = [(3, text), (5, text + " end"), (1, "something else entirely"), (9, None), (8, "")]
    left = simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 8]


def test_near_sets_join_all_pairs_at_the_similarity(spark, monkeypatch):
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one two", "One  two"]
    for _ in range(40):
        words = random.choices(vocabulary, k=random.randint(3, 150))
        for _ in range(random.randint(1, 4)):
            copy = list(words)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = "new" + random.choice(vocabulary)
            texts.append(" ".join(copy))
    # One large group of near copies, and a passage that stands in very different texts.
    base = random.choices(vocabulary, k=120)
    texts += [" ".join([*base[:i], "x", *base[i:]]) for i in range(60)]
    texts += [" ".join(base[:20] + random.choices(vocabulary, k=40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    roots, linked = list(range(len(sets))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                linked += 1
                old, new = max(roots[i], roots[j]), min(roots[i], roots[j])
                roots = [new if r == old else r for r in roots]
    assert linked > 60
    read = lambda: {r.doc_id: r.component_id for r in nearsets.classes(docs).collect()}
    assert read() == dict(enumerate(roots))
    monkeypatch.setattr(nearsets, "BLOCK", 7)  # a hot shingle in several blocks
    monkeypatch.setattr(nearsets, "SENT_NODES", 0)
    assert read() == dict(enumerate(roots))


def test_near_dedup_stage_reaches_similarity_eight_tenths(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:50], "x", *words[51:110], "y", *words[111:150], "z", *words[151:]]  # 181 of 211 shingles: 0.86
    docs = [(1, " ".join(words)), (2, " ".join(near))]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert [r.doc_id for r in left.collect()] == [1]


def test_near_dedup_stage_links_fingerprints_too(spark):
    """Words in pairs, once with many repeats: the shingle sets are far apart, the fingerprints are equal."""
    words = [f"w{i}" for i in range(40)]
    other = words + [f"v{i}" for i in range(5)]
    docs = [(7, " ".join(words * 60)), (4, " ".join(words * 60 + other[38:]) + " end of it and more words still to come"), (9, "apart")]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs[:2]]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in simhash.classes(frame).collect()}
    assert linked == {4: 4, 7: 4, 9: 9}
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [4, 9]


def test_exact_dedup_has_no_false_alarms_or_misses(sf, spark):
    random.seed(8)
    texts = [random.choice(["a b", "ab", "a\tb ", "c", None, "", " ", f"t{i}"]) for i in range(500)]
    got = exactdedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = {}
    for d, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), d == min(g)[1]) for g in groups.values() for _, d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want


def test_large_filters_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 90}") for i in range(100)], "doc_id long, text string")
    small = sorted(exactdedup.classes(docs).collect())
    monkeypatch.setattr(exactdedup, "BROADCAST_BYTES", 0)
    assert sorted(exactdedup.classes(docs).collect()) == small


def windows_by_hand(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        yield doc, (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))


def test_decontamination(spark, monkeypatch):
    random.seed(9)
    vocabulary = ["the", "of", "a", "Rare", "éa", "x1", "on"]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, text(random.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(50, None)]
    docs = [(d, text(random.randint(0, 60)) + " " + (random.choice(items)[1] or "") if d % 3 else text(5)) for d in range(1, 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = dict(windows_by_hand(docs, items))
    read = lambda: {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.matches(frame, tests).collect()}
    assert read() == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)  # several blocks
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 500)
    assert read() == want


def test_proximity(spark):
    item = " ".join(f"w{i}" for i in range(13))
    near = item.replace("w6 ", "w6 new ").replace("w1 ", "")
    docs = spark.createDataFrame([(1, item), (2, near), (3, "w0 w12")], "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.matches(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()}
    assert got[1] == ([4], []) and got[3] == ([], [])
    assert got[2][0] == []


def near_by_hand(words, window):
    """Whether 10 of 13 terms (in proportion) stand in order within 3 words of their places, by dynamic programming."""
    need = len(window) - 3 * len(window) // 13
    for start in range(-9, len(words)):
        ends = {}  # longest chain by its last position
        for k, w in enumerate(window):
            fits = [p for p in range(max(0, start + k - 3), min(len(words), start + k + 4)) if words[p] == w]
            ends |= {p: max([ends.get(p, 0)] + [1 + n for q, n in ends.items() if q < p] + [1]) for p in reversed(fits)}
        if max(ends.values(), default=0) >= need:
            return True
    return False


def test_near_items_are_those_by_hand(sf, spark, monkeypatch):
    random.seed(14)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([2, 5, 9, 13, 16])))) for i in range(25)]
    docs = [(0, items[0][1])]
    for d in range(1, 120):
        words = random.choice(items)[1].split()
        for _ in range(random.randint(1, 4)):
            at = random.randrange(len(words))
            words[at : at + random.randint(0, 1)] = random.choice([[], ["new"], ["a", "b"]])
            words = words or ["x"]
        docs.append((d, " ".join(random.choices(vocabulary, k=random.randint(0, 6)) + words)))
    exact = {d: set(found) for d, (_, _, found, _) in windows_by_hand(docs, items)}
    want = {}
    for d, t in docs:
        near = set()
        for i, x in items:
            w = x.split()
            if any(near_by_hand(t.split(), w[j : j + 13]) for j in range(max(1, len(w) - 12))):
                near.add(i)
        want[d] = sorted(near - exact[d])
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 700)
    folder = sf(documents=[(d, t, "en", "s", 1) for d, t in docs], benchmark=items)
    got = {r.doc_id: [int(i) for i in r.near_items.split(",") if i] for r in queries.op6_near(spark, folder).collect()}
    assert got == want and sum(map(bool, want.values())) > 30


def test_op4_and_op8_queries(sf, spark):
    folder = sf(documents=[(1, "one line that is surely long enough\nshort", "en", "s", 1), (2, "one line that is surely long enough", "en", "s", 1)])
    lines = {r.doc_id: (r.n_lines, r.n_repeated, r.n_near) for r in queries.op4_linededup(spark, folder).collect()}
    assert lines == {1: (1, 0, 0), 2: (1, 1, 0)}
    assert all(len(r.fingerprint) == 16 for r in queries.op8_simhash(spark, folder).collect())


def test_near_dedup_moves_a_set_once(spark, monkeypatch):
    plans = []
    written = nearsets.materialize
    monkeypatch.setattr(nearsets, "materialize", lambda df, *a, **k: plans.append(df) or written(df, *a, **k))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "x y z u v w")], "doc_id bigint, text string")
    pairs = nearsets.nodes(docs, "text", "doc_id", 5).groupBy().agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    nearsets.similar(pairs, docs, "text", 5, 0.8)
    assert "_bucket" not in plans[-1]._jdf.queryExecution().optimizedPlan().toString()


def test_bits_rule_out_only_sets_that_differ(spark, monkeypatch):
    draw = random.Random(3)
    for _ in range(200):
        a = {draw.getrandbits(64) for _ in range(draw.randint(0, 900))}
        b = set(draw.sample(sorted(a), len(a) * draw.randint(0, 9) // 9)) | {draw.getrandbits(64) for _ in range(draw.randint(0, 100))}
        x, y = (nearsets.bits_of(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)
    written = []
    keep = nearsets.materialize
    monkeypatch.setattr(nearsets, "materialize", lambda df, *a, **k: written.append(keep(df, *a, **k)) or written[-1])
    monkeypatch.setattr(nearsets, "drop_folder", lambda *a: None)
    texts = [" ".join(f"w{i}x{n}" for i in range(60)) for n in range(20)] + [" ".join([f"w{i}x0" for i in range(60)] + ["more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = nearsets.nodes(docs, "text", "doc_id", 5)
    pairs = nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).filter("a < b")
    found = nearsets.similar(pairs, docs, "text", 5, 0.8)
    assert found.count() == 1
    assert sorted(t.count() for t in written if t.columns == ["a", "b"]) == [1, 1, 210]  # those found, those that met sets, all


def test_sets_of_pairs_that_bits_rule_out_are_not_made(spark, monkeypatch):
    """Many texts share their first shingles; only two are near copies, and only their sets are written."""
    words = lambda seed, n: [f"w{seed}x{i}" for i in range(n)]
    head = words("head", 12)
    texts = [" ".join(head + words(i, 30)) for i in range(20)]
    texts += [" ".join(words("same", 90) + [w]) for w in ("one", "two")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    written, write = [], nearsets.materialize

    def counting(df, *args, **options):
        table = write(df, *args, **options)
        if "values" in table.columns:
            written.append(table.count())
        return table

    monkeypatch.setattr(nearsets, "materialize", counting)
    nodes = [nearsets.node_of(nearsets.shingle_set(x)) for x in texts]
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(nodes, nodes[1:], strict=False)], "a LONG, b LONG")
    found = nearsets.similar(pairs, docs, "text", nearsets.SHINGLE, nearsets.SIMILARITY).collect()
    assert [tuple(x) for x in found] == [(min(nodes[-2:]), max(nodes[-2:]))] and written == [22, 2]
