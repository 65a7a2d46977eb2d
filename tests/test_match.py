import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from rolecall.operators import match, skew, tiles

def tables(spark, resumes, boards):
    jobs = [(b, i, t, d) for b, listed in boards.items() for i, (t, d) in enumerate(listed)]
    return (
        spark.createDataFrame(list(resumes.items()), "resume_id LONG, resume_text STRING"),
        spark.createDataFrame(jobs, "board_id STRING, ord LONG, title STRING, description STRING"),
    )


def pairs_of(spark, pairs):
    return spark.createDataFrame(pairs, "resume_id LONG, board_id STRING")


def test_jobs_without_shared_words_come_last(spark):
    """Boards of made-up words: job i of a board shares i mod 3 of its words with the résumé."""
    random.seed(12)
    words = [f"word{i:03d}" for i in range(60)]
    own, others = words[:20], words[20:]
    boards = {
        b: [(f"job {b}{i}", " ".join(random.sample(own, i % 3 * 4) + random.sample(others, 6))) for i in range(n)]
        for b, n in (("x", 9), ("y", 4))
    }
    resumes, jobs = tables(spark, {7: " ".join(own)}, boards)
    rows = match.score_jobs(resumes, jobs, pairs_of(spark, [(7, "x"), (7, "y"), (7, "no such board")])).collect()
    assert len(rows) == 13
    for b, listed in boards.items():
        mine = sorted((r for r in rows if r.board_id == b), key=lambda r: r.rank)
        assert [(-r.score, r.ord) for r in mine] == sorted((-r.score, r.ord) for r in mine)
        for r in mine:
            shared = set(listed[r.ord][1].split()) & set(own)
            assert set(r.matched_keywords) == shared and (r.score > 0) == bool(shared)
            assert 0 <= r.score_pct <= 100 and f"({r.score_pct}%)" in r.explanation


def test_missing_texts_keep_their_jobs(spark):
    jobs = [("b", 0, None, "flink scala"), ("b", 1, "flink", None), ("b", 2, None, None)]
    listed = spark.createDataFrame(jobs, "board_id STRING, ord LONG, title STRING, description STRING")
    blank = spark.createDataFrame([("b", 0, "", "flink scala"), ("b", 1, "flink", ""), ("b", 2, "", "")], listed.schema)
    people = spark.createDataFrame([(1, "flink kafka"), (2, None)], "resume_id LONG, resume_text STRING")
    both = pairs_of(spark, [(1, "b"), (2, "b")])
    got = sorted(match.score_jobs(people, listed, both).collect())
    assert len(got) == 6 and got == sorted(match.score_jobs(people, blank, both).collect())


def test_boards_that_a_snapshot_has_not_seen(spark):
    people = spark.createDataFrame([(1, "flink scala kafka")], "resume_id LONG, resume_text STRING")
    old = spark.createDataFrame([("a", 0, "x", "flink")], "board_id STRING, ord LONG, title STRING, description STRING")
    new = spark.createDataFrame([("n", 0, "y", "scala flink"), ("n", 1, "z", "cook"), ("a", 5, "w", "kafka")], old.schema)
    pairs = pairs_of(spark, [(1, "a"), (1, "n")])
    frozen = match.board_df(skew.materialize(match.job_vectors(old, pairs.groupBy("board_id").agg(F.count("*").alias("n_pairs")))))
    got = {(r.board_id, r.ord): r.score for r in match.score_new(skew.materialize(match.resume_terms(people)), new, pairs, frozen).collect()}
    assert set(got) == {("n", 0), ("n", 1), ("a", 5)} and got["n", 0] > 0 and got["n", 1] == 0


def test_display_limits(spark):
    words = [f"skill{i:02d}" for i in range(15)]
    resumes, jobs = tables(spark, {1: " ".join(words)}, {"b": [("job", " ".join(words))]})
    whole = match.score_jobs(resumes, jobs, pairs_of(spark, [(1, "b")])).first()
    assert whole.matched_keywords == words and all(w in whole.explanation for w in words)
    cut = match.score_jobs(resumes, jobs, pairs_of(spark, [(1, "b")]), listed=10, told=(8, 5)).first()
    assert cut.matched_keywords == words[:10] and words[7] in cut.explanation and words[8] not in cut.explanation


# The direct computation: fit one corpus per (résumé, board) pair.
def direct(resume, listed):
    words = lambda t: t.split()
    docs = [Counter(words(resume))] + [Counter(words(t) + words(d) * 3) for t, d in listed]
    n = len(docs)
    df = Counter(w for d in docs for w in d)
    weights = [{w: tf * (math.log((1 + n) / (1 + df[w])) + 1) for w, tf in d.items()} for d in docs]
    norm = lambda d: math.sqrt(sum(v * v for v in d.values()))
    top = lambda d, k: {w for w, _ in sorted(d.items(), key=lambda x: (-round(x[1], 10), x[0]))[:k]}
    person = weights[0]
    out = []
    for i, job in enumerate(weights[1:]):
        length = norm(person) * norm(job)
        cos = sum(v * job.get(w, 0) for w, v in person.items()) / length if length else 0.0
        mine, theirs = top(person, 50), top(job, 30)
        out.append((i, cos, sorted(mine & theirs), sorted(theirs - mine)))
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(match, "TILE_JOBS", 3)
    monkeypatch.setattr(match, "TILE_RESUMES", 2)
    monkeypatch.setattr(skew, "BLOCK_ROWS", 4)


def test_closed_form_equals_direct(spark, small_tiles):
    rnd = random.Random(7)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    some = lambda lo, hi: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(lo, hi)))
    boards = {f"b{i}": [(some(0, 4), some(0, 90)) for _ in range(size)] for i, size in enumerate((1, 7, 13))}
    resumes = {i: some(1, 150) for i in range(5)}
    pairs = [(r, b) for r in resumes for b in boards]
    r, j = tables(spark, resumes, boards)
    got = {(x.resume_id, x.board_id, x.ord): x for x in match.score_jobs(r, j, pairs_of(spark, pairs)).collect()}
    assert len(got) == sum(len(boards[b]) for _, b in pairs)
    for person, board in pairs:
        want = direct(resumes[person], boards[board])
        for i, cos, matched, missing in want:
            row = got[person, board, i]
            assert row.score == pytest.approx(cos, abs=5.1e-5)
            assert (row.matched_keywords, row.missing_keywords) == (matched, missing), (person, board, i)
        order = sorted(want, key=lambda w: (-got[person, board, w[0]].score, w[0]))
        assert [got[person, board, w[0]].rank for w in order] == list(range(1, len(order) + 1))


def test_huge_boards_are_ranked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_ROWS", 2)
    boards = {"big": [(f"t{i}", "python docker" if i % 3 else "swift") for i in range(50)], "small": [("a", "python"), ("b", "go"), ("c", "swift")]}
    r, j = tables(spark, {1: "python swift", 2: "docker"}, boards)
    pairs = pairs_of(spark, [(1, "big"), (2, "big"), (1, "small")])
    rows = match.score_jobs(r, j, pairs).collect()
    for key in ((1, "big"), (2, "big"), (1, "small")):
        mine = sorted((x for x in rows if (x.resume_id, x.board_id) == key), key=lambda x: (-x.score, x.ord))
        assert [x.rank for x in mine] == list(range(1, len(mine) + 1))


def test_top_k_and_idle(spark):
    resumes, jobs = tables(spark, {1: "python docker"}, {"b": [("x", "python go"), ("y", "rust"), ("z", "docker")]})
    pairs = pairs_of(spark, [(1, "b")])
    assert [r.rank for r in match.score_jobs(resumes, jobs, pairs, top_k=2).orderBy("rank").collect()] == [1, 2]
    busy = match.score_jobs(resumes, jobs, pairs, keep_idle=False).collect()
    assert {r.ord for r in busy} == {0, 2}


def test_top_k_equals_the_cut_of_the_full_ranking(spark, small_tiles):
    rnd = random.Random(3)
    vocabulary = [f"term{chr(97 + i)}" for i in range(26)]
    listed = [("", " ".join(rnd.sample(vocabulary, rnd.randint(0, 2)))) for _ in range(30)]
    resumes, jobs = tables(spark, {i: " ".join(rnd.sample(vocabulary, 2)) for i in range(4)}, {"b": listed})
    pairs = pairs_of(spark, [(i, "b") for i in range(4)])
    full = match.score_jobs(resumes, jobs, pairs).filter("rank <= 9").collect()
    assert sum(r.score == 0 for r in full) > 5
    assert sorted(full) == sorted(match.score_jobs(resumes, jobs, pairs, top_k=9).collect())


def test_no_usable_term_scores_zero(spark):
    resumes, jobs = tables(spark, {1: "the and of"}, {"b": [("the", ""), ("role", "team")]})
    rows = match.score_jobs(resumes, jobs, pairs_of(spark, [(1, "b")])).collect()
    assert [(r.score, r.score_pct) for r in rows] == [(0.0, 0), (0.0, 0)]


def test_penalty_moves_the_percentage_not_the_rank(spark):
    listed = [("Senior one", "python docker"), ("One", "python swift kotlin")]
    resumes, jobs = tables(spark, {1: "python docker"}, {"b": listed})
    rows = match.score_jobs(resumes, jobs, pairs_of(spark, [(1, "b")])).orderBy("rank").collect()
    assert rows[0].ord == 0 and rows[0].score_pct == min(100, round(rows[0].score * 200 * 0.4))


def test_attach_jobs(spark):
    matches = spark.createDataFrame([(1, "b", 0)], "resume_id LONG, board_id STRING, ord LONG")
    jobs = spark.createDataFrame(
        [("b", 0, "t", "d", "l", "u")],
        "board_id STRING, ord LONG, title STRING, description STRING, location STRING, url STRING",
    )
    assert match.attach_jobs(matches, jobs).select(F.col("job.title"), F.col("job.url")).first() == ("t", "u")


def some_boards(seed, sizes, most=60):
    rnd = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    some = lambda lo, hi: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(lo, hi)))
    return {b: [(some(0, 3), some(0, most)) for _ in range(n)] for b, n in sizes.items()}, {i: some(0, 20) for i in range(6)}


def test_ranges_expand_to_the_whole_ranking(spark, small_tiles):
    boards, resumes = some_boards(5, {"a": 17, "b": 4}, 6)
    r, j = tables(spark, resumes, boards)
    pairs = pairs_of(spark, [(i, b) for i in resumes for b in boards])
    whole = {(x.resume_id, x.board_id, x.ord): x for x in match.score_jobs(r, j, pairs).collect()}
    shared, idle = match.score_shared(r, j, pairs)
    shared, idle = shared.collect(), idle.collect()
    for x in shared:
        y = whole[x.resume_id, x.board_id, x.ord]
        assert (x.score, x.matched_keywords, x.explanation) == (y.score, y.matched_keywords, y.explanation)
        assert x.rank == (y.rank if x.score else None)
    rest = Counter((k[0], k[1]) for k in whole.keys() - {(x.resume_id, x.board_id, x.ord) for x in shared})
    assert rest == Counter({k: sum(x.jobs for x in idle if (x.resume_id, x.board_id) == k) for k in rest}) and sum(rest.values()) > 20
    assert all(whole[x.resume_id, x.board_id, o].score == 0 for x in idle for o in (x.first_ord, x.last_ord))


def test_best_jobs_without_scoring_the_others(spark):
    """A few jobs share the résumé's rare words; most share a common one and cannot reach the best five."""
    boards = {"b": [("", "common word" + (" rare unusual seldom" if i % 100 == 7 else f" filler{i % 50:02d} stuff{i % 9}")) for i in range(1500)]}
    r, j = tables(spark, {1: "common rare unusual seldom", 2: "nothing of it"}, boards)
    pairs = pairs_of(spark, [(1, "b"), (2, "b")])
    full = match.score_jobs(r, j, pairs).filter("rank <= 5").collect()
    assert sorted(full) == sorted(match.score_jobs(r, j, pairs, top_k=5).collect())
    share = {x.resume_id: x.scored / x.jobs for x in match.scored_share(r, j, pairs, 5).collect()}
    assert share[1] < 0.05 and share[2] == 1


def test_sparse_listing_numbers(spark):
    """Statistics and ranks do not depend on how listing numbers are spread; no block of one job each."""
    boards, resumes = some_boards(6, {"a": 40})
    r, j = tables(spark, resumes, boards)
    pairs = pairs_of(spark, [(i, "a") for i in resumes])
    sparse = j.withColumn("ord", F.col("ord") * 1_000_003)
    dense = {(x.resume_id, x.ord * 1_000_003): (x.score, x.rank) for x in match.score_jobs(r, j, pairs).collect()}
    assert dense == {(x.resume_id, x.ord): (x.score, x.rank) for x in match.score_jobs(r, sparse, pairs).collect()}
    plan = match.job_vectors(sparse)._jdf.queryExecution().optimizedPlan().toString()
    assert "65536" not in plan


def test_a_full_tile_comes_out_in_bounded_batches():
    rnd = random.Random(1)
    words = [f"w{i:03d}" for i in range(300)]
    item = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())]))
    terms = lambda n, df: [dict(term=w, tf=1, df=df) for w in sorted(rnd.sample(words, n))]
    n_jobs, n_people = match.TILE_JOBS, match.TILE_RESUMES
    jobs = pa.table({"is_job": [True] * n_jobs, "ord": list(range(n_jobs)), "senior": [False] * n_jobs, "terms": pa.array([terms(8, 109) for _ in range(n_jobs)], item)})
    people = pa.table(
        {"is_job": [False] * n_people, "resume_id": list(range(n_people)), "years": [1.0] * n_people, "n_jobs": [n_jobs] * n_people, "norm2": [9.0] * n_people,
         "terms": pa.array([terms(6, 110) for _ in range(n_people)], item), "top": pa.array([[] for _ in range(n_people)], pa.list_(pa.string()))}
    )
    schema = pa.schema(
        [("board_id", pa.string()), ("resume_id", pa.int64()), ("ord", pa.int64()), ("cosine", pa.float64()), ("missing", pa.list_(pa.string())),
         ("idle_from", pa.int64()), ("idle_jobs", pa.int64())]
    )
    tile = pa.concat_tables([jobs, people], promote_options="default").to_batches()
    pairs, most = 0, 0
    for batch in tiles.meet((pa.scalar("b"), pa.scalar(0), pa.scalar(0)), iter(tile), schema):
        most = max(most, batch.nbytes)
        pairs += pc.sum(pc.fill_null(batch["idle_jobs"], 0)).as_py() + batch.num_rows - batch["ord"].null_count
    assert pairs == n_jobs * n_people and most < 64 << 20


def test_no_pair_is_written(spark, small_tiles, monkeypatch):
    """Ranks of a board of many tiles come without a table or a shuffle of its pairs; ties go by listing order."""
    rows, write = [], skew.materialize

    def counting(*args, **options):
        table = write(*args, **options)
        rows.append(table.count())
        return table

    monkeypatch.setattr(skew, "materialize", counting)
    boards, resumes = some_boards(9, {"a": 60, "b": 2}, 8)
    resumes = {i: f"{resumes[i % 6]} only{i % 5}" for i in range(12)}
    r, j = tables(spark, resumes, boards)
    pairs = pairs_of(spark, [(i, b) for i in resumes for b in boards])
    j = j.withColumn("ord", F.col("ord") * F.col("ord") * 977 - 400)
    scored = match.score_jobs(r, j, pairs)
    found = scored.collect()
    assert len(found) == 12 * 62 and max(rows) < 12 * 62 / 2
    for keep_idle, listed in ((True, found), (False, match.score_jobs(r, j, pairs, keep_idle=False).collect())):
        for key in {(x.resume_id, x.board_id) for x in listed}:
            mine = sorted((x for x in listed if (x.resume_id, x.board_id) == key), key=lambda x: (-x.score, x.ord))
            assert [x.rank for x in mine] == list(range(1, len(mine) + 1)), (keep_idle, key)
            assert not keep_idle or len(mine) > 30 or key[1] == "b"
    assert len(listed) < len(found)
    plain = match.score_jobs(r, j, pairs, ranked=False, worded=False)
    assert plain.columns == ["resume_id", "board_id", "ord", "score", "score_pct"]
    assert sorted(plain.collect()) == sorted(x[:5] for x in found)


def test_scores_round_as_printed():
    cosine = [0.12345, 0.12355, 0.123450000001, 0.00005, 0.00015, 0.99995, 1.0000000000000002, 0.0, 0.65435]
    assert tiles.rounded(np.array(cosine)).tolist() == [1234, 1236, 1235, 0, 2, 10000, 10000, 0, 6544]


def test_terms_are_counted_inside_the_rows_of_jobs(spark):
    jobs = [
        ("b", 1, "Python python dev", "python rust. rust, go kafka-2 the team"),
        ("b", 1, None, "rust"),
        ("b", 2, "", None),
        (None, 3, "kafka", "kafka"),
    ]
    frame = spark.createDataFrame(jobs, "board_id string, ord bigint, title string, description string")
    got = {(r.board_id, r.ord, r.term): r.tf for r in match.term_freqs(frame).collect()}
    assert got == {("b", 1, "python"): 5, ("b", 1, "dev"): 1, ("b", 1, "rust"): 9, ("b", 1, "kafka-2"): 3, (None, 3, "kafka"): 4}
    df = {(r.board_id, r.term): r.df for r in match.job_df(frame).collect()}
    assert df == {("b", ""): 2, ("b", "python"): 1, ("b", "dev"): 1, ("b", "rust"): 1, ("b", "kafka-2"): 1}
    plan = match._job_postings(frame, ["board_id", "ord"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # words are no rows that an aggregate takes


def test_rows_of_a_job_stand_side_by_side():
    """Keyword lists of a job are alike for all résumés: next to each other they take little room."""
    item = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())]))
    terms = lambda *words: [dict(term=w, tf=1, df=2) for w in words]
    jobs = pa.table({"is_job": [True] * 5, "ord": list(range(5)), "senior": [False] * 5, "terms": pa.array([terms("go", f"w{i}") for i in range(5)], item)})
    people = pa.table(
        {"is_job": [False] * 3, "resume_id": [7, 8, 9], "years": [1.0] * 3, "n_jobs": [5] * 3, "norm2": [9.0] * 3,
         "terms": pa.array([terms("go", f"w{i}") for i in range(3)], item), "top": pa.array([["go"]] * 3, pa.list_(pa.string()))}
    )
    schema = pa.schema([("resume_id", pa.int64()), ("ord", pa.int64()), ("matched", pa.list_(pa.string())), ("missing", pa.list_(pa.string()))])
    tile = pa.concat_tables([jobs, people], promote_options="default").to_batches()
    (batch,) = tiles.meet((pa.scalar("b"), pa.scalar(0), pa.scalar(0)), iter(tile), schema)
    assert batch["ord"].to_pylist() == [i for i in range(5) for _ in range(3)] and batch["resume_id"].to_pylist() == [7, 8, 9] * 5
    assert batch["matched"].to_pylist() == [["go"]] * 15


def test_both_sides_move_packed(spark, monkeypatch):
    """A tile is one block, résumés are blocks of many, and a block takes a fraction of the words in it."""
    boards, _ = some_boards(3, {"a": 700, "b": 9})
    resumes = {i: " ".join(f"word{chr(97 + (i + k) % 26)}{chr(97 + k % 8)}" for k in range(60)) for i in range(200)}
    r, j = tables(spark, resumes, boards)
    monkeypatch.setattr(match, "TILE_JOBS", 300)
    sides = match._sides(r, j, pairs_of(spark, [(i, b) for i in resumes for b in boards]))
    assert sorted((x.board_id, x.jt, x.marks) for x in sides.jobs.collect()) == [("a", 0, 300), ("a", 1, 300), ("a", 2, 100), ("b", 0, 9)]
    blocks = sides.people.collect()
    assert len(blocks) < 10 and sum(len(tiles.unpack(bytes(x.block))["sizes"]) for x in blocks) == 400
    assert sum(len(x.block) for x in blocks) < 2 * sum(map(len, resumes.values())) / 3
    assert sorted((x.board_id, x.jt) for x in match._tiles(sides).filter("kind = 3").distinct().collect())[-1] == ("b", 0)


def test_numbers_survive_packing():
    for numbers in ([], [0], [-5, 3, 70_000, -(1 << 31)], [1 << 40, -1]):
        got = tiles.unpack(tiles.pack(n=np.array(numbers, np.int64), words=pa.array(["é", None, "x"])))
        assert got["n"].tolist() == numbers and got["words"].to_pylist() == ["é", None, "x"]


def test_a_snapshot_is_the_statistics_of_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(match, "TILE_JOBS", 2)
    rows = [("a", i % 4 or None, "Senior x" if i % 3 else None, f"kafka word{i % 5}") for i in range(12)] + [("b", 1, "go", None), (None, 1, "go", "go"), ("c", 1, "x", "y")]
    jobs = spark.createDataFrame(rows, "board_id STRING, ord LONG, title STRING, description STRING")
    boards = spark.createDataFrame([("a", 3), ("b", 1)], "board_id STRING, n_pairs LONG")
    want = sorted(match.board_df(match.job_vectors(jobs, boards)).collect())
    got = match.snapshot(jobs, boards).select("board_id", "term", "df", "n_pairs")
    assert sorted(got.collect()) == want and {x.board_id for x in got.collect()} == {"a", "b"}
    counts = {(x.version, x.board_id, x.term): x.n for x in match.board_counts(jobs.withColumn("version", F.lit(7)), ["version"]).collect()}
    assert (counts[7, "a", ""], counts[7, "a", "kafka"], counts[7, "a", "word3"]) == (4, 4, 2) and counts[7, None, ""] == 1
