"""TF-IDF matching of many résumés against many boards.

Every (résumé, board) pair is its own corpus: the jobs of the board plus the
résumé. Refitting per pair would cost pairs x vocabulary. Adding one document
to a corpus raises the document frequency of exactly the résumé's terms by one,
so board-level statistics are built once and only shared terms are corrected:

    idf(d) = ln((2 + jobs) / (1 + d)) + 1         d = df + 1 for résumé terms
    dot    = sum over shared terms of tf_r * tf_j * idf(df + 1)^2
    |j|^2  = sum tf_j^2 idf(df)^2 + sum over shared tf_j^2 (idf(df+1)^2 - idf(df)^2)

The empty term is a sentinel carried by every document; its document frequency is
the number of jobs of the board. Vectors of both sides meet in tiles of bounded
size, where an inverted list of the tile's terms gives the shared ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .. import rules
from ..functions import text
from . import skew, tiles

SENTINEL = ""
TILE_JOBS, TILE_RESUMES = 4096, 256
#: A tile's résumés are read in turn, so it takes STRETCH times TILE_JOBS x TILE_RESUMES pairs: jobs move to few tiles.
STRETCH = 64
TILE = ["board_id", "jt", "rt"]


def idf(n_jobs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency with the résumé as one more document."""
    return F.log((n_jobs + F.lit(2.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def _counted(docs: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """``(*keys, term, tf)`` plus one sentinel row per document.

    Exploded tokens are counted by a hash aggregate: its partial step sits in
    the task that read the document, so what moves is one row per term.
    """
    # The outer form: a plain explode makes the optimizer add a "not empty"
    # filter below it, which would run the token pattern once more per row.
    words = docs.select(*keys, F.explode_outer(F.concat(F.array(F.lit(SENTINEL)), words)).alias("term"))
    return words.filter(~F.col("term").isin(text.NO_SIGNAL)).groupBy(*keys, "term").agg(F.sum(F.lit(rules.TITLE_WEIGHT)).alias("tf"))


def _job_texts(listings: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, title, description)``, one row per job, dealt out by job. Rows that share a key are one text; no token spans a space."""
    parts = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listings.select(*keys, "title", "description").repartition(parts, "board_id", "ord")
    joined = [F.array_join(F.collect_list(c), " ").alias(c) for c in ("title", "description")]
    return dealt.groupBy(*keys).agg(*joined)


def _job_terms(listings: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, terms)`` with terms (term, tf) of each job, counted inside its row: no word is a row, so nothing is aggregated or spilled."""
    count = lambda c: F.map_from_entries(text.counted(text.tokens(F.col(c))))
    none, weights = F.lit(0).cast("long"), (F.lit(rules.TITLE_WEIGHT), F.lit(rules.DESCRIPTION_WEIGHT))
    total = F.map_zip_with(
        count("title"),
        count("description"),
        lambda _, a, b: F.coalesce(a, none) * weights[0] + F.coalesce(b, none) * weights[1],
    )
    entries = F.map_entries(total).cast("array<struct<term: string, tf: bigint>>")
    return _job_texts(listings, keys).select(*keys, entries.alias("terms"))


def _job_postings(listings: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, term, tf)`` of each job, plus one sentinel row per job."""
    mark = F.array(F.struct(F.lit(SENTINEL).alias("term"), F.lit(rules.TITLE_WEIGHT).cast("long").alias("tf")))
    return _job_terms(listings, keys).select(*keys, F.concat(mark, "terms").alias("terms")).select(*keys, F.inline_outer("terms"))


def term_freqs(listings: DataFrame) -> DataFrame:
    """(board_id, ord, term, tf): title once, description three times."""
    return _job_postings(listings, ["board_id", "ord"]).filter(F.col("term") != SENTINEL)


def _resume_postings(resumes: DataFrame, keys: list[str]) -> DataFrame:
    return _counted(resumes, keys, text.raw_tokens(F.coalesce("resume_text", F.lit(""))))


def resume_term_freqs(resumes: DataFrame) -> DataFrame:
    """(resume_id, term, tf)"""
    return _resume_postings(resumes, ["resume_id"]).filter(F.col("term") != SENTINEL)


def doc_freqs(postings: DataFrame) -> DataFrame:
    """(board_id, term, df) over the jobs of each board."""
    return postings.groupBy("board_id", "term").agg(F.count(F.lit(1)).alias("df"))


def board_counts(listings: DataFrame, keys: list[str], hold: Callable[[DataFrame], DataFrame] = skew.materialize) -> DataFrame:
    """(*keys, board_id, term, n): jobs of each board that have a term; the sentinel's n is their number."""
    key = F.struct(*keys, "board_id")
    named = listings.withColumn("board_id", F.to_json(key)).withColumn("senior", F.lit(False))
    sizes = hold(named.groupBy("board_id").agg(F.count(F.lit(1)).alias("rows")))
    tiled = named.join(sizes, "board_id").withColumn("jt", _tile("ord", "rows", TILE_JOBS))
    jobs = _merged(tiled, hold)
    tiles_of = hold(jobs.groupBy("board_id").agg((F.max("jt") + 1).alias("tiles"), F.sum("marks").alias("n")))
    marks = tiles_of.select("board_id", F.lit(SENTINEL).alias("term"), "n")
    found = _words_told(_summed(jobs, tiles_of, hold)).withColumnRenamed("df", "n").unionByName(marks)
    back = F.from_json("board_id", listings.select(*keys, "board_id").schema)
    return found.select(back.alias("_key"), "term", "n").select("_key.*", "term", "n")


def _ordered(terms: Column, weight) -> Column:
    """Terms by weight, best first, names breaking ties."""
    return F.sort_array(
        F.transform(terms, lambda t: F.struct((-F.round(weight(t), tiles.WEIGHT_DIGITS)).alias("nw"), t["term"].alias("term")))
    )


def _with_seniority(listings: DataFrame) -> DataFrame:
    return listings.withColumn("senior", text.is_senior_title(F.coalesce("title", F.lit(""))))


def job_df(listings: DataFrame) -> DataFrame:
    """``(board_id, term, df)`` over the jobs of each board, written; the sentinel's df is the board size."""
    listings = _with_seniority(listings.filter(F.col("board_id").isNotNull()))
    texts = _job_texts(listings, ["board_id", "ord", "senior"])
    # How often a job has a term is of no use here.
    words = F.array_distinct(F.concat(text.tokens(F.col("title")), text.tokens(F.col("description"))))
    terms = texts.select("board_id", F.explode_outer(F.concat(F.array(F.lit(SENTINEL)), words)).alias("term"))
    return skew.materialize(doc_freqs(terms), compression="zstd")


def job_vectors(listings: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """``(board_id, ord, senior, n_jobs, n_pairs, terms)``, one row per job.

    ``terms`` holds (term, tf, df) with df counted over the board. ``boards(board_id, n_pairs)`` gives the
    number of paired résumés; jobs of boards without any are dropped.
    """
    jobs, dfs, sizes = _statistics(listings, boards)
    schema = StructType(
        [listings.schema[c] for c in ("board_id", "ord")]
        + StructType.fromDDL("senior boolean, n_jobs bigint, n_pairs bigint, terms array<struct<term: string, tf: bigint, df: bigint>>").fields
    )
    arrow = to_arrow_schema(schema)
    blocks = _job_blocks(jobs, dfs).join(sizes, "board_id")
    dealt = blocks.repartition("board_id", "jt").sortWithinPartitions("board_id", "jt", "kind", "at")
    return dealt.mapInArrow(lambda batches: tiles.vectors(batches, arrow), schema)


def snapshot(listings: DataFrame, boards: DataFrame) -> DataFrame:
    """``board_df`` of ``job_vectors``, without a vector made."""
    return _known(*_statistics(listings, boards)[1:])


def _statistics(
    listings: DataFrame, boards: DataFrame | None, hold: Callable[[DataFrame], DataFrame] = skew.materialize
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs in tiles, how many jobs of the board have their words, and ``(board_id, n_jobs, n_pairs, tiles)``, all written.

    No text and no word is a row that moves: terms are counted where a text is read, and go to the job's tile in blocks.
    What tiles tell each other are distinct words with a number, once, in buckets of words.
    """
    listings = listings.filter(F.col("board_id").isNotNull())
    if boards is not None:
        boards = hold(boards)
        listings = listings.join(boards.select("board_id"), "board_id", "left_semi")
    jobs = _merged(_placed(_with_seniority(listings), hold), hold)
    sizes = jobs.groupBy("board_id").agg(F.sum("marks").alias("n_jobs"), (F.max("jt") + 1).alias("tiles"))
    sizes = sizes.withColumn("n_pairs", F.lit(0).cast("long")) if boards is None else sizes.join(boards, "board_id")
    sizes = hold(sizes.select("board_id", "n_jobs", "n_pairs", "tiles"))
    return jobs, _summed(jobs, sizes, hold), sizes


def _placed(listings: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``listings`` with the number of their tile, ``jt``.

    Tiles are ranges of ``ord``, of TILE_JOBS jobs each whatever their numbers are: the numbers of boards beyond one tile
    are sorted, and counted by their place in the partition and the sizes of those before it. A job without ``ord`` is the first.
    """
    places = hold(listings.select("board_id", "ord").distinct())
    large = places.groupBy("board_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE_JOBS)
    large = hold(large.select("board_id"))
    if large.isEmpty():
        return listings.withColumn("jt", F.lit(0))
    ordered = places.join(large, "board_id").orderBy("board_id", F.col("ord").asc_nulls_first())
    ordered = hold(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")  # the upper bits of the number are the partition
    runs = ordered.groupBy("board_id", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("board_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(ahead, F.lit(0)) - F.col("first")).drop("first", "n")
    placed = ordered.select("board_id", "ord", "at", part).join(runs, ["board_id", "part"])
    place = F.col("before") + F.col("at")
    firsts = placed.filter((place > 0) & (place % TILE_JOBS == 0)).groupBy("board_id")
    firsts = hold(firsts.agg(F.sort_array(F.collect_list("ord")).alias("firsts")))
    passed = F.size(F.filter("firsts", lambda first: first <= F.col("ord")))
    jt = F.when(F.col("firsts").isNull(), 0).otherwise(passed).cast("int")
    return listings.join(firsts, "board_id", "left").withColumn("jt", jt).drop("firsts")


def _merged(listings: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(board_id, jt, marks, block): the jobs of each tile with their terms, written; see ``tiles.merged``."""
    words = [text.raw_tokens(F.col(c)).alias(c) for c in ("title", "description")]
    weights = {"title": rules.TITLE_WEIGHT, "description": rules.DESCRIPTION_WEIGHT}
    board = StructType([listings.schema["board_id"]])
    parts, whole = (StructType(board.fields + StructType.fromDDL(x).fields) for x in ("jt int, block binary", "jt int, marks bigint, block binary"))
    parts_arrow, whole_arrow = to_arrow_schema(parts), to_arrow_schema(whole)
    dull = text.NO_SIGNAL

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles.merged(key, batches, whole_arrow)

    counted = listings.select("board_id", "jt", "ord", "senior", *words)
    counted = counted.mapInArrow(lambda batches: tiles.counted_jobs(batches, parts_arrow, dull, weights), parts)
    return hold(counted.groupBy("board_id", "jt").applyInArrow(merge, whole))


def _summed(
    jobs: DataFrame, sizes: DataFrame, hold: Callable[[DataFrame], DataFrame], frozen: DataFrame | None = None
) -> DataFrame:
    """(board_id, h, jt, block): document frequencies of the words of each tile, by bucket, written; see ``tiles.summed``.

    A board of n tiles has n buckets, so a bucket is about as much as a tile. ``frozen(board_id, term, df)`` gives the frequencies instead of the jobs.
    """
    schema = StructType([jobs.schema["board_id"], *StructType.fromDDL("h int, jt int, block binary").fields])
    arrow, fixed = to_arrow_schema(schema), frozen is not None

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles.summed(key, batches, arrow, fixed)

    tiles_of = sizes.select("board_id", "tiles")
    words = jobs.join(tiles_of, "board_id").select("board_id", "jt", "tiles", "block").mapInArrow(lambda batches: tiles.words_of(batches, arrow), schema)
    words = words.withColumns({"term": F.lit(None).cast("string"), "df": F.lit(None).cast("long")})
    if fixed:
        told = frozen.filter(F.col("term") != SENTINEL).join(tiles_of, "board_id")
        told = told.select("board_id", F.pmod(F.crc32(F.col("term").cast("binary")), F.col("tiles")).cast("int").alias("h"), "term", F.col("df").cast("long").alias("df"))
        words = words.unionByName(told, allowMissingColumns=True)
    return hold(words.groupBy("board_id", "h").applyInArrow(add, schema))


def _words_told(dfs: DataFrame) -> DataFrame:
    """(board_id, term, df) of all words of the boards."""
    schema = StructType([dfs.schema["board_id"], *StructType.fromDDL("term string, df bigint").fields])
    arrow = to_arrow_schema(schema)
    return dfs.filter("jt is null").select("board_id", "block").mapInArrow(lambda batches: tiles.told_words(batches, arrow), schema)


def _known(dfs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``board_df`` of counted boards."""
    marks = sizes.select("board_id", F.lit(SENTINEL).alias("term"), F.col("n_jobs").alias("df"), "n_pairs")
    return _words_told(dfs).withColumn("n_pairs", F.lit(None).cast("long")).unionByName(marks)


def _job_blocks(jobs: DataFrame, dfs: DataFrame) -> DataFrame:
    """Tiles (kind 0) and the document frequencies of their words by bucket (kind 1)."""
    left = jobs.select("board_id", "jt", F.lit(0).alias("kind"), F.lit(0).alias("at"), "block")
    return left.unionByName(dfs.filter("jt is not null").select("board_id", "jt", F.lit(1).alias("kind"), F.col("h").alias("at"), "block"))


def _board_weight(t: Column) -> Column:
    return t["tf"] * idf(F.col("n_jobs"), t["df"])


def with_norm(vectors: DataFrame) -> DataFrame:
    """Add ``base2``, the squared norm of the job at board level."""
    total = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.pow(_board_weight(t), F.lit(2.0)))
    return vectors.withColumn("base2", total)


def with_ranked(vectors: DataFrame) -> DataFrame:
    """Add ``ranked``, terms by board-level weight, and ``idle_top``, the best of them."""
    ranked = vectors.withColumn("ranked", _ordered(F.col("terms"), _board_weight))
    best = F.slice("ranked", 1, rules.JOB_TOP_TERMS)
    idle = F.transform(best, lambda t: F.struct(t["nw"], t["term"], F.lit(False).alias("in_top")))
    return ranked.withColumn("idle_top", idle)


def board_df(vectors: DataFrame) -> DataFrame:
    """``(board_id, term, df, n_pairs)``; the sentinel's df is the board size."""
    terms = vectors.select("board_id", F.inline("terms")).groupBy("board_id", "term").agg(F.max("df").alias("df"))
    sizes = vectors.groupBy("board_id").agg(F.max("n_jobs").alias("df"), F.max("n_pairs").alias("n_pairs"))
    return terms.withColumn("n_pairs", F.lit(None).cast("long")).unionByName(
        sizes.withColumn("term", F.lit(SENTINEL))
    )


def resume_terms(resumes: DataFrame) -> DataFrame:
    """``(resume_id, years, terms)``: what a résumé is before it meets a board."""
    dated = resumes.withColumn("years", text.years_of_experience(F.coalesce("resume_text", F.lit(""))))
    return (
        _resume_postings(dated, ["resume_id", "years"])
        .groupBy("resume_id", "years")
        .agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    )


def resume_vectors(terms: DataFrame, pairs: DataFrame, df: DataFrame) -> DataFrame:
    """``(board_id, resume_id, years, n_jobs, n_pairs, norm2, terms)`` per pair, from ``resume_terms``.

    A pair whose board has no jobs disappears.
    """
    exploded = skew.spread_lookup(
        pairs.select("resume_id", "board_id"), terms, ["resume_id"], ["board_id"]
    ).select("board_id", "resume_id", "years", F.inline("terms"))
    known = skew.spread_lookup(exploded, df, ["board_id", "term"], ["resume_id"], "left")
    is_mark = F.col("term") == SENTINEL
    gathered = (
        known.groupBy("board_id", "resume_id")
        .agg(
            F.max("years").alias("years"),
            F.max(F.when(is_mark, F.col("df"))).alias("n_jobs"),
            F.max(F.when(is_mark, F.col("n_pairs"))).alias("n_pairs"),
            F.collect_list(
                F.when(~is_mark, F.struct("term", "tf", (F.coalesce("df", F.lit(0)) + 1).alias("df")))
            ).alias("terms"),
        )
        .filter(F.col("n_jobs").isNotNull())
    )
    n = F.col("n_jobs")
    weight = lambda t: t["tf"] * idf(n, t["df"])
    ranked = gathered.withColumn("_top", F.slice(_ordered(F.col("terms"), weight), 1, rules.RESUME_TOP_TERMS))
    return ranked.select(
        "board_id",
        "resume_id",
        "years",
        "n_jobs",
        "n_pairs",
        F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.pow(weight(t), F.lit(2.0))).alias("norm2"),
        F.col("terms"),
        F.transform("_top", lambda t: t["term"]).alias("top"),
    )


def _blocks(rows: Column, size: int) -> Column:
    return F.ceil(rows / F.lit(size)).cast("int")


def _tile(key: str, rows: str, size: int) -> Column:
    return F.pmod(F.xxhash64(key), _blocks(F.col(rows), size)).cast("int")


def score_jobs(
    resumes: DataFrame,
    listings: DataFrame,
    pairs: DataFrame,
    top_k: int | None = None,
    keep_idle: bool = True,
    listed: int | None = None,
    told: tuple[int | None, int | None] = (None, None),
    ranked: bool = True,
    worded: bool = True,
) -> DataFrame:
    """Score and rank every job of every paired board for every résumé.

    ``resumes(resume_id, resume_text)``, ``listings(board_id, ord, title,
    description)``, ``pairs(resume_id, board_id)``. One row per job and pair:
    ``resume_id, board_id, ord, score, score_pct, matched_keywords,
    missing_keywords, explanation, rank``. A corpus without a single usable
    term gives score 0 everywhere. The job vectors are written once to the shared
    folder and read by every later step.

    ``top_k`` keeps the best k per pair; tiles score only jobs that may be among
    them (``scored_share``), and keywords are worked out for those alone.
    ``keep_idle=False`` leaves out jobs that share no term altogether. ``score_shared`` has them as ranges.

    Rows are in proportion to jobs x résumés, so none of them is written or shuffled here: they leave
    the tiles with their rank (``_ahead``). ``ranked=False`` spares the count that ranks need, ``worded=False`` the keyword
    lists and explanations; their columns are missing then.

    Keyword lists and explanations are whole. Display limits: ``listed`` words in
    each list, ``told`` shared and missing words in the explanation (job sites
    show 10, 8 and 5).
    """
    sides = _sides(resumes, listings, pairs)
    if top_k is not None:
        return _words(rank_matches(_met(sides, top_k, keep_idle), top_k), listed, told)
    return _matches(sides, keep_idle, listed, told, ranked, worded)


@dataclass
class Sides:
    """Both sides of the matching, written: tiles of jobs, their document frequencies, blocks of résumés, and the sizes of boards."""

    jobs: DataFrame
    dfs: DataFrame
    people: DataFrame
    boards: DataFrame
    #: Types of board_id and resume_id.
    keys: list[StructField]


def _sides(resumes: DataFrame, listings: DataFrame, pairs: DataFrame) -> Sides:
    """Vectors of the jobs and of the pairs in blocks, and the tiles that they belong to."""
    pairs = pairs.select("resume_id", "board_id").distinct()
    boards = pairs.groupBy("board_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    jobs, dfs, sizes = _statistics(listings, boards)
    people = resume_vectors(resume_terms(resumes), pairs, _known(dfs, sizes))
    # A word that no job of the board has meets none; it counts in the norm.
    people = people.withColumn("terms", F.filter("terms", lambda t: t["df"] > 1))
    keys = [listings.schema["board_id"], pairs.schema["resume_id"]]
    return Sides(jobs, dfs, _packed_people(people, sizes, skew.materialize), sizes, keys)


def _packed_people(people: DataFrame, sizes: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(board_id, rt, at, n_jobs, tiles, block): résumés of each board in blocks of TILE_RESUMES at most, written."""
    schema = StructType([people.schema["board_id"], *StructType.fromDDL("rt int, at bigint, n_jobs bigint, tiles int, block binary").fields])
    arrow, most = to_arrow_schema(schema), TILE_RESUMES
    rows = people.join(sizes.select("board_id", "tiles"), "board_id").withColumn("rt", F.pmod(F.xxhash64("resume_id"), _pieces()).cast("int"))
    dealt = rows.repartition("board_id", "rt").sortWithinPartitions("board_id", "rt", "resume_id")
    return hold(dealt.mapInArrow(lambda batches: tiles.packed_people(batches, arrow, most), schema))


def score_new(
    terms: DataFrame,
    listings: DataFrame,
    pairs: DataFrame,
    df: DataFrame,
    hold: Callable[[DataFrame], DataFrame] = skew.materialize,
    worded: bool = True,
) -> DataFrame:
    """Score listings that are not part of the counted corpus, for written ``resume_terms``.

    ``df`` is the frozen ``board_df`` of a snapshot. A term the snapshot has
    not seen counts as found in no job. A board that the snapshot has not seen is
    its own snapshot: its size is the number of its new listings, no term of it
    counts as seen. ``hold`` keeps a table that is read more than once; ``worded`` as in ``score_jobs``.
    """
    pairs = pairs.select("resume_id", "board_id").distinct()
    is_mark = F.col("term") == SENTINEL
    known = df.filter(is_mark).select("board_id")
    unseen = listings.join(known, "board_id", "left_anti").groupBy("board_id").agg(F.count(F.lit(1)).alias("df"))
    asked = pairs.groupBy("board_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    fresh = unseen.join(asked, "board_id").withColumn("term", F.lit(SENTINEL))
    df = df.select("board_id", "term", "df", "n_pairs").unionByName(fresh.select("board_id", "term", "df", "n_pairs"))
    sizes = hold(df.filter(is_mark & F.col("df").isNotNull() & F.col("n_pairs").isNotNull()).select("board_id", F.col("df").alias("n_jobs"), "n_pairs"))
    listed = _with_seniority(listings.join(sizes.select("board_id"), "board_id", "left_semi"))
    jobs = _merged(_placed(listed, hold), hold)
    sizes = hold(sizes.join(jobs.groupBy("board_id").agg((F.max("jt") + 1).alias("tiles")), "board_id"))
    dfs = _summed(jobs, sizes, hold, df)
    pairs = pairs.join(sizes.select("board_id"), "board_id", "left_semi")
    people = _packed_people(resume_vectors(terms, pairs, df), sizes, hold)
    sides = Sides(jobs, dfs, people, sizes, [listings.schema["board_id"], pairs.schema["resume_id"]])
    return _matches(sides, worded=worded)


def _pieces() -> Column:
    """Tiles that the résumés of a board are dealt to."""
    pairs = F.col("n_pairs") * F.least("n_jobs", F.lit(TILE_JOBS))
    return _blocks(pairs, TILE_JOBS * TILE_RESUMES * STRETCH)


def _tiles(sides: Sides, ahead: DataFrame | None = None, several: bool = False) -> DataFrame:
    """Blocks of both sides, dealt to the tiles where they meet, jobs first; with ``several`` only of boards of more than one tile.

    A board of J jobs and R résumés is cut into ceil(J/4096) tiles (``_placed``), and more if one would have over
    4096 x 256 x STRETCH pairs, so neither a huge board nor a popular one lands in one task.
    A tile holds its jobs only: résumés pass by. So a job moves once for some 16,000 résumés, and
    a résumé once for 4,096 jobs, both packed (``tiles.pack``); terms are not joined as rows.
    """
    boards = sides.boards.filter("tiles > 1") if several else sides.boards
    pieces = boards.select("board_id", F.explode(F.sequence(F.lit(0), _pieces() - 1)).alias("rt"))
    left = _job_blocks(sides.jobs, sides.dfs).join(pieces, "board_id")
    right = sides.people.filter("tiles > 1") if several else sides.people
    right = right.withColumn("jt", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("kind", F.lit(3))
    parts = left.unionByName(right, allowMissingColumns=True)
    if ahead is not None:
        parts = parts.unionByName(ahead.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return parts.repartition(*TILE).sortWithinPartitions(*TILE, F.least("kind", F.lit(2)), "at", "kind")


def _ahead(sides: Sides, keep_idle: bool) -> DataFrame:
    """For the blocks of résumés and each tile of a board that has several, how many jobs of the board rank ahead of its levels.

    A level is a rounded score. Each tile counts its jobs by level for each résumé; as tiles are
    ranges of ``ord``, what ranks ahead of a level of a tile is all of the levels above it and the same level of the tiles before. So
    what moves is two short lists for a résumé and tile, packed, no row for a pair.
    """
    schema = StructType([sides.keys[0], *StructType.fromDDL("jt int, rt int, at bigint, block binary").fields])
    arrow = to_arrow_schema(schema)

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles.counted(key, batches, arrow, keep_idle)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles.with_ahead(key, batches, arrow)

    found = _tiles(sides, several=True).groupBy(*TILE).applyInArrow(count, schema)
    return found.groupBy("board_id", "rt", "at").applyInArrow(run, schema)


def _met(
    sides: Sides,
    top_k: int | None,
    keep_idle: bool,
    keep_busy: bool = True,
    ahead: DataFrame | None = None,
    ranked: bool = False,
    worded: bool = True,
) -> DataFrame:
    """Pairs with their score, keywords and rank, or ranges of the jobs that share no term with a résumé (``tiles.meet``)."""
    fields = "ord bigint, score double, score_pct int"
    if ranked:
        fields += ", rank int"
    if worded:
        fields += ", matched array<string>, missing array<string>"
    if not keep_busy:
        fields = "jt int, idle_jobs bigint, first_ord bigint, last_ord bigint"
    schema = StructType([*sides.keys, *StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles.meet(key, batches, arrow, top_k, keep_idle, keep_busy)

    return _tiles(sides, ahead).groupBy(*TILE).applyInArrow(run, schema)


def _matches(
    sides: Sides,
    keep_idle: bool = True,
    listed: int | None = None,
    told: tuple[int | None, int | None] = (None, None),
    ranked: bool = True,
    worded: bool = True,
) -> DataFrame:
    """Meet tile by tile, with ranks, and write the sentences."""
    ahead = _ahead(sides, keep_idle) if ranked else None
    found = _met(sides, None, keep_idle, ahead=ahead, ranked=ranked, worded=worded)
    if worded:
        return _words(found, listed, told)
    return found.select("resume_id", "board_id", "ord", "score", "score_pct", *(["rank"] if ranked else []))


def score_shared(
    resumes: DataFrame,
    listings: DataFrame,
    pairs: DataFrame,
    listed: int | None = None,
    told: tuple[int | None, int | None] = (None, None),
) -> tuple[DataFrame, DataFrame]:
    """What ``score_jobs`` gives, in proportion to shared terms: ``(matches, idle)``.

    ``matches`` are the jobs that share a term with the résumé; their ``rank`` is the one among all jobs,
    or NULL where the score rounds to zero and jobs of ``idle`` stand among them. ``idle(resume_id, board_id, tile, first_ord,
    last_ord, jobs)`` are the others: all jobs of that tile of the board from one ``ord`` to the other.
    """
    sides = _sides(resumes, listings, pairs)
    found = _met(sides, None, False, ahead=_ahead(sides, False), ranked=True)
    found = found.withColumn("rank", F.when(F.col("score") > 0, F.col("rank")))
    return _words(found, listed, told), _idle(sides)


def _idle(sides: Sides) -> DataFrame:
    """Ranges of jobs that share no term with a résumé; see ``score_shared``."""
    ranges = _met(sides, None, True, False)
    return ranges.select(
        "resume_id", "board_id", F.col("jt").alias("tile"), "first_ord", "last_ord", F.col("idle_jobs").alias("jobs")
    )


def idle_jobs(resumes: DataFrame, listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ranges of ``score_shared`` alone, without a score worked out."""
    return _idle(_sides(resumes, listings, pairs))


def scored_share(resumes: DataFrame, listings: DataFrame, pairs: DataFrame, top_k: int) -> DataFrame:
    """``(resume_id, board_id, jobs, scored)``: of how many jobs of the board the best ``top_k`` were worked out, and of how many in all."""
    sides = _sides(resumes, listings, pairs)
    schema = StructType([*sides.keys, *StructType.fromDDL("jobs bigint, scored bigint")])
    arrow = to_arrow_schema(schema)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tiles.scored_pairs(key, batches, arrow, top_k)

    found = _tiles(sides).groupBy(*TILE).applyInArrow(run, schema)
    return found.groupBy("resume_id", "board_id").agg(F.sum("jobs").alias("jobs"), F.sum("scored").alias("scored"))


def _words(ranked: DataFrame, listed: int | None = None, told: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Keyword lists and explanation; see ``score_jobs`` for the limits."""

    def shown(words: str) -> Column:
        return F.slice(words, 1, listed) if listed else F.col(words)

    return ranked.select(
        "resume_id",
        "board_id",
        "ord",
        "score",
        "score_pct",
        shown("matched").alias("matched_keywords"),
        shown("missing").alias("missing_keywords"),
        text.explain(F.col("score_pct"), F.col("matched"), F.col("missing"), *told).alias("explanation"),
        *(["rank"] if "rank" in ranked.columns else []),
    )


def rank_matches(scored: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` by rounded score, then listing order, within (résumé, board).

    The penalty scales the percentage only and does not move the rank. The window is cut inside every task before its shuffle.
    """
    return skew.rank_in_groups(scored, ["resume_id", "board_id"], "score", "ord").filter(F.col("rank") <= top_k)


def attach_jobs(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Nest the listing next to its match, the shape of the match result.

    ``ats`` and ``source_url`` come along where the listings have them.
    """
    job = F.struct("title", "description", "location", "url").alias("job")
    jobs = listings.select("board_id", "ord", *(c for c in ("ats", "source_url") if c in listings.columns), job)
    return skew.spread_lookup(matches, jobs, ["board_id", "ord"], ["resume_id"])
