"""Operator 6: benchmark decontamination over a distributed positional inverted index.

The index is split by documents: every shard is a block of whole documents and
holds, for each test term, the ascending list of its token positions, counted
through the shard. It is written as a table of one row per shard, so no shuffle
moves postings, a very common term or passage is spread over all shards, and a
lost executor costs only its own shards.

A search answers each window of test words in every shard: the posting lists of
its words are moved by the words' offsets and intersected, from the rarest term
in that shard to the most common, until nothing is left or all words have been
met. What remains are exact phrase matches, with no look at the texts. Windows
that only come near (all but ``MISSED`` of 13 terms, in proportion for shorter
ones, stand in order within ``SLACK`` words of their places, and the document has
no exact match of the item) are proximity matches. They are looked for from each
of the rarest terms in the shard, one more than may be missed, so none gets lost; the starts of
many windows are looked up together, term by term, in one sorted array of all postings.

The test side is sent to executors in blocks of at most ``BLOCK_WORDS`` words;
a larger benchmark is searched block by block. Rows are numbered then, and the hits
of a row are merged by its number.
"""

from __future__ import annotations

import functools
import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from rolecall.llm.licenses import words_of
from rolecall.llm.rows import sliced
from rolecall.operators.skew import materialize

#: Words of a window, and words of the benchmark that are searched for at once.
WINDOW = 13
BLOCK_WORDS = 1_000_000
#: A proximity match: all but so many of a window's terms in order, each at most SLACK words from its place.
#: With these values a match can't reach over the ``WINDOW`` numbers between documents.
MISSED = 3
SLACK = 3
#: Characters of documents in a shard, and starts of windows that are looked up at once.
SHARD_CHARS = 8_000_000
STARTS = 1_000_000

SHARD = StructType(
    [
        StructField("doc_ids", ArrayType(LongType())),
        StructField("bases", ArrayType(LongType())),
        StructField("n_words", ArrayType(LongType())),
        StructField("terms", ArrayType(IntegerType())),
        StructField("ends", ArrayType(LongType())),
        StructField("positions", BinaryType()),
    ]
)
SPAN = "array<struct<start:bigint,end:bigint>>"
HITS = "doc_id bigint, n_words bigint, hits " + SPAN + ", items array<bigint>, near_items array<bigint>"


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with their words, in blocks of bounded size; the driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        words = words_of(row[1] or "")
        if not words:
            continue
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row[0], words))
        held += len(words)
    if block:
        yield block


def build_index(docs: DataFrame, terms: dict[bytes, int], text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per shard: its documents, and the positions of each test term that occurs in it.

    Positions number the words of a shard; between two documents ``WINDOW`` numbers
    are left out, so that no window reaches over an end. Documents without test
    terms are in the index with their number of words.
    """
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    arrow = to_arrow_schema(SHARD)

    def run(batches):
        number = sent.value.get
        for batch in sliced(batches, 1, SHARD_CHARS):
            ids, texts = (c.to_pylist() for c in batch.columns)
            bases, counts, found, base = [], [], [], 0
            for value in texts:
                words = words_of(value or "")
                bases.append(base)
                counts.append(len(words))
                found.append(np.array([number(w, -1) for w in words], "i4"))
                found.append(np.full(WINDOW, -1, "i4"))
                base += len(words) + WINDOW
            row = np.concatenate(found)
            places = np.flatnonzero(row >= 0)
            order = np.argsort(row[places], kind="stable")
            places = places[order]
            present, first = np.unique(row[places], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], arrow.field("doc_ids").type),
                    pa.array([bases], arrow.field("bases").type),
                    pa.array([counts], arrow.field("n_words").type),
                    pa.array([present.tolist()], arrow.field("terms").type),
                    pa.array([[*first[1:].tolist(), len(places)] if len(places) else []], arrow.field("ends").type),
                    pa.array([places.astype("<u4").tobytes()]),
                ],
                schema=arrow,
            )

    return materialize(source.mapInArrow(run, SHARD))


def windows_of(block: list[tuple[int, list[bytes]]], terms: dict[bytes, int]) -> list[tuple]:
    """Distinct windows as term numbers, with the places of their items."""
    windows: dict[tuple[int, ...], list[int]] = {}
    for place, (_, words) in enumerate(block):
        numbers = [terms[w] for w in words]
        for i in range(max(1, len(numbers) - WINDOW + 1)):
            owners = windows.setdefault(tuple(numbers[i : i + WINDOW]), [])
            if not owners or owners[-1] != place:
                owners.append(place)
    return list(windows.items())


def intersect(window: tuple[int, ...], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Starts of a window in a shard: offset-adjusted lists, intersected from the rarest term on."""
    order = sorted(range(len(window)), key=lambda k: len(lists[window[k]]))
    starts = lists[window[order[0]]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        other = lists[window[k]]
        at = np.searchsorted(other, starts + k)
        starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == starts + k)]
    return starts


class Nearby:
    """Proximity search of a shard: its postings as one sorted array of term and position."""

    def __init__(self, windows: list[tuple[int, ...]], lists: dict[int, np.ndarray]):
        self.windows, self.lists = windows, lists
        row = {t: i for i, t in enumerate(sorted(lists))}
        sizes = np.array([len(lists[t]) for t in row] + [1 << 40])  # the last is that of terms the shard lacks
        self.first = np.concatenate([[0], np.cumsum(sizes[:-1])])
        self.positions = np.concatenate([lists[t] for t in row])
        self.postings = np.repeat(np.arange(len(row)), sizes[:-1]) << 32 | self.positions
        rows = np.array([[row.get(t, -1) for t in w] + [-1] * (WINDOW - len(w)) for w in windows])
        #: Places of each window's terms from the rarest on, their rows, and how many more may be missed.
        self.places = np.argsort(sizes[rows], axis=1, kind="stable")
        self.rows = np.take_along_axis(rows, self.places, 1)
        length = np.array([len(w) for w in windows])
        self.spare = MISSED * length // WINDOW - (length - (rows >= 0).sum(1))
        self.sizes = np.where(self.rows >= 0, sizes[self.rows], 0)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(window, position) for each start at which enough of its terms stand in order within SLACK words of their places."""
        able = np.flatnonzero(self.spare >= 0)
        # At most ``spare`` of the terms in the shard are missed: one of the rarest spare + 1 is met.
        from_ = np.arange(WINDOW)[None, :] <= self.spare[able, None]
        cost = np.cumsum((self.sizes[able] * from_).sum(1))
        for part in np.split(able, np.searchsorted(cost, np.arange(STARTS, cost[-1] if len(cost) else 0, STARTS))):
            yield from self._part(part)

    def _part(self, part: np.ndarray) -> Iterator[tuple[int, int]]:
        w, k = np.nonzero((np.arange(WINDOW)[None, :] <= self.spare[part, None]) & (self.rows[part] >= 0))
        w = part[w]
        n = self.sizes[w, k]
        at = np.repeat(self.first[self.rows[w, k]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        window, start = np.repeat(w, n), self.positions[at] - np.repeat(self.places[w, k], n)
        # Seen from a met term's own place, other terms may be off by twice the slack: few places are left by that.
        window, start = self._met(window, start, 2 * SLACK)
        both = np.unique((window << 32) + (1 << 16) + (start[:, None] + np.arange(-SLACK, SLACK + 1)).T)
        window, start = self._met(both >> 32, (both & 0xFFFFFFFF) - (1 << 16), SLACK)
        for i, s in zip(window.tolist(), start.tolist(), strict=True):
            words = self.windows[i]
            at = in_order(s, words, self.lists, len(words) - MISSED * len(words) // WINDOW)
            if at is not None:
                yield i, at

    def _met(self, window: np.ndarray, start: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts that miss at most as many of the window's terms within ``slack`` words of their places as may be missed."""
        lost = np.zeros(len(window), np.int64)
        for i in range(WINDOW):
            row, place = self.rows[window, i], start + self.places[window, i]
            at = np.searchsorted(self.postings, (row << 32) + np.maximum(place - slack, 0))
            found = self.postings[np.minimum(at, len(self.postings) - 1)]
            lost += (row >= 0) & ((at == len(self.postings)) | (found > (row << 32) + np.maximum(place + slack, -1)))
            left = lost <= self.spare[window]
            window, start, lost = window[left], start[left], lost[left]
        return window, start


def in_order(start: int, window: tuple[int, ...], lists: dict[int, np.ndarray], need: int) -> int | None:
    """Position of a term in a chain of ``need`` ascending positions near the places from ``start`` on; None without."""
    best: list[int] = []  # smallest end of a chain of each length
    for k, term in enumerate(window):
        if term not in lists:
            continue
        other = lists[term]
        a, b = np.searchsorted(other, (start + k - SLACK, start + k + SLACK + 1))
        for p in other[a:b][::-1].tolist():
            at = bisect_left(best, p)
            if at == len(best):
                best.append(p)
            else:
                best[at] = p
    return best[need - 1] if len(best) >= need else None


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Union of intervals as ascending disjoint ones."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return [{"start": s, "end": e} for s, e in zip(starts[new].tolist(), reach[last].tolist(), strict=True)]


def search(index: DataFrame, block: list[tuple[int, list[bytes]]], terms: dict[bytes, int]) -> DataFrame:
    """For each document: word spans inside exact matches, matching items, and items that come near."""
    windows = windows_of(block, terms)
    sent = index.sparkSession.sparkContext.broadcast((windows, [i for i, _ in block]))
    schema = index.sparkSession.createDataFrame([], HITS).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        queries, items = sent.value
        phrases = [window for window, _ in queries]
        for batch in batches:
            for shard in batch.to_pylist():
                positions = np.frombuffer(shard["positions"], "<u4").astype("i8")
                lists = dict(zip(shard["terms"], np.split(positions, shard["ends"][:-1]), strict=True)) if len(positions) else {}
                bases = np.array(shard["bases"], "i8")
                found: dict[int, list] = {}
                near: dict[int, set[int]] = {}
                document = lambda starts, bases=bases: np.searchsorted(bases, np.maximum(starts, 0), "right") - 1
                for window, owners in queries if lists else ():
                    starts = intersect(window, lists) if all(t in lists for t in window) else ()
                    for start, d in zip(list(starts), document(starts).tolist() if len(starts) else (), strict=True):
                        found.setdefault(d, []).append((start, start + len(window), owners))
                close_by = list(Nearby(phrases, lists)) if lists and phrases else []
                for (number, _), d in zip(close_by, document(np.array([at for _, at in close_by], "i8")).tolist(), strict=True):
                    near.setdefault(d, set()).update(queries[number][1])
                columns: list[list] = [[], [], [], [], []]
                for d, (doc, n) in enumerate(zip(shard["doc_ids"], shard["n_words"], strict=True)):
                    hits, exact = [], set()
                    if d in found:
                        starts, ends = (np.array(x) - bases[d] for x in list(zip(*found[d], strict=True))[:2])
                        hits = merge_spans(starts, ends)
                        exact = {items[o] for _, _, owners in found[d] for o in owners}
                    close = {items[o] for o in near.get(d, ())} - exact
                    known = lambda x: sorted((i for i in x if i is not None))
                    for column, value in zip(columns, (doc, n, hits, known(exact), known(close)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return index.mapInArrow(run, schema)


def search_all(docs: DataFrame, block: list[tuple[int, list[bytes]]], text: str, doc: str) -> DataFrame:
    """One block of items searched in an index of its terms."""
    terms: dict[bytes, int] = {}
    for _, words in block:
        for w in words:
            terms.setdefault(w, len(terms))
    return search(build_index(docs, terms, text, doc), block, terms)


def covered(hits: Column) -> Column:
    """Number of words in a union of spans that may overlap."""
    walk = F.aggregate(
        F.array_sort(hits),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], x["end"]).alias("to"),
        ),
    )
    return walk["n"]


def matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items``, ``near_items``, ``hits``, ``contaminated``.

    A window is ``WINDOW`` consecutive words of an item, or all words of a shorter
    one. ``hits`` are the word spans inside exact matches, ``n_hit`` the words in
    them; a document is contaminated if that is a twentieth of its words or more.
    Null texts have no words; items without words match nothing; items without an
    id count as hits but are not listed. Every row has its own result, whatever its doc_id.
    """
    todo = blocks(benchmark, item, item_text)
    first, second = next(todo, []), next(todo, None)
    if second is None:
        found = search_all(docs, first, text, doc)
    else:
        numbered = materialize(
            docs.select(F.monotonically_increasing_id().alias("num"), F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
        )
        parts = [search_all(numbered, block, "text", "num") for block in itertools.chain([first, second], todo)]
        gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = functools.reduce(DataFrame.union, parts).groupBy(F.col("doc_id").alias("num")).agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"),
            gather("items").alias("items"),
            gather("near_items").alias("near_items"),
        )
        found = found.withColumn("near_items", F.array_except("near_items", "items"))
        found = found.join(numbered.select("num", "doc_id"), "num").drop("num")
    found = found.withColumn("n_hit", covered(F.col("hits")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
