"""Operator 13: spelling variants by pivotal grams.

Words are counted over all documents (counts are combined in every batch and
task before they move). Bigrams are ordered by how many words have them. A word's
*prefix* are its three rarest bigrams by place, with all places of the third one's
bigram; its *pivots* are the two disjoint bigrams of the prefix that are rarest
together, chosen by dynamic programming. One edit can destroy one of two disjoint
bigrams, so of two near words, the one whose prefix ends first has a pivot
in the other's prefix, at most one place off.

The surviving pivot has the edit on one side of it, and there in one half: the
other side and the other half stand letter for letter in both words. Pivots and
prefix bigrams are therefore indexed under their place together with that equal
part, so a key is shared by words that agree in about three quarters of their
letters, not by all words with a common bigram. Pairs of the index join
are verified by their edit distance.

Null texts have no words; a null id counts as an empty one in the hash; rows count
as often as they stand in the table. Other columns are not read. No documents, no
words: empty result. Words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.rows import sliced
from rolecall.operators.skew import materialize

#: Length of a gram, edits that words may differ in, and what follows from them for the prefix.
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
#: A form is at least so many times as frequent.
RATIO = 10


def counts(docs: DataFrame, text: str = "text", doc: str = "doc_id", least: int = 7, damaged: int = 31) -> DataFrame:
    """(word, n): occurrences of words of ``least`` code points or more, over whole texts.

    Words are maximal runs of letters with A-Z lower-cased. If the CRC-32 of
    ``doc_id:run`` is divisible by ``damaged``, the run loses the code point at
    that number modulo its length.
    """
    letters = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def found(doc_id: bytes, content: bytes, into: Counter):
        start = zlib.crc32(doc_id + b":")
        for run, n in Counter(letters.findall(content.lower().decode("utf-8", "replace"))).items():
            h = zlib.crc32(run.encode(), start)
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            into[run] += n

    def run(batches):
        for batch in sliced(batches, 1):
            ids, texts = (c.cast(pa.binary()).to_pylist() for c in batch.columns)
            total: Counter = Counter()
            for doc_id, content in zip(ids, texts, strict=True):
                if content:
                    found(doc_id or b"", content, total)
            columns = [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    plain = docs.select(F.col(f"`{doc}`").cast("string"), F.col(f"`{text}`").cast("string"))
    return plain.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of every bigram in the order from rare to frequent; no more entries than pairs of letters."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total.update({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    ordered = sorted((r["n"], r["gram"]) for r in rows)
    return {gram: i for i, (_, gram) in enumerate(ordered)}


def prefix(word: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """(rank, place) of the rarest grams, as many as EDITS edits can touch and one more, with ties of the last."""
    grams = sorted((ranks[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    return [g for g in grams if g[0] <= last]


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Places of EDITS + 1 disjoint grams with the least sum of ranks, by dynamic programming over places."""
    grams = sorted((place, rank) for rank, place in grams)
    # best[m]: for each number of grams looked at, the cheapest choice of m of them as (cost, places).
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] * (len(grams) + 1)]
    for m in range(1, EDITS + 2):
        row: list[tuple[int, tuple[int, ...]] | None] = [None]
        for j, (place, rank) in enumerate(grams):
            before = sum(p + GRAM <= place for p, _ in grams[:j])
            chosen = best[m - 1][before]
            taken = None if chosen is None else (chosen[0] + rank, (*chosen[1], place))
            row.append(min((x for x in (row[j], taken) if x is not None), default=None))
        best.append(row)
    return list(best[-1][-1][1])


def pivot_keys(word: str, place: int) -> set[str]:
    """What near words must agree in around a pivot: one side, and a half of the other."""
    end = place + GRAM
    right, left = len(word) - end, place
    return {
        _key("a", word[: end + right // 2], ""),
        _key("b", word[:end], word[end + right // 2 :]),
        _key("c", word[: left // 2], word[place:]),
        _key("d", "", word[left // 2 :]),
    }


def prefix_keys(word: str, place: int) -> set[str]:
    """Keys that a near word with its pivot at this gram can have: its sides are up to EDITS longer or shorter."""
    end = place + GRAM
    right, left = len(word) - end, place
    keys = set()
    for size in range(right - EDITS, right + EDITS + 1):
        half, rest = size // 2, size - size // 2
        if 0 <= size and half <= right:
            keys.add(_key("a", word[: end + half], ""))
        if 0 <= size and rest <= right:
            keys.add(_key("b", word[:end], word[len(word) - rest :]))
    for size in range(left - EDITS, left + EDITS + 1):
        half, rest = size // 2, size - size // 2
        if 0 <= size and half <= left:
            keys.add(_key("c", word[:half], word[place:]))
        if 0 <= size and rest <= left:
            keys.add(_key("d", "", word[place - rest :]))
    return keys


def _key(kind: str, head: str, tail: str) -> str:
    return f"{kind}{head}\0{tail}"


def _index(words: DataFrame, ranks: dict[str, int], as_pivot: bool) -> DataFrame:
    """(key, word, last): the word's keys as 64-bit hashes, and the rank of its prefix's last gram."""

    def run(batches):
        for batch in batches:
            keys, names, ends = [], [], []
            for word in batch.column(0).to_pylist():
                grams = prefix(word, ranks)
                if as_pivot:
                    mine = set().union(*(pivot_keys(word, p) for p in pivots(grams)))
                else:
                    mine = set().union(*(prefix_keys(word, p) for _, p in grams))
                keys += [xxhash.xxh64_intdigest(k.encode()) - (1 << 63) for k in mine]
                names += [word] * len(mine)
                ends += [grams[-1][0]] * len(mine)
            columns = [pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "word", "last"])

    return words.select("word").mapInArrow(run, "key bigint, word string, last int")


def near(words: DataFrame) -> DataFrame:
    """(word, other): words that differ by exactly one edit, each pair in both directions."""
    ranks = gram_ranks(words)
    left = _index(words, ranks, True)
    right = _index(words, ranks, False).toDF("key", "other", "end")
    meets = (left["key"] == right["key"]) & (left["last"] <= right["end"])
    verified = F.levenshtein("word", "other", EDITS) == EDITS
    pairs = materialize(left.join(right, meets & verified).select("word", "other").distinct())
    return pairs.union(pairs.select("other", "word")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word that has one, by doubling; forms get more frequent, so chains end."""
    found = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = found.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        moved = materialize(moved)
        found = moved.select("word", "root")
        if moved.filter("further is not null").isEmpty():
            return found


def variants(docs: DataFrame, text: str = "text", doc: str = "doc_id", least_n: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word that stands at least ``least_n`` times.

    ``form`` is the most frequent near word (the first in code-point order of
    equals) if it is RATIO times as frequent, ``root`` the last of the chain.
    """
    words = materialize(counts(docs, text, doc).filter(F.col("n") >= least_n))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("least"), "other"))
    near_to = near(words).join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(near_to, "word", "left")
    much = -F.col("best.least") >= RATIO * F.col("n")
    known = materialize(
        known.select(
            "word",
            F.when(much, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(much, -F.col("best.least")).alias("form_n"),
        )
    )
    ends = roots(known.filter("form is not null"))
    found = known.join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
