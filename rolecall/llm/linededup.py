"""Operator 4: line dedup by a segment-partition edit join.

A line repeats an earlier one if the two are equal or at most ``THRESHOLD``
edits apart. Two lines that near share one of the ``THRESHOLD + 1`` even segments
of the shorter one, at almost the same place in the other. Every distinct line
so gives one row for each of its own segments and for each substring that could
equal such a segment of a line of its own length or up to ``THRESHOLD`` shorter;
how far a substring may be shifted follows from the edits that are left on both
sides. Rows meet by (length, segment number, text). What meets is compared by a
sketch of letter counts, which an edit changes by two at most, and what is left
is verified on the texts with a banded bit-parallel edit distance.

A line has to go if *some* earlier line is near. So where it has more than ``MANY`` earlier lines with
an alike sketch in a bucket, it is paired with the ``FIRST`` of them only; near copies of one line all meet the
first, and pairs stay in proportion to lines. If none of those was near, the line is paired with all
the others in a second pass. Where it has no more than ``MANY``, the others are kept, but verified
only for lines that are near to none of their first.

Lines are known by 128-bit hashes outside the tasks that read them; in buckets 64
bits do, as all texts of a hash are verified. Texts of lines are fetched for candidate
pairs only; a Bloom filter of bounded size tells tasks which lines these may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecall.llm.rows import sliced
from rolecall.operators.skew import materialize, spread_lookup

#: Most edits (insertions, deletions, substitutions of a character) between repeated lines.
THRESHOLD = 2
#: Shorter lines, without the white space around them, are left alone.
LEAST_CHARS = 24
SPACE = " \t\n\r\x0b\x0c"
#: Bits of the Bloom filter, at most; beyond that it lets more lines pass, never fewer.
FILTER_BITS = 1 << 27
#: Lines that a task remembers so as not to send their rows again.
REMEMBERED = 500_000
#: Candidates of a bucket that are compared at once.
BLOCK = 1024
#: Partners of a line in a bucket that are all verified, and those that are verified first where there are more.
MANY, FIRST = 64, 4
#: A line's place is one number: its row, then its number among the long lines of the text. Rows are numbered below 2**36.
LINE_BITS, ROW_BITS = 27, 36


def lines_of(text: str) -> list[str]:
    return [line.strip(SPACE) for line in text.split("\n")]


def digests(lines: list[str]) -> np.ndarray:
    """128-bit hash of each line as two signed numbers."""
    return np.frombuffer(b"".join([xxhash.xxh128_digest(x.encode("utf-8", "replace")) for x in lines]), "<i8").reshape(-1, 2)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and size of each segment of an even partition, shorter ones first."""
    size, longer = divmod(length, parts)
    sizes = [size] * (parts - longer) + [size + 1] * longer
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


def substrings(length: int, threshold: int = THRESHOLD, least: int = LEAST_CHARS) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, own) of the substrings of a line by which it meets others.

    For a line of this length and each shorter length that it could be near to:
    segment i of the shorter line, counted from 0, may stand up to i places off its
    start if i edits lie before it, and, seen from the end, up to the number of
    segments after it. ``own`` marks the line's own segments. The seed tells
    lengths and segment numbers apart.
    """
    found = []
    parts = threshold + 1
    for other in range(max(least, length - threshold), length + 1):
        shift = length - other
        for i, (start, size) in enumerate(segments(other, parts)):
            low = max(0, start - i, start + shift - (threshold - i))
            high = min(length - size, start + i, start + shift + (threshold - i))
            for at in range(low, high + 1):
                found.append((at, at + size, other * parts + i, other == length and at == start))
    return found


def sketch(line: bytes | str) -> int:
    """Counts of letters by their number modulo 8, each modulo 16, in 32 bits."""
    letters = np.frombuffer(line, np.uint8) if isinstance(line, bytes) else np.frombuffer(line.encode("utf-32-le", "replace"), "<u4")
    counts = np.bincount(letters & 7, minlength=8) & 15
    return int(counts @ _PLACES)


_PLACES = 1 << (4 * np.arange(8, dtype=np.int64))


def alike(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether sketches of ``a`` and ``b`` (all pairs) leave room for that few edits."""
    total = np.zeros((len(a), len(b)), np.int16)
    for k in range(8):
        off = ((a[:, None] >> (4 * k)) - (b[None, :] >> (4 * k))) & 15
        total += np.minimum(off, 16 - off).astype(np.int16)
    return total <= 2 * threshold


def edits(a: str, b: str, most: int = THRESHOLD) -> int | None:
    """Edit distance of two texts if it is at most ``most``, else None.

    State d holds, as bits, the places of ``a`` that can be reached with d edits
    after some letters of ``b``. Only places within ``most`` of the diagonal count;
    bit t stands for place j - most + t after j letters.
    """
    if abs(len(a) - len(b)) > most:
        return None
    start, end = 0, min(len(a), len(b))
    while start < end and a[start : start + 32] == b[start : start + 32]:
        start = min(start + 32, end)
    while start < end and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << (i + most)
    band = (1 << (2 * most + 1)) - 1
    states = [((1 << (d + 1)) - 1) << most for d in range(most + 1)]
    for j, letter in enumerate(b):
        same = places.get(letter, 0) >> j & band
        within = band if len(a) - j + most >= 2 * most + 1 else (1 << max(0, len(a) - j + most)) - 1
        below_old = below_new = 0
        for d, old in enumerate(states):
            # Same letter or another in both; a letter of b alone; a letter of a alone.
            new = (old & same | (below_old | below_old >> 1 | below_new << 1)) & band & within
            states[d], below_old, below_new = new, old, new
        if not below_new:
            return None
    at = len(a) - len(b) + most
    return next((d for d, state in enumerate(states) if state >> at & 1), None)


def places(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, line) of every line that isn't too short; ``docs`` has doc_id and text."""

    def run(batches):
        for batch in sliced(batches, 1):
            ids, texts = (c.to_pylist() for c in batch.columns)
            found, doc, number = [], [], []
            for i, text in enumerate(texts):
                for n, line in enumerate(lines_of(text or "")):
                    if len(line) >= LEAST_CHARS:
                        found.append(line)
                        doc.append(ids[i])
                        number.append(n)
            h = digests(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc, pa.int64()), pa.array(number, pa.int32())],
                ["h1", "h2", "doc_id", "line"],
            )

    return docs.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, line int")


def keys(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(key, h1, mark, at) for each line and substring.

    ``mark`` is the sketch, doubled, plus 1 for own segments; ``at`` the line's first place
    among those that the task has seen.
    """

    def run(batches):
        plans: dict[int, tuple] = {}
        seen: dict[int, int] = {}
        hashed = xxhash.xxh64_digest
        for batch in sliced(batches, 1, 1_000_000):
            ids, texts = (c.to_pylist() for c in batch.columns)
            first: dict[str, int] = {}
            for row, text in zip(ids, texts, strict=True):
                if text:
                    at = row << LINE_BITS
                    for line in lines_of(text):
                        if len(line) >= LEAST_CHARS:
                            if first.setdefault(line, at) > at:
                                first[line] = at
                            at += 1
            lines = list(first)
            found: list[bytes] = []
            h1, counts, marks, places = [], [], [], []
            for line, h in zip(lines, digests(lines)[:, 0].tolist(), strict=True):
                at = first[line]
                if seen.get(h, at + 1) <= at:
                    continue
                seen[h] = at
                if len(plans) > 10_000:
                    plans.clear()
                if len(line) not in plans:
                    plan = substrings(len(line), threshold)
                    plans[len(line)] = [x[:3] for x in plan], np.array([x[3] for x in plan], np.int64)
                plan, own = plans[len(line)]
                if line.isascii():
                    raw = line.encode()
                    found += [hashed(raw[a:b], seed) for a, b, seed in plan]
                    mark = sketch(raw)
                else:
                    found += [hashed(line[a:b].encode("utf-8", "replace"), seed) for a, b, seed in plan]
                    mark = sketch(line)
                h1.append(h)
                counts.append(len(plan))
                marks.append(own + 2 * mark)
                places.append(at)
            if len(seen) > REMEMBERED:
                seen.clear()
            if h1:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(b"".join(found), "<i8")),
                        pa.array(np.repeat(np.array(h1, np.int64), counts)),
                        pa.array(np.concatenate(marks)),
                        pa.array(np.repeat(np.array(places, np.int64), counts)),
                    ],
                    ["key", "h1", "mark", "at"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint, h1 bigint, mark bigint, at bigint")


def partners(
    h1: np.ndarray, mark: np.ndarray, at: np.ndarray, threshold: int, asked: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(later, earlier) of the lines of a bucket whose sketches are alike, block by block.

    A line with more than ``MANY`` partners comes with the ``FIRST`` of them and with itself. If some
    lines ``asked`` for partners, they get all of theirs, and others none.
    """
    for later, earlier, _ in _partners(h1, mark, at, threshold, asked):
        yield later, earlier


def _partners(
    h1: np.ndarray, mark: np.ndarray, at: np.ndarray, threshold: int, asked: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``partners``, and whether the earlier one comes after the ``FIRST``."""
    order = np.lexsort((at, h1))
    h1, mark, at = h1[order], mark[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
    own = np.maximum.reduceat(mark & 1, starts).astype(bool)
    if len(starts) < 2 or not own.any():
        return
    order = np.argsort(at[starts], kind="stable")
    h1, sketches, own = h1[starts][order], (mark >> 1)[starts][order], own[order]
    wants = np.ones(len(h1), bool) if asked is None else np.isin(h1, asked)
    for low in range(0, len(h1), BLOCK):
        later = low + np.flatnonzero(wants[low : low + BLOCK])
        found, held = np.zeros(len(later), np.int64), []
        for j in range(0, low + BLOCK, BLOCK):
            # A line with more than enough partners looks no further.
            still = np.flatnonzero(found <= MANY) if asked is None else np.arange(len(later))
            earlier = np.arange(j, min(j + BLOCK, len(h1)))
            if not len(still):
                break
            rows = later[still]
            near = alike(sketches[rows], sketches[earlier], threshold)
            near &= (own[rows, None] | own[None, earlier]) & (earlier[None, :] < rows[:, None])
            x, y = np.nonzero(near)
            if not len(x):
                continue
            if asked is not None:
                yield h1[rows[x]], h1[earlier[y]], np.zeros(len(x), bool)
                continue
            nth = near.cumsum(1)[x, y] + found[still[x]]
            held.append([c[nth <= MANY] for c in (still[x], earlier[y], nth)])
            found[still] += near.sum(1)
        if held:
            x, y, nth = (np.concatenate(c) for c in zip(*held, strict=True))
            kept = (found[x] <= MANY) | (nth <= FIRST)
            yield h1[later[x[kept]]], h1[y[kept]], nth[kept] > FIRST
        if (found > MANY).any():
            yield h1[later[found > MANY]], h1[later[found > MANY]], np.zeros((found > MANY).sum(), bool)


def candidates(rows: DataFrame, threshold: int = THRESHOLD, asked: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b, more) of a line and an earlier one that meet in a bucket and whose sketches are alike (see ``partners``).

    ``more`` marks pairs that come after the ``FIRST`` of the line in every bucket. Rows are dealt out by key and read sorted, as a stream.
    """
    if asked is not None:
        marked = spread_lookup(rows, asked.withColumn("asked", F.lit(True)), ["h1"], ["key"], "left")
        marked = marked.withColumn("asked", F.coalesce("asked", F.lit(False)))
        busy = marked.filter("asked").select("key").distinct()
        rows = spread_lookup(marked, busy, ["key"], ["h1"])

    everyone = asked is None

    def close(parts):
        h1, mark, at, wants = (np.concatenate(c) for c in zip(*parts, strict=True))
        for a, b, more in _partners(h1, mark, at, threshold, None if everyone else h1[wants]):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more)], ["a", "b", "more"])

    def run(batches):
        current, held = None, []
        for batch in batches:
            key, h1, mark, at, *wants = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            wants = wants[0] if wants else np.ones(len(key), bool)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            # Whole buckets inside this batch that have one line, or no segment of one's own, meet nobody.
            busy = np.minimum.reduceat(h1, starts) != np.maximum.reduceat(h1, starts)
            busy &= np.bitwise_or.reduceat(mark, starts) & 1 == 1
            busy[0] = busy[-1] = True
            for start, end in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
                if key[start] != current:
                    if len(held) > 1 or (held and len(held[0][0]) > 1):
                        yield from close(held)
                    current, held = key[start], []
                held.append((h1[start:end], mark[start:end], at[start:end], wants[start:end]))
        if held:
            yield from close(held)

    columns = ["key", "h1", "mark", "at", *(["asked"] if asked is not None else [])]
    dealt = rows.select(*columns).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(run, "a bigint, b bigint, more boolean")
    return found.groupBy("a", "b").agg(F.min("more").alias("more"))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, text) of the lines whose first half of the hash is in ``wanted`` (h1)."""
    n = wanted.count()
    bits = 1 << 20
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    place = F.pmod("h1", F.lit(bits)) + 1  # bitmap functions number bits from 1
    cells = (
        wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        .collect()
    )  # FILTER_BITS / 8 bytes at most
    table = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in cells:
        table[(bucket - 1) * 4096 : bucket * 4096] |= np.frombuffer(bitmap, np.uint8)[: len(table)]
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches, 0):
            texts = batch.column(0).to_pylist()
            lines = list({line for x in texts if x for line in lines_of(x) if len(line) >= LEAST_CHARS})
            both = digests(lines)
            h = both[:, 0]
            at = h % bits
            hit = np.flatnonzero(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            new = [i for i in hit.tolist() if int(both[i, 1]) not in seen]
            seen.update(both[new, 1].tolist())
            if len(seen) > REMEMBERED:
                seen.clear()
            halves = [pa.array(both[new, k].copy()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*halves, pa.array([lines[i] for i in new], pa.string())], ["h1", "h2", "text"])

    found = docs.select("text").mapInArrow(run, "h1 bigint, h2 bigint, text string")
    return found.join(wanted, "h1", "left_semi").dropDuplicates(["h1", "h2"])


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``line_texts`` of the lines of ``pairs`` (a, b), written."""
    wanted = materialize(pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).distinct())
    return materialize(line_texts(docs, wanted))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, a2, b, b2): both halves of the hashes of pairs (a, b) of lines that are at most ``threshold`` edits apart."""
    pairs = pairs.select("a", "b")
    for side, other in (("a", "b"), ("b", "a")):
        named = texts.select(F.col("h1").alias(side), F.col("h2").alias(f"{side}2"), F.col("text").alias(f"text_{side}"))
        pairs = spread_lookup(pairs, named, [side], [other])

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
            near = [edits(p, q, threshold) is not None for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "a2", "b", "b2"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, a2 bigint, b bigint, b2 bigint")


def near_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(h1, h2) of the lines of ``docs(doc_id, text)`` that are near to an earlier, different one."""
    rows = keys(docs, threshold)
    met = materialize(candidates(rows, threshold))
    pairs = met.filter("a <> b")
    texts = texts_of(docs, pairs)
    later = materialize(verified(pairs.filter("not more"), texts, threshold).select("a", "a2").distinct())
    # Lines of different texts that share half a hash: all of them have to be decided.
    decided = later.groupBy("a").count().join(texts.groupBy(F.col("h1").alias("a")).count(), ["a", "count"], "left_semi").select("a")
    left = materialize(pairs.filter("more").join(decided, "a", "left_anti"))
    if not left.isEmpty():
        later = later.union(materialize(verified(left, texts, threshold).select("a", "a2")))
    undecided = met.filter("a = b").select("a").join(later.select("a"), "a", "left_anti")
    undecided = materialize(undecided.select(F.col("a").alias("h1")))
    if not undecided.isEmpty():
        rest = materialize(candidates(rows, threshold, undecided))
        rest = materialize(rest.join(met, ["a", "b"], "left_anti"))
        later = later.union(materialize(verified(rest, texts_of(docs, rest), threshold).select("a", "a2")))
    return later.select(F.col("a").alias("h1"), F.col("a2").alias("h2")).distinct()


def repeated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, line, near): lines that repeat an earlier one; ``near`` if no earlier line is equal.

    ``docs(doc_id, text)`` with different ids. Lines stand in order of (doc_id, number in the document). The first of equal
    lines repeats another only if some line before it is near; so for every line
    that goes, one at most ``threshold`` edits away stands before it.
    """
    found = materialize(places(docs))
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    later = near_lines(docs, threshold).withColumn("near", F.lit(True))
    known = materialize(firsts.join(later, ["h1", "h2"], "left"))
    marked = spread_lookup(found, known, ["h1", "h2"], ["doc_id", "line"])
    first = F.struct("doc_id", "line") == F.col("first")
    return marked.filter(~first | F.coalesce("near", F.lit(False))).select("doc_id", "line", first.alias("near"))


def numbered(docs: DataFrame, doc: str) -> DataFrame:
    """``docs`` with ``_row``, a different number for each row in order of (``doc``, place in the table), null first.

    That is the id itself where ids are different and small; otherwise rows are numbered in written tables.
    """
    key = F.col(doc).cast("bigint")
    spread = docs.select(key.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    seen = spread.agg(F.max("n").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("none")).first()
    if not seen["none"] and (seen["n"] or 1) == 1 and (seen["low"] or 0) >= 0 and (seen["high"] or 0) < 1 << ROW_BITS:
        return docs.withColumn("_row", key)
    rows = materialize(docs.withColumn("_at", F.monotonically_increasing_id()), compression="zstd")
    ordered = rows.select(key.alias("_id"), "_at").orderBy(F.col("_id").asc_nulls_first(), "_at")
    ordered = materialize(ordered.select("_at", F.monotonically_increasing_id().alias("_nth")))
    # The upper bits of the number are the partition, a dense number needs those before it.
    part = F.shiftright("_nth", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = dict(zip([r["part"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)]).tolist(), strict=False))
    if not starts:
        return rows.withColumn("_row", F.col("_at")).drop("_at")
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]), part)
    ranked = ordered.select("_at", (start + F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1))).alias("_row"))
    return materialize(rows.join(ranked, "_at").drop("_at"), compression="zstd")


def clean(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without repeated lines in ``text``, plus ``n_lines``, ``n_repeated`` and ``n_near``.

    ``n_lines`` counts the lines of ``LEAST_CHARS`` or more, ``n_repeated`` those that
    went because an equal line stands before, ``n_near`` the others that went. Null
    texts stay null. Rows are documents of their own: those that share a doc_id follow each other in
    the order of the table, those without one come first. Input columns with the names of the
    new ones are replaced.
    """
    new = ("n_lines", "n_repeated", "n_near")
    kept = [c for c in docs.columns if c.lower() not in new]
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = numbered(docs.toDF(*names.values()), names[doc])
    plain = rows.select(F.col("_row").alias("doc_id"), F.col(names[text]).alias("text"))
    gone = repeated(plain, threshold).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.when(~F.col("near"), F.col("line"))).alias("_equal"),
        F.collect_set(F.when(F.col("near"), F.col("line"))).alias("_near"),
    )
    joined = rows.select("_row", *(names[c] for c in kept)).join(gone, F.col("_row") == F.col("_id"), "left").drop("_id", "_row")
    schema = StructType(joined.schema.fields[: len(kept)])
    schema[names[text]].nullable = True
    for name in new:
        schema = schema.add(f"_{name}", "long")
    place = kept.index(text)
    made = schema.names

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts, out, counts = columns[place].to_pylist(), [], []
            for value, equal, near in zip(texts, columns[-2].to_pylist(), columns[-1].to_pylist(), strict=True):
                lines = (value or "").split("\n")
                equal, near = set(equal or ()), set(near or ())
                counts.append((sum(len(x.strip(SPACE)) >= LEAST_CHARS for x in lines), len(equal), len(near)))
                gone = equal | near
                out.append("\n".join([x for n, x in enumerate(lines) if n not in gone]) if gone else value)
            columns = columns[:-2]
            columns[place] = pa.array(out, columns[place].type)
            counts = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in counts.T.copy())], made)

    return joined.mapInArrow(run, schema).toDF(*kept, *new)
