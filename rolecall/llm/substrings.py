"""Operator 12: repeated strings by the common-prefix interval tree of an enhanced suffix array.

A string of LENGTH bytes that stands at an earlier place too is removed wherever
else it stands; "earlier" is by doc_id, then row, then byte. Texts are UTF-8 bytes.

1. *Anchors.* Every window of LENGTH bytes has an anchor: of its GRAM-byte strings
   the one with the least hash, so equal windows have equal anchors at equal
   places. The windows of one anchor are a run; the bytes of the run are the
   anchor's *context*, of at most 2 * LENGTH - GRAM bytes. One row for each anchor,
   about one for 35 bytes, is all that is shuffled of a text here. Equal contexts
   are one: all but the first are repeats as they are. They meet inside a batch
   first, so even a passage in a third of all documents sends few rows.
2. *Suffix array.* Where an anchor has several contexts, these are cut out of their
   texts and sorted: a suffix array of the starts of windows with the lengths of
   common prefixes. A stack scan over it visits the tree of prefix intervals. In
   every interval the earliest suffix is the original; each other occurrence is
   given out once, with the longest prefix that it shares with an earlier one, unless
   the bytes left of the two agree (then the interval is not left-diverse, and the
   string that begins one byte before says the same).
3. What is found is joined to the texts again, by row.

Anchors with very many contexts (the edges of a passage that a third of all
documents share) would be one large group. They are found in a sixteenth of the
documents, and the windows of these, at most HOT, are rows of their own: an interval
of depth LENGTH each. That changes how repeats are found, not which. Another group
holds no more than about a HOTth of all anchors.

A null text is empty. Rows without an id come last; rows that share an id are texts
of their own, in the order of the table. Rows are never lost or joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rolecall.operators.skew import materialize, spread_lookup

#: Bytes of a string that counts, and of the strings that anchors are chosen from.
LENGTH, GRAM = 100, 32
#: Most anchors whose windows are dealt one by one, and the least contexts of such an anchor in the sample.
HOT, HOT_SEEN, SAMPLED = 1_000_000, 32, 16
#: Bytes of text, rows of anchors and bytes of contexts that are worked on at once.
CHUNK, ROWS, CONTEXTS = 1 << 19, 1 << 20, 1 << 21
#: A span of a text is one number: its start, then its size in the low bits. Covered spans are below zero.
SIZE_BITS = 31
LAST = (1 << 63) - 1

_random = np.random.Generator(np.random.PCG64(12))
_LETTERS = _random.integers(0, 1 << 64, (2, 256), np.uint64)
_ODD = _random.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchors of texts; reused for all texts of a task."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot
        base = int(_ODD[2])
        size = CHUNK + 2 * LENGTH + 1
        self.powers, self.inverse = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)

    def rows(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, key, context, start, end) of the anchors of concatenated texts that end at ``ends``."""
        if len(data) < LENGTH:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        h = _LETTERS[0][data]
        step, factor = 1, int(_ODD[3])
        while step < GRAM:
            h = h[:-step] * np.uint64(factor) + h[step:]
            step, factor = 2 * step, factor * factor % (1 << 64)
        h = _mixed(h)
        least = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        width, step = LENGTH - GRAM + 1, 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        # A window must end where its text ends, or before.
        begins = np.concatenate([[0], ends[:-1]])
        inside = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        if not len(inside):
            return tuple(np.empty(0, np.int64) for _ in range(5))
        at = (_PLACE - (least[inside] & _PLACE)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        start, end, key = inside[first], inside[last] + LENGTH, h[at[first]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[1][data] * self.powers[: len(data)])])
        if len(self.hot):
            many = np.isin(key.view(np.int64), self.hot)
            if many.any():
                a, n = start[many], (end - start)[many] - LENGTH + 1
                windows = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                parts = (h[windows + place] * _ODD[4 + i] for i, place in enumerate((0, GRAM, 2 * GRAM, LENGTH - GRAM)))
                whole = _mixed(np.bitwise_xor.reduce(list(parts)))
                start = np.concatenate([start[~many], windows])
                end = np.concatenate([end[~many], windows + LENGTH])
                key = np.concatenate([key[~many], whole])
        context = _mixed((sums[end] - sums[start]) * self.inverse[start] ^ (end - start).astype(np.uint64) * _ODD[2])
        text = np.searchsorted(ends, start, "right")
        return text, key.view(np.int64), context.view(np.int64), start - begins[text], end - begins[text]


def _chunks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, ends in them, number of the first text, its offset) of pieces of about CHUNK bytes.

    A longer text is several pieces that overlap, so that no window is lost.
    """
    i = 0
    while i < len(ends):
        if ends[i] - begins[i] > CHUNK:
            for at in range(int(begins[i]), int(ends[i]) - LENGTH + 1, CHUNK):
                piece = data[at : min(at + CHUNK + LENGTH - 1, int(ends[i]))]
                yield piece, np.array([len(piece)]), i, at - int(begins[i])
            i += 1
            continue
        j = max(int(np.searchsorted(ends, begins[i] + CHUNK, "right")), i + 1)
        yield data[begins[i] : ends[j - 1]], ends[i:j] - begins[i], i, 0
        i = j


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its values; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _span(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (start << SIZE_BITS) | size


def anchor_rows(texts: DataFrame, hot: np.ndarray, combined: bool = True) -> DataFrame:
    """(key, ctx, doc, num, span) of every anchor; of contexts that are equal in a batch, the first only.

    The others are spans below zero: covered. Their key deals them out and means nothing.
    """

    def settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, context, doc, num, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
        span = _span(start, end - start)
        if combined:
            order = np.argsort(key ^ (context * np.int64(0x9E3779B97F4A7C1 | 1)), kind="stable")
            k, c = key[order], context[order]
            again = np.zeros(len(key), bool)
            again[order[1:]] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
            # Spans are in order of text and start: what overlaps is one covered span.
            d, n, a, b = doc[again], num[again], start[again], end[again]
            opens = np.ones(len(n), bool)
            opens[1:] = (n[1:] != n[:-1]) | (a[1:] > b[:-1])
            at = np.flatnonzero(opens)
            closes = np.concatenate([at[1:], [len(n)]]) - 1 if len(n) else at
            covered = -1 - _span(a[at], b[closes] - a[at])
            key, context = (np.concatenate([x[~again], n[at]]) for x in (key, context))
            doc, num = (np.concatenate([x[~again], y[at]]) for x, y in ((doc, d), (num, n)))
            span = np.concatenate([span[~again], covered])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, context, doc, num, span)], ["key", "ctx", "doc", "num", "span"])

    def run(batches):
        anchors = Anchors(hot)
        for batch in batches:
            docs, nums = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((nums, docs))
            docs, nums = docs[order], nums[order]
            data, offsets = _bytes(batch.column(2).take(pa.array(order)))
            held, rows = [], 0
            for piece, ends, first, at in _chunks(data, offsets[:-1], offsets[1:]):
                text, key, context, start, end = anchors.rows(piece, ends)
                text = text + first
                held.append((key, context, docs[text], nums[text], start + at, end + at))
                rows += len(key)
                if rows > ROWS:
                    yield settled(held)
                    held, rows = [], 0
            if rows:
                yield settled(held)

    plain = texts.select("doc", "num", "text")
    return plain.mapInArrow(run, "key bigint, ctx bigint, doc bigint, num bigint, span bigint")


def hot_keys(texts: DataFrame) -> np.ndarray:
    """Anchors with the most contexts in a sample of the documents, at most HOT."""
    sample = texts.filter(F.pmod(F.xxhash64("num"), F.lit(SAMPLED)) == 0)
    rows = anchor_rows(sample, np.empty(0, np.int64)).filter("span >= 0")
    seen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_SEEN)
    return np.sort(np.array([r["key"] for r in seen.orderBy(F.desc("n"), "key").limit(HOT).collect()], np.int64))


def settle(rows: DataFrame) -> DataFrame:
    """(key, ctx, doc, num, span): later ones of equal contexts as covered spans, and contexts of keys with several.

    Rows are dealt by key and sorted, then read as a stream; one row is held back.
    """

    def run(batches):
        last: tuple | None = None  # key and context of the last row
        held: list | None = None  # the last first row of a context, and whether its key had another before
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            covered = columns[4] < 0
            out = [[x[covered] for x in columns]]
            key, ctx, doc, num, span = (x[~covered] for x in columns)
            if len(key):
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
                new[0] = last != (key[0], ctx[0])
                last = (key[-1], ctx[-1])
                out.append([x[~new] for x in (key, ctx, doc, num)] + [-1 - span[~new]])
                firsts = [x[new] for x in (key, ctx, doc, num, span)]
                had = False
                if held is not None:
                    firsts = [np.concatenate([[x], y]) for x, y in zip(held[0], firsts, strict=True)]
                    had = held[1]
                if len(firsts[0]):
                    same = firsts[0][1:] == firsts[0][:-1]
                    before = np.concatenate([[had], same])
                    several = before[:-1] | same
                    out.append([x[:-1][several] for x in firsts])
                    held = [[x[-1] for x in firsts], bool(before[-1])]
            yield batch_of(out)
        if held is not None and held[1]:
            yield batch_of([[np.array([x]) for x in held[0]]])

    names = rows.columns

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names)

    dealt = rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "num", "span")
    return dealt.mapInArrow(run, rows.schema)


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, ctx, doc, num, start, bytes) of wanted spans."""
    lists = wanted.groupBy("num").agg(F.collect_list(F.struct("key", "ctx", "doc", "span")).alias("spans"))
    both = texts.join(lists.withColumnRenamed("num", "_num"), F.col("num") == F.col("_num"))
    place, spans = both.columns.index("text"), both.columns.index("spans")
    number = both.columns.index("num")
    schema = to_arrow_schema(StructType().add("key", "long").add("ctx", "long").add("doc", "long").add("num", "long").add("start", "long").add("bytes", "binary"))

    def run(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column(place))
            lists = batch.column(spans)
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            fields = lists.flatten()
            key, ctx, doc, span = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            start, base = span >> SIZE_BITS, offsets[rows]
            lows, highs = base + start, base + start + (span & ((1 << SIZE_BITS) - 1))
            whole = data.tobytes()
            for i in range(0, len(rows), 20_000):
                cut = slice(i, i + 20_000)
                pieces = [whole[a:b] for a, b in zip(lows[cut].tolist(), highs[cut].tolist(), strict=True)]
                nums = batch.column(number).to_numpy()[rows[cut]]
                columns = [pa.array(x) for x in (key[cut], ctx[cut], doc[cut], nums, start[cut])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], schema=schema)

    return both.mapInArrow(run, "key bigint, ctx bigint, doc bigint, num bigint, start bigint, bytes binary")


def suffix_array(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` in order, and the common prefix length of each with the next.

    Symbols are above zero, texts end with seven zeros. Seven symbols of nine bits
    are one number; runs that agree so far are sorted by the next seven.
    """
    word = np.zeros(len(symbols) - 6, np.uint64)
    for j in range(7):
        word = (word << np.uint64(9)) | symbols[j : len(symbols) - 6 + j].astype(np.uint64)
    order = starts[np.argsort(word[starts], kind="stable")]
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    at = np.arange(len(order))  # places that are still looked at
    group = np.zeros(len(order), np.int64)
    depth = 0
    while len(at) > 1:
        now = word[order[at] + depth]
        same = group[1:] == group[:-1]
        differs = now[1:] ^ now[:-1]
        split = same & (differs != 0)
        # Symbols before the first that differs.
        exact = differs[split]
        shared = np.zeros(len(exact), np.int64)
        for j in range(6):
            shared += (exact >> np.uint64(9 * (6 - j))) == 0
        common[at[:-1][split]] = depth + shared
        equal = same & (differs == 0)
        ended = equal & ((now[1:] & np.uint64(511)) == 0)
        zeros = now[1:][ended]
        size = np.full(len(zeros), 7, np.int64)
        for j in range(7):
            size -= (zeros & np.uint64((1 << (9 * (j + 1))) - 1)) == 0
        common[at[:-1][ended]] = depth + size
        equal &= ~ended
        stay = np.zeros(len(at), bool)
        stay[:-1] |= equal
        stay[1:] |= equal
        joined = np.concatenate([[False], equal])[stay]
        at, group = at[stay], np.cumsum(~joined)
        depth += 7
        if len(at):
            fresh = np.lexsort((word[order[at] + depth], group))
            order[at] = order[at][fresh]
    return order, common


def scan(order: list[int], common: list[int], before: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(place, size, original) of repeats in one run of suffixes that share ``length`` symbols or more.

    Intervals close from the inside out. Each one's earliest suffix goes on to the interval around it.
    """
    stack: list[tuple[int, int]] = []  # earliest suffix of an interval, and what it shares with the next one
    for i, place in enumerate(order):
        shared = common[i] if i < len(common) else 0
        while stack and stack[-1][1] >= max(shared, length):
            other, size = stack.pop()
            first, later = (other, place) if other < place else (place, other)
            if before[first] != before[later] or before[first] < 0:
                yield later, size, first
            place = first
        stack.append((place, shared))


def intervals(common: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, size) of the left-diverse prefix intervals of a run of suffixes, inner ones first."""
    stack: list[list[int]] = []  # size, first place, and the one symbol left of all its suffixes or -1
    for i, shared in enumerate([*common, 0]):
        first, left = i, before[i]
        while stack and stack[-1][0] > shared:
            size, first, other = stack.pop()
            left = left if left == other else -1
            if left < 0:
                yield first, i, size
        if shared and stack and stack[-1][0] == shared:
            stack[-1][2] = left if left == stack[-1][2] else -1
        elif shared:
            stack.append([shared, first, left])


class Suffixes:
    """The starts of windows in some contexts, sorted: an enhanced suffix array."""

    def __init__(self, table: pa.Table, length: int):
        self.key, self.ctx, doc, self.num, self.start = (table.column(c).to_numpy() for c in ("key", "ctx", "doc", "num", "start"))
        pieces = table.column("bytes").to_pylist()
        #: Contexts in order of document, row and start; so are the places in the symbols.
        self.order = np.lexsort((self.start, self.num, doc))
        sizes = np.array([len(p) for p in pieces], np.int64)[self.order]
        tops = np.cumsum(sizes + 7) - 7
        self.symbols = np.zeros(int(tops[-1]) + 7, np.uint16)
        joined = np.frombuffer(b"".join(pieces[i] for i in self.order.tolist()), np.uint8)
        self.symbols[np.arange(len(joined)) + np.repeat(7 * np.arange(len(sizes)), sizes)] = joined.astype(np.uint16) + 1
        self.low, n = tops - sizes, sizes - length + 1
        self.places = np.repeat(self.low - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.owner = np.repeat(np.arange(len(sizes)), n)
        # What stands before a context is not known: its first window counts as one that cannot begin earlier.
        own = self.low[self.owner]
        self.before = np.where(self.places == own, -1, self.symbols[self.places - 1].astype(np.int64))
        number = np.empty(len(self.symbols), np.int64)
        number[self.places] = np.arange(len(self.places))
        at, self.common = suffix_array(self.symbols, self.places)
        #: Number of the suffix at each place of the array; smaller ones are earlier.
        self.sorted = number[at]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self.common >= length, [False]]).astype(np.int8)))
        self.runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _by_key(found: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on contexts dealt by key. Equal windows have equal keys: contexts may be parted wherever the key changes."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                if size > CONTEXTS and keys[a] != last:
                    yield from work(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += held[-1].column(5).nbytes
                last = keys[a]
        if held:
            yield from work(pa.Table.from_batches(held))

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def repeats(found: DataFrame, length: int) -> DataFrame:
    """(num, span): what contexts share with earlier ones, as covered spans."""

    def work(table):
        s = Suffixes(table, length)
        out, before = [], s.before.tolist()
        for a, b in s.runs:
            out += scan(s.sorted[a : b + 1].tolist(), s.common[a:b].tolist(), before, length)
        if not out:
            return
        later, size, _ = np.array(out, np.int64).T
        own = s.owner[later]
        begin = s.start[s.order][own] + s.places[later] - s.low[own]
        # Spans of a context that overlap are one.
        by = np.lexsort((begin, own))
        own, begin, end = own[by], begin[by], (begin + size)[by]
        reach = np.maximum.accumulate(end + own * (1 << 40)) - own * (1 << 40)
        opens = np.ones(len(own), bool)
        opens[1:] = (own[1:] != own[:-1]) | (begin[1:] > reach[:-1])
        first = np.flatnonzero(opens)
        last = np.concatenate([first[1:], [len(own)]]) - 1
        spans = -1 - _span(begin[first], reach[last] - begin[first])
        yield pa.RecordBatch.from_arrays([pa.array(s.num[s.order][own[first]]), pa.array(spans)], ["num", "span"])

    return _by_key(found, work, "num bigint, span bigint")


def group_members(found: DataFrame, length: int) -> DataFrame:
    """(key, ctx, repeat, size, shift): the maximal repeats of different contexts and where in each they stand.

    A context that stands whole in another one has a row without a repeat too.
    """

    def work(table):
        s = Suffixes(table, length)
        # Contexts that stand whole inside another one: what they share has an interval.
        at = np.empty(len(s.places), np.int64)
        at[s.sorted] = np.arange(len(s.sorted))
        nearby = np.concatenate([[0], s.common, [0]])
        opens = at[np.searchsorted(s.places, s.low)]
        ends = np.append(s.low[1:], len(s.symbols)) - 7
        inside = s.order[np.maximum(nearby[opens], nearby[opens + 1]) == ends - s.low]
        rows = [(k, c, None, 0, 0) for k, c in zip(s.key[inside].tolist(), s.ctx[inside].tolist(), strict=True)]
        for a, b in s.runs:
            numbers = s.sorted[a : b + 1]
            for first, last, size in intervals(s.common[a:b].tolist(), s.before[numbers].tolist()):
                members = numbers[first : last + 1]
                at = int(s.places[members[0]])
                name = hashlib.md5((s.symbols[at : at + size] - 1).astype(np.uint8).tobytes()).hexdigest()
                own = s.owner[members]
                shift = s.places[members] - s.low[own]
                whose = s.order[own]
                rows += zip(s.key[whose].tolist(), s.ctx[whose].tolist(), [name] * len(own), [size] * len(own), shift.tolist(), strict=True)
                if len(rows) > ROWS // 8:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["key", "ctx", "repeat", "size", "shift"])

    return _by_key(found, work, "key bigint, ctx bigint, repeat string, size bigint, shift bigint")


def _written(docs: DataFrame, text: str, doc: str) -> tuple[DataFrame, list[str]]:
    """Rows with a number of their own, the id as ``doc`` (null is last), the text and all columns as c0, c1, ..."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    return (
        materialize(
            plain.select(
                F.monotonically_increasing_id().alias("num"),
                F.coalesce(F.col(at[doc]).cast("bigint"), F.lit(LAST)).alias("doc"),
                F.col(at[text]).cast("string").alias("text"),
                *(c for c in names if c != at[text]),
            ),
            compression="zstd",
        ),
        names,
    )


def covered(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(num, span below zero) of all that stands earlier, possibly in parts that overlap."""
    settled = materialize(settle(anchor_rows(texts, hot_keys(texts))))
    found = repeats(contexts(texts, settled.filter("span >= 0")), length)
    return settled.filter("span < 0").select("num", "span").union(found)


def groups(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(repeat, size, doc_id, start): maximal repeats of LENGTH bytes or more with all their occurrences.

    A repeat is named by the MD5 of its bytes, or by its context where whole contexts are equal, and is as long as
    the context of its anchor lets it be; a longer one is found in parts, one for each anchor inside.
    """
    texts, _ = _written(docs, text, doc)
    hot = hot_keys(texts)
    rows = materialize(anchor_rows(texts, hot, combined=False))
    several = settle(rows).filter("span >= 0")
    members = materialize(group_members(contexts(texts, several), LENGTH))
    found = members.filter("repeat is not null")
    # Equal contexts are a repeat from end to end.
    whole = rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("span")).filter("n > 1")
    whole = whole.join(members.filter("repeat is null").select("key", "ctx"), ["key", "ctx"], "left_anti")
    name = F.concat(F.lower(F.hex("key")), F.lit("-"), F.lower(F.hex("ctx")))
    size = F.col("span").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    found = found.unionByName(whole.select("key", "ctx", name.alias("repeat"), size.alias("size"), F.lit(0).cast("bigint").alias("shift")))
    lists = found.groupBy("key", "ctx").agg(F.collect_list(F.struct("repeat", "size", "shift")).alias("found"))
    met = spread_lookup(rows, lists, ["key", "ctx"], ["num"])
    met = met.select("doc", F.shiftright("span", SIZE_BITS).alias("at"), F.inline("found"))
    doc_id = F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id")
    return met.select("repeat", "size", doc_id, (F.col("at") + F.col("shift")).alias("start"))


def clean(docs: DataFrame, text: str = "text", doc: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    ``kept`` is binary: a cut may fall inside a character. A column with the name of
    a new one gives way to it.
    """
    texts, names = _written(docs, text, doc)
    lists = covered(texts).groupBy("num").agg(F.collect_list("span").alias("spans"))
    both = texts.join(lists.withColumnRenamed("num", "_num"), F.col("num") == F.col("_num"), "left")
    new = {"n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType(), "kept": BinaryType()}
    wanted = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    inner = {c: "text" if c == text else names[i] for i, c in enumerate(docs.columns)}
    carried = [both.columns.index(inner[c]) for c in wanted]
    made = StructType([both.schema[i] for i in carried] + [StructField(f"_{c}", kind) for c, kind in new.items()])
    made = StructType([StructField(f"o{i}", f.dataType) for i, f in enumerate(made)])
    schema, place, spans = to_arrow_schema(made), both.columns.index("text"), both.columns.index("spans")

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(place).cast(pa.large_binary()).to_pylist(), batch.column(spans)
            found = []
            for i, content in enumerate(texts):
                content = content or b""
                held = lists[i].values.to_numpy() if lists[i].is_valid else None
                found.append((len(content), 0, 0, content) if held is None else _removed(content, -1 - held))
            columns = [batch.column(i).cast(f.type) for i, f in zip(carried, schema, strict=False)]
            results = [pa.array(c, f.type) for c, f in zip(zip(*found), list(schema)[len(carried) :], strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays(columns + results, schema=schema)

    return both.mapInArrow(run, made).toDF(*wanted, *new)


def _removed(content: bytes, spans: np.ndarray) -> tuple[int, int, int, bytes]:
    start, size = spans >> SIZE_BITS, spans & ((1 << SIZE_BITS) - 1)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + size)[order])
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    low, high = start[opens], end[np.concatenate([opens[1:], [len(start)]]) - 1]
    parts = zip([0, *high.tolist()], [*low.tolist(), len(content)], strict=True)
    return len(content), int((high - low).sum()), len(low), b"".join(content[a:b] for a, b in parts)
