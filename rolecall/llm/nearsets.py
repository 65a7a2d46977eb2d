"""Near-duplicates by shingle sets: an exact join at a Jaccard similarity, for the pipeline.

Two texts are linked if the sets of their shingles (``SHINGLE`` words each) have a
Jaccard similarity of ``SIMILARITY`` or more. Fingerprints of 64 bits can't tell
that: at 0.8 they differ in about ten bits, which is too many for buckets.

Shingles have one fixed order: those that are common in a sample come last, equal
ones by hash. Sets of n shingles that are similar enough share one of their first
n - ceil(similarity * n) + 1 in that order, so only these are shuffled; no link is
missed. Sizes and places in the order rule pairs out before sets are compared.
The sample decides about speed only: any order gives the same links.

Equal sets are one node from the start. A first round links the members of a
shingle only to the one before them by size; a second compares what is still in
different components, so groups of near copies never become all their pairs. It
runs on cells of two blocks of at most ``BLOCK`` members, so a hot shingle is dealt
out to many tasks, each with two blocks at a time.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rolecall.llm.components import components
from rolecall.llm.rows import map_texts
from rolecall.operators.skew import drop_folder, materialize, scratch_dir, spread_lookup

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Members of a shingle that are compared with others at once.
BLOCK = 256
#: About so many documents show which shingles are common, so many of them at least; at most COMMON go to every task.
SAMPLE_ROWS, COMMON_DOCS, COMMON = 5_000, 4, 100_000
#: Bits of a set by which pairs are compared first (``bits_of``).
BITS = 8192
#: Nodes whose sets are compared are sent to every task up to this number; more are joined.
SENT_NODES = 4_000_000

ROW = "token bigint, node bigint, size int, left int"


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) > shingle:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    else:
        parts = [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """Number of a set as a signed 64-bit hash; 0 for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))) if len(hashes) else 0


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """A set as BITS bits, in signed numbers: two sets differ in at least as many hashes as in bits."""
    bits = np.zeros(BITS, bool)
    bits[(hashes % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view("<i8")


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def nodes(docs: DataFrame, text: str, doc: str, shingle: int) -> DataFrame:
    """(doc_id, node) of every row."""
    source = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    make = lambda: lambda texts: [[node_of(shingle_set(x, shingle)) for x in texts]]
    return map_texts(source, make, StructType([StructField("node", LongType())]), "text", ["doc_id"])


def common_shingles(docs: DataFrame, text: str, doc: str, shingle: int, total: int) -> np.ndarray:
    """Hashes that many documents of a sample have, ascending."""
    every = max(1, -(-total // SAMPLE_ROWS))
    sample = docs.filter(F.pmod(F.xxhash64(f"`{doc}`"), F.lit(every)) == 0)
    make = lambda: lambda texts: [[shingle_set(x, shingle).view(np.int64) for x in texts]]
    sets = map_texts(sample, make, StructType([StructField("_set", ArrayType(LongType()))]), text, [])
    counts = sets.select(F.explode("_set").alias("token")).groupBy("token").count().filter(F.col("count") >= COMMON_DOCS)
    found = counts.orderBy(F.desc("count"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, text: str, common: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(token, node, size, left): the first shingles of every set; ``left`` counts those from it on."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        known = sent.value
        for batch in batches:
            held: list[list[np.ndarray]] = [[], [], [], []]
            room = 0

            def flush(held=held):
                columns = [np.concatenate(x) for x in held]
                for x in held:
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "size", "left"])

            for value in batch.column(0):
                hashes = shingle_set(value.as_py() or "", shingle)
                n = len(hashes)
                if not n:
                    continue
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hot = known[at] == hashes if len(known) else np.zeros(n, bool)
                first = np.concatenate([hashes[~hot], hashes[hot]])[: prefix_size(n, similarity)]
                columns = (
                    first.view(np.int64),
                    np.full(len(first), node_of(hashes), np.int64),
                    np.full(len(first), n, np.int32),
                    n - np.arange(len(first), dtype=np.int32),
                )
                for x, c in zip(held, columns, strict=True):
                    x.append(c)
                room += len(first)
                if room > 200_000:
                    yield flush()
                    room = 0
            if held[0]:
                yield flush()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, ROW)


def fits(size, left, other_size, other_left, similarity: float):
    """Whether two sets can be similar enough, if this is the first shingle that they share."""
    need = similarity / (1 + similarity) * (size + other_size) - 1e-6
    smaller, larger = np.minimum(size, other_size), np.maximum(size, other_size)
    return (smaller >= similarity * larger - 1e-6) & (np.minimum(left, other_left) >= need)


def _folder(docs: DataFrame) -> str:
    """A folder for tables that go before the components are known."""
    spark = docs.sparkSession
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/sets-{uuid.uuid4().hex}"


def shared(rows: DataFrame, similarity: float, folder: str | None = None) -> DataFrame:
    """Members of shingles that several sets begin with, numbered in blocks by size; ``before`` is the last that fits."""
    schema = ROW + ", block int, before bigint"

    def run(batches):
        last = None  # (token, node, size, left, place, whether it was given out)
        for batch in batches:
            out = [[], [], [], [], [], []]
            for token, node, size, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or token != last[0]:
                    last = (token, node, size, left, 0, False)
                    continue
                if node == last[1]:
                    continue
                if not last[5]:
                    for x, v in zip(out, (*last[:4], 0, None), strict=True):
                        x.append(v)
                place = last[4] + 1
                before = last[1] if fits(size, left, last[2], last[3], similarity) else None
                for x, v in zip(out, (token, node, size, left, place // BLOCK, before), strict=True):
                    x.append(v)
                last = (token, node, size, left, place, True)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            names = ["token", "node", "size", "left", "block", "before"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    dealt = rows.repartition("token").sortWithinPartitions("token", "size", "node")
    return materialize(dealt.mapInArrow(run, schema), folder, "zstd")


def crossing(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of members (with ``root``) of one shingle that fit and are in different components."""
    # A shingle whose members are in one component already has nothing left to compare.
    apart = members.groupBy("token").agg(F.max("block").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    apart = materialize(apart.filter("lo <> hi").select("token", "blocks"))
    rows = spread_lookup(members, apart, ["token"], ["node"])
    other = F.explode(F.sequence(F.lit(0), "blocks")).alias("other")
    cells = rows.select("*", other).select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).alias("second"), "node", "size", "left", "root",
    )

    def close(parts):
        second, node, size, left, root = (np.concatenate(c) for c in zip(*parts, strict=True))
        a = np.flatnonzero(~second)
        b = np.flatnonzero(second) if second.any() else a
        good = root[a][:, None] != root[b][None, :]
        good &= fits(size[a][:, None], left[a][:, None], size[b][None, :], left[b][None, :], similarity)
        x, y = np.nonzero(good)
        x, y = node[a[x]], node[b[y]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        cell, held = None, []
        for batch in batches:
            token, i, j, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(token):
                continue
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)], strict=True):
                now = (token[start], i[start], j[start])
                if now != cell:
                    if held:
                        yield from close(held)
                    cell, held = now, []
                held.append([c[start:end] for c in rest])
        if held:
            yield from close(held)

    dealt = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def described(docs: DataFrame, text: str, shingle: int, nodes: DataFrame, values, texts: DataFrame | None = None) -> DataFrame:
    """(node, digest, n, values): of each of ``nodes`` the size of its set, what ``values`` makes of it, and the digest of a text that has it.

    With ``texts``, digests, other texts are not taken apart: two of one digest are no harm, as a text tells its node itself.
    """
    sent = []
    for table in (nodes, texts):
        few = table is not None and table.count() <= SENT_NODES
        known = np.sort(table.toArrow().column(0).to_numpy()) if few else None
        sent.append(docs.sparkSession.sparkContext.broadcast(known) if few else None)
    few, asked = sent

    def has(known, value: int) -> bool:
        at = np.searchsorted(known.value, value)
        return at < len(known.value) and known.value[at] == value

    def run(batches):
        for batch in batches:
            held, told, sizes, lists, room = [], [], [], [], 0

            def flush(held=held, told=told, sizes=sizes, lists=lists):
                made = [pa.array(held), pa.array(told), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))]
                for x in (held, told, sizes, lists):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, ["node", "digest", "n", "values"])

            for value, digest in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if asked is not None and not has(asked, digest):
                    continue
                hashes = shingle_set(value.as_py() or "", shingle)
                node = node_of(hashes)
                if few is not None and not has(few, node):
                    continue
                held.append(node)
                told.append(digest)
                sizes.append(len(hashes))
                lists.append(values(hashes))
                room += len(lists[-1])
                if room > 500_000:
                    yield flush()
                    room = 0
            if held:
                yield flush()

    source = docs.select(F.col(f"`{text}`"), F.xxhash64(F.col(f"`{text}`")))
    rows = source.mapInArrow(run, "node bigint, digest bigint, n int, values array<bigint>")
    firsts = [F.first(c).alias(c) for c in ("digest", "n", "values")]
    return rows.join(nodes, "node", "left_semi").groupBy("node").agg(*firsts)


def similar(pairs: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough, by comparing the sets, which are dropped then.

    Pairs whose bits (``bits_of``) rule that out meet no sets: only the sets of the others are made and move.
    """
    folder = _folder(docs)
    pairs = materialize(pairs, folder)

    def ends(links: DataFrame) -> DataFrame:
        return links.select(F.col("a").alias("node")).union(links.select("b")).distinct()

    def joined(links: DataFrame, table: DataFrame) -> DataFrame:
        # Plain joins move a column once for both sides; adaptive execution splits the pairs of a node that has very many.
        for c in ("a", "b"):
            links = links.join(table.select(F.col("node").alias(c), F.col("values").alias(f"_{c}"), F.col("n").alias(f"n_{c}")), c)
        return links

    total = F.col("n_a") + F.col("n_b")
    need = F.lit(similarity / (1 + similarity)) * total - F.lit(1e-6)
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    bits = materialize(described(docs, text, shingle, materialize(ends(pairs), folder), bits_of), folder)
    able = materialize(joined(pairs, bits).filter((total - differ) / 2 >= need).select("a", "b"), folder)
    left = materialize(bits.join(ends(able), "node", "left_semi").select("node", "digest"), folder)
    texts = left.select("digest").distinct()
    sets = materialize(described(docs, text, shingle, left.select("node"), lambda hashes: hashes.view(np.int64), texts), folder)
    found = materialize(joined(able, sets).filter(F.size(F.array_intersect("_a", "_b")) >= need).select("a", "b"))
    drop_folder(docs.sparkSession, folder)
    return found


def classes(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, component_id) per row: the smallest doc_id of all that its links reach.

    Texts without words (null, empty) are one node. Rows with a null doc_id join a
    component but name it only if all its ids are null.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    marked = materialize(nodes(docs, text, doc, shingle))
    common = common_shingles(docs, text, doc, shingle, marked.count())
    first_folder, folder = _folder(docs), _folder(docs)
    members = shared(prefixes(docs, text, common, shingle, similarity), similarity, first_folder)
    pair = [F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")]
    links = similar(members.filter("before is not null").select(*pair).distinct(), docs, text, shingle, similarity)
    roots = components(links)
    found = spread_lookup(members.drop("before"), roots, ["node"], ["token"], "left")
    found = materialize(found.withColumn("root", F.coalesce("root", "node")), folder, "zstd")
    drop_folder(docs.sparkSession, first_folder)
    links = links.union(similar(crossing(found, similarity), docs, text, shingle, similarity))
    drop_folder(docs.sparkSession, folder)
    roots = components(links)
    first = marked.groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = materialize(first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    known = materialize(spread_lookup(joined, materialize(named), ["root"], ["node"]).select("node", "component_id"))
    return spread_lookup(marked, known, ["node"], ["doc_id"]).select("doc_id", "component_id")


def deduplicate(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns stay as they are.

    Rows that repeat a doc_id count as one document and stay or go together; rows with a null id stay.
    """
    found = classes(docs, text, doc, shingle, similarity)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{doc}`"] == F.col("_gone"), "left_anti")
