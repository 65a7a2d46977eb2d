"""Operator 8: SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into four segments of 16 bits that form a ring. If
two fingerprints differ in at most three bits, the pigeonring principle says
that from some segment on *every* chain of consecutive segments stays within its
proportional budget: the first segment differs in 3/4, so in no bit, the first
two together in at most 1, three in at most 2, all four in at most 3.

Candidates share a bucket: for each of the four places on the ring, the first
segment, and one half of the second, because of two halves with at most one
differing bit one is equal. That is eight rows for each *distinct* fingerprint,
keyed by 24 bits. In a bucket, pairs must keep the budgets of chains of two and
three segments before their whole distance is looked at. A bucket passes on only
what joins its members, one link less than members at most, so groups of near
copies never grow into all their pairs. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rolecall.llm.components import components
from rolecall.llm.rows import map_texts
from rolecall.operators.skew import materialize, spread_lookup

#: Words of a shingle, seed of its hash, and the most bits that linked fingerprints differ in.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Most differing bits of the first one to four segments of a chain.
BUDGETS = (0, 1, 2, 3)
#: Members of a bucket that are compared with others at once.
BLOCK = 1024

#: Bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str) -> bytes:
    """XXH64 of each shingle, eight big-endian bytes each; nothing for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) > SHINGLE:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    else:
        shingles = [b" ".join(words)] if words else []
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in shingles])


def fingerprints(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text as a signed number; 0 without words."""
    hashes = [shingle_hashes(x) for x in texts]
    counts = np.array([len(h) // 8 for h in hashes], np.int64)
    rows = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    text = np.repeat(np.arange(len(texts)) * 256, counts)
    out = np.empty((len(texts), 8), np.uint8)
    for b in range(8):
        values = np.bincount(text + rows[:, b], minlength=256 * len(texts)).reshape(-1, 256)
        out[:, b] = np.packbits(2 * (values @ _BITS) > counts[:, None], axis=1)[:, 0]
    return out.view(">i8")[:, 0].astype(np.int64)


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` (bigint). Row-wise; null counts as empty; a column of that name is replaced."""

    def make():
        def work(texts):
            # A few hundred texts at once keep the counters small.
            return [np.concatenate([fingerprints(texts[i : i + 500]) for i in range(0, len(texts), 500)])]

        return work

    return map_texts(df, make, StructType([StructField("fingerprint", LongType())]), text, keep)


def buckets(prints: DataFrame) -> DataFrame:
    """(bucket, fp): eight rows for each distinct fingerprint."""
    fp = F.col("fp")
    rows = []
    for place in range(4):
        first = F.shiftrightunsigned(fp, 16 * place).bitwiseAND(F.lit(0xFFFF))
        second = F.shiftrightunsigned(fp, 16 * ((place + 1) % 4)).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            part = F.shiftright(second, 8 * half).bitwiseAND(F.lit(0xFF))
            rows.append(((first * 256 + part) * 8 + (place * 2 + half)).cast("bigint"))
    return prints.select(F.explode(F.array(*rows)).alias("bucket"), "fp")


def chained(a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    """Whether each fingerprint of ``a`` links to each of ``b`` by a chain that starts at a segment."""
    differing = a[:, None] ^ b[None, :]
    segment = lambda k: (differing >> np.uint64(16 * ((place + k) % 4))) & np.uint64(0xFFFF)
    used = np.bitwise_count(segment(0))
    fits = used <= BUDGETS[0]
    for k in (1, 2):
        used = used + np.bitwise_count(segment(k))
        fits &= used <= BUDGETS[k]
    fits[fits] = np.bitwise_count(differing[fits]) <= DISTANCE
    return fits


def joins(members: np.ndarray, place: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in one bucket: a spanning forest of the links between its members."""
    parent = list(range(len(members)))

    def end(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(0, len(members), BLOCK):
        for j in range(i, len(members), BLOCK):
            fits = chained(members[i : i + BLOCK], members[j : j + BLOCK], place)
            while fits.any():
                rows, columns = (np.array([end(k + x) for x in range(n)]) for k, n in zip((i, j), fits.shape, strict=True))
                fits &= rows[:, None] != columns[None, :]
                left = np.flatnonzero(fits.any(1))
                for a, b in zip(left.tolist(), fits[left].argmax(1).tolist(), strict=True):
                    x, y = end(i + a), end(j + b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        yield i + a, j + b


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` that have the same components as all links of up to DISTANCE bits.

    Buckets are dealt out and sorted, then read as a stream; a task holds one bucket at a time.
    """

    def close(bucket: int, parts: list[np.ndarray]):
        members = np.concatenate(parts)
        if len(members) < 2:
            return
        members = members.view(np.uint64)
        found = list(joins(members, (bucket & 7) >> 1))
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(members[x].view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if end == start:
                    continue
                if bucket is not None and keys[start] != bucket:
                    yield from close(bucket, held)
                    held = []
                bucket = int(keys[start])
                held.append(prints[start:end])
        if held:
            yield from close(bucket, held)

    dealt = buckets(prints).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: the smallest doc_id of all that its fingerprint reaches.

    Texts without words (null, empty) share fingerprint 0. Rows with a null doc_id
    join a component but name it only if all its ids are null.
    """
    marked = materialize(with_fingerprint(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    prints = materialize(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    roots = components(links(prints.select("fp")))
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = materialize(joined)
    named = materialize(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    known = materialize(spread_lookup(joined, named, ["root"], ["fp"]))
    known = known.select(F.col("fp").alias("fingerprint"), "component_id")
    return spread_lookup(marked, known, ["fingerprint"], ["doc_id"]).select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns stay as they are.

    Rows that repeat a doc_id count as one document and stay or go together; rows with a null id stay.
    """
    found = classes(docs, text, doc)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{doc}`"] == F.col("_gone"), "left_anti")
