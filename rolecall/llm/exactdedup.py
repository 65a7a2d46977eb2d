"""Operator 5: exact dedup by two-pass Bloom filtering, in DataFrame functions only.

The texts are read once, into a narrow table of digests. The first pass over it
finds the cells of a Bloom filter (``FUNCTIONS`` hash functions, each with its
own range of cells) that two or more rows fall into, and packs these into
bitmaps. The second pass looks every row up: if one of its cells has only
itself, its text occurs once and the row goes straight to the result. Only the
others, repeated texts and a few false alarms, are shuffled by digest and
grouped.

The filter has ``CELLS_PER_ROW`` cells per row and function, at every size. Up to
``BROADCAST_BYTES`` it is broadcast; a larger one is joined by bitmap number, with
hot numbers spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.operators.skew import materialize, spread_lookup

FUNCTIONS = 2
CELLS_PER_ROW = 8
#: Bits of one bitmap, as Spark's bitmap functions have them.
BITMAP = 32768
BROADCAST_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """Text without the characters U+0020 and U+0009 to U+000D; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for code in (0x20, 0x0A, 0x09, 0x0B, 0x0C, 0x0D):
        text = F.replace(text, F.lit(chr(code)), F.lit(""))
    return text


def digests(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, chars, digest): code points of the original text, and SHA-256 of the normalised one."""
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    return docs.select(
        docs[f"`{doc}`"].alias("doc_id"),
        F.length(body).cast("bigint").alias("chars"),
        F.unhex(F.sha2(F.encode(normalised(body), "UTF-8"), 256)).alias("digest"),
    )


def cells(rows: int) -> int:
    """Cells of one hash function: a power of two, at least one bitmap."""
    n = BITMAP
    while n < CELLS_PER_ROW * rows:
        n *= 2
    return n


def cell(function: int, n: int) -> Column:
    """Cell of a row under one function, counted from 1 through all functions."""
    return F.pmod(F.xxhash64("digest", F.lit(function)), F.lit(n)) + F.lit(function * n + 1)


def crowded(rows: DataFrame, n: int) -> DataFrame:
    """First pass: (bucket, bitmap) of the cells with two or more rows."""
    each = rows.select(F.explode(F.array(*(cell(k, n) for k in range(FUNCTIONS)))).alias("cell"))
    full = each.groupBy("cell").count().filter("count > 1")
    return full.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap")
    )


def looked_up(rows: DataFrame, filled: DataFrame, n: int) -> DataFrame:
    """Second pass: ``rows`` with ``maybe``, whether all their cells are crowded."""
    small = FUNCTIONS * n // 8 <= BROADCAST_BYTES
    for k in range(FUNCTIONS):
        rows = rows.withColumn("bucket", F.bitmap_bucket_number(cell(k, n)))
        if small:
            rows = rows.join(F.broadcast(filled), "bucket", "left")
        else:
            rows = spread_lookup(rows, filled, ["bucket"], ["doc_id"], "left")
        at = F.bitmap_bit_position(cell(k, n))
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
        rows = rows.withColumn("maybe", hit if k == 0 else F.col("maybe") & hit).drop("bucket", "bitmap")
    return rows


def classes(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of ``docs``, dropped ones too.

    Texts are equal if they are after white space is deleted. The one with the most
    code points stays, then the one of the smallest doc_id (a null id counts as the
    smallest). Rows that repeat both its id and its length are kept like it.
    """
    rows = materialize(digests(docs, text, doc))
    n = cells(rows.count())
    marked = materialize(looked_up(rows, materialize(crowded(rows, n)), n))
    alone = marked.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    shared = marked.filter("maybe").drop("maybe")
    groups = materialize(
        shared.groupBy("digest").agg(
            F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").alias("id"))).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    found = spread_lookup(shared, groups, ["digest"], ["doc_id"]).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.less"))).alias("kept"),
        "digest",
    )
    return alone.union(found)


def deduplicate(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``classes`` drops, told by doc_id; rows with a null id stay."""
    gone = classes(docs, text, doc).filter("not kept and doc_id <> keep_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{doc}`"] == F.col("_gone"), "left_anti")
