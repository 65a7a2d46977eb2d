"""Training-corpus pipeline over ``documents``: five stages, each an operator of ``rolecall.llm``.

Every stage takes what the one before it kept, as a written table, and returns
the columns of ``documents``; the last adds the tokens. Extra columns are carried
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import bpe, components, decontaminate, langid, linededup, nearsets, simhash
from rolecall.llm.queries import VOCABULARY
from rolecall.operators.skew import materialize

#: Not in SQL: letter models, edit joins and byte pair merges; tests compare with brute force.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... so that no operator's column replaces one of them, and their names."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(name) for name, c in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents in one of the learned languages; rejected ones go.

    What is rejected depends on the text alone, so digests of rejected texts are written, no texts.
    """
    plain, names = _numbered(docs)
    text, lang, doc = names["text"], names["lang"], names["doc_id"]
    plain = plain.withColumn("digest", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    found = langid.label(plain.select(doc, lang, text, "digest"), text, lang, doc, ["digest"])
    gone = materialize(found.filter("rejected").select("digest").distinct())
    return _named(plain.join(gone, "digest", "left_anti"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated lines go, and documents that nothing but white space is left of by that."""
    plain, names = _numbered(docs)
    text = names["text"]
    found = linededup.clean(plain, text, names["doc_id"])
    emptied = (F.col("n_repeated") + F.col("n_near") > 0) & ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    found = found.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn(names["n_chars"], F.coalesce(F.length(text).cast(kind), F.col(names["n_chars"])))
    return _named(found, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, and its job at the stage's values, five words and similarity 0.8: one document of each component stays.

    Components are those of the links of both: fingerprints within three bits, and shingle sets. Rows
    that repeat a doc_id stay or go together; rows with a null id stay.
    """
    plain, names = _numbered(docs)
    doc, text = names["doc_id"], names["text"]
    found = None
    for method in (simhash, nearsets):
        links = method.classes(plain, text, doc).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        links = links.filter("a <> b")
        found = links if found is None else found.unionByName(links)
    gone = components.components(found).filter("node <> root").select(F.col("node").alias(doc))
    return _named(plain.join(materialize(gone), doc, "left_anti"), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a twentieth of their words or more inside benchmark windows go."""
    plain, names = _numbered(docs)
    rows = materialize(plain.select(F.monotonically_increasing_id().alias("row"), *names.values()))
    found = decontaminate.matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["text"], "row")
    gone = materialize(found.filter("contaminated").select(F.col("doc_id").alias("row")))
    return _named(rows.join(gone, "row", "left_anti"), names)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ``n_tokens`` and ``token_ids`` of every document that is left."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
