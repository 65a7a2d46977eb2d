"""Registered queries of the operators in this package, one for each and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import (
    bpe,
    centroids,
    chat,
    decontaminate,
    exactdedup,
    langid,
    licenses,
    linededup,
    oracles,
    pii,
    planted_chat,
    secrets,
    simhash,
    spelling,
    substrings,
)

#: Vocabulary of operator 1; a path on the driver, its content is sent to executors.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests."""
    coded = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), VOCABULARY, keep=["doc_id"], with_decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of every document."""
    found = licenses.scan(documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS),
        F.sha2(secrets.listed(*secrets.KINDS), 256).alias("base_sha256"),
        secrets.listed(*secrets.KINDS, "random").alias("spans"),
    )


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses, and what is left of it."""
    found = linededup.clean(documents(spark, sf_dir, "doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_repeated", "n_near", kept)


def op5_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    found = exactdedup.classes(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumn("digest", F.lower(F.hex("digest"))).withColumnRenamed("digest", "text_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(documents(spark, sf_dir, "doc_id", "text"), benchmark)
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document comes near without an exact match of them."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(documents(spark, sf_dir, "doc_id", "text"), benchmark)
    return found.select("doc_id", F.array_join("near_items", ",").alias("near_items"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM windows) ON n <= len(w))),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with tool calls derived from its turns, linked, ordered, checked and serialised."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = chat.formatted(planted_chat.messages(conversations), planted_chat.tools(spark))
    calls = F.coalesce("calls", F.array().cast(found.schema["calls"].dataType))
    return found.select(
        "conv_id",
        "turn",
        "role",
        F.array_join(F.transform("place", lambda x: x.cast("string")), ":").alias("place"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.size(calls).alias("n_calls"),
        F.size(F.filter(calls, lambda c: c["result_turn"].isNotNull())).alias("n_answered"),
        F.array_join(F.flatten(F.transform(calls, lambda c: c["errors"])), ",").alias("errors"),
        "json",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.classes(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.scan(documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])

    def count(i: int):
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by models of the documents that are not held out."""
    found = langid.label(documents(spark, sf_dir, "doc_id", "text", "lang"), keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector, with the inertia of its cluster and of all."""
    found = centroids.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = [(c, found.inertia[c], ",".join(map(str, x))) for c, x in enumerate(found.centroids)]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, components string")
    return found.members.join(F.broadcast(each), "cluster").select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(sum(found.inertia)).cast("bigint").alias("inertia"),
        F.sha2("components", 256).alias("centroid_sha256"),
    )


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when bytes in strings that stand earlier go."""
    found = substrings.clean(documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word."""
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_secrets": op3_secrets,
    "op4_linededup": op4_linededup,
    "op5_exactdedup": op5_exactdedup,
    "op6_decontaminate": op6_decontaminate,
    "op6_near": op6_near,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_langid": op10_langid,
    "op11_centroids": op11_centroids,
    "op12_substrings": op12_substrings,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op5_exactdedup": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op7_chat": planted_chat.SQL,
    "op11_centroids": oracles.OP11_SQL,
    "op12_substrings": oracles.OP12_SQL,
    "op13_spelling": oracles.OP13_SQL,
}
