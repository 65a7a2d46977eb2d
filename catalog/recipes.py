"""Inputs of the queries, derived from the shared tables.

Every recipe is written twice with the same meaning: as a DataFrame and as SQL
for the oracle. All of them read whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

# --- listings: one per document, one board per source -------------------------
JOBS_SQL = r"""
jobs AS (
  SELECT source AS board_id, doc_id AS ord,
         CASE WHEN doc_id % 5 = 0 THEN 'Senior ' ELSE '' END
           || regexp_replace(split_part(text, '.', 1), '[^\x20-\x7E]', '', 'g') AS title,
         text AS description, '' AS location,
         'https://jobs.example.com/' || source || '/' || CAST(doc_id AS VARCHAR) AS url
  FROM documents)"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    sentence = F.regexp_replace(F.split_part("text", F.lit("."), F.lit(1)), r"[^\x20-\x7E]", "")
    return table(spark, sf, "documents").select(
        F.col("source").alias("board_id"),
        F.col("doc_id").alias("ord"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "Senior ").otherwise(""), sentence).alias("title"),
        F.col("text").alias("description"),
        F.lit("").alias("location"),
        F.concat(F.lit("https://jobs.example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
    )


# --- resumes: the user's words of a conversation plus dated lines --------------
RESUMES_SQL = r"""
resumes AS (
  SELECT conv_id AS resume_id,
         string_agg(text, chr(10) ORDER BY turn)
         || CASE WHEN conv_id % 3 = 0 THEN ''
                 ELSE chr(10) || '20' || lpad(CAST(conv_id % 20 AS VARCHAR), 2, '0') || ' - present' END
         || CASE WHEN conv_id % 4 = 0 THEN chr(10) || 'Education' || chr(10) || '1990 - 2000' ELSE '' END
           AS resume_text
  FROM conversations WHERE role = 'user' GROUP BY conv_id),
pairs AS (SELECT resume_id, 'src' || CAST(resume_id % 20 AS VARCHAR) AS board_id FROM resumes)"""


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").filter(F.col("role") == "user")
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    year = F.lpad((F.col("conv_id") % 20).cast("string"), 2, "0")
    return said.select(
        F.col("conv_id").alias("resume_id"),
        F.concat(
            F.array_join(F.transform("turns", lambda t: t["text"]), "\n"),
            F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("\n20"), year, F.lit(" - present"))),
            F.when(F.col("conv_id") % 4 == 0, "\nEducation\n1990 - 2000").otherwise(""),
        ).alias("resume_text"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resumes(spark, sf).select(
        "resume_id", F.concat(F.lit("src"), (F.col("resume_id") % 20).cast("string")).alias("board_id")
    )
