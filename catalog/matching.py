"""Queries of the text and matching operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall import rules
from rolecall.functions import text
from rolecall.operators import match, skew

from . import recipes
from .registry import query, sql_list

# Oracle macros: the tokenizer in its long form (strip dots, then drop short
# words), so that the engine's one-pattern form is checked against it.
TOKENS = rf"""list_filter(
    list_transform(regexp_extract_all(lower(%s), '[a-z][a-z0-9+#./-]*'),
                   lambda t: regexp_replace(t, '[.,:;!?()\[\]]+$', '')),
    lambda t: length(t) > 2 AND t NOT IN ({sql_list(text.NO_SIGNAL)}))"""
JOB_TF = f"""
job_tokens AS (
  SELECT board_id, ord, unnest({TOKENS % 'title'}) AS term, 1 AS w FROM jobs
  UNION ALL
  SELECT board_id, ord, unnest({TOKENS % 'description'}) AS term, 3 AS w FROM jobs),
jtf AS (SELECT board_id, ord, term, CAST(sum(w) AS BIGINT) AS tf FROM job_tokens GROUP BY ALL)"""
RESUME_TF = f"""
rtf AS (
  SELECT resume_id, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT resume_id, unnest({TOKENS % 'resume_text'}) AS term FROM resumes) GROUP BY ALL)"""
DF = "dfs AS (SELECT board_id, term, count(*) AS df FROM jtf GROUP BY ALL)"
SIZES = "sizes AS (SELECT board_id, count(*) AS n_jobs FROM jobs GROUP BY ALL)"
# The direct formula: every pair is a corpus of its own.
PAIR = """
pair_df AS (
  SELECT p.resume_id, d.board_id, d.term, d.df + CASE WHEN r.term IS NULL THEN 0 ELSE 1 END AS df
  FROM pairs p JOIN dfs d USING (board_id) LEFT JOIN rtf r ON r.resume_id = p.resume_id AND r.term = d.term
  UNION ALL
  SELECT p.resume_id, p.board_id, r.term, 1 AS df
  FROM pairs p JOIN sizes USING (board_id) JOIN rtf r USING (resume_id)
  LEFT JOIN dfs d ON d.board_id = p.board_id AND d.term = r.term WHERE d.term IS NULL),
pair_idf AS (
  SELECT resume_id, board_id, term, ln((2.0::DOUBLE + n_jobs) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
  FROM pair_df JOIN sizes USING (board_id)),
job_w AS (
  SELECT i.resume_id, j.board_id, j.ord, j.term, j.tf * i.idf AS w
  FROM jtf j JOIN pair_idf i ON i.board_id = j.board_id AND i.term = j.term),
resume_w AS (
  SELECT i.resume_id, i.board_id, r.term, r.tf * i.idf AS w
  FROM rtf r JOIN pair_idf i ON i.resume_id = r.resume_id AND i.term = r.term),
job_norm AS (SELECT resume_id, board_id, ord, sqrt(sum(w * w)) AS norm FROM job_w GROUP BY ALL),
resume_norm AS (SELECT resume_id, board_id, sqrt(sum(w * w)) AS norm FROM resume_w GROUP BY ALL),
dots AS (
  SELECT j.resume_id, j.board_id, j.ord, sum(j.w * r.w) AS dot
  FROM job_w j JOIN resume_w r ON r.resume_id = j.resume_id AND r.board_id = j.board_id AND r.term = j.term
  GROUP BY ALL),
cosines AS (
  SELECT p.resume_id, p.board_id, j.ord, j.title,
         coalesce(d.dot / (jn.norm * rn.norm), 0.0::DOUBLE) AS cosine
  FROM pairs p JOIN jobs j USING (board_id)
  LEFT JOIN dots d ON d.resume_id = p.resume_id AND d.board_id = p.board_id AND d.ord = j.ord
  LEFT JOIN job_norm jn ON jn.resume_id = p.resume_id AND jn.board_id = p.board_id AND jn.ord = j.ord
  LEFT JOIN resume_norm rn ON rn.resume_id = p.resume_id AND rn.board_id = p.board_id)"""
YEARS = r"""
work AS (
  SELECT resume_id, regexp_split_to_array(resume_text,
           '(?im)^\s*(education|academic|degree|university|college|school)\b')[1] AS t FROM resumes),
spans AS (
  SELECT resume_id,
    unnest(regexp_extract_all(t, '(?i)(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+)?((?:19|20)\d{2})\s*[-–—to]+\s*((?:19|20)\d{2}|present|current|now)', 1)) AS b,
    unnest(regexp_extract_all(t, '(?i)(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+)?((?:19|20)\d{2})\s*[-–—to]+\s*((?:19|20)\d{2}|present|current|now)', 2)) AS e
  FROM work),
years AS (
  SELECT resume_id, coalesce(sum(greatest(0,
      CASE WHEN lower(e) IN ('present', 'current', 'now') THEN 2025 ELSE try_cast(e AS INT) END - CAST(b AS INT))), 0)::DOUBLE AS years
  FROM resumes LEFT JOIN spans USING (resume_id) GROUP BY resume_id)"""
SCORED = r"""
scored AS (
  SELECT c.*, round_even(c.cosine, 4) AS score,
    CAST(least(100, round_even(c.cosine * 200 * CASE WHEN regexp_matches(c.title,
      '(?i)\b(senior|sr\.?|staff|principal|lead|director|vp|vice\s+president)\b') AND y.years < 3
      THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, 0)) AS INT) AS score_pct
  FROM cosines c JOIN years y USING (resume_id))"""
KEYWORDS = """
job_rank AS (
  SELECT resume_id, board_id, ord, term,
    row_number() OVER (PARTITION BY resume_id, board_id, ord ORDER BY round(w, 10) DESC, term) AS k FROM job_w),
resume_rank AS (
  SELECT resume_id, board_id, term,
    row_number() OVER (PARTITION BY resume_id, board_id ORDER BY round(w, 10) DESC, term) AS k FROM resume_w),
job_top AS (SELECT resume_id, board_id, ord, term FROM job_rank WHERE k <= 30),
resume_top AS (SELECT resume_id, board_id, term FROM resume_rank WHERE k <= 50),
words AS (
  SELECT j.resume_id, j.board_id, j.ord,
    coalesce(list(j.term ORDER BY j.term) FILTER (WHERE r.term IS NOT NULL), []) AS matched,
    coalesce(list(j.term ORDER BY j.term) FILTER (WHERE r.term IS NULL), []) AS missing
  FROM job_top j LEFT JOIN resume_top r
    ON r.resume_id = j.resume_id AND r.board_id = j.board_id AND r.term = j.term GROUP BY ALL),
listed AS (
  SELECT s.*, coalesce(matched, CAST([] AS VARCHAR[])) AS matched, coalesce(missing, CAST([] AS VARCHAR[])) AS missing
  FROM scored s LEFT JOIN words w
    ON w.resume_id = s.resume_id AND w.board_id = s.board_id AND w.ord = s.ord)"""
EXPLAINED = """CASE WHEN score_pct >= 75 THEN 'Strong' WHEN score_pct >= 50 THEN 'Moderate' ELSE 'Weak' END
    || ' match (' || CAST(score_pct AS VARCHAR) || '%).'
    || CASE WHEN len(matched) > 0 THEN ' Shared skills: ' || array_to_string(matched, ', ') || '.' ELSE '' END
    || CASE WHEN len(missing) > 0 THEN ' Gap areas: ' || array_to_string(missing, ', ') || '.' ELSE '' END"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


MATCH = _with(
    recipes.JOBS_SQL, recipes.RESUMES_SQL, JOB_TF, RESUME_TF, DF, SIZES, PAIR, YEARS, SCORED, KEYWORDS
)


@query(
    "job_tokens",
    f"WITH {recipes.JOBS_SQL} SELECT board_id, ord, array_to_string({TOKENS % 'description'}, ' ') AS tokens FROM jobs",
)
def job_tokens(spark, sf):
    return recipes.jobs(spark, sf).select(
        "board_id", "ord", F.array_join(text.tokens(F.col("description")), " ").alias("tokens")
    )


@query("job_term_freqs", _with(recipes.JOBS_SQL, JOB_TF) + " SELECT board_id, ord, term, tf FROM jtf")
def job_term_freqs(spark, sf):
    return match.term_freqs(recipes.jobs(spark, sf)).withColumn("tf", F.col("tf").cast("long"))


@query("resume_term_freqs", _with(recipes.RESUMES_SQL, RESUME_TF) + " SELECT resume_id, term, tf FROM rtf")
def resume_term_freqs(spark, sf):
    return match.resume_term_freqs(recipes.resumes(spark, sf)).withColumn("tf", F.col("tf").cast("long"))


@query("doc_freqs", _with(recipes.JOBS_SQL, JOB_TF, DF) + " SELECT board_id, term, df FROM dfs")
def doc_freqs(spark, sf):
    return match.doc_freqs(match.term_freqs(recipes.jobs(spark, sf)))


@query(
    "board_idf",
    _with(recipes.JOBS_SQL, JOB_TF, DF, SIZES)
    + " SELECT board_id, term, round(ln((2.0::DOUBLE + n_jobs) / (1.0::DOUBLE + df)) + 1, 6) AS idf FROM dfs JOIN sizes USING (board_id)",
)
def board_idf(spark, sf):
    df = match.job_df(recipes.jobs(spark, sf))
    sizes = df.filter(F.col("term") == match.SENTINEL).select("board_id", F.col("df").alias("n_jobs"))
    terms = df.filter(F.col("term") != match.SENTINEL)
    return skew.spread_lookup(terms, sizes, ["board_id"], ["term"]).select(
        "board_id", "term", F.round(match.idf(F.col("n_jobs"), F.col("df")), 6).alias("idf")
    )


@query(
    "job_vector_norms",
    _with(recipes.JOBS_SQL, JOB_TF, DF, SIZES)
    + """ SELECT board_id, ord, round(sqrt(sum(pow(tf * (ln((2.0::DOUBLE + n_jobs) / (1.0::DOUBLE + df)) + 1), 2))), 6) AS norm,
          count(*) AS n_terms
          FROM jtf JOIN dfs USING (board_id, term) JOIN sizes USING (board_id) GROUP BY ALL""",
)
def job_vector_norms(spark, sf):
    vectors = match.with_norm(match.job_vectors(recipes.jobs(spark, sf)))
    return vectors.filter(F.size("terms") > 0).select(
        "board_id",
        "ord",
        F.round(F.sqrt("base2"), 6).alias("norm"),
        F.size("terms").cast("long").alias("n_terms"),
    )


@query(
    "job_top_terms",
    _with(recipes.JOBS_SQL, JOB_TF, DF, SIZES)
    + """, ranked AS (SELECT board_id, ord, term, row_number() OVER (PARTITION BY board_id, ord
            ORDER BY round(tf * (ln((2.0::DOUBLE + n_jobs) / (1.0::DOUBLE + df)) + 1), 10) DESC, term) AS k
          FROM jtf JOIN dfs USING (board_id, term) JOIN sizes USING (board_id))
          SELECT board_id, ord, CAST(k AS INT) AS k, term FROM ranked WHERE k <= 30""",
)
def job_top_terms(spark, sf):
    vectors = match.with_ranked(match.job_vectors(recipes.jobs(spark, sf)))
    top = F.transform(F.slice("ranked", 1, rules.JOB_TOP_TERMS), lambda t: t["term"])
    return vectors.select("board_id", "ord", F.posexplode(top).alias("k", "term")).withColumn("k", F.col("k") + 1)


@query("resume_years", _with(recipes.RESUMES_SQL, YEARS) + " SELECT resume_id, years FROM years")
def resume_years(spark, sf):
    return recipes.resumes(spark, sf).select(
        "resume_id", text.years_of_experience(F.col("resume_text")).alias("years")
    )


@query(
    "seniority_multiplier",
    _with(recipes.JOBS_SQL)
    + r""" SELECT board_id, ord,
           CASE WHEN regexp_matches(title, '(?i)\b(senior|sr\.?|staff|principal|lead|director|vp|vice\s+president)\b')
                 AND ord % 7 < 3 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM jobs""",
)
def seniority_multiplier(spark, sf):
    """Every title against a candidate with ``ord % 7`` years."""
    return recipes.jobs(spark, sf).select(
        "board_id", "ord", text.seniority_multiplier(F.col("title"), F.col("ord") % 7).alias("multiplier")
    )


def _matches(spark, sf, **options):
    return match.score_jobs(
        recipes.resumes(spark, sf), recipes.jobs(spark, sf), recipes.pairs(spark, sf), **options
    )


@query("resume_job_cosine", MATCH + " SELECT resume_id, board_id, ord, score, score_pct FROM scored")
def resume_job_cosine(spark, sf):
    return _matches(spark, sf, ranked=False, worded=False).select("resume_id", "board_id", "ord", "score", "score_pct")


@query(
    "match_keywords",
    MATCH
    + """ SELECT resume_id, board_id, ord, array_to_string(matched, ' ') AS matched_keywords,
          array_to_string(missing, ' ') AS missing_keywords FROM listed""",
)
def match_keywords(spark, sf):
    return _matches(spark, sf, ranked=False).select(
        "resume_id",
        "board_id",
        "ord",
        F.array_join("matched_keywords", " ").alias("matched_keywords"),
        F.array_join("missing_keywords", " ").alias("missing_keywords"),
    )


@query("match_explanation", MATCH + f" SELECT resume_id, board_id, ord, {EXPLAINED} AS explanation FROM listed")
def match_explanation(spark, sf):
    return _matches(spark, sf, ranked=False).select("resume_id", "board_id", "ord", "explanation")


RANKED = f""" SELECT resume_id, board_id, ord, score, score_pct,
    array_to_string(matched, ' ') AS matched_keywords, array_to_string(missing, ' ') AS missing_keywords,
    {EXPLAINED} AS explanation,
    CAST(row_number() OVER (PARTITION BY resume_id, board_id ORDER BY score DESC, ord) AS INT) AS rank FROM listed"""


@query("ranked_matches", MATCH + RANKED)
def ranked_matches(spark, sf):
    return _matches(spark, sf).select(
        "resume_id",
        "board_id",
        "ord",
        "score",
        "score_pct",
        F.array_join("matched_keywords", " ").alias("matched_keywords"),
        F.array_join("missing_keywords", " ").alias("missing_keywords"),
        "explanation",
        "rank",
    )


@query("top_matches", f"SELECT * FROM ({MATCH + RANKED}) WHERE rank <= 5")
def top_matches(spark, sf):
    return _matches(spark, sf, top_k=5).select(
        "resume_id",
        "board_id",
        "ord",
        "score",
        "score_pct",
        F.array_join("matched_keywords", " ").alias("matched_keywords"),
        F.array_join("missing_keywords", " ").alias("missing_keywords"),
        "explanation",
        "rank",
    )


@query(
    "idle_ranges",
    MATCH
    + """ SELECT p.resume_id, p.board_id, count(*) AS idle_jobs FROM pairs p JOIN jobs j USING (board_id)
          LEFT JOIN dots d ON d.resume_id = p.resume_id AND d.board_id = p.board_id AND d.ord = j.ord
          WHERE d.ord IS NULL GROUP BY ALL""",
)
def idle_ranges(spark, sf):
    """Jobs that share no term with the résumé, kept as ranges of listing order."""
    idle = match.idle_jobs(recipes.resumes(spark, sf), recipes.jobs(spark, sf), recipes.pairs(spark, sf))
    return idle.groupBy("resume_id", "board_id").agg(F.sum("jobs").alias("idle_jobs"))


@query(
    "shared_matches",
    MATCH
    + """ SELECT l.resume_id, l.board_id, l.ord, l.score, array_to_string(matched, ' ') AS matched_keywords,
          CASE WHEN l.score > 0 THEN CAST(row_number() OVER (PARTITION BY l.resume_id, l.board_id ORDER BY l.score DESC, l.ord) AS INT) END AS rank
          FROM listed l JOIN dots d ON d.resume_id = l.resume_id AND d.board_id = l.board_id AND d.ord = l.ord""",
)
def shared_matches(spark, sf):
    """Only the jobs that share a term, with their rank among all."""
    found, _ = match.score_shared(recipes.resumes(spark, sf), recipes.jobs(spark, sf), recipes.pairs(spark, sf))
    return found.select(
        "resume_id", "board_id", "ord", "score", F.array_join("matched_keywords", " ").alias("matched_keywords"), "rank"
    )


@query(
    "scored_share",
    MATCH + " SELECT p.resume_id, p.board_id, count(*) AS jobs, true AS within FROM pairs p JOIN jobs j USING (board_id) GROUP BY ALL",
)
def scored_share(spark, sf):
    """Jobs of the board of each résumé, and that no more than those were scored for the best five."""
    share = match.scored_share(recipes.resumes(spark, sf), recipes.jobs(spark, sf), recipes.pairs(spark, sf), 5)
    within = F.col("scored").between(F.least(F.col("jobs"), F.lit(5)), F.col("jobs"))
    return share.select("resume_id", "board_id", "jobs", within.alias("within"))
