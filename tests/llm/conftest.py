import pytest
from pyspark.sql import functions as F

#: Awkward rows that every operator must take: nulls, empty and white texts, ties, repeated rows, a very long text.
AWKWARD = [
    (1, "the same line of text that stands in many documents of this table\nshort", "en", "a", 1),
    (2, "the same line of text that stands in many documents of this table\nshort", "en", "a", 1),
    (2, "the same line of text that stands in many documents of this table\nshort", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (None, "a row without an id but with a line that is long enough to count", "en", None, 3),
    (6, "x" * 200_000, "en", "c", 200_000),
    (7, ("word " * 50_000).strip(), "de", "c", 250_000),
    (8, "ünïcödé 𝒳 🙂 ¹²³ 一二三    <|endoftext|>", "fr", "c", 30),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def awkward(spark):
    """The awkward rows with extra columns whose names clash with what operators add."""
    extra = ("score", "n_words", "labels", "fingerprint", "token_ids", "n_lines", "spans", "hits", "kept", "base", "runs")
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit(c) for c in extra})


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def sf(tmp_path, spark):
    """A writer of small tables: ``sf(documents=[...])`` gives their folder."""

    def write(**tables):
        schemas = {"documents": SCHEMA, "benchmark": "item_id bigint, text string", "conversations": "conv_id bigint, turn bigint, role string, text string"}
        for name, rows in tables.items():
            frame = spark.createDataFrame(rows, schemas[name]) if isinstance(rows, list) else rows
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
