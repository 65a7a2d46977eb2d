"""Schemas, readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.skew import materialize

PAGES = "page_id LONG, url STRING, html STRING"
REQUESTS = "request_id LONG, url STRING"
RESUMES = "resume_id LONG, resume_text STRING"
LISTINGS = "board_id STRING, ord LONG, title STRING, description STRING, location STRING, url STRING"
FORMATS = {"parquet", "orc", "json"}


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read a stored table with its declared schema; nothing is inferred."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    return spark.read.schema(StructType.fromDDL(schema)).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawled pages ``(page_id, url, html)``."""
    return read_table(spark, path, PAGES, fmt)


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, REQUESTS, fmt)


def read_resumes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, RESUMES, fmt)


def _numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with a ``page_id`` that is unique by its place in the table; written, so that it stays the same."""
    return materialize(pages.select(F.monotonically_increasing_id().alias("page_id"), *pages.columns))


def read_html_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw HTML files below a folder as ``(page_id, url, html)``, one page per file; ``url`` is the file.

    Empty files give no page. Small files share a task up to ``spark.sql.files.maxPartitionBytes``.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return _numbered(files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))


#: First line of every record of a web archive.
ARCHIVE_RECORD = "WARC/1.0\r\n"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Response records of web archives (WARC 1.0) as ``(page_id, url, status, whole, html)``.

    Records are parted where a task finds their first line, so one large file is read by
    many tasks, split wherever ``spark.sql.files.maxPartitionBytes`` falls (a compressed one
    by a single task). A body that holds such a line itself, or a broken download, is shorter than
    its record says: ``whole`` is false then.
    """
    records = spark.read.option("lineSep", ARCHIVE_RECORD).text(path)

    def field(name: str):
        return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*<?([^\s>]*)", 1)

    end = F.lit("\r\n\r\n")
    at = F.instr("value", end)
    parted = records.filter(at > 0).select(
        F.substring(F.col("value"), F.lit(1), at - 1).alias("head"), F.substring(F.col("value"), at + 4, F.length("value")).alias("body")
    )
    found = parted.filter(F.lower(field("WARC-Type")) == "response").select(
        field("WARC-Target-URI").alias("url"),
        F.try_to_number(field("Content-Length"), F.lit("999999999999999999")).cast("bigint").alias("_size"),
        F.octet_length("body").alias("_found"),
        "body",
    )
    start = F.instr("body", end)
    html = F.regexp_replace(F.substring(F.col("body"), start + 4, F.length("body")), r"\r\n\r\n$", "")
    return _numbered(
        found.select(
            "url",
            F.try_to_number(F.regexp_extract("body", r"^HTTP/\S+ (\d{3})", 1), F.lit("999")).cast("int").alias("status"),
            (F.col("_found") >= F.col("_size")).alias("whole"),
            F.when(start > 0, html).otherwise("").alias("html"),
        )
    )


def write_listings(listings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Listings by board type; a board type is few values, so files stay large."""
    listings.write.mode(mode).partitionBy("ats").parquet(path)


def write_matches(matches: DataFrame, path: str, mode: str = "overwrite", by_board: bool = False) -> None:
    """Matches sorted by board so that a board's rows sit together.

    ``by_board`` makes one folder per board, for a modest number of boards.
    """
    if by_board:
        matches.write.mode(mode).partitionBy("board_id").parquet(path)
    else:
        matches.sortWithinPartitions("board_id", "resume_id", "rank").write.mode(mode).parquet(path)
