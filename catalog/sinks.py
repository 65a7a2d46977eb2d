"""Sources and sinks: tables written by the library and read back with declared schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rolecall.operators import skew
from rolecall.plans import boards as plan
from rolecall.sources import tables

from . import plans, urls
from .plans import SITES_SQL
from .registry import query, table
from .urls import WITH


def _folder(spark) -> str:
    return f"{skew.scratch_dir(spark)}/{spark.sparkContext.applicationId}/sink-{uuid.uuid4().hex}"


@query("stored_requests", WITH + " SELECT request_id, url FROM requests")
def stored_requests(spark, sf):
    """Requests through JSON and the declared schema."""
    path = _folder(spark)
    urls.requests(spark, sf).write.json(path)
    return tables.read_requests(spark, path, "json").select("request_id", "url")


@query("listing_sink", f"WITH {SITES_SQL} SELECT board_id, ats, ord, title, location, url FROM found")
def listing_sink(spark, sf):
    """Listings written by board type and read back."""
    path = _folder(spark)
    found, _ = plan.listings(plans.careers(spark, sf), plans.snapshots(spark, sf))
    tables.write_listings(found, path)
    return spark.read.parquet(path).select("board_id", "ats", "ord", "title", "location", "url")


@query(
    "match_sink",
    plans.END_MATCH
    + """ SELECT l.resume_id, l.board_id, l.ord, f.ats, f.board_id AS source_url, f.title, f.url, l.score_pct
          FROM listed l JOIN found f USING (board_id, ord)""",
)
def match_sink(spark, sf):
    """Matches with their nested listing, written and read back."""
    path = _folder(spark)
    tables.write_matches(plans._whole_way(spark, sf), path)
    return spark.read.parquet(path).select(
        "resume_id", "board_id", "ord", "ats", "source_url", "job.title", "job.url", "score_pct"
    )



@query("archived_pages", "SELECT url, 200 AS status, true AS whole, md5(html) AS html FROM pages")
def archived_pages(spark, sf):
    """Pages written as a web archive and read back by splits."""
    path = _folder(spark)
    payload = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), "html")
    head = F.concat(
        F.lit(tables.ARCHIVE_RECORD + "WARC-Type: response\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    # The writer adds the second line end after a record.
    records = table(spark, sf, "pages").select(F.concat(head, payload, F.lit("\r\n")))
    records.write.option("lineSep", "\r\n").text(path)
    return tables.read_archives(spark, path).select("url", "status", "whole", F.md5("html").alias("html"))


@query("html_files", "SELECT page_id, md5(html || chr(10)) AS html FROM pages")
def html_files(spark, sf):
    """Pages written as a file each into one folder and read back.

    A task numbers its files as it meets its rows, so a page is known by its place in the written table.
    """
    path = _folder(spark)
    pages = skew.materialize(table(spark, sf, "pages").select("page_id", "html"))
    commit = "mapreduce.fileoutputcommitter.algorithm.version"  # 2: tasks move their files, not the driver
    pages.select("html").write.option("maxRecordsPerFile", 1).option(commit, 2).text(path)
    part, nth = (F.regexp_extract("url", r"part-(\d+)-[^/]*-c(\d+)", i).cast("long") for i in (1, 2))
    found = tables.read_html_files(spark, path, "*.txt").select((F.shiftleft(part, 33) + nth).alias("place"), "html")
    placed = pages.select("page_id", "html").select("page_id", F.monotonically_increasing_id().alias("place"))
    return found.join(skew.materialize(placed), "place").select("page_id", F.md5("html").alias("html"))
