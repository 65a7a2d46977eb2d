"""Raw pages: folders of files and web archives."""

import hashlib

from catalog import sinks
from rolecall.operators import skew
from rolecall.sources import tables


def record(kind, url, body, size=None):
    payload = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{body}"
    size = len(payload.encode()) if size is None else size
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: <{url}>\r\nContent-Length: {size}\r\n\r\n"
    return head + payload + "\r\n\r\n"


def test_an_archive_far_above_the_split_size(spark, tmp_path):
    pages = {f"https://a.org/{i}": f"<p>é {i}</p>\n" * (i % 700) for i in range(400)}
    text = record("warcinfo", "", "x") + "".join(record("response", u, h) + record("request", u, "") for u, h in pages.items())
    text += record("response", "https://a.org/cut", "short", 10_000)
    (tmp_path / "a.warc").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert spark.read.option("lineSep", tables.ARCHIVE_RECORD).text(str(tmp_path / "a.warc")).rdd.getNumPartitions() > 20
        rows = tables.read_archives(spark, str(tmp_path / "a.warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.url: r.html for r in rows if r.whole} == pages and [r.url for r in rows if not r.whole] == ["https://a.org/cut"]
    assert len({r.page_id for r in rows}) == len(rows) == 401 and {r.status for r in rows} == {200}


def test_a_folder_of_html_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    wanted = {}
    for i in range(20):
        path = tmp_path / ("deep" if i % 2 else ".") / f"{i}.html"
        path.write_text(f"<p>{i}</p>\n<p>two lines</p>")
        wanted[path.name] = hashlib.md5(path.read_bytes()).hexdigest()
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "empty.html").write_text("")
    rows = tables.read_html_files(spark, str(tmp_path), "*.html").collect()
    assert {r.url.rsplit("/", 1)[1]: hashlib.md5(r.html.encode()).hexdigest() for r in rows} == wanted
    assert len({r.page_id for r in rows}) == 20


def test_written_tables_can_be_dropped(spark, tmp_path):
    folder = str(tmp_path / "held")
    assert skew.materialize(spark.range(3), folder).count() == 3
    skew.drop_folder(spark, folder)
    assert not (tmp_path / "held").exists()


def test_pages_as_files_lie_in_one_folder(spark, tmp_path, monkeypatch):
    rows = [(i * 7, f"<p>{i}</p>\nline {i}") for i in range(40)] + [(3, ""), (3, "")]
    spark.createDataFrame(rows, "page_id long, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(sinks, "_folder", lambda spark: f"{tmp_path}/files")
    found = sinks.html_files(spark, str(tmp_path)).collect()
    assert sorted(found) == sorted((k, hashlib.md5(f"{h}\n".encode()).hexdigest()) for k, h in rows)
    assert not [x for x in (tmp_path / "files").iterdir() if x.is_dir()]
