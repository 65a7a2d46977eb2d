import pytest
from pyspark.sql import functions as F

from rolecall.functions import urls


def evaluate(spark, build, *rows):
    width = len(rows[0])
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, " + ", ".join(f"{n} STRING" for n in names))
    return [r[0] for r in df.orderBy("i").select(build(*[F.col(n) for n in names])).collect()]


def test_detect_ats(spark):
    cases = {
        "https://boards.greenhouse.io/acme/jobs/123": "greenhouse",
        "https://jobs.lever.co/acme/abc-123": "lever",
        "https://acme.ashbyhq.com/jobs": "ashby",
        "https://acme.myworkdayjobs.com/careers": "workday",
        "https://careers.randomco.com/openings": "generic",
        "https://ACME.fa.OracleCloud.com/x/hcmUI/y": "oracle_hcm",
        "https://careers.ibm.com/greenhouse.io": "greenhouse",
    }
    assert evaluate(spark, urls.detect_ats, *[(u,) for u in cases]) == list(cases.values())


def test_resolve(spark):
    base = "https://a.com/x/y/z?q=1"
    cases = {
        "http://b.com/k": "http://b.com/k",
        "//b.com/k?x#y": "https://b.com/k?x#y",
        "/k": "https://a.com/k",
        "k": "https://a.com/x/y/k",
        "../k": "https://a.com/x/k",
        "./k": "https://a.com/x/y/k",
        "..": "https://a.com/x/",
        ".": "https://a.com/x/y/",
        "../../../k": "https://a.com/k",
        "a//b/": "https://a.com/x/y/a/b/",
        "?p=2": "https://a.com/x/y/z?p=2",
        "#f": "https://a.com/x/y/z?q=1#f",
        "": base,
        "mailto:x@a.com": "mailto:x@a.com",
        "https:k": "https:k",
    }
    got = evaluate(spark, urls.resolve, *[(base, href) for href in cases])
    assert got == list(cases.values())
    assert evaluate(spark, urls.resolve, ("https://a.com", "k")) == ["https://a.com/k"]


def test_resolve_is_lenient(spark):
    assert evaluate(spark, urls.resolve, ("https://a.com/", "a b|c"), ("https://a.com/", "javascript:void(0)")) == [
        "https://a.com/a b|c",
        "javascript:void(0)",
    ]


@pytest.mark.parametrize(
    "href,pattern",
    [
        ("/jobs", "/"),
        ("/acme/jobs", "/acme"),
        ("/acme/jobs/1", "/acme/jobs"),
        ("/careers/JobDetail/Slug/9", "/careers/JobDetail"),
        ("https://a.com/jobs/1?x", "https://a.com/jobs"),
        ("HTTPS://a.com/1", "https://a.com/"),
        ("?x=1", "?x=1"),
        ("https://a.com", "https://a.com"),
    ],
)
def test_base_pattern(spark, href, pattern):
    assert evaluate(spark, urls.base_pattern, (href,)) == [pattern]


def test_job_urls(spark):
    cases = {
        ("/jobs/1", "a.com"): True,
        ("https://a.com/jobs/1", "a.com"): True,
        ("https://b.com/jobs/1", "a.com"): False,
        ("/x-12345", "a.com"): True,
        ("/x-1234", "a.com"): False,
        ("/p_0a1b2c3d-0000-1111-2222-333344445555", "a.com"): True,
    }
    assert evaluate(spark, urls.is_job_url, *cases) == list(cases.values())


def test_small_rules(spark):
    assert evaluate(spark, urls.normalize_url, (" a.com ",), ("//a.com",), ("ftp://a",), ("\ta.com\n",)) == [
        "https://a.com",
        "https://a.com",
        "ftp://a",
        "https://a.com",
    ]
    assert evaluate(spark, urls.base_url, ("https:///x",), ("https://a.com/x",)) == [None, "https://a.com"]
    assert evaluate(spark, urls.canonical, ("https://a.com/j//?x=1/",)) == ["https://a.com/j"]
    assert evaluate(spark, urls.is_careers_url, ("https://a.com/Careers",), ("https://a.com?x=/jobs",)) == [True, False]
