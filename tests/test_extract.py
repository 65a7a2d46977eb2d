import random
import time

from pyspark.sql import functions as F

from rolecall.operators import extract
from rolecall.sources import dom


def parsed(spark, *pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return dom.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))


def universal(spark, html, url="https://acme.com/careers"):
    rows = extract.universal(parsed(spark, (url, html))).orderBy("ord").collect()
    return [(r.title, r.location, r.job_url) for r in rows]


def test_cards_titles_locations(spark):
    html = """<html><body><nav><a href="/jobs/9">Nav job</a></nav><div class="list">
      <div class="card"><h3>Data Engineer</h3><span class="location">Core • Berlin • Full time</span>
        <a href="/jobs/1?src=x">Apply now</a></div>
      <div class="card"><a href="/jobs/2"><h2>ML Engineer</h2></a><p>Remote</p></div>
      <div class="card"><p>Platform Lead</p><p>London</p><a href="/jobs/3">Apply</a></div>
      <div class="card"><h3>Copy</h3><a href="/jobs/1">Apply</a></div>
      <div class="card"><h3>Other site</h3><a href="https://other.com/jobs/4">Apply</a></div>
    </div></body></html>"""
    assert universal(spark, html) == [
        ("Data Engineer", "Berlin", "https://acme.com/jobs/1"),
        ("ML Engineer", "", "https://acme.com/jobs/2"),
        ("Platform Lead", "London", "https://acme.com/jobs/3"),
    ]


def test_location_element_without_place_stops_the_search(spark):
    html = """<body><div><h3>A job</h3><i class="office">HQ</i><p>Remote</p><a href="/jobs/1">x</a></div>
      <div><h3>B job</h3><p>Remote</p><a href="/jobs/2">x</a></div></body>"""
    assert [r[1] for r in universal(spark, html)] == ["", "Remote"]


def test_untitled_first_link_loses_the_job(spark):
    html = """<body><section><a href="/jobs/1">Apply</a></section><section><a href="/jobs/1">Real title</a></section>
      <section><a href="/jobs/2">Second</a></section></body>"""
    assert [r[0] for r in universal(spark, html)] == ["Second"]


def test_biggest_group_wins_and_order_is_group_order(spark):
    html = """<body><ul><li><a href="/jobs/de/1">D1</a></li><li><a href="/jobs/us/1">U1</a></li>
      <li><a href="/jobs/us/2">U2</a></li><li><a href="/jobs/us/3">U3</a></li><li><a href="/jobs/de/2">D2</a></li>
      <li><a href="/careers/x/1">C1</a></li><li><a href="/careers/x/2">C2</a></li></ul></body>"""
    assert [r[0] for r in universal(spark, html)] == ["U1", "U2", "U3", "D1", "D2"]


def test_no_group_takes_every_job_link(spark):
    html = """<body><div><a href="/jobs/a/1">One</a></div><div><a href="/careers/b/2">Two</a></div></body>"""
    assert [r[0] for r in universal(spark, html)] == ["One", "Two"]
    assert universal(spark, "<p>nothing</p>") == []


def direct(spark, html, url="https://acme.com/careers"):
    rows = extract.direct_links(parsed(spark, (url, html))).orderBy("ord").collect()
    return [(r.ats, r.title, r.location, r.job_url) for r in rows]


GH = "https://boards.greenhouse.io/acme/jobs/"


def test_direct_links_with_children_and_headings(spark):
    html = f"""<body><h2>Teams</h2><div><h3>Remote jobs</h3><p>x</p></div>
      <a href="{GH}1"><span>Apply</span><span>Engineer</span><span>Paris office</span></a>
      <nav><a href="{GH}2"><div>Designer</div><i class="city">Rome</i></a></nav>
      <a href="{GH}3?x=1">Analyst → Apply</a><a href="{GH}3">Analyst again</a></body>"""
    assert direct(spark, html) == [
        ("greenhouse", "Engineer", "Paris office", GH + "1"),
        ("greenhouse", "Designer", "Rome", GH + "2"),
        ("greenhouse", "Analyst", "Remote jobs", GH + "3"),
    ]


def test_direct_links_need_three_and_uuid_fallback(spark):
    u = "/careers/0a1b2c3d-0000-1111-2222-33334444555"
    html = f"""<body><a href="{GH}1">A</a><a href="{GH}2">B</a>
      <a href="{u}1">One</a><a href="{u}2">Two</a><a href="{u}3">Three</a></body>"""
    assert direct(spark, html) == [
        ("generic", t, "", f"https://acme.com{u}{i}") for i, t in enumerate(["One", "Two", "Three"], 1)
    ]


def test_embedded_board(spark):
    html = '<iframe src="https://jobs.ashbyhq.com/acme/embed?version=2"></iframe>'
    row = spark.range(1).select(extract.embedded_board(F.lit(html)).alias("b")).first()
    assert (row.b.board_url, row.b.ats) == ("https://jobs.ashbyhq.com/acme", "ashby")


def plain_label(nodes, anchor):
    """The first heading of the outermost thing that ended before the link and holds the last heading that did."""
    heading = lambda n: n["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6")
    holds = lambda n: any(heading(m) and n["pre"] <= m["pre"] <= n["end"] for m in nodes)
    before = [n for n in nodes if n["end"] < anchor["pre"] and holds(n)]
    last = [n for n in before if heading(n)]
    if not last:
        return -1
    outer = next(n for n in before if n["pre"] <= last[-1]["pre"] <= n["end"])
    return next(n["pre"] for n in before if heading(n) and n["pre"] >= outer["pre"])


def test_labels_and_ranks_of_random_pages():
    rnd = random.Random(7)
    tags = ["div", "p", "h1", "h2", "h5", "section", "nav", "span", "li", "br"]
    for _ in range(150):
        html = []
        for _ in range(rnd.randint(5, 50)):
            tag = rnd.choice(tags)
            name = rnd.choice(["", ' class="job-location x"', ' id="geo"', ' class="title"'])
            html.append(rnd.choice([f"<{tag}{name}>", f"</{tag}>", "some text", '<a href="/jobs/1">a link</a>', f"<{tag}>short</{tag}>"]))
        nodes, _ = dom.tree("".join(html))
        counts = [0, 0, 0]
        for n in nodes:
            assert n["label"] == plain_label(nodes, n), html
            if n["noise"] == 0:
                counts[0] += n["tag"] in ("h1", "h2", "h3", "h4")
                counts[1] += "location" in n["classes"] or "geo" in n["id"]
                counts[2] += n["tag"] in ("span", "p", "div", "li") and 1 <= n["tlen"] <= 119
            assert [n["head_rank"], n["place_rank"], n["line_rank"]] == counts


def test_time_of_a_page_grows_with_its_links(spark):
    """Eight times the links take at most about that much more time."""

    def seconds(n):
        html = "".join(f'<h3>Team {i}</h3><p><a href="https://boards.greenhouse.io/x/jobs/{i}"><span>Job {i}</span></a></p>' for i in range(n))
        pages = parsed(spark, ("https://acme.com/careers", html)).persist()
        pages.count()
        started = time.time()
        found = extract.direct_links(pages).collect()
        assert len(found) == n
        return time.time() - started

    seconds(100)
    assert seconds(4000) < 12 * max(seconds(500), 0.5)


def test_long_titles_by_argument(spark):
    long = "A title " * 20
    html = f'<div><h3>{long}</h3><a href="/jobs/1">x</a></div><div><h3>Short one</h3><a href="/jobs/2">x</a></div>'
    pages = parsed(spark, ("https://acme.com/careers", html))
    titles = lambda **limit: {r.title for r in extract.universal(pages, **limit).collect()}
    assert long.strip() not in titles() and titles(max_title=None) == {long.strip(), "Short one"}
