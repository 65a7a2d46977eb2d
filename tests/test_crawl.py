import datetime

from rolecall import rules
from rolecall.operators import discover, enrich, skew
from rolecall.plans import boards as plan
from rolecall.sources import dom, tables
from rolecall.streaming import stream


def test_spread_lookup_with_a_hot_key(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)], "k STRING, i LONG")
    right = spark.createDataFrame([("hot", 1), ("k0", 2)], "k STRING, v INT")
    inner = {(r.k, r.i): r.v for r in skew.spread_lookup(left, right, ["k"], ["i"]).collect()}
    assert len(inner) == 61 and inner["k0", 0] == 2
    assert skew.spread_lookup(left, right, ["k"], ["i"], "left").count() == 90


def attempt(command, n, chars, ai=False, spa=False, generic=False, browser=False, wants=False, url="u"):
    return (url, generic, browser, wants, command, n, ai, chars, spa)


def kept(spark, *rows):
    schema = (
        "url STRING, generic BOOLEAN, browser BOOLEAN, wants_ai BOOLEAN, command STRING, attempt INT, "
        "ai_targeted BOOLEAN, chars LONG, spa BOOLEAN"
    )
    got = discover.choose_snapshot(spark.createDataFrame(list(rows), schema)).collect()
    return [(r.command, r.attempt, r.ai_targeted) for r in got]


def test_choose_snapshot(spark):
    g = dict(generic=True)
    assert kept(spark, attempt("get", 1, 1999), attempt("get", 2, 2000), attempt("fetch", 1, 9000)) == [("get", 2, False)]
    assert kept(spark, attempt("get", 1, 9000, browser=True), attempt("fetch", 1, 2000, browser=True)) == [("fetch", 1, False)]
    # Unknown sites: a browser page between the limits is passed over in the end.
    assert kept(spark, attempt("get", 1, 2999, **g), attempt("fetch", 1, 2500, **g), attempt("stealthy-fetch", 1, 3000, **g)) == [
        ("stealthy-fetch", 1, False)
    ]
    assert kept(spark, attempt("get", 1, 5000, spa=True, **g), attempt("fetch", 1, 2500, **g), attempt("fetch", 2, 3500, **g)) == [
        ("fetch", 2, False)
    ]
    assert kept(spark, attempt("get", 1, 5000, spa=True, **g), attempt("fetch", 1, 2500, **g)) == [("get", 1, False)]
    w = dict(wants=True)
    assert kept(spark, attempt("get", 1, 10, ai=True, **w), attempt("fetch", 1, 2100, **w)) == [("fetch", 1, False)]
    assert kept(spark, attempt("get", 1, 10)) == []


def test_page_prefix_and_scroll(spark):
    pages = [("a", 1, 200, True), ("a", 2, 200, True), ("a", 4, 200, True), ("b", 1, 200, False), ("b", 2, 200, True),
             ("c", 1, 200, True), ("c", 2, 500, True), ("d", 2, 200, True)]
    pages += [("e", i, 200, True) for i in range(1, 130)]
    df = spark.createDataFrame(pages, "board_id STRING, page INT, status INT, has_next BOOLEAN")
    got = {}
    for r in discover.page_prefix(df).collect():
        got[r.board_id] = max(got.get(r.board_id, 0), r.page)
    assert got == {"a": 2, "b": 1, "c": 1, "e": 129}
    assert max(r.page for r in discover.page_prefix(df, rules.MAX_PAGES).collect()) == rules.MAX_PAGES
    rounds = [("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("a", 4, 12), ("b", 1, 0), ("c", 1, 3), ("c", 2, 4)]
    stops = discover.scroll_stop(spark.createDataFrame(rounds, "url STRING, round INT, tiles LONG")).collect()
    assert {(r.url, r.stop_round, r.tiles) for r in stops} == {("a", 3, 9), ("b", 1, 0), ("c", 2, 4)}
    long = spark.createDataFrame([("u", i, min(i, 45)) for i in range(1, 60)], "url STRING, round INT, tiles LONG")
    assert discover.scroll_stop(long).first().stop_round == 46
    assert discover.scroll_stop(long, rules.MAX_SCROLL_ROUNDS).first().stop_round == rules.MAX_SCROLL_ROUNDS


def test_several_snapshots_are_one_page(spark):
    """Two homepages of a site, two snapshots of a board, and a text per board type."""
    link = lambda href: f'<p><a href="{href}">Careers</a></p>'
    homes = [(1, "https://x.org", link("/careers-here")), (2, "https://x.org", link("/careers"))]
    home = dom.parse(spark.createDataFrame(homes, "page_id LONG, base STRING, html STRING"), ("page_id", "base"))
    asked = spark.createDataFrame([(1, "x.org")], tables.REQUESTS)
    none = spark.createDataFrame([], "candidate STRING, status INT, final_url STRING")
    got = discover.careers_urls(asked, none, home).collect()
    assert [(r.careers_url, r.via) for r in got] == [("https://x.org/careers", "link")]

    html = "".join(f'<div class="posting"><a class="posting-title" href="/j/{i}"><h5>Job {i}</h5></a></div>' for i in range(2))
    shots = [(i, "https://jobs.lever.co/c", "board", html) for i in (5, 6)]
    snapshots = spark.createDataFrame(shots, "page_id LONG, url STRING, stage STRING, html STRING")
    careers = spark.createDataFrame([("https://jobs.lever.co/c", "lever")], "careers_url STRING, ats STRING")
    found, _ = plan.listings(careers, snapshots, "by_ats")
    assert sorted((r.board_id, r.ord) for r in found.collect()) == [("https://jobs.lever.co/c", 1), ("https://jobs.lever.co/c", 2)]

    jobs = [("b", 0, "A", "", "", "u", "lever"), ("c", 0, "A", "", "", "u", "ibm")]
    listed = spark.createDataFrame(jobs, tables.LISTINGS + ", ats STRING")
    details = spark.createDataFrame([("u", "lever", "of lever"), ("u", "ibm", "an ibm text")], "url STRING, ats STRING, detail STRING")
    assert {r.board_id: r.description for r in enrich.descriptions(listed, details).collect()} == {"b": "of lever", "c": "an ibm text"}


def test_odd_declarations_hide_nothing():
    nodes, _ = dom.tree('<a href="1">x</a><![weird stuff]><![if IE]><a href="2">y</a><![endif]><![CDATA[z]]><a href="3">w</a>')
    assert [n["href"] for n in nodes if n["tag"] == "a"] == ["1", "2", "3"]


def test_descriptions_by_url(spark):
    long = "x" * 120
    rows = [("b", 0, "A", "", "", "u1"), ("b", 1, "B", long, "", "u1"), ("b", 2, "C", "", "", "u1"), ("b", 3, "D", long, "", "u2"),
            ("b", 4, "E", long + "!", "", "u2"), ("c", 0, "F", long, "", "u3"), ("c", 1, "G", long, "", "u3")]
    df = spark.createDataFrame(rows, tables.LISTINGS)
    details = spark.createDataFrame([("u1", "text")], "url STRING, detail STRING")
    got = [(r.board_id, r.ord, r.title, r.description) for r in enrich.descriptions(df, details).orderBy("board_id", "ord").collect()]
    assert got == [("b", 0, "C", "text"), ("b", 1, "C", "text"), ("b", 2, "C", "text"), ("b", 3, "E", long + "!"),
                   ("b", 4, "E", long + "!"), ("c", 0, "F", long), ("c", 1, "G", long)]


def test_tree_rules():
    nodes, texts = dom.tree('<p>a<p>b</i>c<br>d<img/><script>"</p>"</script>e</p>&lt;x&gt; &copy; &nosuch;<!-- c -->')
    assert [n["tag"] for n in nodes] == ["[document]", "p", "p", "br", "img", "script"]
    assert nodes[2]["parent"] == 1 and nodes[2]["end"] == 5
    assert [(t["s"], t["kind"]) for t in texts] == [
        ("a", 0), ("b", 0), ("c", 0), ("d", 0), ('"</p>"', 2), ("e", 0), ("<x> © &nosuch", 0), ("c", 1),
    ]


CARD = '<div><h3>Job {k}</h3><p>Berlin</p><a href="/jobs/{k}">Apply</a></div>'


def test_scrape_and_sinks(spark, tmp_path):
    requests = spark.createDataFrame([(1, "acme.com"), (2, "https:///x"), (3, "https://void.com/jobs"), (4, "acme.com")], tables.REQUESTS)
    probes = spark.createDataFrame([("https://acme.com/careers", 404, "x"), ("https://acme.com/jobs", 200, "https://acme.com/jobs/all")],
                                   "candidate STRING, status INT, final_url STRING")
    homes = dom.parse(spark.createDataFrame([], "page_id LONG, base STRING, html STRING"), ("page_id", "base"))
    html = CARD.format(k=1) + CARD.format(k=2)
    shots = spark.createDataFrame(
        [(1, "https://acme.com/jobs/all", "raw", "<p>wait</p>"), (2, "https://acme.com/jobs/all", "rendered", html),
         (3, "https://void.com/jobs", "raw", ""), (4, "https://void.com/jobs", "rendered", "")],
        "page_id LONG, url STRING, stage STRING, html STRING")
    careers, found, errors = plan.scrape(requests, probes, homes, shots)
    assert {(r.request_id, r.careers_url, r.via) for r in careers.collect()} == {
        (1, "https://acme.com/jobs/all", "probe"), (3, "https://void.com/jobs", "input"), (4, "https://acme.com/jobs/all", "probe")}
    assert [(r.title, r.location, r.url) for r in found.orderBy("ord").collect()] == [
        ("Job 1", "Berlin", "https://acme.com/jobs/1"), ("Job 2", "Berlin", "https://acme.com/jobs/2")]
    assert {(r.request_id, r.stage) for r in errors.collect()} == {(2, "discover"), (3, "extract")}
    tables.write_listings(found, str(tmp_path / "listings"))
    assert spark.read.parquet(str(tmp_path / "listings")).filter("ats = 'generic'").count() == 2


def test_streams_survive_a_restart(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    html = CARD.format(k=1) + CARD.format(k=2)
    folder = str(tmp_path)

    def crawl(page_id, minutes, mode):
        row = (page_id, "https://acme.com/jobs", html, "acme", at + datetime.timedelta(minutes=minutes))
        spark.createDataFrame([row], stream.CRAWLED).write.mode(mode).parquet(f"{folder}/pages")

    def run():
        stream.extract_stream(spark, f"{folder}/pages", f"{folder}/found", f"{folder}/c1").awaitTermination()
        stream.dedup_stream(spark, f"{folder}/found", f"{folder}/out", f"{folder}/c2").awaitTermination()
        return spark.read.parquet(f"{folder}/out").count()

    crawl(1, 0, "overwrite")
    assert run() == 2
    crawl(2, 5, "append")
    assert run() == 2


def test_boards_by_type_and_match_sink(spark, tmp_path):
    careers = spark.createDataFrame([("https://jobs.lever.co/acme", "lever")], "careers_url STRING, ats STRING")
    html = '<div class="posting"><a class="posting-title" href="/acme/1"><h5>Potter</h5></a><i class="location">Delft</i></div>'
    shots = spark.createDataFrame(
        [(1, "https://jobs.lever.co/acme", "board", html)], "page_id LONG, url STRING, stage STRING, html STRING"
    )
    found, errors = plan.listings(careers, shots, mode="by_ats")
    assert [(r.ats, r.title, r.location, r.url) for r in found.collect()] == [("lever", "Potter", "Delft", "/acme/1")]
    assert errors.count() == 0
    people = spark.createDataFrame([(1, 9, "potter clay wheel")], "request_id LONG, resume_id LONG, resume_text STRING")
    asked = spark.createDataFrame([(1, "https://jobs.lever.co/acme")], "request_id LONG, careers_url STRING")
    page = "<main>" + "Throwing clay on a wheel, glazing and firing. " * 5 + "</main>"
    details = spark.createDataFrame([(1, "/acme/1", page)], "page_id LONG, url STRING, html STRING")
    matches = plan.match_requests(asked, found, details, people)
    tables.write_matches(matches, str(tmp_path / "m"))
    tables.write_matches(matches, str(tmp_path / "b"), by_board=True)
    row = spark.read.parquet(str(tmp_path / "m")).first()
    assert row.rank == 1 and {"clay", "wheel"} <= set(row.matched_keywords)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_runs_of_blank_comments_are_one_step():
    seen = []

    class Watched(dom._Tree):
        def handle_comment(self, data):
            seen.append(data)
            super().handle_comment(data)

    page = Watched()
    page.feed("<p>a<!-- -->b" + "<!---->" * 1500 + "<!--\n-->c<!-- d --><!-- --></p><script>e<!-- --><!-- -->f</script>g<!-- ")
    page.close()
    page.finish()
    pieces = list(zip(page.texts["s"], page.texts["kind"], strict=True))
    assert seen == [" d "]
    assert pieces[:5] == [("a", dom.PLAIN), ("b", dom.PLAIN), ("c", dom.PLAIN), ("d", dom.COMMENT), ("e<!-- --><!-- -->f", dom.RAW)]
    assert pieces[5][0].startswith("g")


def test_chosen_pages_move_once_and_are_not_written(spark, monkeypatch):
    """Of F23: pages of attempts were written, then parsed in as few tasks as their bytes fill."""
    card = "<article><h3>Engineer {0}</h3><a href='/jobs/{0}'>Apply</a></article>"
    good = "".join(card.format(i) for i in range(4)) + "<!-- -->" * 400
    rows = [(i * 3 + n, f"https://jobs.lever.co/c{i}", command, n, html if i % 5 else "<p>x</p>")
            for i in range(20) for n, (command, html) in enumerate(
                [("get", "<p>wait</p>"), ("fetch", good), ("stealthy-fetch", good.replace("Engineer", "Wrong"))])]
    # A page_id that comes twice is two rows, and a page without one is none.
    rows += [rows[4], (None, "https://jobs.lever.co/none", "fetch", 1, good)]
    attempts = spark.createDataFrame(rows, "page_id LONG, url STRING, command STRING, attempt INT, html STRING").selectExpr(
        "page_id", "url", "'board' AS stage", "false AS generic", "false AS browser", "false AS wants_ai", "command", "attempt",
        "false AS ai_targeted", "html",
    )
    written = []
    write = skew.materialize
    monkeypatch.setattr(skew, "materialize", lambda df, *a, **k: written.append(df.columns) or write(df, *a, **k))
    snapshots, _ = discover.chosen_snapshots(attempts)
    assert sorted(r.page_id for r in snapshots.collect()) == sorted([i * 3 + 1 for i in range(20) if i % 5] + [4])
    assert snapshots.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    asked = spark.createDataFrame([(i, f"https://jobs.lever.co/c{i}") for i in range(20)], "request_id LONG, url STRING")
    none = spark.createDataFrame([], "candidate STRING, status INT, final_url STRING")
    home = dom.parse(spark.createDataFrame([], "page_id LONG, base STRING, html STRING"), ("page_id", "base"))
    _, found, errors = plan.scrape(asked, none, home, attempts=attempts)
    assert written and not any("html" in columns for columns in written)
    assert {(r.board_id, r.title) for r in found.collect()} == {
        (f"https://jobs.lever.co/c{i}", f"Engineer {k}") for i in range(20) if i % 5 for k in range(4)
    }
    assert {(r.request_id, r.stage) for r in errors.collect()} == {(i, "fetch") for i in range(0, 20, 5)}
