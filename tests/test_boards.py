"""Board readers on generated pages.

Class names, attributes and hosts are those that the readers look for and have to
match; everything else is made up here: each board is written by a small function
from (number, title, place), with cards that must be left out in between.
"""

import time

import pytest
from pyspark.sql import functions as F

from rolecall.operators import boards
from rolecall.sources import dom

TRADES = ["Quarry Blaster", "Lens Grinder", "Tide Observer", "Seed Archivist", "Bell Tuner", "Kiln Keeper"]
TOWNS = ["Ghent", "Porvoo", "Sibiu", "Kotor", "Ayr", "Nyon"]
JOBS = [(i, trade, town) for i, (trade, town) in enumerate(zip(TRADES, TOWNS, strict=True), 40)]


def rows_of_tables(n, title, place):
    return f'<tbody><tr data-n="{n}" class="x job-post"><td><div><a rel=n href="/team/jobs/{n}?lang=nl"><p>{title}</p><em>new</em><p>{place}</p></a></div></td></tr>'


def openings(n, title, place):
    return f'<section class="deep level-0"><h4>Dept {n}</h4><div class="opening"><p><a href="/team/jobs/{n}">{title}</a></p><p class="location">{place}</p></div></section>'


def postings(n, title, place):
    return f'<article><div class="first posting"><div><a class="posting-title big" href="https://jobs.lever.co/kiln/{n}"><h5>{title}</h5><i>Apply</i></a></div><b class="location">{place}</b></div></article>'


def briefs(n, title, place):
    """Odd jobs are linked around the card, even ones inside; two parts or three in the details."""
    details = f'<ul class="ashby-job-posting-brief-details"><li>Crew {n} • {place}' + (" • Shifts" if n % 3 else "") + "</li></ul>"
    card = f'<div class="ashby-job-posting-brief wide"><p class="ashby-job-posting-brief-title">{title}</p>{details}'
    return f'<a href="kiln/{n}"><span>{card}</div></span></a>' if n % 2 else f'{card}<a href="kiln/{n}">more</a></div>'


def job_titles(n, title, place):
    """Lists of items, or boxes outside of any list."""
    where = f'<dl data-automation-id="workerSubType">{place}</dl>' if n % 2 else f'<em><span class="the-location">{place}</span></em>'
    box = "li" if n % 3 else "div"
    return f'<{box}><p><a href="job/{n}" data-automation-id="jobTitle">{title}</a></p>{where}</{box}>'


def results(n, title, place):
    return f'<article class="z article--result"><div class="article__header__text__title"><a href="Role/{n}">{title}</a></div><em class="list-item-location">{place}</em></article>'


def tiles(n, title, place):
    return f'<section><div class="job-tile"><p class="x job-tile__title">{title}</p><a href="/site/job/{n}">see</a><ul><li class="job-list-item__job-info-item">Full</li><li class="job-list-item__job-info-item"><p aria-label="Locations">{place}</p></li></ul></div></section>'


def ibm_cards(n, title, place):
    return f'<article class="w article--card"><div><h3 class="article__header__text__title"><a href="https://careers.ibm.com/role/{n}" class="a link">{title}</a></h3></div><span class="card-item-location">{place}</span></article>'


def position_rows(n, title, place):
    return f'<ol><li class="open-position"><div>{n}</div><a href="../apply/{n}"><b>{title}</b></a><div class="city-of-work">{place}</div></li></ol>'


# name: page url, card writer, markup that is no listing, expected url of a job
BOARDS = {
    "greenhouse": ("https://boards.greenhouse.io/kiln", rows_of_tables, '<tr class="job-post"><td>no link</td></tr>', "https://job-boards.greenhouse.io/team/jobs/{n}?lang=nl"),
    "greenhouse/openings": ("https://boards.greenhouse.io/kiln", openings, '<div class="opening"><a href="/out">outside a section</a></div>', "https://boards.greenhouse.io/team/jobs/{n}"),
    "lever": ("https://jobs.lever.co/kiln", postings, '<div class="posting"><a class="posting-title"><h5>No href</h5></a></div>', "https://jobs.lever.co/kiln/{n}"),
    "ashby": ("https://jobs.ashbyhq.com/", briefs, '<div class="ashby-job-posting-brief"><a href="x">No title</a></div>', "https://jobs.ashbyhq.com/kiln/{n}"),
    "workday": ("https://kiln.myworkdayjobs.com/en/", job_titles, '<li class="menu"><a href="m">Menu</a></li>', "https://kiln.myworkdayjobs.com/en/job/{n}"),
    "avature": ("https://kiln.avature.net/jobs/", results, '<article class="article--result"><a href="q">Not in a title</a></article>', "https://kiln.avature.net/jobs/Role/{n}"),
    "oracle_hcm": ("https://kiln.fa.oraclecloud.com/ui/", tiles, '<div class="job-tile"><a href="/job/0">No title</a></div>', "https://kiln.fa.oraclecloud.com/site/job/{n}"),
    "ibm": ("https://careers.ibm.com/en", ibm_cards, '<article class="article--card"><a class="link" href="/z">No heading</a></article>', "https://careers.ibm.com/role/{n}"),
    "generic": ("https://kiln.example/work/now", position_rows, '<li class="open-position">No link</li><nav><li class="job"><a href="/m">Menu</a></li></nav>', "https://kiln.example/apply/{n}"),
}
TEXT = "Carries " + "stones and " * 500 + "sand."
# Pages of one job: title, place and a text of more than any usual cut.
DETAILS = {
    "greenhouse": '<main id="header"><h1 class="app-title">{t}</h1><p class="location">{p}</p></main><section id="content"><div id="app_body"><p>{d}</p></div></section>',
    "lever": '<div class="posting-headline"><span><h2>{t}</h2></span></div><div class="posting-categories"><u class="location">{p}</u></div><div class="content"><ul><li>{d}</li></ul></div>',
    "ashby": '<h1>{t}</h1><p class="ashby-job-posting-brief-details">Crew • {p} • Day</p><article><p>{d}</p></article>',
    "workday": '<h1>{t}</h1><dd data-automation-id="locations">{p}</dd><div class="the-job-description"><p>{d}</p></div>',
    "avature": '<h1 class="title">{t}</h1><i class="job-location">{p}</i><main><p>{d}</p></main>',
    "oracle_hcm": '<h1 class="x-job-title">{t}</h1><i class="x-location">{p}</i><div class="job-description"><p>{d}</p></div>',
    "generic": "<h2>{t}</h2><article><i>{d}</i></article>",
}


def read(spark, pages, **options):
    rows = [(i, url, name.split("/")[0], f"<html><body>{html}</body></html>") for i, (name, url, html) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, ats string, html string")
    found = boards.by_rules(dom.parse(frame, ("page_id", "url", "ats")), **options).collect()
    out = {name: [] for name, _, _ in pages}
    for r in sorted(found, key=lambda r: (r.page_id, r.ord)):
        out[pages[r.page_id][0]].append((r.title, r.description, r.location, r.job_url))
    return out


@pytest.fixture(scope="module")
def listed(spark):
    pages = [(name, url, "".join(write(*job) + trap for job in JOBS)) for name, (url, write, trap, _) in BOARDS.items()]
    return read(spark, pages)


@pytest.mark.parametrize("name", BOARDS)
def test_cards_in_order_without_traps(listed, name):
    assert listed[name] == [(t, "", p, BOARDS[name][3].format(n=n)) for n, t, p in JOBS]


def test_pages_of_one_job_have_their_whole_text(spark):
    pages = [(name, BOARDS[name][0], html.format(t="Reed Cutter", p="Ronda", d=TEXT)) for name, html in DETAILS.items()]
    whole, cut = read(spark, pages), read(spark, pages, max_chars=2000)
    for name, url, _ in pages:
        place = "" if name == "generic" else "Ronda"
        assert whole[name] == [("Reed Cutter", TEXT, place, url)], name
        assert cut[name] == [("Reed Cutter", TEXT[:2000], place, url)], name


@pytest.mark.parametrize("name", ["ashby", "workday"])
def test_work_grows_with_the_cards(spark, name):
    """Eight times the cards may take about eight times as long, far from sixty-four."""
    url, write, _, _ = BOARDS[name]
    seconds = []
    for n in (250, 250, 2000):
        html = "<html>" + "".join(write(i, f"Job {i}", "Here") for i in range(n)) + "</html>"
        frame = spark.createDataFrame([(1, url, name, html)], "page_id long, url string, ats string, html string")
        parsed = dom.parse(frame, ("page_id", "url", "ats")).cache()
        parsed.count()
        began = time.time()
        assert boards.by_rules(parsed, [name]).agg(F.count("*")).first()[0] == n
        seconds.append(time.time() - began)
        parsed.unpersist()
    assert seconds[2] < 2 + 24 * seconds[1]
