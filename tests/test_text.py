from pyspark.sql import functions as F

from rolecall.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    said = "Senior Python/Django dev. C# C++ node.js, ci/cd... Go; the TEAM loves développeur python/ (REST APIs)."
    got = one(spark, text.tokens(F.lit(said)))
    assert got == ["python/django", "dev", "c++", "node.js", "ci/cd", "loves", "veloppeur", "python/", "rest"]


def years(spark, resume, **options):
    return one(spark, text.years_of_experience(F.lit(resume), **options))


def test_years(spark):
    assert years(spark, "2018 - 2021\nJan 2020 – Present") == 3 + 5
    assert years(spark, "2019 to now, 2015-2012") == 6
    assert years(spark, "Jan 2019 – Mar 2022") == 0
    assert years(spark, "Jan 2019 – Mar 2022", allow_end_month=True) == 3
    assert years(spark, "2010 - 2012\n\n  Education\n2000 - 2004") == 2
    assert years(spark, "my education 2010 - 2012") == 2
    assert years(spark, "Education\n2000 - 2004") == 0
    assert years(spark, "2020 - current", current_year=2022) == 2
    assert years(spark, "2015 - 2016") == 1


def test_seniority(spark):
    m = lambda title, y: one(spark, text.seniority_multiplier(F.lit(title), F.lit(y)))
    assert m("Sr. Engineer", 2.0) == 0.4
    assert m("Vice  President", 2.9) == 0.4
    assert m("Senior Engineer", 3.0) == 1.0
    assert m("Leader", 0.0) == 1.0


def test_explanation(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w]) if w else F.array().cast("array<string>")
    say = lambda p, a, b, *shown: one(spark, text.explain(F.lit(p), a, b, *shown))
    assert say(75, words(), words()) == "Strong match (75%)."
    assert say(50, words("a"), words()) == "Moderate match (50%). Shared skills: a."
    assert say(49, words(*"abcdefghi"), words(*"uvwxyz"), 8, 5) == (
        "Weak match (49%). Shared skills: a, b, c, d, e, f, g, h. Gap areas: u, v, w, x, y."
    )
    assert say(10, words(), words(*"uvwxyz")) == "Weak match (10%). Gap areas: u, v, w, x, y, z."
