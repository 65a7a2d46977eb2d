"""Tokens, term counts, years of experience and seniority as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable.

    An expression used inside a lambda is evaluated again for every element;
    binding it first evaluates it once per row.
    """
    return F.get(F.transform(F.array(value), body), 0)


# A token is a letter followed by token characters; dots at its end are
# sentence ends and tokens shorter than three characters carry no signal, so
# the pattern asks for three characters of which the last is not a dot.
_TOKEN = r"[a-z][a-z0-9+#./-]+[a-z0-9+#/-]"
NO_SIGNAL = sorted(set(rules.STOP_WORDS) | set(rules.JOB_AD_WORDS))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens without stop words and words found in every job advert."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(NO_SIGNAL))


def counted(words: Column) -> Column:
    """``array<struct<term, n>>``: how often each word stands in an array, in order of the words; runs of the sorted array."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(
            starts,
            lambda at: F.transform(
                at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("n"))
            ),
        )

    none = F.array().cast("array<struct<term: string, n: bigint>>")
    return F.when(F.size(words) > 0, let(F.sort_array(words), runs)).otherwise(none)


def years_of_experience(
    resume: Column, current_year: int = rules.CURRENT_YEAR, allow_end_month: bool = False
) -> Column:
    """Years covered by explicit ranges ahead of the education section.

    Overlapping ranges count twice and, unless ``allow_end_month``, a range
    whose end year follows a month name counts nothing.
    """
    month = rf"(?:(?:{rules.MONTHS})[a-z]*\.?\s+)?"
    ends = "|".join(rules.OPEN_END_WORDS)
    span = (
        rf"(?iU){month}((?:19|20)[0-9]{{2}})\s*[-–—to]+\s*"
        rf"{month if allow_end_month else ''}((?:19|20)[0-9]{{2}}|{ends})"
    )
    work = F.split(resume, "(?imdU)" + rules.EDUCATION_LINE, 2)[0]
    begin = F.regexp_extract_all(work, F.lit(span), F.lit(1))
    until = F.regexp_extract_all(work, F.lit(span), F.lit(2))

    def length(b: Column, u: Column) -> Column:
        last = F.when(F.lower(u).isin(rules.OPEN_END_WORDS), current_year).otherwise(u.try_cast("int"))
        return F.greatest(last - b.cast("int"), F.lit(0))

    return F.aggregate(F.zip_with(begin, until, length), F.lit(0), lambda acc, y: acc + y).cast("double")


def is_senior_title(title: Column) -> Column:
    return title.rlike(rules.SENIOR_TITLE)


def seniority_multiplier(title: Column, years: Column) -> Column:
    return F.when(is_senior_title(title) & (years < 3), 0.4).otherwise(1.0)


def explain(
    score_pct: Column, matched: Column, missing: Column, shared: int | None = None, gaps: int | None = None
) -> Column:
    """One sentence each for the grade, the shared skills and the gaps; display limits cut the lists."""
    pct = F.concat(F.lit(" match ("), score_pct.cast("string"), F.lit("%)."))
    grade = F.when(score_pct >= 75, "Strong").when(score_pct >= 50, "Moderate").otherwise("Weak")

    def listing(label: str, words: Column, n: int | None) -> Column:
        listed = F.array_join(F.slice(words, 1, n) if n else words, ", ")
        return F.when(F.size(words) > 0, F.concat(F.lit(label + ": "), listed, F.lit(".")))

    return F.concat_ws(
        " ", F.concat(grade, pct), listing("Shared skills", matched, shared), listing("Gap areas", missing, gaps)
    )
