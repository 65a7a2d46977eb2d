"""Operator 3: secret scans, in DataFrame functions only.

Three fixed kinds of secret are found by pattern. Further candidates are runs of
20 or more characters of an encoding alphabet with a letter and a digit among
them. For each, the encoding is inferred (hex, base 32, letters and digits in
one or both cases, base 64) and three tests of the hypothesis "drawn uniformly
from that alphabet" are made over the letters' places in it: chi-squared over
bins of the alphabet, the number of runs above and below its middle, and the
correlation of neighbours. Fisher's method combines the three p-values.

A candidate is taken for random, so for a secret, unless the hypothesis is
rejected. Over all candidates of the table the rejections follow a weighted
Benjamini-Hochberg step-up rule at rate ``ALPHA``, so that at most that share of
what is thrown away is expected to be random after all. It is length-aware: a
candidate's p-value is divided by a weight in proportion to 1/length (mean 1),
because a short text that isn't random deviates less. The rule needs only the
counts of candidates by weighted p-value, which are kept in at most ``BINS`` bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.operators.skew import materialize

#: The kinds that every scan counts, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, tried in order: a pattern of the whole run, its alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+=*$", UPPER + "234567"),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "_-"),
)
ALPHA = 0.05
BINS = 512


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, matches: Column) -> Column:
    """Start, end and text of all ``matches`` of a pattern, by what stands between them; null without any."""
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    walked = F.aggregate(
        F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("text"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found")),
        lambda acc, x: let(
            acc["at"] + F.length(x["gap"]),
            lambda start: F.struct(
                (start + F.length(x["text"])).alias("at"),
                F.concat(
                    acc["found"],
                    F.array(F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"))),
                ).alias("found"),
            ),
        ),
        lambda acc: acc["found"],
    )
    return F.when(F.size(matches) > 0, walked)


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal value above ``z`` (logistic approximation, error under 2e-4)."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def two_sided(z: Column) -> Column:
    return 2 * upper_tail(F.abs(z))


def randomness(places: Column, letters: int) -> Column:
    """Combined p-value of the three tests for places (0 to ``letters`` - 1) in an alphabet."""
    n = F.size(places).cast("double")
    bins = F.least(F.lit(letters), F.greatest(F.lit(4), F.floor(n / 5))).cast("int")

    def uniform(b):
        squares = F.aggregate(
            F.sequence(F.lit(0), b - 1),
            F.lit(0.0),
            lambda acc, j: acc + F.pow(F.size(F.filter(places, lambda x: F.floor(x * b / letters) == j)), F.lit(2.0)),
        )
        df = (b - 1).cast("double")
        shrink = 2 / (9 * df)
        return upper_tail((F.pow((squares * b / n - n) / df, F.lit(1 / 3)) - (1 - shrink)) / F.sqrt(shrink))

    neighbours = F.zip_with(
        F.slice(places, 1, F.size(places) - 1),
        F.slice(places, F.lit(2), F.size(places) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def runs(high):
        low = n - high
        mean = 1 + 2 * high * low / n
        variance = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        count = 1 + F.size(F.filter(neighbours, lambda x: (x["a"] * 2 >= letters) != (x["b"] * 2 >= letters)))
        return F.when((high == 0) | (low == 0), F.lit(1e-9)).otherwise(two_sided((count - mean) / F.sqrt(variance)))

    def serial(mean):
        around = F.aggregate(places, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        along = F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + (x["a"] - mean) * (x["b"] - mean))
        return F.when(around == 0, F.lit(1e-9)).otherwise(two_sided((along / around + 1 / n) * F.sqrt(n)))

    tests = F.array(
        let(bins, uniform),
        let(F.size(F.filter(places, lambda x: x * 2 >= letters)).cast("double"), runs),
        let(F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x) / n, serial),
    )
    half = F.aggregate(tests, F.lit(0.0), lambda acc, p: acc - F.log(F.greatest(p, F.lit(1e-12))))
    return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def p_random(run: Column) -> Column:
    """p-value of a run of characters under the first encoding that it fits; null if it fits none."""
    letters = F.split(F.rtrim(run, F.lit("=")), "")
    chosen = F.when(F.lit(False), F.lit(0.0))
    for pattern, alphabet in ENCODINGS:
        chosen = chosen.when(run.rlike(pattern), _judged(letters, alphabet))
    return chosen


def _judged(letters: Column, alphabet: str) -> Column:
    places = F.transform(letters, lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(places, lambda x: randomness(x, len(alphabet)))


def candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all), spans of the fixed kinds, and ``runs`` with their p-values.

    One pass over the texts, row-wise. Null counts as empty.
    """
    kept = df.columns if keep is None else keep
    body = F.coalesce(df[f"`{text}`"], F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": RUN}
    found = df.select(*(df[f"`{c}`"] for c in kept if c.lower() not in {"assign", "access", "hex", "runs"}), body.alias("_body"))
    # A fixed kind is matched by its shortest pattern and filtered afterwards, but texts without a match of
    # the least length are told apart first: nearly all letters a-f of ordinary words match HEX.
    least = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
    for kind, pattern in patterns.items():
        matches = F.regexp_extract_all("_body", F.lit(pattern), F.lit(0))
        found = found.withColumn(f"_{kind}", F.when(F.col("_body").rlike(least[kind]), matches) if kind in least else matches)
    spanned = {kind: spans(F.col("_body"), pattern, F.col(f"_{kind}")) for kind, pattern in patterns.items()}
    found = found.withColumns({f"_{kind}": value for kind, value in spanned.items()})

    def long_enough(kind):
        size = lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2) if kind == "assign" else x["text"])
        kept = F.filter(f"_{kind}", lambda x: size(x) >= LEAST[kind])
        return F.coalesce(F.transform(kept, lambda x: F.struct(x["start"], x["end"])), F.array())

    mixed = F.filter("_run", lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"))
    judged = F.transform(
        mixed,
        lambda x: F.struct(
            x["start"], x["end"], F.length(x["text"]).alias("n"), p_random(x["text"]).alias("p")
        ),
    )
    return found.select(
        *(c for c in found.columns if not c.startswith("_")),
        *(long_enough(kind).alias(kind) for kind in KINDS),
        F.coalesce(F.filter(judged, lambda x: x["p"].isNotNull()), F.array()).alias("runs"),
    )


def accepted_bin(runs: DataFrame, alpha: float = ALPHA) -> tuple[float, int]:
    """Mean of 1/length and the first bin of rejected p-values, over all ``runs`` (columns n, p).

    Bins number the weighted p-values downwards; the second value is ``BINS`` if none is rejected.
    """
    total, weight = runs.agg(F.count("p"), F.avg(1 / F.col("n"))).first()
    if not total:
        return 1.0, BINS
    cells = runs.groupBy(bin_of(F.col("p"), F.col("n"), weight).alias("bin")).count()
    # At most BINS rows: one task is enough for their running sum.
    rejected = F.sum("count").over(Window.orderBy(F.desc("bin")))
    step = cells.withColumn("rejected", rejected).filter(F.exp(-F.col("bin") / 16) <= alpha * F.col("rejected") / total)
    return weight, step.agg(F.coalesce(F.min("bin"), F.lit(BINS))).first()[0]


def bin_of(p: Column, n: Column, weight: float) -> Column:
    weighted = F.greatest(p * n * weight, F.lit(math.exp(-BINS)))
    return F.greatest(F.least(F.floor(-16 * F.log(weighted)), F.lit(BINS - 1)), F.lit(0)).cast("int")


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Spans of secrets in every text: arrays ``assign``, ``access``, ``hex`` and ``random``.

    Spans are (start, end) in code points, end exclusive, in order. ``random`` has
    the runs that the battery takes for random and that touch no span of the fixed
    kinds. One row out for each row in; null and empty texts have none; columns of
    the same names are replaced. The spans with p-values, without text, are
    written once to the shared folder; nothing else is shuffled than bin counts.
    """
    scored = materialize(candidates(df, text, keep))
    weight, first = accepted_bin(scored.select(F.explode("runs").alias("r")).select("r.n", "r.p"), alpha)
    fixed = F.concat(*KINDS)
    free = F.filter(
        "runs",
        lambda r: (bin_of(r["p"], r["n"], weight) < first)
        & ~F.exists(fixed, lambda f: (f["start"] < r["end"]) & (r["start"] < f["end"])),
    )
    return scored.withColumn("random", F.transform(free, lambda r: F.struct(r["start"], r["end"]))).drop("runs")


def listed(*kinds: str) -> Column:
    """``kind:start:end`` of the spans of these columns by start, then kind as listed, comma-joined."""

    def mark(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"], F.lit(i).alias("i"), x["end"], F.lit(kind).alias("kind")))

    marked = F.concat(*(mark(i, kind) for i, kind in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(marked), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
