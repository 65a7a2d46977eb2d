"""Operator 9: personal data by candidate gradient boosting.

Four kinds are found by pattern and check (``fixed``). Beside them, high-recall
generators propose spans, which may overlap: anything around an at sign or
spelled-out "at ... dot", dotted or colon-joined groups, and runs of digits with
separators, each as a card and as a phone number. Boosted trees judge a proposal
by format and context only; they learn from proposals that a check has confirmed
(they cover a fixed span of their kind) against those that no check confirms, on
all proposals, counted by their bins. A threshold per kind, on
calibrated probabilities, lets at most ``FALSE_RATE`` of the unconfirmed
proposals pass. Selected spans are added to the fixed ones.

One pass reads the texts; proposals with features are written without text, and
the counts are taken from, and the scores are given to, that table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolecall.llm.boosting import Boosted
from rolecall.llm.rows import map_texts
from rolecall.operators.skew import materialize

#: Kinds in their order, and the patterns that a scan counts.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

FALSE_RATE = 0.02
#: Fewer proposals of either class teach nothing; then none of the kind is added.
LEAST_OF_CLASS = 20
AROUND = 24  # characters of context on either side

_BUSY = re.compile(r"[0-9@]|\bat\b", re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,24}",
    re.IGNORECASE,
)
_GROUPS = re.compile(r"[0-9]{1,4}(?:[.:][0-9]{1,4}){2,7}|[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}")
_CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobil"),
}


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 1) % 9 + 1 if v else 0 for i, v in enumerate(values)) % 10 == 0


def fixed(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the spans of all four patterns that pass their check, in order.

    Matches of a kind are leftmost and do not overlap; what fails its check has used up its characters.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in DOTTED.finditer(text):
            # Four parts at a time, from the left: what the pattern of four parts matches in such a run.
            if m[0].count(".") < 3:
                continue
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((start, 1, end))
                start = end + 1
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all that may be personal data."""
    found = set()
    at = text.find("@")
    while at >= 0:
        left = re.search(r"[^\s@<>()\"']*\Z", text[max(0, at - 64) : at])[0]
        right = re.match(r"[^\s@<>()\"',;]*", text[at + 1 : at + 256])[0].rstrip(".!?")
        if left and right:
            found.add((at - len(left), 0, at + 1 + len(right)))
        at = text.find("@", at + 1)
    found.update((m.start(), 0, m.end()) for m in _SPELLED.finditer(text))
    if _DIGIT.search(text):
        found.update((m.start(), 1, m.end()) for m in _GROUPS.finditer(text))
        for m in _NUMBER.finditer(text):
            found.add((m.start(), 2, m.end()))
            found.add((m.start(), 3, m.end()))
    return sorted(found)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a span and what stands around it; nothing that a check looks at beyond lengths and separators."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    near = before + " " + after
    return [
        len(span),
        digits,
        letters,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        span.count("."),
        span.count("-") + span.count(" "),
        span.count("(") + span.count(":"),
        span.startswith("+"),
        span.count("@"),
        len(span.rpartition(".")[2]),
        len(set(span)) / max(1, len(span)),
        bool(before) and (before[-1].isalnum() or before[-1] in "._+-/="),
        bool(after) and (after[0].isalnum() or after[0] in "_+-/="),
        any(c in near for c in _CUES[KINDS[kind]]),
        before.rstrip().endswith((":", "=", "(")),
    ]


def _spans(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "kind": k, "end": e} for s, k, e in found]


SPAN = "struct<start:bigint,kind:int,end:bigint>"


def proposed(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the fixed spans ``base``, and ``proposals`` with features and whether a check confirms them."""
    kinds = f"base array<{SPAN}>, proposals array<struct<span:{SPAN},confirmed:boolean,x:array<double>>>"
    schema = df.sparkSession.createDataFrame([], kinds).schema

    def make():
        def work(texts):
            base, all_proposed = [], []
            for x in texts:
                if not _BUSY.search(x):
                    base.append([])
                    all_proposed.append([])
                    continue
                sure = fixed(x)
                base.append(_spans(sure))
                row = []
                for start, kind, end in proposals(x):
                    covers = any(k == kind and s < end and start < e for s, k, e in sure)
                    row.append(
                        {
                            "span": {"start": start, "kind": kind, "end": end},
                            "confirmed": covers,
                            "x": list(map(float, features(x, start, kind, end))),
                        }
                    )
                all_proposed.append(row)
            return [base, all_proposed]

        return work

    return map_texts(df, make, schema, text, keep)


def _tallied(table: DataFrame, count: Callable, schema: str, keys: list[str]) -> pd.DataFrame:
    """What ``count`` makes of the kinds, spans, marks and features of proposals, summed over the table by ``keys``.

    A quarter of the proposals, by a hash of place and features, is held back for calibration.
    """
    p = table.select(F.explode("proposals").alias("p"))
    rows = p.select("p.span.kind", "p.confirmed", (F.pmod(F.xxhash64("p.span", "p.x"), F.lit(4)) == 3).alias("held"), "p.x")

    def run(batches):
        for batch in batches:
            kind, confirmed, held, x = batch.columns
            if batch.num_rows:
                wide = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                flags = [c.to_numpy(zero_copy_only=False) for c in (kind, confirmed, held)]
                yield from count(*flags, wide)

    return rows.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n")).toPandas()


def fit(table: DataFrame) -> dict[int, tuple[Boosted, float]]:
    """Trees and threshold of each kind that has enough proposals of both classes.

    Two passes over the written proposals count them all: by value of each feature, for the
    bins, and by bins, class and share. Trees see every proposal through these sums, of which there are as many as
    different binned rows.
    """

    def by_value(kind, confirmed, held, x):
        for k in np.unique(kind[~held]):
            for f, column in enumerate(x[(kind == k) & ~held].T):
                values, n = np.unique(column, return_counts=True)
                columns = [np.full(len(n), k, np.int32), np.full(len(n), f, np.int32), values, n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "feature", "value", "n"])

    values = _tallied(table, by_value, "kind int, feature int, value double, n bigint", ["kind", "feature", "value"])
    trees = {}
    for kind, own in values.groupby("kind"):
        own = own.sort_values(["feature", "value"])
        trees[int(kind)] = Boosted()
        trees[int(kind)].cut(*(own[c].to_numpy() for c in ("feature", "value", "n")))

    def by_bins(kind, confirmed, held, x):
        for k in np.unique(kind):
            own = kind == k
            if int(k) not in trees:
                continue
            bins = np.column_stack([confirmed[own], held[own], trees[int(k)].binned(x[own])]).astype(np.uint8)
            cells, n = np.unique(bins, axis=0, return_counts=True)
            columns = [pa.array(np.full(len(n), k, np.int32)), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "cell", "n"])

    cells = _tallied(table, by_bins, "kind int, cell binary, n bigint", ["kind", "cell"])
    models = {}
    for kind, own in cells.groupby("kind"):
        own = own.assign(cell=own["cell"].map(bytes)).sort_values("cell")
        bins = np.frombuffer(b"".join(own["cell"]), np.uint8).reshape(len(own), -1)
        y, held, b, n = bins[:, 0].astype(float), bins[:, 1] == 1, bins[:, 2:].astype(int), own["n"].to_numpy(float)
        if min(n[y == 1].sum(), n[y == 0].sum()) < LEAST_OF_CLASS or len(np.unique(y[~held])) < 2:
            continue
        model = trees[int(kind)].fit(b, y, n, held)
        chance, weight = model.chance(b[y == 0]), n[y == 0]
        order = np.argsort(-chance, kind="stable")
        allowed = int(FALSE_RATE * weight.sum())
        at = np.searchsorted(np.cumsum(weight[order]), allowed, "right")
        models[int(kind)] = (model, max(0.5, float(chance[order][at])))
    return models


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` (spans of the fixed kinds) and ``added`` (spans that the trees select), one row for each row in.

    Spans are structs of start, kind (number in ``KINDS``) and end, in code points,
    end exclusive, in order. Added spans overlap no fixed one; of added ones that
    overlap, the likeliest stays. Null and empty texts have none. Columns named
    ``base``, ``added`` or ``proposals`` are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("base", "added", "proposals")]
    table = materialize(proposed(df, text, kept))
    sent = df.sparkSession.sparkContext.broadcast(fit(table))
    schema = StructType(table.schema.fields[:-1])
    schema = schema.add("added", table.schema["base"].dataType)

    def run(batches):
        models = sent.value
        for batch in batches:
            columns = list(batch.columns)
            base, every = columns[-2].to_pylist(), columns[-1].to_pylist()
            flat = [(i, p) for i, ps in enumerate(every) for p in ps if p["span"]["kind"] in models]
            likely: dict[int, list] = {}
            for kind, (model, least) in models.items():
                own = [(i, p) for i, p in flat if p["span"]["kind"] == kind]
                if own:
                    chance = model.probability(np.array([p["x"] for _, p in own]))
                    for (i, p), c in zip(own, chance.tolist(), strict=True):
                        if c > least:
                            likely.setdefault(i, []).append((-c, p["span"]["start"], kind, p["span"]["end"]))
            added = []
            for i, sure in enumerate(base):
                taken = [(s["start"], s["end"]) for s in sure]
                row = []
                for _, start, kind, end in sorted(likely.get(i, [])):
                    if all(e <= start or end <= s for s, e in taken):
                        taken.append((start, end))
                        row.append((start, kind, end))
                added.append(_spans(sorted(row)))
            columns[-1] = pa.array(added, columns[-2].type)
            yield pa.RecordBatch.from_arrays(columns, [*kept, "base", "added"])

    return table.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def redacted(df: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """``df`` after ``scan`` with its spans in ``text`` replaced by their kind."""
    names = F.array(*(F.lit(mask.format(k)) for k in KINDS))
    body = F.col(text)
    walked = F.aggregate(
        F.array_sort(F.concat("base", "added")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(body, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                    F.element_at(names, x["kind"] + 1),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
    )
    done = F.concat(walked["out"], F.substring(body, (walked["at"] + 1).cast("int"), F.length(body)))
    return df.withColumn(text, done)
