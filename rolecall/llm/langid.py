"""Operator 10: language identification with interpolated Kneser-Ney letter models.

A text is read as its words (runs of letters, lower case), each between a start
and an end mark. A model of order ``ORDER`` for each language predicts every
letter and the end mark from the letters before it in the word. Its n-grams are
64-bit keys of 16 bits for each letter, kept in one sorted array per order with
the languages' log-probabilities beside it, so a lookup is a binary search. The
language with the lowest cross-entropy per letter is chosen. A text is rejected
if even that is above what texts of the language show: a limit calibrated on all
labelled training documents, widened for short texts.

Counts of n-grams come from all labelled training documents: tasks count the
distinct words of their documents and only summed n-gram counts are shuffled.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from rolecall.llm.rows import map_texts, sliced
from rolecall.operators.skew import materialize

ORDER = 4
START, END = 1, 2  # marks; no letter has these numbers
#: A text is rejected above the 99.9 % point of its language's labelled texts times SLACK, plus SPREAD / sqrt(letters).
SLACK, SPREAD = 1.25, 8.0
UNKNOWN = "und"

#: Characters of texts that are worked on at once.
SLICE = 1_000_000


def _numbers() -> str:
    """Characters that a pattern takes for word characters though they are numbers (½, ², ③, Ⅷ), as ranges of a class."""
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i)) in ("Nl", "No"):
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


#: A run of letters: Unicode category L.
WORD = re.compile(rf"[^\W\d_{_numbers()}]+")
_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(5)]
_LETTER = np.uint64(16)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per predicted letter of distinct words: key of the letters up to it, their number, and the word's place.

    A key holds the last ``ORDER`` letters at most, the predicted one in its lowest 16 bits.
    """
    joined = "".join([f"\x01{w}\x02" for w in words])
    letters = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    letters = np.where(letters <= 0xFFFF, letters, 0x8000 | letters & 0x7FFF).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(letters)) - first  # within the word
    key = letters.copy()
    for k in range(1, ORDER):
        fits = place >= k
        key[fits] |= letters[np.flatnonzero(fits) - k] << np.uint64(16 * k)
    predicted = place > 0
    return key[predicted], np.minimum(place + 1, ORDER)[predicted], np.repeat(np.arange(len(words)), sizes)[predicted]


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed weights."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=weights, minlength=len(distinct))


def order_of(keys: np.ndarray) -> np.ndarray:
    return 1 + sum((keys > _MASK[k]).astype(np.int64) for k in range(1, ORDER))


@dataclass
class Model:
    languages: list[str]
    #: By order from 1: sorted keys; log2-probabilities (keys x languages) of the last letter; log2 of the
    #: weight that a context (a key of this order) gives to shorter ones.
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    backoffs: list[np.ndarray]
    #: log2-probability of a letter that no language has shown.
    unseen: np.ndarray
    #: Highest cross-entropy of an accepted text by language; under None, that of languages that have none.
    limits: dict[str | None, float] | None = None

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log2-probability of each distinct word under each language, and its predicted letters."""
        key, size, word = ngrams(words)
        total = np.zeros((len(key), len(self.languages)))
        waiting = np.arange(len(key))
        for k in range(ORDER, 0, -1):
            able = size[waiting] >= k
            now = waiting[able]
            at, found = _find(self.keys[k - 1], key[now] & _MASK[k])
            total[now[found]] += self.logs[k - 1][at[found]]
            missed = now[~found]
            if k > 1:
                context, known = _find(self.keys[k - 2], (key[missed] & _MASK[k]) >> _LETTER)
                total[missed[known]] += self.backoffs[k - 2][context[known]]
            else:
                total[missed] += self.unseen
            waiting = np.concatenate([waiting[~able], missed])
        letters = np.bincount(word, minlength=len(words))
        return np.stack([np.bincount(word, weights=c, minlength=len(words)) for c in total.T], 1), letters

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter (texts x languages) and number of predicted letters of each text."""
        words = [words_of(x) for x in texts]
        counts = np.array([len(w) for w in words], np.int64)
        codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], object))
        if not len(codes):
            return np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        scores, letters = self.scores(distinct.tolist())
        text = np.repeat(np.arange(len(texts)), counts)
        n = np.bincount(text, weights=letters[codes], minlength=len(texts))
        bits = np.stack([np.bincount(text, weights=c[codes], minlength=len(texts)) for c in scores.T], 1)
        return -bits / np.maximum(n, 1)[:, None], n


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit_model(languages: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from (keys, counts) of each language.

    A count belongs to the longest key of a predicted letter. Shorter keys that
    begin a word keep their counts; all others get the number of distinct letters
    that stand before them. One discount for each order: n1 / (n1 + 2 n2).
    """
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for keys, counts in rows:
        order = order_of(keys)
        own = [(keys[order == k], counts[order == k]) for k in range(1, ORDER + 1)]
        for k in range(ORDER - 1, 0, -1):
            longer = own[k][0]
            suffix = longer & _MASK[k]
            more, left = sums(suffix, np.ones(len(suffix)))
            # Raw counts are those of keys that begin with the start mark, and no suffix does.
            merged = sums(np.concatenate([own[k - 1][0], more]), np.concatenate([own[k - 1][1], left]))
            own[k - 1] = merged
        levels.append(own)
    letters = np.unique(np.concatenate([own[0][0] for own in levels] or [np.empty(0, np.uint64)]))
    uniform = 1 / (len(letters) + 1)
    all_keys = [np.unique(np.concatenate([own[k][0] for own in levels])) for k in range(ORDER)]
    # Contexts are looked up among the keys of their order; those that begin a word are not predicted, so add them.
    for k in range(1, ORDER):
        all_keys[k - 1] = np.union1d(all_keys[k - 1], all_keys[k] >> _LETTER)
    probabilities = [np.zeros((len(keys), len(languages))) for keys in all_keys]
    weights = [np.ones((len(keys), len(languages))) for keys in all_keys]
    unseen = np.zeros(len(languages))
    for language, own in enumerate(levels):
        for k in range(ORDER):
            keys, counts = own[k]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, total = sums(keys >> _LETTER, counts)
            _, kinds = sums(keys >> _LETTER, np.minimum(counts, discount))
            share = kinds / np.maximum(total, 1e-12)  # of shorter contexts
            if k == 0:
                lower = np.full(len(all_keys[0]), uniform)
                weight = np.full(len(all_keys[0]), share[0] if len(share) else 1.0)
                unseen[language] = weight[0] * uniform if len(weight) else uniform
            else:
                at, known = _find(context, all_keys[k] >> _LETTER)
                weight = np.where(known, share[at] if len(share) else 1.0, 1.0)
                down, there = _find(all_keys[k - 1], all_keys[k] & _MASK[k])
                lower = np.where(there, probabilities[k - 1][down, language], unseen[language])
                at, known = _find(context, all_keys[k - 1])
                weights[k - 1][:, language] = np.where(known, share[at] if len(share) else 1.0, 1.0)
            at, known = _find(keys, all_keys[k])
            context_at, _ = _find(context, all_keys[k] >> _LETTER)
            direct = np.zeros(len(all_keys[k]))
            if len(keys):
                direct = np.where(known, np.maximum(counts[at] - discount, 0) / np.maximum(total[context_at], 1e-12), 0)
            probabilities[k][:, language] = direct + weight * lower
    log = lambda x: np.log2(np.maximum(x, 1e-30)).astype(np.float32)
    return Model(languages, all_keys, [log(p) for p in probabilities], [log(w) for w in weights], np.log2(np.maximum(unseen, 1e-30)))


def held_out(doc: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % 3 == 1, F.lit(False))


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, key, n) over all rows; a row of key -1 has the number of documents."""

    def run(batches):
        held: dict[str, list] = {}
        docs_of: dict[str, int] = {}

        def gather(language):
            keys, counts = zip(*held[language], strict=True)
            held[language] = [sums(np.concatenate(keys), np.concatenate(counts))]

        for batch in sliced(batches, 0, SLICE):
            words: dict[str, list[str]] = {}
            for x, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words.setdefault(language, []).extend(words_of(x or ""))
                docs_of[language] = docs_of.get(language, 0) + 1
            for language, found in words.items():
                if not found:
                    continue
                codes, distinct = pd.factorize(np.array(found, object))
                keys, _, word = ngrams(distinct.tolist())
                held.setdefault(language, []).append(sums(keys, np.bincount(codes)[word]))
                if sum(len(k) for k, _ in held[language]) > 1_000_000:
                    gather(language)
        for language, n in docs_of.items():
            yield pa.RecordBatch.from_arrays([pa.array([language]), pa.array([-1]), pa.array([n])], ["lang", "key", "n"])
        for language in held:
            gather(language)
            keys, counts = held[language][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "key", "n"],
            )

    found = docs.select(text, lang).mapInArrow(run, "lang string, key bigint, n bigint")
    return materialize(found.groupBy("lang", "key").agg(F.sum("n").alias("n")))


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", calibrated: bool = True
) -> Model | None:
    """Model of all labelled documents that are not held out; None if there is none with a letter.

    ``calibrated`` scores them all for the limits of rejection. All counts of n-grams make the model; up to four letters
    of a word have as many as the alphabets allow, whatever the number of texts.
    """
    training = docs.filter(F.col(lang).isNotNull() & F.col(doc).isNotNull() & ~held_out(doc))
    counts = count_ngrams(training, text, lang)
    frame = counts.filter("key <> -1").toArrow().to_pandas()
    languages = sorted(frame["lang"].unique().tolist())
    if not languages:
        return None
    rows = []
    for language in languages:
        own = frame[frame["lang"] == language]
        keys = own["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        rows.append((keys[order], own["n"].to_numpy(np.float64)[order]))
    model = fit_model(languages, rows)
    if calibrated:
        model.limits = limits_of(predict(training, model, text, [lang]), lang)
    return model


def limits_of(scored: DataFrame, lang: str) -> dict[str | None, float]:
    """Limits from all rows of ``predict`` whose language is known and was found; the common one counts all languages."""
    seen = scored.filter((F.col("lang_pred") == F.col(lang)) & (F.col("letters") >= 20))
    point = F.percentile_approx("entropy", 0.999, 10_000)
    known = dict(seen.groupBy(lang).agg(point).collect())
    known[None] = seen.agg(point).first()[0]
    return {k: v for k, v in known.items() if v is not None}


def rejected(limits: dict[str | None, float] | None) -> Column:
    """Whether a row of ``predict`` has no letters or is beyond its language's limit."""
    limits = limits or {}
    named = [F.lit(x) for k, v in limits.items() if k is not None for x in (k, float(v))]
    other = F.lit(float(limits.get(None, math.inf)))
    limit = F.coalesce(F.try_element_at(F.create_map(*named), F.col("lang_pred")), other) if named else other
    beyond = F.col("entropy") > limit * SLACK + SPREAD / F.sqrt(F.col("letters"))
    return F.when(F.col("letters") == 0, True).otherwise(F.coalesce(beyond, F.lit(False)))


def label(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (default all) with those of ``predict``: learned from, calibrated on and applied to the same table.

    Every text is scored once; the written scores give the limits of all labelled documents.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    model = fit(plain, names[text], names[lang], names[doc], calibrated=False)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in FIELDS.names]
    needed = list(dict.fromkeys(names[c] for c in [*kept, lang, doc]))
    scored = materialize(predict(plain, model, names[text], needed).drop("rejected"))
    labelled = scored.filter(F.col(names[lang]).isNotNull() & F.col(names[doc]).isNotNull() & ~held_out(names[doc]))
    found = scored.withColumn("rejected", rejected(limits_of(labelled, names[lang])))
    return found.select(*(F.col(names[c]).alias(c) for c in kept), *FIELDS.names)


FIELDS = StructType(
    [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("entropy", DoubleType()),
        StructField("letters", LongType()),
        StructField("rejected", BooleanType()),
    ]
)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``entropy`` (bits per letter), ``letters`` and ``rejected``.

    A null text, one without letters, and every text if there is no model, gives
    ``und`` with score 0, rejected. ``score`` is the chosen language's share when
    each language weighs 2 to the power of minus its cross-entropy times the root
    of the number of letters. Of equal cross-entropies the first language in
    alphabetical order is chosen. Row-wise; columns of the same names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def work(texts):
            if model is None:
                n = len(texts)
                return [[UNKNOWN] * n, [0.0] * n, [None] * n, [0] * n]
            entropy, n = model.entropies(texts)
            best = entropy.argmin(1)
            low = entropy[np.arange(len(texts)), best]
            share = 1 / np.exp2(np.maximum(-(entropy - low[:, None]) * np.sqrt(n)[:, None], -1000)).sum(1)
            none = n == 0
            names = [UNKNOWN if u else model.languages[b] for u, b in zip(none, best, strict=True)]
            return [
                names,
                np.where(none, 0.0, share).tolist(),
                pa.array(low, mask=none),
                n.astype(np.int64).tolist(),
            ]

        return work

    scored = map_texts(df.drop("rejected"), make, StructType(FIELDS.fields[:4]), text, keep and [c for c in keep if c != "rejected"], SLICE)
    return scored.withColumn("rejected", rejected(model.limits if model else None))
