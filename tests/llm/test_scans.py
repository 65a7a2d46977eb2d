"""Licence, secret and personal data scans against plain regular expressions."""

import hashlib
import random
import re

import pytest

from rolecall.llm import licenses, pii, queries, secrets

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize(
    "text, order, labels, permissive",
    [
        ("MIT", ["MIT"], {"mit"}, True),
        ("Apache-2.0 OR GPL-2.0-only AND MIT", ["Apache-2.0", "GPL-2.0-only", "MIT", "and", "or"], {"apache", "gpl", "mit"}, True),
        ("(Apache-2.0 OR GPL-2.0-only) AND LGPL-3.0+", ["Apache-2.0", "GPL-2.0-only", "or", "LGPL-3.0+", "and"], {"apache", "gpl", "lgpl"}, False),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later", "Classpath-exception-2.0", "with"], {"gpl"}, False),
        ("MIT */ more words", ["MIT"], {"mit"}, True),
        ("(MIT OR", [], None, None),
        ("AND MIT", [], None, None),
        ("", [], None, None),
    ],
)
def test_licence_expressions(text, order, labels, permissive):
    assert licenses.postfix(text) == order
    found = licenses.evaluate(order)
    assert found == (None if labels is None else licenses.Licence(frozenset(labels), permissive))


def test_licence_scan(spark):
    texts = [
        "Released under the MIT License, or the Apache-License; the mit license.",
        "SPDX-License-Identifier: (Apache-2.0 OR MPL-2.0) -->\ncc-by CC BY xcc by",
        "GNU General   Public\nLicense",
        "permitted license",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d, text in enumerate(texts):
        words = re.findall(WORD, lowered(text or ""))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (got[d].n_words, got[d].n_base) == (len(words), len(places))
        assert (got[d].first_word, got[d].last_word) == (min(starts, default=None), max(starts, default=None))
        assert got[d].base_labels == sorted({label for _, label in places})
    assert got[1].expressions == ["Apache-2.0 MPL-2.0 or"] and got[1].labels == ["apache", "cc-by", "mpl"] and got[1].permissive
    assert got[4].score == 0 and got[1].score > got[0].score > 0


def test_secret_scan_against_patterns(sf, spark):
    random.seed(4)
    bits = ["token", "API_KEY", "passwd", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0f" * 13, "abc", "é", "secret", "key", "𝒳", "\n"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(400)]
    folder = sf(documents=[(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    rules = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    for r in queries.op3_secrets(spark, folder).collect():
        found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, texts[r.doc_id]) if ok(m)]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[3] == k for f in found) for k in rules)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_random_runs_are_told_from_written_ones(spark):
    random.seed(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(random.choices(letters, k=40)) + "7a" for _ in range(60)]
    written = [f"version-{i}-of-the-manual-page-number-{i}" for i in range(60)] + ["a1" * 20, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"]
    docs = spark.createDataFrame(list(enumerate(drawn + written)), "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(docs).filter("size(random) > 0").collect()}
    assert len(found & set(range(60))) >= 54 and len(found - set(range(60))) <= 4


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def test_fixed_personal_data():
    random.seed(1)
    for alphabet, size in (("a.@0123-+ ()_%é\n.@11", 40), ("0123456789- ", 60), ("+1 ().", 30)):
        for _ in range(4000):
            text = "".join(random.choices(alphabet, k=random.randint(0, size)))
            assert pii.fixed(text) == plain_pii(text), text
    assert pii.fixed("1" * 100_000 + "." + "a" * 100_000 + "@") == []


def test_trees_add_what_looks_like_it(spark):
    random.seed(2)
    number = lambda: f"{random.randint(200, 999)}) 555-{random.randint(1000, 9999)}"
    rows = [f"please call our phone +1 ({number()} today" for _ in range(300)]
    rows += [f"part {random.randint(10**8, 10**9)}/{i} in stock" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert all(len(got[i].base) == 1 for i in range(300)) and sum(len(got[i].added) for i in range(300, 600)) <= 30
    masked = pii.redacted(pii.scan(docs)).filter("doc_id = 0").first().text
    assert masked == "please call our phone [phone] today"


def test_batches_are_cut_before_texts_are_taken_out():
    import pyarrow as pa

    from rolecall.llm.rows import sliced

    texts = ["é" * 60, None, "x" * 500, "", "y" * 30, "z" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    parts = list(sliced(iter([batch]), 1, 300))
    assert [p.column(1).to_pylist() for p in parts] == [texts[:2], texts[2:3], texts[3:]]
