"""Every operator on awkward rows, with clashing column names, and on an empty table."""

import pytest

from rolecall.llm import bpe, decontaminate, exactdedup, langid, licenses, linededup, pii, secrets, simhash
from rolecall.llm.queries import VOCABULARY


def benchmark(spark):
    rows = [(1, "the same line of text that stands in many documents of this table"), (2, None), (3, ""), (None, "word word")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


OPERATORS = {
    "bpe": lambda docs: bpe.encode(docs, VOCABULARY, with_decoded=True),
    "licenses": licenses.scan,
    "secrets": secrets.scan,
    "linededup": linededup.clean,
    "exactdedup": exactdedup.classes,
    "decontaminate": lambda docs: decontaminate.matches(docs, benchmark(docs.sparkSession)),
    "simhash": simhash.classes,
    "pii": pii.scan,
    "langid": lambda docs: langid.predict(docs, langid.fit(docs)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_come_out_once_each(awkward, name):
    assert len(OPERATORS[name](awkward).collect()) == awkward.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_results_on_awkward_rows(awkward):
    tokens = {r.doc_id: r for r in OPERATORS["bpe"](awkward).collect()}
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert all(r.decoded == texts[d] for d, r in tokens.items()) and tokens[3].n_tokens == tokens[4].n_tokens == 0
    assert tokens[1].score == "score" and isinstance(tokens[1].token_ids, bytes | bytearray)

    groups = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in OPERATORS["exactdedup"](awkward).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (5, 5, 3, True), (3, 5, 3, False), (4, 5, 3, False)} <= groups

    classes = {r.doc_id: r.component_id for r in OPERATORS["simhash"](awkward).collect()}
    assert classes[2] == 1 and classes[3] == classes[4] == classes[5] == 3

    cleaned = {r.doc_id: r for r in OPERATORS["linededup"](awkward).collect()}
    assert cleaned[1].text == texts[1] and cleaned[2].text == "short" and cleaned[3].text is None
    assert cleaned[1].n_lines == 1 and cleaned[2].n_repeated == 1 and cleaned[5].text == texts[5]

    hits = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in OPERATORS["decontaminate"](awkward).collect()}
    assert hits[1] == (14, 13, True) and hits[3] == (0, 0, False) and hits[7] == (50_000, 50_000, True)

    langs = {r.doc_id: (r.lang_pred, r.rejected) for r in OPERATORS["langid"](awkward).collect()}
    assert langs[3] == langs[4] == langs[5] == ("und", True)
