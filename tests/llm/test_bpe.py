import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rolecall.llm import bpe
from rolecall.llm.queries import VOCABULARY

LIBRARY = Tokenizer.from_file(VOCABULARY)
with open(VOCABULARY, encoding="utf-8") as f:
    OURS = bpe.Bpe(f.read())

PIECES = st.sampled_from(["the", " the", "'s", "'ll", "  ", "\n", "\t", " \n ", "<|endoftext|>", "12", "½", "é", "你好", "🙂", "a", "\x1c", "\x85", " ", "_", "..."])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=20).map("".join)))
def test_ids_and_round_trip_are_the_library_s(text):
    (ids,) = OURS.encode([text])
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert OURS.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_prefixes_are_shared_in_sorted_order():
    words = sorted({b"thin", b"thing", b"things", b"the", b"theatre", b"zoo"})
    want = [LIBRARY.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in OURS.encode_words(words)] == want


def test_decode_table(spark):
    docs = spark.createDataFrame([(1, "A text, of words."), (2, None)], "doc_id bigint, text string")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    assert {r.doc_id: r.decoded for r in bpe.decode(coded, VOCABULARY).collect()} == {1: "A text, of words.", 2: ""}


def test_frequent_words_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = bpe.Bpe(f.read())
    walked = []
    walk = encoder.encode_words
    encoder.encode_words = lambda words: walked.append(set(words)) or walk(words)
    for n in range(12):
        text = "often seen, " + " ".join(f"q{'x' * k}{'abcdefghijkl'[n]}" for k in range(30))
        (ids,) = encoder.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert sum(b" seen" in words or b"often" in words for words in walked) == 1
    assert len(encoder.pieces.new) + len(encoder.pieces.old) < 200
