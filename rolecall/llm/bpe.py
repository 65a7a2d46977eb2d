"""Operator 1: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is found from the *last token* of each of its prefixes.
The last token of a prefix is the only vocabulary entry that ends there and can
follow the last token of what stands before it, so a prefix has the same state
in every word that starts with it. The distinct words of a batch form a trie;
they are visited in sorted order, which is its depth-first order, with a stack
of last-token states: a word takes over the states of the prefix that it shares
with the word before and works out only the rest. Following the states back
from a word's end gives its tokens.

Two tokens can follow each other if no merge of the vocabulary would have
joined bytes over their boundary earlier; that is seen by taking the two apart
again in the reverse order of the merges. It needs a vocabulary whose ids are
its single bytes followed by one id for each merge in order.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from rolecall.llm.rows import map_texts

#: Fixed value: the pattern that byte-level BPE splits a text by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space here does not start a word of its own; such texts are split by the whole pattern.
JOINED_SPACE = re.compile(r"\s (?=\s|\Z)")
#: Entries of a task's memory that begin a new generation, some 40 MB; the one before is kept besides.
REMEMBERED = 200_000
#: Token pairs that a task remembers, some 50 MB; it starts anew beyond that.
PAIRS = 500_000
#: Bytes by which the tokens are looked up that may end at a place.
TAIL = 4
#: Longer words are encoded but not remembered.
REMEMBERED_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Memory:
    """Ids of words, in two generations: those asked for since the last change, and those of the time before it.

    What is asked for again moves on to the new generation, so frequent words stay and rare ones go.
    """

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look(self, words: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the words that are known, and the others."""
        new, old = self.new, self.old
        found = {w: x for w in words if (x := new.get(w)) is not None}
        if len(found) < len(words):
            again = {w: x for w in words if w not in found and (x := old.get(w)) is not None}
            new.update(again)
            found.update(again)
        return found, [w for w in words if w not in found]

    def keep(self, found: dict[str, bytes]) -> None:
        self.new.update((w, x) for w, x in found.items() if len(w) <= REMEMBERED_CHARS)
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}


class Bpe:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, letters = spec["model"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for token, i in model["vocab"].items():
            if token not in self.added:
                self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        added = set(self.added.values())
        self.ids = {t: i for i, t in enumerate(self.tokens) if t and i not in added}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            pair = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (self.ids[bytes(letters[c] for c in part)] for part in pair)
            made = self.ids[self.tokens[left] + self.tokens[right]]
            if made != 256 + n:
                raise ValueError("token ids must follow the order of the merges")
            self.parts[made] = (left, right)
            self.merged[left, right] = made
        #: By the last bytes, TAIL at most: tokens that may end there, as (length, id), longest first. Longer ones
        #: than TAIL come without their id, so bytes that no token ends in are looked up by fewer of them.
        self.ends: dict[bytes, tuple[tuple[int, int | None], ...]] = {}
        longer: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > TAIL:
                longer.setdefault(token[-TAIL:], set()).add(len(token))
        one = {t: (len(t), i) for t, i in self.ids.items() if len(t) <= TAIL}
        for tail in {t[-k:] for t in self.ids for k in range(1, TAIL + 1)}:
            own = [one[tail[k:]] for k in range(len(tail)) if tail[k:] in one]
            self.ends[tail] = (*((n, None) for n in sorted(longer.get(tail, ()), reverse=True)), *own)
        #: For each token, whether it can follow others.
        self.follows: list[dict[int, bool]] = [{} for _ in self.tokens]
        self.n_pairs = 0
        self.split = regex.compile(WORDS).findall
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known = Memory()  # words that begin with no space
        self.pieces = Memory()  # what stands between spaces, with the space before it

    def can_follow(self, left: int, right: int) -> bool:
        """Whether these two tokens stay apart when their bytes are encoded together."""
        answer = self.follows[right].get(left)
        if answer is None:
            if self.n_pairs >= PAIRS:
                self.n_pairs = 0
                for known in self.follows:
                    known.clear()
            self.n_pairs += 1
            answer = self.follows[right][left] = self._stays_apart(left, right)
        return answer

    def _stays_apart(self, left: int, right: int) -> bool:
        a, b, until = left, right, len(self.tokens)  # merges before ``until`` would join a and b
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < until:
                return False
            parts_a, parts_b = self.parts[a], self.parts[b]
            if parts_a is None and parts_b is None:
                return True
            if parts_b is None or (parts_a is not None and a > b):
                # The left token was completed last: before that, its right part stood at the boundary.
                until, a = a, parts_a[1]
            else:
                # A merge of the same kind at the left would have come first, so b itself still counts.
                until, b = b + 1, parts_b[0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, four bytes each) of distinct words, which must be sorted."""
        ids, ends, follows, tokens = self.ids.get, self.ends.get, self.follows, self.tokens
        last: list[int] = [-1]  # last[i]: last token of the first i bytes of the current path
        before, out, none = b"", [], ()
        for word in words:
            shared, end = 0, min(len(before), len(word))
            while shared < end and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                k = TAIL if i > TAIL else i
                while (found := ends(word[i - k : i], none)) is none and k > 1:
                    k -= 1
                for size, token in found:
                    start = i - size
                    if token is None and (start < 0 or (token := ids(word[start:i])) is None):
                        continue
                    if start:
                        left = last[start]
                        if (fits := follows[token].get(left)) is None:
                            fits = self.can_follow(left, token)
                        if not fits:
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, i = [], len(word)
            while i:
                path.append(last[i])
                i -= len(tokens[last[i]])
            out.append(np.array(path[::-1], "<u4").tobytes())
            before = word
        return out

    def _encoded(self, words: set[str], pieces: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of distinct words and pieces: those known, and one walk over the trie of the rest.

        A piece of one word is that word with a space before it, and is remembered as a piece alone.
        """
        made, new = self.pieces.look(pieces)
        # Letters alone are one word; with ASCII ones all versions of Unicode agree on that.
        several = {p: found for p in new if not (p.isascii() and p.isalpha()) and len(found := self.split(" " + p)) > 1}
        inner = {w for found in several.values() for w in found}
        # Words of several-word pieces and of texts that are pieces themselves are looked up there.
        spaced = {w[1:] for w in inner | words if w[:1] == " "} - pieces
        heads, unknown = self.pieces.look(spaced)
        plain, others = self.known.look({w for w in inner | words if w[:1] != " "})
        alone = [*(p for p in new if p not in several), *unknown]
        todo = sorted([*((b" " + p.encode(), p, True) for p in alone), *((w.encode(), w, False) for w in others)])
        ids = self.encode_words([b for b, _, _ in todo])
        fresh = {p: x for (_, p, spaced), x in zip(todo, ids, strict=True) if spaced}
        rest = {w: x for (_, w, spaced), x in zip(todo, ids, strict=True) if not spaced}
        made.update(fresh)
        plain.update(rest)
        heads.update(fresh)
        look = lambda w: plain[w] if w[:1] != " " else made[w[1:]] if w[1:] in made else heads[w[1:]]
        joined = {p: b"".join([look(w) for w in found]) for p, found in several.items()}
        made.update(joined)
        self.pieces.keep(fresh)
        self.pieces.keep(joined)
        self.known.keep(rest)
        return {w: look(w) for w in words}, made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts, four little-endian bytes for each.

        A text is cut before its spaces, which is always a word boundary unless
        white space stands on both sides; pieces are looked up as a whole. Texts
        with such spaces, and strings of added tokens, take the word pattern.
        """
        jobs: list[list] = []  # for each text: pieces, words, and bytes of added tokens
        pieces: set[str] = set()
        words: set[str] = set()
        for text in texts:
            parts: list[tuple] = []
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                parts += [("text", text[at : m.start()]), ("ids", np.array([self.added[m[0]]], "<u4").tobytes())]
                at = m.end()
            parts.append(("text", text[at:]))
            job = []
            for kind, part in parts:
                if kind == "ids":
                    job.append((kind, part))
                elif JOINED_SPACE.search(part):
                    found = self.split(part)
                    words.update(found)
                    job.append(("words", found))
                elif part:
                    first, *rest = part.split(" ")
                    found = self.split(first)
                    words.update(found)
                    pieces.update(rest)
                    job += [("words", found), ("pieces", rest)]
            jobs.append(job)
        ids, made = self._encoded(words, pieces)
        look = {"words": ids.__getitem__, "pieces": made.__getitem__}
        return [b"".join([p if k == "ids" else b"".join(map(look[k], p)) for k, p in job]) for job in jobs]

    def decode(self, ids: bytes) -> str:
        """Text of token ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _vocabulary(df: DataFrame, path: str):
    """The file's text for all executors; a vocabulary of more than 64 MB is refused."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(1 << 26)
        if f.read(1):
            raise ValueError("vocabulary files of over 64 MB are not sent to executors")
    return df.sparkSession.sparkContext.broadcast(spec)


def encode(
    df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, with_decoded: bool = False
) -> DataFrame:
    """Add ``n_tokens`` and ``token_ids`` (ids as little-endian unsigned 32-bit integers).

    ``vocabulary`` is a driver-side path to a byte-level BPE file with ``vocab`` and
    ``merges``. Null and empty texts have no tokens. With ``with_decoded`` the ids
    are decoded in the same pass into ``decoded``. What a task remembers of words goes with it, as Spark's workers
    live on for other work. Row-wise: no shuffle, one row out
    for each row in; columns named like the new ones are replaced.
    """
    spec = _vocabulary(df, vocabulary)
    fields = [StructField("n_tokens", LongType()), StructField("token_ids", BinaryType())]
    fields += [StructField("decoded", StringType())] * with_decoded

    def make():
        bpe = Bpe(spec.value)

        def work(texts):
            ids = bpe.encode(texts)
            return [[len(x) // 4 for x in ids], ids] + [[bpe.decode(x) for x in ids]] * with_decoded

        return work

    return map_texts(df, make, StructType(fields), text, keep)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``; null ids give the empty text."""
    spec = _vocabulary(df, vocabulary)

    def make():
        bpe = Bpe(spec.value)
        return lambda values: [[bpe.decode(x or b"") for x in values]]

    return map_texts(df, make, StructType([StructField("decoded", StringType())]), ids, keep)
