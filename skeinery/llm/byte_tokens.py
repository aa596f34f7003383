"""Ids of whole texts by a byte-level tokenizer, through a memory of pieces.

A byte-level tokenizer cuts a text by one pattern and encodes each piece by itself, so a text's ids are its pieces' ids in
order, and a piece that a worker has met needs no second encoding. Texts with a special token's mark, or with characters
whose class could differ between two versions of Unicode's tables, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

from skeinery.llm import packing

# Fixed value: the pattern that byte-level tokenizers of this family cut by, for texts that ``_UNSURE`` doesn't find anything in.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Special marks, separators that only some call white space, numbers that aren't digits, and all beyond the letters that
#: every version of Unicode's tables knows.
_UNSURE = re.compile("<\\||[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: Those of them that a text of ASCII can have.
_UNSURE_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: A blank that doesn't begin a piece, or not surely.
_LOOSE = re.compile(r" (?:\s|$)")
#: Marks that are pieces of their own where they end a word of letters.
_ENDS = frozenset(".,;:!?)")
#: A blank between two letters: a piece surely begins there.
_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")

#: Words, and pieces, that a worker remembers. Words are in two halves: what isn't asked for while the newer one fills is forgotten.
REMEMBERED = 800_000


def unsure(text: str) -> bool:
    return any(mark in text for mark in _UNSURE_ASCII) if text.isascii() else bool(_UNSURE.search(text))


class PieceIds:
    """Calling it with texts gives each one's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.words, self.older = Tokenizer.from_file(path), {}, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the blank, as byte-level vocabularies write it
        self.line_break = vocabulary.get("\u010a")  # as byte-level vocabularies write it
        plan = json.loads(self.tokenizer.to_str())
        pre = plan.get("pre_tokenizer") or {}
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not plan.get("normalizer")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_pieces or unsure(t)]
        for i, ids in zip(whole, self.encode([texts[i] for i in whole]) if whole else []):
            out[i] = ids
        short = [i for i, ids in enumerate(out) if ids is None and len(texts[i]) <= packing.AT_ONCE]
        for i, ids in zip(short, self.of([texts[i] for i in short])):
            out[i] = ids
        return [b"".join(self.of([part])[0] for part in slices(t)) if ids is None else ids for t, ids in zip(texts, out)]

    def of(self, texts: list[str]) -> list[bytes]:
        """A blank before anything but white space begins a piece, so a text is its words, each with the blank before it."""
        if len(self.words) > REMEMBERED // 2:
            self.words, self.older = {}, self.words
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [[t] if _LOOSE.search(t) else t.split(" ") for t in texts]
        heads = [PIECES.findall(words[0]) for words in split]
        new = self.unknown(set().union(*(words[1:] for words in split)))
        letters = {w for w in new if w.isalpha()}
        ended = {w for w in new - letters if w[-1:] in _ENDS and w[:-1].isalpha()}
        cut = {w: PIECES.findall(" " + w) for w in new - letters - ended}
        self.learn(set().union(*heads, *cut.values(), _ENDS))
        self.learn_letters([*letters, *self.unknown({w[:-1] for w in ended}.difference(letters))])
        known, word = self.known.__getitem__, self.words.__getitem__
        self.words.update([(w, word(w[:-1]) + known(w[-1])) for w in ended])
        self.words.update((w, known(pieces[0]) if len(pieces) == 1 else b"".join(map(known, pieces))) for w, pieces in cut.items())
        return [b"".join([*map(known, head), *map(word, words[1:])]) for head, words in zip(heads, split)]

    def unknown(self, words: set[str]) -> set[str]:
        """Those of ``words`` that aren't in memory; what the older half has goes to the newer one."""
        new = words.difference(self.words)
        again = {w: self.older[w] for w in new if w in self.older} if self.older else {}
        self.words.update(again)
        return new.difference(again)

    def learn_letters(self, words: list[str]) -> None:
        """Have the ids of words of letters, with the blank before them, in memory. They are encoded together: only a word's first token begins with the blank."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.frombuffer(self.encode([" " + " ".join(part)])[0], "<u4")
            cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
            data = ids.tobytes()
            self.words.update(zip(part, [data[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], None])]) if len(cuts) == len(part) else zip(part, self.encode([" " + w for w in part])))

    def learn(self, pieces: set[str]) -> None:
        """Have the ids of ``pieces`` in memory. Letters with a blank, and letters alone, are encoded together, the latter with line breaks between them."""
        new = pieces.difference(self.known)
        words = {p: p[1:] for p in new if p[0] == " " and p[1:].isalpha()}
        self.learn_letters([*self.unknown(set(words.values()))])
        self.known.update((p, self.words[w]) for p, w in words.items())
        bare = [p for p in new if p.isalpha()]
        for at in range(0, len(bare), 1000):
            part = bare[at : at + 1000]
            data = self.encode(["\n".join(part)])[0]
            ids = np.frombuffer(data, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.line_break)).tolist() if self.line_break is not None else []
            if len(cuts) == len(part) - 1:
                self.known.update(zip(part, [data[lo:hi] for lo, hi in zip([0, *(c + 4 for c in cuts)], [*cuts, None])]))
        others = [p for p in new if p not in self.known]
        for at in range(0, len(others), 1000):
            self.known.update(zip(others[at : at + 1000], self.encode(others[at : at + 1000])))


def slices(text: str, at_once: int = packing.AT_ONCE) -> Iterator[str]:
    """A long text in parts that end where a piece surely ends, so that not all its pieces are in memory at once."""
    at = 0
    while len(text) - at > at_once:
        m = _CUT.search(text, at + at_once)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@cache
def ids_by(path: str) -> PieceIds:
    """One memory for a worker process, kept from task to task."""
    return PieceIds(path)
