"""Encoding of long texts in pieces that a tokenizer treats independently, each distinct piece once per worker.

A text is cut only at safe boundaries, where the library's own split can never join the two sides:

* before a space or line feed that follows something else than a blank. The library's patterns never join a blank to what
  stands before it, and a run of blanks stays whole with the word after it.
* a piece that is long without such a boundary: before `.,;:!?` and the like after a letter, where both patterns end a run
  of letters. A run of letters itself (some scripts have no blanks) is one token to the library's split and stays whole.
* vocabulary that drops blanks: at every space and line feed.

Special strings hold no blanks and none of these marks, so no cut falls inside one. Trailing `.,;:!?#$%&*` of a word may be cut
off too. What is not cached goes to the library in batches balanced by bytes; words of Latin-1 letters, which its normalizer
and split leave whole, go right to its model. The cache holds so many short pieces at most.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Callable, Iterable
from itertools import islice

from deltaloom.llm.common import hold, slices  # noqa: F401

BATCH_BYTES = 1 << 20
CACHE_ENTRIES = 800_000
#: Characters of a piece that is cached at most, and of one that is not cut further.
CACHED, LONG = 64, 256

#: Words on which an encoder is tried before it goes past the library's split.
PROBES = "the The THE hello Hello world international internationalization Straße straße ÜBER über señor École naïve façade pneumonoultramicroscopic s t re ve m ll d S T RE VE M LL D xqzjk".split()

#: Letters that lower case or NFC end in a combining mark, which the split joins to marks that follow.
OPEN = "\u0130\u0958-\u095f\u09dc-\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c-\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40-\ufb41\ufb43-\ufb44\ufb46-\ufb4e"

_TOUCHING = re.compile(r"\s[ \n]").search
_BEFORE_BLANKS = re.compile(r"(?<=\S)(?=[ \n])").split
_BEFORE_MARKS = re.compile(rf"(?<=[^\W\d_{OPEN}])(?=[.,;:!?。，、！？；：…،؛؟।॥])").split
_WORD_END = re.compile(rf"([^\W\d_]*[^\W\d_{OPEN}])([.,;:!?#$%&*]+)").fullmatch
_SPACED_WORD_END = re.compile(rf"([ \n]?[^\W\d_]*[^\W\d_{OPEN}])([.,;:!?#$%&*]+)").fullmatch
#: Letters whose words need no split: composed, one lower-case letter each, none in a special string.
LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if chr(c).isalpha()]
_WORD = re.compile(f"([{''.join(LETTERS)}]{{1,{CACHED}}})([.,;:!?#$%&*]*)").fullmatch
_SPACED_WORD = re.compile(f"([ \\n]?[{''.join(LETTERS)}]{{1,{CACHED - 1}}})([.,;:!?#$%&*]*)").fullmatch


def load(name: str):
    """The library's tokenizer for a vocabulary file of public_tokenizers, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def cut_long(pieces: list[str]) -> list[str]:
    return [x for p in pieces for x in (_BEFORE_MARKS(p) if len(p) > LONG else (p,))] if max(map(len, pieces)) > LONG else pieces


def cut_byte_level(text: str) -> list[str]:
    if _TOUCHING(text) or "\0" in text:
        return cut_long(_BEFORE_BLANKS(text))
    return cut_long(text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"))


def cut_blank_dropping(text: str) -> list[str]:
    # special strings are matched as they stand, before the vocabulary lower-cases
    if text.isascii() and "<|" not in text:
        text = text.lower()
    return cut_long(text.replace("\n", " ").split(" "))


def byte_letters() -> dict[int, str]:
    """For str.translate: blanks and LETTERS as the byte-level alphabet writes their UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {ord(c): "".join(letter[b] for b in c.encode()) for c in [" ", "\n", *LETTERS]}


class Encoder:
    """Maps texts to what `fold` makes of their pieces' values; `make` gives a piece's value (its length, or its ids as bytes)."""

    def __init__(self, name: str, make: Callable[[list[int]], object], join: Callable[[object, object], object], fold: Callable[[Iterable], object]):
        self.tokenizer, self.make, self.join, self.fold = load(name), make, join, fold
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        drops_blanks = ids(" a b ") == ids("a b")
        self.cut = cut_blank_dropping if drops_blanks else cut_byte_level
        self.word_end = _WORD_END if drops_blanks else _SPACED_WORD_END
        self.known: dict[str, object] = {}
        # the model alone, where it gives on words what the library gives
        self.model, self.letters, self.lower = self.tokenizer.model, byte_letters(), drops_blanks
        self.word = _WORD if drops_blanks else _SPACED_WORD
        starts = [""] if drops_blanks else ["", " ", "\n"]
        probes = [s + w for s in starts for w in (*LETTERS, *(a + b for a in LETTERS for b in LETTERS[::7]), "".join(LETTERS), "".join(LETTERS[::-1]), *PROBES)]
        plain = all(re.search(r"[^\w\s]", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        if not plain or self._words(probes) != [e.ids for e in self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)]:
            self.word = lambda p: None

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of words of LETTERS, from the library's model."""
        if not words:
            return []
        text, tokens = "\0".join(words), self.model.tokenize
        shown = (text.lower() if self.lower else text).translate(self.letters).split("\0")
        return [[t.id for t in tokens(w)] for w in shown]

    def _learn(self, new: Iterable[str]) -> None:
        known, tails, plain, words = self.known, [], set(), set()
        whole, word = self.word_end, self.word
        for p in new:
            if m := word(p):
                w, end = m.groups()
                words.add(w)
                if end:
                    tails.append((p, w, end))
                    plain.add(end)
            elif m := whole(p):
                tails.append((p, m[1], m[2]))
                plain.update(m.groups())
            else:
                plain.add(p)
        words = list(words.difference(known))
        known.update(zip(words, map(self.make, self._words(words))))
        batch, size = [], 0
        for p in plain.difference(known):
            batch.append(p)
            size += len(p) if p.isascii() else 4 * len(p)
            if size >= BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)
        for p, word, end in tails:
            known[p] = self.join(known[word], known[end])

    def _encode(self, batch: list[str]) -> None:
        if batch:
            for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                self.known[p] = self.make(e.ids)

    def values(self, texts: list[str]) -> list:
        """For each text, its pieces' values, folded."""
        if len(self.known) > CACHE_ENTRIES:
            # what was learnt first is met most often
            self.known = dict(islice(self.known.items(), CACHE_ENTRIES * 3 // 4))
        collects = gc.isenabled()
        gc.disable()  # millions of strings and no cycles: the collector would only walk them
        try:
            ends, flat = [0], []
            for pieces in map(self.cut, texts):
                flat += pieces
                ends.append(len(flat))
            found = list(map(self.known.get, flat))
            if None in found:
                missed = [i for i, v in enumerate(found) if v is None]
                new = {flat[i] for i in missed}
                self._learn(new)
                at = self.known.__getitem__
                for i in missed:
                    found[i] = at(flat[i])
                for p in new:
                    if len(p) > CACHED:
                        self.known.pop(p, None)
            fold = self.fold
            return [fold(found[i:j]) for i, j in zip(ends, ends[1:])]
        finally:
            if collects:
                gc.enable()


_encoders: dict[tuple[str, str], Encoder] = {}


def counter(name: str) -> Encoder:
    """Gives lengths only; kept for the worker's next tasks."""
    hold("counts", _encoders.clear)
    if ("n", name) not in _encoders:
        _encoders["n", name] = Encoder(name, len, int.__add__, sum)
    return _encoders["n", name]


def ids(name: str) -> Encoder:
    """Gives ids as little-endian bytes, 2 bytes each where the vocabulary allows and else 4."""
    hold(f"ids {name}", _encoders.clear)
    if ("ids", name) not in _encoders:
        kind = "H" if id_kind(name) == "<u2" else "I"
        _encoders["ids", name] = Encoder(name, lambda x: struct.pack(f"<{len(x)}{kind}", *x), bytes.__add__, b"".join)
    return _encoders["ids", name]


_kinds: dict[str, str] = {}


def id_kind(name: str) -> str:
    if name not in _kinds:
        _kinds[name] = "<u2" if load(name).get_vocab_size() <= 1 << 16 else "<u4"
    return _kinds[name]
