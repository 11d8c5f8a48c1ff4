"""Whole-text encoding with the tokenizers library, remembered word by word.

A byte-pair tokenizer cuts a text before it merges, and none of its cuts lies inside a
word. So the ids of a text are the ids of its words in order, and a word that was seen
before need not be merged again. Texts whose white space could be cut in more than one
way (two spaces in a row, a space beside a line break) are encoded as a whole instead.
"""

from __future__ import annotations

import re
import sys
from array import array

from .common import HELD

#: Words that a worker remembers.
CACHE_WORDS = 200_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable ones stand for
    themselves, the others follow from 256 on in ascending order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class _Known(dict):
    """Words and their ids; `more` has those of this batch that did not fit."""

    more: dict[str, bytes | None] = {}

    def __missing__(self, word: str) -> bytes | None:
        return self.more[word]


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    path: a tokenizer file. No special tokens are added around a text.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.limit = cache_words
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # Does a word's leading space belong to its first token? Ask the tokenizer itself.
        self.spaced = self._whole("a b") != self._whole("a") + self._whole("b")
        self.lower = self._whole("Q") == self._whole("q")
        self.lead = " " if self.spaced else ""
        self.shown_lead = self.letters[32] if self.spaced else ""
        self.break_ids = self._whole("\n")
        self.plain = self._plain_works()
        self._restart()

    def _restart(self) -> None:
        self.words = _Known()  # ids of a word that follows a space
        self.firsts: dict[str, bytes] = {}  # ids of a word at the start of a line
        self.tails: dict[str, bytes] = {}  # ids of punctuation at a word's end

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain_works(self) -> bool:
        """Whether merging a bare word gives what encoding it gives, tried on a few."""
        tries = ["word", "Straße", "été", "QUERY", "niños", "internationalisation", "xqzkw", "a"]
        return sys.byteorder == "little" and all(self._merge(w) == self._whole(self.lead + w) for w in tries)

    def _merge(self, word: str) -> bytes:
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(self.shown_lead + word)]).tobytes()

    def _learn(self, pieces: set[str]) -> dict[str, bytes | None]:
        """Ids of words not remembered; None for one that must not be cut out of its text."""
        found: dict[str, bytes | None] = {}
        rest = []
        for p in pieces:
            m = _PLAIN.fullmatch(p) if self.plain else None
            if m:
                word, tail = m.groups()
                if not tail:
                    found[p] = self._merge(word)
                    continue
                if (end := self.tails.get(tail)) is None:
                    end = self.tails[tail] = self._whole(tail)
                kept = self.words.get(word)
                found[p] = (self._merge(word) if kept is None else kept) + end
            elif not p or p[0].isspace() or p[-1].isspace():
                found[p] = None
            else:
                rest.append(p)
        if rest:
            for p, e in zip(rest, self.tok.encode_batch_fast([self.lead + p for p in rest], add_special_tokens=False)):
                found[p] = array("I", e.ids).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; a null text has none."""
        cut: list[list[list[str]] | None] = []
        seen: set[str] = set()
        count = 0
        for text in texts:
            if not text or any(s in text for s in self.specials):
                cut.append(None)
                continue
            cut.append(lines := [x.split(" ") for x in text.split("\n")])
            for line in lines:
                seen.update(line)
                count += len(line)
        missing = seen.difference(self.words)
        if len(self.words) >= self.limit and 2 * len(missing) > count:
            self._restart()  # other words than before
            missing = seen
        found = self._learn(missing)
        if len(self.words) < self.limit:
            self.words.update(found)
        else:
            self.words.more = found
        out = []
        for text, lines in zip(texts, cut):
            ids = self._join(lines) if lines else None
            out.append(ids if ids is not None else self._whole(text) if text else b"")
        self.words.more = {}
        return out

    def _join(self, lines: list[list[str]]) -> bytes | None:
        """None if a cut of this text would not be safe."""
        get = self.words.__getitem__
        parts: list[bytes] = []
        for k, line in enumerate(lines):
            ids = [*map(get, line)]
            if None in ids:
                return None
            if k:
                parts.append(self.break_ids)
            if self.spaced:
                first = line[0]  # no space before it
                if (kept := self.firsts.get(first)) is None:
                    kept = self._whole(first)
                    if len(self.firsts) < self.limit // 4:
                        self.firsts[first] = kept
                ids[0] = kept
            parts += ids
        return b"".join(parts)


_OF: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file in each worker process."""
    if path not in _OF:
        _OF[path] = WordEncoder(path)
    HELD["tokens"] = _OF.clear
    return _OF[path]
