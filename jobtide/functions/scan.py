"""Vocabulary terms in whole Arrow batches: one pass of an automaton over all texts, edges tested as vectors.

The texts of a batch are joined (a code point that no text uses stands between them), the automaton of all terms runs over
them once, and its hits become arrays: which text, which term, where. Whether the neighbours of a hit let it count is
decided for all hits at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

SEPARATORS = " \t\r\n,，、;；|/()（）:：。."
#: Characters joined at a time; a longer text is joined alone.
JOINED = 1 << 21
_APART = 0x10FFFF
_ALNUM, _LEFT, _RIGHT, _SEP, _WORD = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What every code point is: ASCII letter or digit, sign beside a short term, separator, part of a word."""
    out = np.fromiter((_WORD if chr(c).isalnum() else 0 for c in range(0x110000)), np.uint8, 0x110000)
    for c in range(128):
        out[c] |= _ALNUM if chr(c).isalnum() else 0
    for signs, bit in (("+#&.", _LEFT), ("+#&", _RIGHT), (SEPARATORS, _SEP), ("_", _WORD)):
        out[[ord(c) for c in signs]] |= bit
    out[_APART] = _SEP  # the edge of a text
    return out


@dataclass
class Hits:
    """Occurrences of terms: text, term (place in the vocabulary), first and last place + 1 in the text."""

    text: np.ndarray
    term: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Scan:
    """All terms of a vocabulary, with the rule for their edges (``ascii_edge``, ``unicode_word``, ``sep_or_word``, ``sep_only``)."""

    def __init__(self, terms: tuple[str, ...], mode: str = "ascii_edge") -> None:
        import ahocorasick

        if mode not in ("ascii_edge", "unicode_word", "sep_or_word", "sep_only"):
            raise ValueError(mode)
        self.mode, self.terms = mode, terms
        same: dict[str, list[int]] = {}
        for k, term in enumerate(terms):
            if term:
                same.setdefault(lowered(term), []).append(k)
        self.machine = ahocorasick.Automaton()
        for k, word in enumerate(same):
            self.machine.add_word(word, k)
        if same:
            self.machine.make_automaton()
        self.size = np.array([len(w) for w in same], np.int64)
        self.many = np.array([len(v) for v in same.values()], np.int64)
        self.flat = np.array([k for v in same.values() for k in v], np.int64)

    def hits(self, texts: list[str | None]) -> Hits:
        """Occurrences in order of place, longer ones first at the same start."""
        parts = [self._joined(first, some) for first, some in _runs(texts)] if len(self.size) else []
        names = ("text", "term", "start", "end")
        return Hits(*(np.concatenate([getattr(p, n) for p in parts]) if parts else np.zeros(0, np.int64) for n in names))

    def _joined(self, first: int, texts: list[str]) -> Hits:
        whole = chr(_APART) + chr(_APART).join(texts) + chr(_APART)
        found = np.fromiter(chain.from_iterable(self.machine.iter(whole)), np.int64).reshape(-1, 2)
        # Words that end inside a longer hit of the automaton come as hits of their own.
        last, word = found[:, 0], found[:, 1]
        start = last + 1 - self.size[word]
        kinds = _kinds()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ok = self._edges(kinds[start - 1], kinds[start], kinds[last], kinds[last + 1], self.size[word])
        last, word, start = last[ok], word[ok], start[ok]
        order = np.lexsort((-last, start))
        last, word, start = last[order], word[order], start[order]
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(offsets, start, "right") - 1
        many = self.many[word]
        base = (np.cumsum(self.many) - self.many)[word]
        term = self.flat[np.repeat(base - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        place = start - offsets[text]
        return Hits(np.repeat(text + first, many), term, np.repeat(place, many), np.repeat(place + last + 1 - start, many))

    def _edges(self, left: np.ndarray, head: np.ndarray, tail: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        has = lambda x, bit: (x & bit) != 0
        if self.mode == "ascii_edge":
            bad = has(head & left, _ALNUM) | has(tail & right, _ALNUM)
            return ~bad & ~((size <= 2) & (has(left, _LEFT) | has(right, _RIGHT)))
        bound = lambda a, b: has(a, _WORD) != has(b, _WORD)
        if self.mode == "unicode_word":
            return bound(left, head) & bound(tail, right)
        if self.mode == "sep_or_word":
            return (has(left, _SEP) | bound(left, head)) & (has(right, _SEP) | bound(tail, right))
        return has(left, _SEP) & has(right, _SEP)


@lru_cache(maxsize=16)
def scan_of(terms: tuple[str, ...], mode: str = "ascii_edge") -> Scan:
    """One automaton a worker and vocabulary."""
    return Scan(terms, mode)


def lowered(text: str) -> str:
    """Lower case with every character in its place (a few have two small ones; they stay)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, some, size = 0, [], 0
    for k, text in enumerate(texts):
        text = lowered(text or "")
        if some and size + len(text) > JOINED:
            yield first, some
            first, some, size = k, [], 0
        some.append(text)
        size += len(text) + 1
    if some:
        yield first, some


def named(texts: int, text: np.ndarray, name: np.ndarray, names: list[str]) -> pa.ListArray:
    """For each of ``texts`` rows the distinct names (places in ``names``) in that order."""
    both = np.unique(text * np.int64(max(1, len(names))) + name)
    row, name = both // max(1, len(names)), both % max(1, len(names))
    offsets = np.searchsorted(row, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names, pa.string()).take(pa.array(name)))


def longest(h: Hits) -> np.ndarray:
    """Places of the hits that a reader takes who goes from left to right, takes the longest at each place and never goes back."""
    kept, text, until = [], -1, 0
    for k, (t, start, end) in enumerate(zip(h.text.tolist(), h.start.tolist(), h.end.tolist(), strict=True)):
        if t != text:
            text, until = t, 0
        if start >= until:
            kept.append(k)
            until = end
    return np.array(kept, np.int64)
