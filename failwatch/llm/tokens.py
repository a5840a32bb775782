"""Token ids of whole texts by a tokenizers file, distinct units once.

A unit starts at a run of ASCII blanks and at an ASCII mark after a letter, but for the apostrophe
and the characters of added tokens. Pre-tokenizers of byte-level and word BPE files never join text
across these places, so the ids of a text are those of its units in order. Where the character
before a run is itself a blank to Unicode, no unit starts. Units that the file's own rules make
equal (lower case, dropped blanks) are taken as one. The ids of known units are kept, within a
bound, for the next texts; when it is reached, those that came up again stay.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from failwatch.llm.words import LOWER, span_hashes

#: Units kept by a worker.
KEPT_UNITS = 1_500_000
#: Units encoded in one call.
CALL = 20_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First bytes of two-byte letters: U+00C0-027F and U+0400-047F, but for two signs and U+0130, in lower case a letter and a mark.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
_ODD = np.zeros(256, bool)
_ODD[[*range(9, 14), 28, 29, 30, 31, 32]] = True


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each of the places is surely a letter."""
    last = data[at - 1]
    lead = data[np.maximum(at - 2, 0)]
    other = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7)) | (lead == 0xC4) & (last == 0xB0)
    return _LETTER[last] | ((at > 1) & (last >= 0x80) & _LEAD[lead] & ~other)


def unit_starts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray = _MARK) -> np.ndarray:
    """Byte starts of all units, among them the first of every row that has text."""
    blank = _BLANK[data]
    start = blank.copy()
    start[1:] &= ~_ODD[data[:-1]]
    at = np.flatnonzero(start)
    # A blank in UTF-8 before the run: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-9, U+202F, U+205F, U+3000.
    high = at[(at > 0) & (data[at - 1] >= 0x80)]
    if len(high):
        one, two, three = data[high - 1], data[high - 2], data[np.maximum(high - 3, 0)]
        odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        odd |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
        odd |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
        odd |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
        odd |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
        start[high[odd]] = False
    mark = np.flatnonzero(marks[data[1:]]) + 1
    start[mark[_after_letter(data, mark)]] = True
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = True
    return np.flatnonzero(start)


class UnitTokenizer:
    """Ids of texts, by units that were seen before or are encoded now."""

    def __init__(self, path: str, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        # Whether the strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = _MARK.copy()
        self.marks[list("".join(self.added).encode("utf-8"))] = False
        with open(path, encoding="utf-8") as f:
            rule = json.load(f).get("normalizer") or {}
        kinds = [r["type"] for r in rule.get("normalizers", [rule]) if r]
        self.lowers = "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        # A file that gives a letter, a digit and a mark the same ids behind blanks drops blanks.
        self.drops_blanks = all(self._encode([x, f" {x}", f"\n\t {x}"]) == 3 * self._encode([x]) for x in "a7#")
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.firsts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def _keep_frequent(self):
        """Only the units that came up again since the last time stay, if they fill half the bound at most."""
        kept = np.flatnonzero(self.again)
        if len(kept) > KEPT_UNITS // 2:
            return self._forget()
        counts = self.counts[kept]
        ends = np.cumsum(counts)
        self.ids = self.ids[np.arange(int(counts.sum())) + np.repeat(self.firsts[kept] - ends + counts, counts)]
        self.keys, self.firsts, self.counts = self.keys[kept], ends - counts, counts
        self.again = np.zeros(len(kept), bool)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, spans: list[tuple[int, int]], raw: bytes) -> None:
        found: list[list[int]] = []
        for i in range(0, len(spans), CALL):
            found += self._encode([raw[a:b].decode("utf-8", "replace") for a, b in spans[i : i + CALL]])
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((t for x in found for t in x), np.uint32, int(counts.sum()))
        firsts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, flat])
        # Both key lists are sorted, so the new keys are let in without sorting all.
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.firsts = np.insert(self.firsts, at, firsts)
        self.counts = np.insert(self.counts, at, counts)
        self.again = np.insert(self.again, at, False)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def _plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes and starts of units with what the file makes equal written alike.

        A letter before a non-ASCII byte keeps its case: with a combining mark it may be another letter.
        So do all letters where lower case would make an added token out of ordinary text."""
        if self.lowers:
            lower = LOWER[data]
            lower[:-1] = np.where(data[1:] >= 0x80, data[:-1], lower[:-1])
            raw = lower.tobytes().lower()
            if not any(t.lower().encode("utf-8") in raw for t in self.added):
                data = lower
        if self.drops_blanks:
            words = np.append(np.flatnonzero(~_BLANK[data]), len(data))
            starts = np.minimum(words[np.searchsorted(words, starts)], ends - 1)
        return data, starts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the offset of each row in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = unit_starts(data, offsets, self.marks)
        ends = np.append(starts[1:], len(data))
        data, firsts = self._plain(data, starts, ends)
        keys, first, inverse = np.unique(span_hashes(data, firsts, ends), return_index=True, return_inverse=True)
        known = self._known(keys)
        if len(self.keys) + len(keys) - known.sum() > KEPT_UNITS:
            self._keep_frequent()
            known = self._known(keys)
        self.again[np.searchsorted(self.keys, keys[known])] = True
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(keys[new], list(zip(firsts[first[new]].tolist(), ends[first[new]].tolist())), data.tobytes())
        at = np.searchsorted(self.keys, keys)[inverse]
        counts, firsts = self.counts[at], self.firsts[at]
        ends_at = np.cumsum(counts)
        total = int(ends_at[-1])
        source = np.arange(total) - np.repeat(ends_at - counts - firsts, counts)
        units = np.searchsorted(starts, offsets)
        return self.ids[source], np.concatenate([[0], ends_at])[units]


@lru_cache(2)
def tokenizer(path: str) -> UnitTokenizer:
    """The worker's tokenizer of that file, with what it has learned.

    Its ids are those of the library's plain call, so a special token's string gets its one id.
    A task has one core, for which the library's own threads would only compete."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitTokenizer(path, special_as_text=False)
