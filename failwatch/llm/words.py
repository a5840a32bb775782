"""Vectorised word hashing over Arrow text columns, shared by the word-based operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_LONGEST = 1 << 20


def byte_table(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but space and the ASCII blanks.
BLANK_SEPARATED = byte_table(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and all non-ASCII bytes.
ALPHANUMERIC = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Blocks of scripts that set no blanks between words: Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(longest: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < longest:
        size = min(_LONGEST, max(256, 1 << (longest - 1).bit_length()))
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) with at most ``limit`` bytes, or one row.

    A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts_at = inside[1:-1] & ~inside[:-2]
    ends_at = inside[1:-1] & ~inside[2:]
    if len(edges):
        starts_at[edges] = inside[1:-1][edges]
        lasts = edges[1:] - 1
        ends_at[lasts] = inside[1:-1][lasts]
    starts = np.flatnonzero(starts_at)
    ends = np.flatnonzero(ends_at) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which must be ascending and disjoint."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    powers = _powers(int(lengths.max()))
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    source = place + np.repeat(starts, lengths)
    if len(powers) < lengths.max():
        place %= len(powers)
    values = (data[source].astype(np.uint64) + _U(1)) * powers[place]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, ASCII letters in lower case, and each row's first word."""
    starts, ends, rows = word_spans(data, offsets, table)
    return span_hashes(LOWER[data], starts, ends), rows


@lru_cache(1)
def letter_kinds() -> np.ndarray:
    """For every code point 0 (no part of a word), 1 (of a longer word) or 2 (a word by itself)."""
    kinds = np.array([unicodedata.category(chr(p))[0] in "LMN" for p in range(0x110000)], np.uint8)
    for first, last in UNSPACED:
        kinds[first : last + 1] *= 2
    return kinds


def letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans as of ``word_spans`` of runs of letters, digits and their marks in any script.

    A character of a script without blanks is a word; malformed bytes are read as some character."""
    kinds = ALPHANUMERIC[data].astype(np.uint8)
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = (data[wide] & 0xC0) != 0x80
        lead[0] = True
        at = wide[lead]
        b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in range(4)]
        two, three = ((b[0] & 0x1F) << 6) | b[1], ((b[0] & 0x0F) << 12) | (b[1] << 6) | b[2]
        four = ((b[0] & 0x07) << 18) | (b[1] << 12) | (b[2] << 6) | b[3]
        points = np.where(data[at] < 0xE0, two, np.where(data[at] < 0xF0, three, np.minimum(four, 0x10FFFF)))
        kinds[wide] = letter_kinds()[points][np.cumsum(lead) - 1]
    first = (data & 0xC0) != 0x80
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    inside, single = kinds > 0, kinds == 2
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1] | (first[1:] & (single[1:] | single[:-1]))
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts_at[edges] = inside[edges]
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:] | starts_at[1:]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row and their offsets.

    A row with fewer words than ``size`` has its whole sequence as its one shingle, a row
    without words none."""
    counts = np.diff(rows)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    firsts = np.cumsum(n) - n
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    at = np.arange(total) - np.repeat(firsts, n) + np.repeat(rows[:-1], n)
    words = np.repeat(np.minimum(counts, size), n)
    code = words.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        code = mix(code * _U(0xC2B2AE3D27D4EB4F) + np.where(k < words, padded[at + k], _U(0)))
    ends = firsts + n
    for a, b in zip(firsts.tolist(), ends.tolist()):
        if b - a > 1:
            code[a:b].sort()
    new = np.ones(total, bool)
    new[1:] = code[1:] != code[:-1]
    new[firsts[n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return code[new], kept[np.concatenate([firsts, [total]])]
