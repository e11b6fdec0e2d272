"""Words and their hashes over whole batches of UTF-8 texts, with numpy inside tasks.

A word is a run of bytes outside space and 0x09-0x0D; A-Z count as a-z. Both
rules concern ASCII bytes only, so working on UTF-8 bytes gives the same words
as working on characters. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240131).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


class Texts(NamedTuple):
    """Documents ``lo`` to ``hi`` of a batch: their bytes end to end and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    held = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(held):
        return
    _, bounds, data = held.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(held):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield Texts(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def pieces(data: np.ndarray, gap: np.ndarray = SPACE, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``size`` bytes of one text, cut before bytes of ``gap``; between two such bytes nothing is cut."""
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data):
            held = np.flatnonzero(gap[data[end : end + size]])
            if len(held):
                end += int(held[0])
                break
            end = min(len(data), end + size)
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


class Words(NamedTuple):
    """Every word of a run of texts: its text (from 0), its hash, its first byte and the byte after it."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the polynomial over random letters of any span can be read."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[LOWER[data]] * _power("up", _BASE, len(data)), out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    value = (sums[end] - sums[start]) * _power("down", _INVERSE, len(sums))[start]
    return mix(value + (end - start).astype(np.uint64))


def words(texts: Texts) -> Words:
    """All words with 64-bit hashes."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none)
    space = SPACE[data]
    full = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[full] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[ends - 1] = True
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, _hashes(_sums(data), start, end), start, end)


def prefixes(texts: Texts, found: Words, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: text and hash of the first ``size`` bytes of every longer word; never equal to a word's hash."""
    sums, out = _sums(texts.data), []
    for size in sizes:
        longer = found.end - found.start > size
        start = found.start[longer]
        out.append((found.doc[longer], mix(_hashes(sums, start, start + size) ^ np.uint64(size))))
    return out


def word_hash(word: bytes) -> int:
    """The hash :func:`words` gives to one word."""
    text = pa.array([word], pa.large_binary())
    return int(words(next(slices(text))).hash[0])


def _long_word(data: np.ndarray, size: int) -> int:
    """The hash of one word, taken from parts of ``size`` bytes."""
    total = 0
    for at in range(0, len(data), size):
        part = _LETTERS[LOWER[data[at : at + size]]]
        total += int((part * _power("up", _BASE, len(part))).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return int(mix(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0])


def word_hashes(data: np.ndarray, size: int = SLICE_BYTES) -> np.ndarray:
    """Hashes of the words of one text in order, as :func:`words` gives them, in memory of a few bytes for each byte of text.

    A long text is met in pieces; so is a word longer than a piece.
    """
    out = [np.zeros(0, np.uint64)]
    for a, b in pieces(data, size=size):
        if b - a > 2 * size:  # a word that begins in the first ``size`` bytes fills the rest
            blanks = np.flatnonzero(SPACE[data[a : a + size]])
            word = a + int(blanks[-1]) + 1 if len(blanks) else a
            out += [words(Texts(0, 1, data[a:word], np.array([0, word - a]))).hash, np.array([_long_word(data[word:b], size)], np.uint64)]
        else:
            out.append(words(Texts(0, 1, data[a:b], np.array([0, b - a]))).hash)
    return np.concatenate(out)
