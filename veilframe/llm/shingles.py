"""Sets of hashed word shingles of whole texts, a batch at a time in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veilframe.llm.textio import slices_by_bytes, text_buffer, text_offsets

_STEP, _RANGE_BYTES = np.uint64(0x9E3779B97F4A7C15), 900_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z as a-z; and which bytes are blanks."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return lower, blank


def word_hashes(data: np.ndarray, starts: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that begin at `starts` in data, and the number of the text it is in."""
    hashes, owner, _, _ = placed_word_hashes(data, starts, blank)
    return hashes, owner


def placed_word_hashes(data: np.ndarray, starts: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(), and where each word begins and ends in data. blank: which bytes part words, the six ASCII blanks by default."""
    begin, end = word_places(data, starts, blank)
    (hashes,) = span_hashes(data, begin, end, (0,))
    return hashes, np.searchsorted(starts, begin, "right") - 1, begin, end


def word_places(data: np.ndarray, starts: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts that begin at `starts` in data begins and ends."""
    blank = _byte_tables()[1] if blank is None else blank
    word = ~blank[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = starts[starts < len(data)]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed a hash of each data[begin[i]:end[i]], A-Z as a-z.

    A span is read in pieces of eight bytes. Each piece is mixed with its place, which no polynomial does, before
    the pieces are summed, so that no two spans share a hash by their structure.
    """
    lower = np.zeros(len(data) + 8, np.uint8)
    lower[: len(data)] = _byte_tables()[0][data]
    at_byte = np.ndarray((len(data) + 1,), "<u8", lower, strides=(1,))
    count = -(-(end - begin) // 8)
    many = bool((count > 1).any())
    if many:
        own = np.repeat(np.arange(len(begin)), count)
        place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[own] + 8 * place
        left = np.minimum(end[own] - at, 8)
    else:
        place, at, left = np.zeros(len(begin), np.int64), begin, end - begin
    value = at_byte[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))
    out = []
    for seed in seeds:
        salt = mix64(np.array([seed * 2 + 1], np.uint64) * _STEP)[0]
        mixed = mix64(mix64(value ^ salt) + mix64((place + 1).astype(np.uint64) * _STEP + salt))
        if many:
            mixed = np.add.reduceat(mixed, np.cumsum(count) - count) if len(mixed) else mixed
        out.append(mix64(mixed + (end - begin).astype(np.uint64) * _STEP))
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes as uint64) of every row.

    A shingle is k consecutive words, A-Z as a-z; a text of fewer words has one, all its words; a null or a text
    without words has none. Words are parted by the six ASCII blanks.
    """
    for row, (grams,) in _gram_rows(texts, k, (0,)):
        yield row, np.unique(grams)


def digested_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, tuple[int, int]]]:
    """As shingle_sets(), and two signed 64-bit numbers that stand for the set. The second comes from hashes of its own,
    so that equal numbers mean equal sets but for a chance of 2 ** -128, whatever two sets are compared."""
    for row, (grams, others) in _gram_rows(texts, k, (0, 1)):
        tokens, at = np.unique(grams, return_index=True)
        yield row, tokens, (_sum_of(tokens), _sum_of(others[at]))


def _sum_of(tokens: np.ndarray) -> int:
    total = mix64(tokens + _STEP).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(total.view(np.int64))


def _gram_rows(texts: pa.Array, k: int, seeds: tuple[int, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, for each seed the hashes of its shingles in order of place)."""
    offsets, data = text_offsets(texts), text_buffer(texts)
    for low, high in slices_by_bytes(texts, _RANGE_BYTES, 1 << 16):
        part = data[offsets[low] : offsets[high]]
        none = np.zeros(0, np.uint64)
        if not len(part):
            yield from ((row, [none for _ in seeds]) for row in range(low, high))
            continue
        starts = offsets[low:high] - offsets[low]
        begin, end = word_places(part, starts)
        owner = np.searchsorted(starts, begin, "right") - 1
        bounds = np.searchsorted(owner, np.arange(high - low + 1))
        n = len(begin) - k + 1
        words, grams = span_hashes(part, begin, end, seeds), []
        weights = [mix64(np.arange(101 + 1000 * seed, 101 + 1000 * seed + k, dtype=np.uint64) * _STEP) | np.uint64(1) for seed in seeds]
        for own, weight in zip(words, weights, strict=True):
            total = np.zeros(max(n, 0), np.uint64)
            for j in range(k if n > 0 else 0):
                total += own[j : j + n] * weight[j]
            grams.append(mix64(total))
        for row in range(low, high):
            a, b = bounds[row - low], bounds[row - low + 1]
            if b - a >= k:
                yield row, [g[a : b - k + 1] for g in grams]
            elif b > a:
                yield row, [mix64(np.array([int((own[a:b] * weight[: b - a]).sum(dtype=np.uint64)) ^ int(b - a)], np.uint64)) for own, weight in zip(words, weights, strict=True)]
            else:
                yield row, [none for _ in seeds]
