"""Statistics of whole texts, computed over blocks of rows with numpy."""

from __future__ import annotations

import numpy as np

from ._core import Words, mix, span_hashes, sums_by_row

U = np.uint64
SYMBOLS = b"#*$%&|<>"
_HIGH = U(1) << U(32)
_LOW_MASK = _HIGH - U(1)
_bytes = np.arange(256)
_space = np.isin(_bytes, [0x20, *range(0x09, 0x0E)])


def _pair(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U) + (high.astype(U) << U(32))


_COUNTERS = {
    "chars_symbols": _pair(~_space & ((_bytes < 0x80) | (_bytes >= 0xC0)), np.isin(_bytes, list(SYMBOLS))),
    "upper_digits": _pair((_bytes >= 65) & (_bytes <= 90), (_bytes >= 48) & (_bytes <= 57)),
    "bars_bangs": _pair(_bytes == ord("|"), _bytes == ord("!")),
}


def byte_counts(words: Words, which: str) -> tuple[np.ndarray, np.ndarray]:
    """Two counters of one byte table by row."""
    total = sums_by_row(_COUNTERS[which][words.raw], words.offsets)
    return (total & _LOW_MASK).astype(np.int64), (total >> U(32)).astype(np.int64)


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether its key occurs elsewhere in its row, and whether it is a later one in sorted order."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(key ^ mix(row.astype(U) + U(0x632BE59BD9B4E019)))
    by = np.argsort(own, kind="stable")
    same = np.concatenate(([False], own[by][1:] == own[by][:-1]))
    later = np.empty(len(key), bool)
    later[by] = same
    some = np.empty(len(key), bool)
    some[by] = same | np.concatenate((same[1:], [False]))
    return some, later


def repeated_words(words: Words, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each row inside windows of width words that the row has twice or more."""
    count = np.maximum(words.count - width + 1, 0)
    at = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(words.rows[:-1] - at[:-1], count) + np.arange(at[-1])
    row = np.repeat(np.arange(len(count)), count)
    key = np.zeros(len(first), U)
    for k in range(width):
        key = mix(key * U(0xFF51AFD7ED558CCD) + hashes[first + k])
    some, _ = _repeats(key, row)
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, first[some] + width, -1)
    return sums_by_row((np.cumsum(edge[:-1]) > 0).astype(np.int64), words.rows)


def lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """By row: lines that have a word, and those of them equal to an earlier line."""
    n_rows = len(words.count)
    cut = np.flatnonzero(words.raw == 10)
    filled = np.flatnonzero(np.diff(words.offsets) > 0)
    start = np.concatenate((words.offsets[:-1][filled], cut + 1))
    row = np.concatenate((filled, np.searchsorted(words.offsets, cut, "right") - 1))
    by = np.lexsort((start, row))
    start, row = start[by], row[by]
    end = np.sort(np.concatenate((words.offsets[1:][filled], cut)))
    used = (np.searchsorted(words.start, end) > np.searchsorted(words.start, start)) & (end > start)
    start, end, row = start[used], end[used], row[used]
    _, later = _repeats(span_hashes(words.raw, start, end), row)
    return np.bincount(row, minlength=n_rows), np.bincount(row[later], minlength=n_rows)


def distinct_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    _, later = _repeats(hashes, words.row_of())
    return words.count - sums_by_row(later.astype(np.int64), words.rows)


def adjacent_repeats(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words equal to the word before them."""
    same = np.zeros(len(hashes), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[words.rows[:-1][words.count > 0]] = 0
    return sums_by_row(same, words.rows)
