"""Counts of texts that quality rules and classifiers start from, a block at a time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from cellzonal.llm.text import TERM_BYTE, WORD_BYTE, mix, word_hashes

# Frequent function words by language, in their usual spelling.
COMMON = {
    "en": "the of and to in is for that with as on are by this be it was at from or an a not have has",
    "fr": "le la les de des du et un une que qui pour par sur avec dans est au en ne pas plus ce se",
    "de": "der die das und ist im in den von mit zu auf für nicht sich dem des ein eine als auch an",
    "es": "el la los las de del y que en un una por con para se su es al no lo como más o esta",
}
WORDS = tuple(dict.fromkeys(" ".join(COMMON.values()).split()))
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "wide")
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SYMBOL, OTHER, WIDE = range(len(CLASSES))


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0xC0:
        return WIDE
    if b >= 0x80:
        return len(CLASSES)  # the rest of a character counted before
    if b in SYMBOLS:
        return SYMBOL
    if c.islower():
        return LOWER
    if c.isupper():
        return UPPER
    if c.isdigit():
        return DIGIT
    if c == "\n":
        return LINE
    if not WORD_BYTE[b]:
        return SPACE
    return STOP if c in ".,;:!?'\"-()" else OTHER


_CLASS = np.array([_class_of(b) for b in range(256)])
_FIRST_BYTE = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    rows = [w.encode() for w in words]
    data = np.frombuffer(b"".join(rows), np.uint8)
    return word_hashes(data, np.cumsum([0, *map(len, rows)]), TERM_BYTE)[0]


_COMMON_HASHES = _hash_words(WORDS)
_COMMON_ORDER = np.argsort(_COMMON_HASHES)
_COMMON_SORTED = _COMMON_HASHES[_COMMON_ORDER]


class Profile(NamedTuple):
    """One entry, or line, for each text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    distinct_words: np.ndarray
    classes: np.ndarray
    common: np.ndarray


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _table(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    flat = np.bincount(rows * shape[1] + columns, minlength=shape[0] * shape[1])
    return flat.reshape(shape)


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def profile(data: np.ndarray, at: np.ndarray) -> Profile:
    n = len(at) - 1
    words, bounds = word_hashes(data, at, lower=False)
    repeat, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        windows = (
            mix(words[:-2] * np.uint64(3) + mix(words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)))
            if len(words) > 2
            else np.empty(0, np.uint64)
        )
    raw = data.tobytes()
    lines = np.zeros(n, np.int64)
    for row in range(n):
        a, b = bounds[row], bounds[row + 1]
        lines[row] = _duplicate_lines(raw[at[row] : at[row + 1]])
        distinct[row] = len(np.unique(words[a:b]))
        if b - a < 4:
            continue
        _, place, times = np.unique(windows[a : b - 2], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[place] > 1)
        if len(twice):
            mark = np.zeros(b - a, bool)
            mark[twice] = mark[twice + 1] = mark[twice + 2] = True
            repeat[row] = mark.sum()
    row_of = np.repeat(np.arange(n), np.diff(at))
    kinds = _CLASS[data]
    classes = _table(row_of, kinds, (n, len(CLASSES) + 1))[:, :-1]
    spoken, term_at = word_hashes(data, at, TERM_BYTE)
    found = np.minimum(np.searchsorted(_COMMON_SORTED, spoken), len(WORDS) - 1)
    is_common = _COMMON_SORTED[found] == spoken
    column = np.where(is_common, _COMMON_ORDER[found], len(WORDS))
    term_row = np.repeat(np.arange(n), np.diff(term_at))
    return Profile(
        np.diff(bounds),
        _per_row(WORD_BYTE[data] & _FIRST_BYTE[data], at),
        _per_row(kinds == SYMBOL, at),
        lines,
        repeat,
        distinct,
        classes,
        _table(term_row, column, (n, len(WORDS) + 1)),
    )
