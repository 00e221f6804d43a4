"""Benchmark passages in training texts, found by suffix arrays over shards of texts.

A shard is a run of documents within one task. Its suffix array sorts all places at which
a passage of the benchmark can begin, and every benchmark suffix is looked up in it by
binary search: the places that share its first words are neighbours. Finds of one
item that follow each other without a gap make one longest verbatim match.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.text import TERMS, blocks, put_back, set_aside, small_batches, with_columns

WINDOW = 13
#: Bytes of benchmark text that are sent to every task; more is refused.
MOST_BENCHMARK = 256 << 20
SHARD = 2 << 20


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class Suffixes(NamedTuple):
    """The benchmark's suffixes of a window's length, and what its words are called."""

    vocabulary: dict[bytes, int]
    pairs: np.ndarray
    shortest: int
    queries: list[tuple[int, np.ndarray, list[tuple[int, int]]]]


def _key(words: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    wide = np.ascontiguousarray(words.astype(">u4"))
    return wide.view(f"S{4 * wide.shape[1]}").ravel()


def benchmark_suffixes(items: list[tuple[int | None, str | None]], window: int) -> Suffixes:
    vocabulary: dict[bytes, int] = {}
    suffixes: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    pairs: set[int] = set()
    for number, (_, text) in enumerate(items):
        words = [
            vocabulary.setdefault(w, len(vocabulary) + 1) for w in terms((text or "").encode())
        ]
        pairs.update((a << 32) | b for a, b in zip(words, words[1:], strict=False))
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if size else ():
            suffixes.setdefault(tuple(words[i : i + size]), []).append((number, i))
    by_size: dict[int, list] = {}
    for words, places in suffixes.items():
        by_size.setdefault(len(words), []).append((words, places))
    queries = [
        (size, np.array([w for w, _ in found], np.int64), [p for _, p in found])
        for size, found in sorted(by_size.items())
    ]
    shortest = queries[0][0] if queries else 0
    return Suffixes(vocabulary, np.array(sorted(pairs), np.int64), shortest, queries)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def shard_matches(
    rows: list[np.ndarray], known: Suffixes, window: int
) -> list[tuple[int, int, int, int, int]]:
    """(row, item, place in row, place in item, words) of each longest match of a shard.

    rows: numbers of each document's words, 0 for words that no item has.
    """
    if not known.queries or not rows:
        return []
    # One sequence, with a 0 between rows and enough of them at the end.
    sizes = np.array([len(r) + 1 for r in rows])
    first = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(first[-1] + window, np.int64)
    for r, at in zip(rows, first, strict=False):
        text[at : at + len(r)] = r
    # Places from which on enough words follow that also follow each other in an item.
    n = first[-1]
    goes_on = _member((text[:n] << 32) | text[1 : n + 1], known.pairs)
    stop = np.append(np.flatnonzero(~goes_on), n)
    after = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1
    starts = np.flatnonzero((text[:n] > 0) & (after >= known.shortest))
    if not len(starts):
        return []
    # The suffix array, to the depth of a window.
    keys = _key(text[starts[:, None] + np.arange(window)])
    order = np.argsort(keys, kind="stable")
    keys, starts = keys[order], starts[order]
    found: list[tuple[int, int, int]] = []
    for size, words, places in known.queries:
        low = np.zeros((len(words), window), np.int64)
        low[:, :size] = words
        high = np.full((len(words), window), 0xFFFFFFFF, np.int64)
        high[:, :size] = words
        begin = np.searchsorted(keys, _key(low), "left")
        end = np.searchsorted(keys, _key(high), "right")
        for i in np.flatnonzero(end > begin):
            for place in starts[begin[i] : end[i]]:
                found += [(item, int(place) - at, at) for item, at in places[i]]
        # Equal windows of an item meet each of their places once each.
    matches = []
    lengths = {}
    for size, _, places in known.queries:
        lengths.update({item: size for own in places for item, _ in own})
    found.sort()
    for item, diagonal, at in found:
        last = matches[-1] if matches else None
        if last and last[0] == item and last[1] == diagonal and last[2] + last[3] - lengths[item] + 1 == at:
            last[3] += 1
        else:
            matches.append([item, diagonal, at, lengths[item]])
    out = []
    for item, diagonal, at, size in matches:
        row = int(np.searchsorted(first, diagonal + at, "right")) - 1
        out.append((row, item, diagonal + at - int(first[row]), at, size))
    return sorted(out)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard: int = SHARD,
    keep_text: bool = False,
) -> DataFrame:
    """docs' columns, text if asked for, with n_words, n_hit, items and matches.

    docs: any columns, among them text; benchmark: item_id and text. Words are lower-cased
    in A-Z and hold letters, digits and what is not ASCII. A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. matches
    has the longest verbatim matches (item_id, place, item_place, words), n_hit counts
    the words inside any, and items has the different ids of the matched items, as
    strings in order. Null and empty texts have no words; items without words match
    nothing; items without an id count as hits and are in no list. Items that repeat are
    matched once each. All rows stay, repeated ones too; columns of docs of these names
    are replaced.

    The benchmark, the query set, is sent to every task, and refused beyond
    ``MOST_BENCHMARK`` bytes. Texts are taken in shards of a few megabytes, whatever
    their number; one text is never split.
    """
    small_batches(docs.sparkSession)
    given = benchmark.select(F.col("item_id").cast("long"), F.col("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BENCHMARK:
        raise ValueError(f"a benchmark of {size} bytes; {MOST_BENCHMARK} are the most")
    items = [(r[0], r[1]) for r in given.collect()]
    known = benchmark_suffixes(items, window)
    ids = [i for i, _ in items]
    made = ("n_words", "n_hit", "items", "matches")
    rest = [c for c in docs.columns if c not in made and (c != "text" or keep_text)]
    read = [*rest, *(() if keep_text else ("text",))]
    kind = pa.list_(
        pa.struct([(c, pa.int64()) for c in ("item_id", "place", "item_place", "words")])
    )

    def scan(batches):
        number = known.vocabulary.get
        for part, data, at in blocks(batches, limit=shard):
            raw = data.tobytes().translate(TERMS)
            rows = []
            for a, b in zip(at, at[1:], strict=False):
                words = raw[a:b].split()
                rows.append(np.array([number(w, 0) for w in words], np.int64))
            own: dict[int, list] = {}
            for row, item, place, item_place, n in shard_matches(rows, known, window):
                own.setdefault(row, []).append((item, place, item_place, n))
            hits, listed, matches = [], [], []
            for r in range(len(rows)):
                mark = np.zeros(len(rows[r]), bool)
                for _, place, _, n in own.get(r, ()):
                    mark[place : place + n] = True
                hits.append(int(mark.sum()))
                named = {ids[m[0]] for m in own.get(r, ())} - {None}
                listed.append(sorted(str(i) for i in named))
                matches.append(
                    [
                        {"item_id": ids[i], "place": p, "item_place": q, "words": n}
                        for i, p, q, n in own.get(r, ())
                    ]
                )
            columns = [part.column(c) for c in rest]
            columns += [
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array(listed, pa.list_(pa.string())),
                pa.array(matches, kind),
            ]
            yield pa.record_batch(columns, [*rest, *made])

    ddl = (
        "n_words long, n_hit long, items array<string>, "
        "matches array<struct<item_id:long,place:long,item_place:long,words:long>>"
    )
    schema = with_columns(docs.select(*rest).schema, ddl)
    return docs.select(*read).mapInArrow(scan, schema)


def contaminated():
    """A twentieth or more of the words are inside benchmark passages."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones; all columns, and rows without words, stay."""
    given, aside = set_aside(docs, ("n_words", "n_hit", "items", "matches"))
    found = find_passages(given, benchmark, window, keep_text=True)
    return put_back(found.where(~contaminated()), aside, docs.columns)
