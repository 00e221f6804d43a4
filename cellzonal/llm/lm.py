"""Interpolated modified Kneser-Ney language model over pairs or triples of words.

Numbering: the words of all texts get numbers, by shards of their hashes, so that four bytes
stand for a word in what follows. Counting: every task adds up the triples of its documents and sends
each once, packed in arrays, to the shard that the hash of its last two words belongs to; a shard's
task merges what it gets. There a pair counts as often as different words precede it, or, at the start of
a text and in a model of order two, as it occurs. From there go, again packed by hash, each
word's share of the sums that smoothing needs, and each pair's that triples seen twice or more begin with:
the others are what these leave of the pair's own count. A model is a folder of shards: sorted 64-bit hashes
beside their values, which workers map into memory and look up with sorted queries. No triple, no pair and
no word is dropped, and no frequent word is gathered in one task.
"""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.text import Scratch, blocks, fold, mix, word_hashes

FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x0E0D0E0D0E0D0E0D)
START = np.uint64(0x57A2757A2757A275)
#: In place of the first word's number where a triple has but two words, and the number of words not learned.
NONE, UNSEEN = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
#: So many keys of a shard are kept as 48 bits each, below a table of where their first 16 bits begin.
MANY = 1 << 18
LOW = np.uint64((1 << 48) - 1)
#: Bytes of text for each shard, about, and tokens that a task holds before it sends them.
SHARD_BYTES = 16 << 20
HELD = 3_000_000
#: Texts are looked up in blocks of this size, so that neighbours in a shard meet.
BLOCK = 8 << 20
PACKED = "to int, blob binary, file string, facts array<long>"
_MANIFEST = -1


class Facts(NamedTuple):
    """Sums over a whole model."""

    pairs: tuple[int, int, int, int]  # pairs that count once, twice, 3 and 4 times
    triples: tuple[int, int, int, int]  # triples seen once, twice, 3 and 4 times
    words: tuple[int, int, int, int]  # words after 1, 2, 3 and 4 different words
    followed: int  # different pairs
    more: int  # words after 3 different words or more
    tokens: int
    vocabulary: int


def sequence(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' tokens, ends included, and where each row begins."""
    words, bounds = word_hashes(data, at)
    rows = len(at) - 1
    row_of = np.repeat(np.arange(rows), np.diff(bounds))
    tokens = np.empty(len(words) + rows, np.uint64)
    tokens[np.arange(len(words)) + row_of] = words
    tokens[bounds[1:] + np.arange(rows)] = END
    return tokens, bounds[:-1] + np.arange(rows)


def preceding(tokens: np.ndarray, begins: np.ndarray, start: np.uint32) -> np.ndarray:
    """Every token's predecessor, that of a row's first token being start."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins] = start
    return before


def pair_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Different for different pairs of numbers."""
    with np.errstate(over="ignore"):
        return mix(before.astype(np.uint64) << np.uint64(32) | token)


def further(before: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """The words before the predecessors; NONE at the start of a row and in order two."""
    first = np.full_like(before, NONE)
    if order > 2:
        first[1:] = before[:-1]
        first[begins] = NONE
    return first


def triple_hash(first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + pairs)


def _starts(*arrays: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    new = np.zeros(len(arrays[0]), bool)
    new[:1] = True
    for array in arrays:
        new[1:] |= array[1:] != array[:-1]
    return np.flatnonzero(new)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    return (
        keys[first],
        *[np.add.reduceat(v[order], first) if len(first) else v[order] for v in values],
        order[first],
    )


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each as one plane for every byte that its largest number needs."""
    buffer = io.BytesIO()
    for array in arrays:
        array = array.astype(np.min_scalar_type(int(array.max(initial=0))))
        np.save(buffer, np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.itemsize).T))
    return pa.compress(buffer.getvalue(), codec="zstd", asbytes=True) + len(
        buffer.getvalue()
    ).to_bytes(8, "little")


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    size = int.from_bytes(blob[-8:], "little")
    buffer = io.BytesIO(pa.decompress(blob[:-8], size, codec="zstd", asbytes=True))
    planes = [np.load(buffer) for _ in range(n)]
    return [np.ascontiguousarray(p.T).view(f"u{len(p)}").ravel() for p in planes]


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the steps between them; the sums of these are the keys again."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _keys(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes, many of them without their first 16 bits."""
    if len(keys) < MANY:
        return {f"{name}-start": np.array([len(keys)], np.uint32), f"{name}-low": keys}
    start = np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))
    high = (keys >> np.uint64(32)).astype(np.uint16)
    return {f"{name}-start": start.astype(np.uint32), f"{name}-high": high, f"{name}-low": keys.astype(np.uint32)}


def _row(to: int, blob: bytes | None, file: str | None, facts: list[int] | None) -> dict:
    return {"to": to, "blob": blob, "file": file, "facts": facts}


def _table(rows: list[dict]) -> pa.Table:
    kinds = {
        "to": pa.int32(),
        "blob": pa.binary(),
        "file": pa.string(),
        "facts": pa.list_(pa.int64()),
    }
    return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})


def _split(shards: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(count + 1))
    for shard in range(count):
        if edges[shard] < edges[shard + 1]:
            yield shard, order[edges[shard] : edges[shard + 1]]


def _count_words(texts: DataFrame, word_shards: int) -> DataFrame:
    """Words of every task by shard, and how often each occurs; START occurs 0 times."""

    def send(held):
        tokens = np.concatenate([*held, [START]])
        words, counts, _ = _sums(tokens, (tokens != START).astype(np.int64))
        rows = [
            _row(shard, _pack(_steps(words[own]), counts[own]), None, None)
            for shard, own in _split((words % np.uint64(word_shards)).astype(np.int64), word_shards)
        ]
        return _table(rows).to_batches()

    def count(batches):
        held, size = [], 0
        for _, data, at in blocks(batches):
            held.append(sequence(data, at)[0])
            size += len(held[-1])
            if size >= HELD:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return texts.mapInArrow(count, PACKED)


def _merge_words(table: pa.Table, folder: str) -> pa.Table:
    """One shard of words, written: a word's number is its place, after the words of the shards before."""
    shard = table["to"][0].as_py()
    keys, (counts,) = _merged(table, 1)
    small = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    file = _save(folder, f"words-{shard}", {**_keys("keys", keys), "counts": small})
    return _table([_row(shard, None, file, [len(keys), int(counts.sum()), int((counts > 0).sum())])])


def _count_triples(texts: DataFrame, known: Words, shards: int, order: int) -> DataFrame:
    """Triples of every task by shard, as words' numbers: middle words, pairs each has, last words, triples
    each pair has, first words, and how often each triple occurs."""

    def send(held):
        first, before, token = (np.concatenate(x) for x in zip(*held, strict=True))
        pairs = pair_hash(before, token)
        _, counts, where = _sums(triple_hash(first, pairs), np.ones(len(token), np.int64))
        first, before, token, pairs = (x[where] for x in (first, before, token, pairs))
        rows = []
        for shard, own in _split((pairs % np.uint64(shards)).astype(np.int64), shards):
            own = own[np.lexsort((first[own], token[own], before[own]))]
            b, t = before[own], token[own]
            by_pair = _starts(b, t)
            by_word = _starts(b[by_pair])
            n_pairs = np.diff(np.append(by_word, len(by_pair)))
            n_triples = np.diff(np.append(by_pair, len(own)))
            parts = (_steps(b[by_pair][by_word]), n_pairs, t[by_pair], n_triples, first[own], counts[own])
            rows.append(_row(shard, _pack(*parts), None, None))
        return _table(rows).to_batches()

    def count(batches):
        with contextlib.ExitStack() as stack:
            files = Files(known, stack)
            held, size = [], 0
            for _, data, at in blocks(batches, limit=BLOCK // 4):
                token, begins = sequence(data, at)
                words, place = np.unique(token, return_inverse=True)
                token = files.numbers(words)[0][place]
                before = preceding(token, begins, files.start)
                held.append((further(before, begins, order), before, token))
                size += len(token)
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
            if held:
                yield from send(held)

    return texts.mapInArrow(count, PACKED)


def _triples(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First, middle and last words and counts, as _count_triples packs them."""
    middle, n_pairs, last, n_triples, first, counts = _unpack(blob, 6)
    middle = np.cumsum(middle, dtype=np.uint64).astype(np.uint32)
    n_triples = n_triples.astype(np.int64)
    middle = np.repeat(np.repeat(middle, n_pairs.astype(np.int64)), n_triples)
    return first.astype(np.uint32), middle, np.repeat(last.astype(np.uint32), n_triples), counts.astype(np.int64)


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays as files beside each other under a name no other attempt has."""
    place, path = arrow_fs.FileSystem.from_uri(folder)
    own = f"{name}-{uuid.uuid4().hex}"
    place.create_dir(path, recursive=True)
    for column, array in arrays.items():
        buffer = io.BytesIO()
        np.save(buffer, array)
        with place.open_output_stream(f"{path}/{own}.{column}.npy") as out:
            out.write(buffer.getbuffer())
    return own


def _classes(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _narrow(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of 1 to 3 in two bits, four to a byte, with a list of those that are larger."""
    large = np.flatnonzero(counts > 3)
    bits = np.zeros(-(-len(counts) // 4) * 4, np.uint8)
    bits[: len(counts)] = np.minimum(counts, 4) - 1
    often = counts[large]
    return {
        name: np.bitwise_or.reduce(bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1),
        f"{name}-large": large.astype(np.uint32),
        f"{name}-often": often.astype(np.min_scalar_type(int(often.max(initial=0)))),
    }


def _seen(counts: np.ndarray) -> list[np.ndarray]:
    return [s.astype(np.int64) for s in (counts == 1, counts == 2, counts > 2)]


def _merge_triples(table: pa.Table, folder: str, shards: int, known: Words, order: int) -> pa.Table:
    """One shard, written; what it adds to its words, and to the pairs that its triples begin with, goes on."""
    shard = table["to"][0].as_py()
    parts = [_triples(blob.as_py()) for blob in table["blob"]]
    first, before, token, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    pairs = pair_hash(before, token)
    triples, counts, where = _sums(triple_hash(first, pairs), counts)
    first, before, token, pairs = (x[where] for x in (first, before, token, pairs))
    whole = first != NONE
    keys, raw, often, where = _sums(pairs, counts, np.where(whole, 1, counts))
    del pairs
    triples, times = triples[whole], counts[whole]
    arrays = {**_keys("keys", keys), **_narrow("counts", often)}
    if order > 2:
        arrays |= {**_narrow("raw", raw), **_keys("triples", triples), **_narrow("times", times)}
    file = _save(folder, f"pairs-{shard}", arrays)
    rows = [_row(_MANIFEST, None, file, [shard, len(keys), *_classes(often), len(triples), *_classes(times)])]
    again = np.flatnonzero(whole)[times > 1]
    if len(again):
        times = counts[again]
        contexts, *values, _ = _sums(pair_hash(first[again], before[again]), *_seen(times)[1:], times)
        for to, own in _split((contexts % np.uint64(shards)).astype(np.int64), shards):
            blob = _pack(_steps(contexts[own]), *[v[own] for v in values])
            rows.append(_row(known.shards + to, blob, None, None))
    before, token = before[where], token[where]
    none = np.zeros(len(keys), np.int64)
    as_next = (token, none + 1, none, none, none, none)
    as_before = (before, none, often, *_seen(often))
    both = [np.concatenate(x) for x in zip(as_next, as_before, strict=True)]
    words, *values, _ = _sums(*both)
    for to, own in _split(known.shard_of(words), known.shards):
        rows.append(_row(to, _pack(_steps(words[own]), *[v[own] for v in values]), None, None))
    return _table(rows)


WORD_COLUMNS = ("after", "before", "once", "twice", "more")
CONTEXT_COLUMNS = ("twice", "more", "again")


def _merged(table: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    parts = [_unpack(blob.as_py(), 1 + columns) for blob in table["blob"]]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    values = [np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(1, 1 + columns)]
    keys, *values, _ = _sums(keys, *values)
    return keys, values


def _merge_sums(table: pa.Table, folder: str, known: Words) -> pa.Table:
    """One shard of words, or of pairs that triples begin with, written; the list of files passes as it is."""
    shard = table["to"][0].as_py()
    if shard == _MANIFEST:
        return table
    columns = WORD_COLUMNS if shard < known.shards else CONTEXT_COLUMNS
    keys, values = _merged(table, len(columns))
    facts = [shard]
    if shard < known.shards:
        after = values[0]
        facts += [*_classes(after), int((after > 2).sum())]
        at = keys.astype(np.int64) - known.first[shard]
        dense = np.zeros((len(values), known.first[shard + 1] - known.first[shard]), np.int64)
        dense[:, at] = values
        values, arrays = list(dense), {}
    else:
        arrays = _keys("keys", keys)
    small = [v.astype(np.min_scalar_type(int(v.max(initial=0)))) for v in values]
    file = _save(folder, f"sums-{shard}", {**arrays, **dict(zip(columns, small, strict=True))})
    return _table([_row(shard, None, file, facts)])


class Words(NamedTuple):
    """Where the words' shards are, and the number that each shard begins with."""

    folder: str
    files: dict[int, str]
    first: tuple[int, ...]

    @property
    def shards(self) -> int:
        return len(self.first) - 1

    def shard_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.first[1:]), numbers.astype(np.int64), "right")


class Trained(NamedTuple):
    """Where a model's shards are, by shard, and the sums over them."""

    words: Words
    pairs: dict[int, str]
    pair_shards: int
    sums: dict[int, str]
    contexts: dict[int, str]
    facts: Facts
    order: int


def train(texts: DataFrame, scratch: Scratch, shard_bytes: int = SHARD_BYTES, order: int = 2) -> Trained:
    """A model of all texts (column text; null counts as empty). Its files are in scratch."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    word_shards = max(1, shards // 4)
    folder = scratch.path("model")
    texts = texts.select("text")
    numbered = _count_words(texts, word_shards).groupBy("to").applyInArrow(
        lambda table: _merge_words(table, folder), PACKED
    )
    numbered = {r["to"]: r for r in numbered.select("to", "file", "facts").collect()}
    held = [numbered[i]["facts"][0] if i in numbered else 0 for i in range(word_shards)]
    if sum(held) >= int(UNSEEN):
        raise ValueError(f"{sum(held)} different words are too many for numbers of 32 bits")
    first = tuple(sum(held[:i]) for i in range(word_shards + 1))
    known = Words(folder, {i: r["file"] for i, r in numbered.items()}, first)
    counted = _count_triples(texts, known, shards, order)
    merged = counted.groupBy("to").applyInArrow(
        lambda table: _merge_triples(table, folder, shards, known, order), PACKED
    )
    merged = merged.groupBy("to").applyInArrow(lambda table: _merge_sums(table, folder, known), PACKED)
    files = merged.select("to", "file", "facts").collect()
    pairs = [r for r in files if r["to"] == _MANIFEST]
    words = [r for r in files if 0 <= r["to"] < word_shards]
    contexts = [r for r in files if r["to"] >= word_shards]

    def total(rows, i):
        return sum(r["facts"][i] for r in rows)

    facts = Facts(
        tuple(total(pairs, i) for i in (2, 3, 4, 5)),
        tuple(total(pairs, i) for i in (7, 8, 9, 10)),
        tuple(total(words, i) for i in (1, 2, 3, 4)),
        total(pairs, 1),
        total(words, 5),
        total(numbered.values(), 1),
        total(numbered.values(), 2),
    )
    return Trained(
        known,
        {r["facts"][0]: r["file"] for r in pairs},
        shards,
        {r["facts"][0]: r["file"] for r in words},
        {r["facts"][0] - word_shards: r["file"] for r in contexts},
        facts,
        order,
    )


def discounts(n: tuple[int, int, int, int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, kept apart from nothing and all."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [k - (k + 1) * y * b / a if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *[min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]])


class Files:
    """Shards mapped into a worker's memory; local copies go with it."""

    def __init__(self, words: Words, stack: contextlib.ExitStack):
        self.words = words
        self.local = urlparse(words.folder)
        self.copies = None
        if self.local.scheme not in ("", "file"):
            self.copies = stack.enter_context(tempfile.TemporaryDirectory())
        self.open: dict[str, np.ndarray] = {}
        self.start = self.numbers(np.array([START]))[0][0]

    def array(self, file: str, column: str) -> np.ndarray:
        name = f"{file}.{column}.npy"
        if name not in self.open:
            path = f"{self.local.path}/{name}"
            if self.copies:
                place, remote = arrow_fs.FileSystem.from_uri(f"{self.words.folder}/{name}")
                path = f"{self.copies}/{name}"
                arrow_fs.copy_files(remote, path, place, arrow_fs.LocalFileSystem())
            try:
                self.open[name] = np.load(path, mmap_mode="r")
            except ValueError:  # an empty array cannot be mapped
                self.open[name] = np.load(path)
        return self.open[name]

    def places(self, file: str, within: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are among those of a file, and which of them are."""
        start, low = (self.array(file, f"{within}-{part}") for part in ("start", "low"))
        size = int(start[-1])
        if not size:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if len(start) == 1:
            at = np.minimum(np.searchsorted(low, keys), size - 1)
            return at, low[at] == keys
        high = self.array(file, f"{within}-high")
        top, wanted = (keys >> np.uint64(48)).astype(np.int64), keys & LOW
        at, end = start[top].astype(np.int64), start[top + 1].astype(np.int64)

        def less(i):
            return (high[i].astype(np.uint64) << np.uint64(32) | low[i]) < wanted[todo]

        todo, further_end = np.flatnonzero(at < end), end.copy()
        while len(todo):
            half = (at[todo] + further_end[todo]) >> 1
            below = less(half)
            at[todo] = np.where(below, half + 1, at[todo])
            further_end[todo] = np.where(below, further_end[todo], half)
            todo = todo[at[todo] < further_end[todo]]
        there = at < end
        at = np.minimum(at, size - 1)
        return at, there & ((high[at].astype(np.uint64) << np.uint64(32) | low[at]) == wanted)

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of different words, UNSEEN for those not learned, and how often they were seen."""
        out, counts = np.full(len(words), UNSEEN), np.zeros(len(words), np.int64)
        first = self.words.first
        for shard, own in _split((words % np.uint64(self.words.shards)).astype(np.int64), self.words.shards):
            if shard in self.words.files:
                file = self.words.files[shard]
                at, hit = self.places(file, "keys", words[own])
                own, at = own[hit], at[hit]
                out[own] = at + first[shard]
                counts[own] = self.array(file, "counts")[at]
        return out, counts


class Model(Files):
    """A trained model's shards."""

    def __init__(self, trained: Trained, stack: contextlib.ExitStack):
        super().__init__(trained.words, stack)
        self.trained = trained
        self.of_pairs = discounts(trained.facts.pairs)
        self.of_words = discounts(trained.facts.words)
        self.of_triples = discounts(trained.facts.triples)

    def _find(self, files, keys: np.ndarray, columns, by=None, within: str = "keys"):
        """Values of different keys, 0 for those that are missing; by: what tells their shards."""
        shards = self.trained.pair_shards
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        by = keys if by is None else by
        for shard, own in _split((by % np.uint64(shards)).astype(np.int64), shards):
            if shard not in files:
                continue
            at, hit = self.places(files[shard], within, keys[own])
            own, at = own[hit], at[hit]
            for values, column in zip(out, columns, strict=True):
                held = self.array(files[shard], column)
                if files is self.trained.pairs:
                    values[own] = (held[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) + 1
                    over = np.flatnonzero(values[own] == 4)
                    if len(over):
                        large, often = (self.array(files[shard], f"{column}-{c}") for c in ("large", "often"))
                        values[own[over]] = often[np.searchsorted(large, at[over])]
                else:
                    values[own] = held[at]
        return out

    def pair_values(self, keys: np.ndarray, column: str) -> np.ndarray:
        return self._find(self.trained.pairs, keys, (column,))[0]

    def triple_counts(self, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return self._find(self.trained.pairs, keys, ("times",), by=pairs, within="triples")[0]

    def context_values(self, keys: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
        """Triples seen once, twice and more often that begin with a pair, itself seen so often in total."""
        twice, more, again = self._find(self.trained.contexts, keys, CONTEXT_COLUMNS)
        return [total - again, twice, more]

    def word_values(self, numbers: np.ndarray, columns) -> list[np.ndarray]:
        out = [np.zeros(len(numbers), np.int64) for _ in columns]
        learned = np.flatnonzero(numbers != UNSEEN)
        for shard, own in _split(self.words.shard_of(numbers[learned]), self.words.shards):
            own = learned[own]
            at = numbers[own].astype(np.int64) - self.words.first[shard]
            for values, column in zip(out, columns, strict=True):
                values[own] = self.array(self.trained.sums[shard], column)[at]
        return out

    def score(self, token: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every token's count in training and log10 probability after what precedes it."""
        facts = self.trained.facts
        words, place = np.unique(token, return_inverse=True)
        numbers, counts = self.numbers(words)
        (after,) = self.word_values(numbers, ("after",))
        token = numbers[place]
        before = preceding(token, begins, self.start)
        # Words by how many different words they follow, mixed with all words alike.
        if facts.followed:
            less = self.of_words[np.minimum(after, 3)]
            w1, w2 = facts.words[:2]
            left = self.of_words[1] * w1 + self.of_words[2] * w2 + self.of_words[3] * facts.more
            lower = (after - less + left / (facts.vocabulary + 1)) / facts.followed
        else:
            lower = np.ones(len(words))
        contexts, context = np.unique(before, return_inverse=True)
        seen, once, twice, more = self.word_values(contexts, ("before", "once", "twice", "more"))
        left = once * self.of_pairs[1] + twice * self.of_pairs[2] + more * self.of_pairs[3]
        keys, pair = np.unique(pair_hash(before, token), return_inverse=True)
        c = self.pair_values(keys, "counts")
        own = (c - self.of_pairs[np.minimum(c, 3)])[pair]
        total = seen[context]
        p = np.where(
            total > 0, (own + left[context] * lower[place]) / np.maximum(total, 1), lower[place]
        )
        if self.trained.order > 2:
            p = self._after_two(further(before, begins, 3), before, keys[pair], p)
        return counts[place], np.log10(p)

    def _after_two(
        self, first: np.ndarray, before: np.ndarray, pairs: np.ndarray, lower: np.ndarray
    ) -> np.ndarray:
        """Probabilities after two words, from those after one; the first token of a text has one."""
        contexts, context = np.unique(pair_hash(first, before), return_inverse=True)
        total = self.pair_values(contexts, "raw")
        seen = self.context_values(contexts, total)
        total = total[context]
        left = sum(n * d for n, d in zip(seen, self.of_triples[1:], strict=True))
        keys, at, triple = np.unique(
            triple_hash(first, pairs), return_index=True, return_inverse=True
        )
        c = self.triple_counts(keys, pairs[at])
        own = (c - self.of_triples[np.minimum(c, 3)])[triple]
        # A pair that was seen is followed by a word or by the end, each time.
        return np.where(total > 0, (own + left[context] * lower) / np.maximum(total, 1), lower)


def score_texts(docs: DataFrame, shard_bytes: int = SHARD_BYTES, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    docs: any columns, among them doc_id and text. The model learns from the documents
    whose id's checksum does not leave 2 by 7, and scores all. Words are lower-cased in A-Z
    and split at ASCII white space; every text, a null one too, ends with a token
    for its end. order is 2, for one word of context, or 3, for two. score is the log10 probability of all tokens, base_score that of single
    words with one added to every count, and n_known counts the tokens seen in training.
    Without training texts every token has probability 1. A null id counts as an empty
    text. Rows stay, repeated ones too, and count as often as they occur.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    held = fold(FOLDS) == HELD_OUT
    trained = train(docs.where(~held).select("text"), scratch, shard_bytes, order)
    facts = trained.facts

    def scan(batches):
        with contextlib.ExitStack() as stack:
            model = Model(trained, stack)
            for part, data, at in blocks(batches, limit=BLOCK):
                token, begins = sequence(data, at)
                counts, p = model.score(token, begins)
                base = np.log10((counts + 1) / (facts.tokens + facts.vocabulary + 1))
                score = np.add.reduceat(p, begins)
                n = np.diff(np.append(begins, len(token)))
                yield pa.record_batch(
                    [
                        *part.columns[:2],
                        pa.array(n),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), begins)),
                        pa.array(np.full(len(n), facts.tokens, np.int64)),
                        pa.array(np.add.reduceat(base, begins)),
                        pa.array(score),
                        pa.array(10 ** np.minimum(-score / n, 300)),
                    ],
                    list(names),
                )

    names = {
        "doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long",
        "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double",
    }
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(scan, ", ".join(f"{n} {k}" for n, k in names.items()))
