"""Quality rules: how far a text's histograms lie from those of its language.

References are the mean histograms of character classes and of common words over those
documents of a listed language that pass the base rules. A document is judged by the
Jensen-Shannon distances of both to the reference of its own language, with room for the
noise of short texts, and only from a least length on. Documents without a language, or
of one that is not listed, add to no reference; each is held against the listed language
that it is nearest to in both histograms at once, and fails if that one rejects it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.profile import COMMON, Profile, profile
from cellzonal.llm.text import blocks, small_batches

LEAST_WORDS = 50
#: Most distance of either histogram for a very long text, and what a short one adds:
#: the room falls with the square root of the number of characters, or words.
MOST_CLASS, MOST_COMMON = 0.135, 0.22
CLASS_ROOM, COMMON_ROOM = 2.0, 1.8
#: Frequencies are added up in whole numbers, so that their order does not matter.
UNIT = 1_000_000


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return counts / np.maximum(total, 1)


def distances(shares: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, 0 to 1, of rows to one distribution."""
    middle = (shares + reference) / 2

    def divergence(p):
        p = np.broadcast_to(p, middle.shape)
        ratio = np.divide(p, middle, out=np.ones_like(middle), where=p > 0)
        return (p * np.log2(ratio)).sum(1)

    return np.sqrt(np.clip((divergence(shares) + divergence(reference)) / 2, 0, 1))


def base_failed(found: Profile) -> np.ndarray:
    """Texts of too few words, or mostly of repeated ones."""
    return (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > 50 * found.n_words)


def language_references(docs: DataFrame, languages: tuple[str, ...] = tuple(COMMON)) -> dict:
    """Mean shares by listed language of what passes the base rules: {language: (classes, common words)}."""

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for part, data, at in blocks(batches):
            found = profile(data, at)
            both = np.hstack([_shares(found.classes), _shares(found.common)])
            both = np.rint(both * UNIT).astype(np.int64)
            good = ~base_failed(found)
            spoken = np.array([x if x in languages else "" for x in part.column("lang").to_pylist()])
            for lang in set(spoken[good]) - {""}:
                sums[lang] = sums.get(lang, 0) + both[good & (spoken == lang)].sum(0)
        rows = [(lang, i, int(v)) for lang, own in sums.items() for i, v in enumerate(own) if v]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.record_batch(arrays, ["lang", "bin", "total"])

    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.mapInArrow(add, "lang string, bin long, total long")
    sums = rows.groupBy("lang", "bin").agg(F.sum("total").alias("total")).collect()
    empty = profile(np.empty(0, np.uint8), np.zeros(2, np.int64))
    n, k = empty.classes.shape[1], empty.common.shape[1]
    found: dict[str, np.ndarray] = {}
    for lang, place, total in sums:
        found.setdefault(lang, np.zeros(n + k))[place] = total
    return {
        lang: (own[:n] / max(own[:n].sum(), 1), own[n:] / max(own[n:].sum(), 1))
        for lang, own in sorted(found.items())
    }


def judge(
    found: Profile, references: dict, languages: list[str | None]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of both histograms to the reference that judges a text, and which are kept.

    languages: every text's own. Without a reference of it, the one that leaves most room judges.
    """
    n = len(found.n_words)
    if not references:
        return np.zeros(n), np.zeros(n), np.ones(n, bool)
    classes, common = _shares(found.classes), _shares(found.common)
    far_class = np.array([distances(classes, c) for c, _ in references.values()])
    far_common = np.array([distances(common, w) for _, w in references.values()])
    most_class = MOST_CLASS + CLASS_ROOM / np.sqrt(np.maximum(found.classes.sum(1), 1))
    most_common = MOST_COMMON + COMMON_ROOM / np.sqrt(np.maximum(found.common.sum(1), 1))
    place = {lang: i for i, lang in enumerate(references)}
    own = np.array([place.get(lang, -1) for lang in languages], int)
    nearest = np.maximum(far_class / most_class, far_common / most_common).argmin(0)
    at = np.where(own >= 0, own, nearest), np.arange(n)
    kept = (far_class[at] <= most_class) & (far_common[at] <= most_common)
    return far_class[at], far_common[at], kept


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with the counts, distances and verdicts of every document.

    docs: any columns, among them text and lang. Adds n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, class_distance, common_distance, base_failed (fewer than 50
    words, or more than half of them in 3-word windows found twice) and kept. Null and
    empty texts have no words and fail. A document whose lang has a list of common words is
    judged by that language alone. One whose lang is null, or has no list, must come up to one
    of the listed languages in both histograms, and its distances are those to the one that
    leaves it most room; so text of a language without a list is not kept unless it reads like
    a listed one. Where no document of a listed language passes the base rules there is
    nothing to judge by: all distances are 0 and the base rules alone decide. All rows stay,
    repeated ones too; columns of docs of these names are replaced.
    """
    made = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "common_distance", "base_failed", "kept",
    )
    small_batches(docs.sparkSession)
    references = language_references(docs)
    rest = [c for c in docs.columns if c not in (*made, "text")]

    def scan(batches):
        for part, data, at in blocks(batches):
            p = profile(data, at)
            far_class, far_common, good = judge(p, references, part.column("lang").to_pylist())
            failed = base_failed(p)
            values = [
                p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words,
                far_class, far_common, failed, good & ~failed,
            ]
            columns = [part.column(c) for c in rest] + [pa.array(v) for v in values]
            yield pa.record_batch(columns, [*rest, *made])

    schema = docs.select(*rest).schema
    for name in made:
        kind = "boolean" if name in ("base_failed", "kept") else "long"
        schema = schema.add(name, "double" if name.endswith("distance") else kind)
    return docs.select(*rest, "text").mapInArrow(scan, schema)
