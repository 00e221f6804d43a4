"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Terms that mark toxic texts are mined from one part of the labelled sample: whole words
and the beginnings of words, so that inflected forms count. A text's features are the
densities of such terms by how telling they are, their closeness to the second
person, and rates of capitals, punctuation and disguised spelling. Trees are grown on
a second part, and their probabilities calibrated on a third.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.text import LOWER, Scratch, blocks, fold, shingle_rows, with_columns

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Most labelled documents, about, that are learned from; a rare label may take half of them.
SAMPLE = 20_000
#: Of ten parts of the sample, those that terms are mined from and trees grown on.
MINED, GROWN = 5, 8
STARTS = (4, 5, 6)
LEAST_DOCS = 4
LEAST_ODDS = 2.0
MOST_TERMS = 20_000
TREES, DEPTH, STEP = 30, 3, 0.3

# Insults in their usual spelling, and words for the second person.
INSULTS = frozenset(
    b"idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool".split()
)
YOU = frozenset(
    "you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch"
    " usted ustedes ti tus su".encode().split()
)
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
DISGUISED = re.compile(rb"[a-z][0-9@$!*]+[a-z]")
SPACED = re.compile(rb"(?<![a-z0-9])(?:[a-z][ .\-_]){3,}[a-z](?![a-z0-9])")
_PUNCTUATION = b".,;:!?\"'()[]{}<>|*#%&$-_/\\~`"
FEATURES = (
    "log_words", "insults", "strong", "middle", "weak", "count", "strongest", "total",
    "near_you", "you", "capitals", "shouted", "exclaimed", "punctuation", "disguised", "spaced",
)


def plain(word: bytes) -> bytes:
    """A word without punctuation around it."""
    return word.strip(_PUNCTUATION)


def forms(word: bytes) -> list[bytes]:
    """The word and its beginnings, marked as such."""
    return [word, *[word[:n] + b"-" for n in STARTS if len(word) > n]]


class Lexicon:
    """How telling the words are; keeps what it looked up, up to a bound."""

    def __init__(self, terms: dict[bytes, float]):
        self.terms, self.known = terms, {}

    def odds(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            core = plain(word)
            found = max((self.terms.get(f, 0.0) for f in forms(core)), default=0.0)
            if not found and DISGUISED.search(core):
                undone = core.translate(LEET).replace(b"*", b"")
                found = max((self.terms.get(f, 0.0) for f in forms(undone)), default=0.0)
            self.known[word] = found
        return found


def measure(text: bytes, lexicon: Lexicon) -> list[float]:
    lower = text.translate(LOWER)
    words = lower.split()
    n = max(len(words), 1)
    odds = lexicon.odds
    hits = [(i, o) for i, o in enumerate(map(odds, words)) if o]
    you = [i for i, w in enumerate(words) if plain(w) in YOU]
    near = 0
    if you and hits:
        places = np.array(you)
        at = np.array([i for i, _ in hits])
        after = np.searchsorted(places, at)
        gap = np.minimum(
            np.abs(places[np.minimum(after, len(you) - 1)] - at),
            np.abs(places[np.maximum(after - 1, 0)] - at),
        )
        near = int((gap <= 5).sum())
    tiers = [sum(1 for _, o in hits if low <= o < high) for low, high in ((5, 99), (3.5, 5), (0, 3.5))]
    size = max(len(text), 1)
    raw = text.split()
    capitals = sum(text.count(bytes([c])) for c in range(65, 91))
    marks = sum(text.count(bytes([c])) for c in b".,;:?!*#%&$|")
    disguised = len(DISGUISED.findall(lower))
    return [
        log(1 + len(words)),
        sum(1 for i, _ in hits if plain(words[i]) in INSULTS) / n,
        tiers[0] / n,
        tiers[1] / n,
        tiers[2] / n,
        log(1 + tiers[0] + tiers[1]),
        max((o for _, o in hits), default=0.0),
        sum(o for _, o in hits) / n,
        near / n,
        len(you) / n,
        capitals / size,
        sum(1 for w in raw if len(w) > 2 and w.isupper()) / n,
        text.count(b"!") / n,
        marks / size,
        disguised / n,
        len(SPACED.findall(lower)) / n,
    ]


def mine_terms(texts: DataFrame) -> dict[bytes, float]:
    """Log odds of the terms (words and beginnings) that toxic texts have more often.

    texts: text and toxic. Texts that share their smallest shingle are near copies and count
    once. The table is bounded: the ``MOST_TERMS`` most telling terms.
    """

    def smallest(batches):
        for part, data, at in blocks(batches):
            windows, bounds = shingle_rows(data, at)
            least = [int(windows[a:b].min() >> np.uint64(1)) if b > a else -1 for a, b in bounds]
            yield pa.record_batch(
                [part.column("text"), part.column("toxic"), pa.array(least, pa.int64())],
                ["text", "toxic", "least"],
            )

    def count(batches):
        seen: Counter = Counter()
        toxic: Counter = Counter()
        for part, data, at in blocks(batches):
            raw = data.tobytes().translate(LOWER)
            marks = part.column("toxic").to_pylist()
            for a, b, mark in zip(at, at[1:], marks, strict=False):
                words = {plain(w) for w in raw[a:b].split()} - {b""}
                own = {f for w in words for f in forms(w)}
                seen.update(own)
                if mark:
                    toxic.update(own)
        yield pa.record_batch(
            {
                "term": pa.array(list(seen), pa.binary()),
                "n": pa.array(list(seen.values()), pa.int64()),
                "bad": pa.array([toxic[t] for t in seen], pa.int64()),
            }
        )

    once = texts.select("text", "toxic").mapInArrow(smallest, "text string, toxic int, least long")
    # Of several texts the same one in every run, also where a lost task comes again.
    once = once.groupBy("least", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counts = once.select("text", "toxic").mapInArrow(count, "term binary, n long, bad long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log(
        (F.col("n") - F.col("bad") + 0.5) / (good + 1)
    )
    least = min(LEAST_DOCS, max(2, bad // 10))
    telling = counts.where(F.col("bad") >= least).withColumn("odds", odds)
    telling = telling.where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "term")
    return {bytes(r["term"]): r["odds"] for r in telling.limit(MOST_TERMS).collect()}


def _measured(texts: DataFrame, terms: dict[bytes, float], others: list[str]) -> DataFrame:
    """The other columns and the features as an array."""

    def scan(batches):
        lexicon = Lexicon(terms)
        for part, data, at in blocks(batches):
            raw = data.tobytes()
            x = [measure(raw[a:b], lexicon) for a, b in zip(at, at[1:], strict=False)]
            yield pa.record_batch(
                [*[part.column(c) for c in others], pa.array(x, pa.list_(pa.float64()))],
                [*others, "x"],
            )

    schema = with_columns(texts.select(*others).schema, "x array<double>")
    read = others if "text" in others else [*others, "text"]
    return texts.select(*read).mapInArrow(scan, schema)


def draw(marks: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of label_id and toxic, with the weight each stands for.

    Both labels are drawn by a hash of their id, each up to half of the sample and what the
    other leaves, so a rare label is not thinned out with a frequent one. Weights bring their
    shares back: all rows of a label weigh as many as there were.
    """
    sizes = {0: 0, 1: 0}
    sizes |= {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {
        toxic: min(1.0, (sample - min(sizes[1 - toxic], sample // 2)) / max(sizes[toxic], 1))
        for toxic in (0, 1)
    }
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    pick = F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(1 << 30))
    return marks.withColumn("weight", 1 / share).where(pick < share * (1 << 30))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the carried columns.

    docs: any columns, among them doc_id and text; labels: doc_id and toxic. Documents whose
    id's checksum leaves 1 by 3 are held out; at most about ``sample`` of the other labelled
    ones, drawn for each label by a hash of their id and weighed back, are learned from. Nothing
    but the text makes the score. A null id counts as an empty text; labels without an id or a value are left out,
    and a document with any label 1 counts as toxic. Null and empty texts are scored like
    any. Where the labels do not hold both values, or too few of each, all scores are the
    share of toxic labels, 0 without any. Rows stay, repeated ones too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(FOLDS) == HELD_OUT).alias("held_out"),
        F.col("text"),
        *[F.col(c).alias(f"carry_{c}") for c in carry if c != "text"],
    )
    marks = labels.where("doc_id is not null and toxic is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("label_id"))
    marks = marks.agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    marks = draw(marks.where(fold(FOLDS, "label_id") != HELD_OUT), sample)
    marks = marks.withColumn("part", F.pmod(F.xxhash64("label_id", F.lit(4)), F.lit(10)))
    known = rows.join(F.broadcast(marks), F.col("doc_id") == F.col("label_id"))
    known = scratch.keep(known.select("doc_id", "text", "toxic", "part", "weight"), "known")
    counts = known.groupBy("toxic").agg(
        F.sum("weight").alias("n"),
        F.countDistinct(F.when(F.col("part") < GROWN, F.col("part") < MINED)).alias("grown"),
        F.max(F.col("part") >= GROWN).alias("held"),
    ).collect()
    out = ["doc_id", "held_out", *["text" if c == "text" else f"carry_{c}" for c in carry]]
    if len(counts) < 2 or not all(r["grown"] == 2 and r["held"] for r in counts):
        total = sum(r["n"] for r in counts)
        share = sum(r["n"] for r in counts if r["toxic"]) / total if total else 0.0
        scored = rows.select(*out, F.lit(share).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    terms = mine_terms(known.where(F.col("part") < MINED))
    learned = _measured(known, terms, ["toxic", "part", "weight"]).where(F.col("part") >= MINED)
    learned = scratch.keep(learned, "learned").coalesce(4)
    learned = learned.select(
        array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), "part", "weight"
    )
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, cacheNodeIds=True, weightCol="weight")
    model = trees.fit(learned.where(F.col("part") < GROWN))

    def raw(frame):
        found = model.setProbabilityCol("p").transform(frame)
        return found.withColumn("raw", vector_to_array("p")[1])

    held = raw(learned.where(F.col("part") >= GROWN)).select("raw", "label", "weight")
    steps = IsotonicRegression(featuresCol="raw", weightCol="weight").fit(held)
    measured = _measured(rows, terms, out).withColumn("features", array_to_vector("x"))
    scored = steps.setPredictionCol("step").transform(raw(measured))
    # Equal steps stay in the order of the trees.
    score = F.col("step") * 0.99 + F.col("raw") * 0.01
    scored = scored.select(*out, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be toxic; all columns stay."""
    marked = score_toxicity(docs, labels, carry=tuple(docs.columns))
    kept = marked.where("predicted = 0")
    return kept.select(
        *[F.col("text" if c == "text" else f"carry_{c}").alias(c) for c in docs.columns]
    )
