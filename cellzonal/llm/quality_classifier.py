"""Quality classifier learned from trusted positives and unlabelled text.

A logistic model minimises the non-negative unbiased risk of positive-unlabelled
learning: positives stand for their share of the unlabelled text, the class prior, and what
they take off the unlabelled risk is never more than there is. The prior is the
smallest ratio, over score bands, of the unlabelled share to that of held-back positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.profile import (
    CLASSES, DIGIT, LOWER, OTHER, STOP, SYMBOL, UPPER, WIDE, Profile, profile,
)
from cellzonal.llm.text import Scratch, blocks, fold

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Most positives, and most unlabelled documents, that the model is fitted to.
SAMPLE = 20_000
FEATURES = (
    "log_words", "word_length", "lower", "upper", "digit", "stop", "symbol", "other", "wide",
    "common", "distinct", "repeated", "duplicate_lines", "symbols_per_word", "stops_per_word",
)


def features(p: Profile) -> np.ndarray:
    words = np.maximum(p.n_words, 1)
    chars = np.maximum(p.classes.sum(1), 1)[:, None]
    share = p.classes / chars
    assert share.shape[1] == len(CLASSES)
    terms = np.maximum(p.common.sum(1), 1)
    columns = [
        np.log1p(p.n_words),
        p.word_chars / words,
        *[share[:, c] for c in (LOWER, UPPER, DIGIT, STOP, SYMBOL, OTHER, WIDE)],
        p.common[:, :-1].sum(1) / terms,
        p.distinct_words / words,
        p.n_repeat_words / words,
        np.log1p(p.n_dup_lines),
        np.minimum(p.n_symbols / words, 3),
        np.minimum(p.classes[:, STOP] / words, 3),
    ]
    return np.stack(columns, 1).astype(float)


class PuModel:
    """Scaled features, their squares, and a line through them."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.mean, self.spread, self.weights = mean, spread, weights

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.minimum(z * z, 9) / 3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int) -> PuModel:
    """Gradient steps on the non-negative risk; without a prior, positives against the rest."""
    both = np.vstack([positive, unlabelled])
    model = PuModel(both.mean(0), both.std(0) + 1e-9, np.zeros(1 + 2 * both.shape[1]))
    p, u = model.design(positive), model.design(unlabelled)
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def slope(rows, sign):
        """Value and gradient of the mean of log(1 + exp(-sign * g))."""
        g = np.clip(sign * (rows @ model.weights), -30, 30)
        part = -sign / (1 + np.exp(g))
        return np.log1p(np.exp(-g)).mean(), rows.T @ part / len(rows)

    for step in range(1, steps + 1):
        pos, d_pos = slope(p, 1)
        un, d_un = slope(u, -1)
        if prior is None:
            gradient = (d_pos + d_un) / 2
        else:
            neg, d_neg = slope(p, -1)
            rest = un - prior * neg
            gradient = prior * d_pos + (d_un - prior * d_neg) if rest >= 0 else prior * d_neg - d_un
        gradient = gradient + 1e-3 * np.append(0, model.weights[1:])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weights = model.weights - 0.03 * move
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, bands: int = 20) -> float:
    """Share of positives in the unlabelled rows, bounded by how their scores compare.

    No set of scores can hold fewer unlabelled rows than its share of positives allows.
    """
    # Upper halves of the positives and more, as fewer of them would make a noisy ratio.
    edges = np.quantile(positive, np.linspace(0, 0.5, bands // 2 + 1)[1:])
    n_p = np.array([(positive >= e).mean() for e in edges])
    n_u = np.array([(unlabelled >= e).mean() for e in edges])
    return float(np.clip((n_u / n_p).min(), 0.05, 0.99))


def learn(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600) -> PuModel | None:
    """The fitted model; None without positives or without unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return None
    back = np.arange(len(positive)) % 5 == 0
    fitted, held = (positive[~back], positive[back]) if (~back).any() else (positive, positive)
    naive = _fit(fitted, unlabelled, None, steps // 2)
    prior = estimate_prior(naive.logits(held), naive.logits(unlabelled))
    return _fit(positive, unlabelled, prior, steps)


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most about ``most`` rows, chosen by a hash of their id, in order of it."""
    n = rows.count()
    pick = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    rows = rows.withColumn("pick", pick).where(F.col("pick") < min(1.0, most / max(n, 1)) * (1 << 30))
    found = rows.select("pick", "x").toPandas().sort_values("pick", kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return x[np.lexsort(x.T)] if len(x) else x


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    docs: any columns, among them doc_id and text; labels: doc_id and quality. Documents whose
    id's checksum leaves 0 by 5 are held out; of the others, those labelled 1 are the trusted
    positives, at most about ``sample`` of them, and as many of those without a label stand for
    the unlabelled text. Nothing but the text makes the score. A null id counts
    as an empty text, labels without an id or a value are left out, and a
    document with any label 1 is a positive. Null and empty texts are scored like any.
    Without positives or unlabelled documents all scores are 0.5. Rows stay, repeated ones too.
    """
    schema = "doc_id long, held_out boolean, x array<double>"

    def measure(batches):
        for part, data, at in blocks(batches):
            x = features(profile(data, at))
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
            yield pa.record_batch([*part.columns[:2], lists], ["doc_id", "held_out", "x"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(FOLDS) == HELD_OUT).alias("held_out"),
        "text",
    )
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(rows.mapInArrow(measure, schema), "features")
    marks = labels.where("doc_id is not null and quality is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("quality").alias("quality"))
    known = rows.where("not held_out").join(marks, "doc_id", "left")
    positive = _sample(known.where("quality = 1"), sample)
    unlabelled = _sample(known.where("quality is null"), sample)
    model = learn(positive, unlabelled)

    def score(batches):
        for part in batches:
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(part.num_rows, len(FEATURES))
            values = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.record_batch(
                [*part.columns[:2], pa.array(values)], ["doc_id", "held_out", "score"]
            )

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
