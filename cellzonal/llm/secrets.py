"""Secrets in texts: fixed patterns, and words that look drawn at random.

A word of letters, digits and +/_- that is no pattern's is put to a battery of tests
within the encoding its characters allow (hex, lower or upper letters with digits,
base64): chi-squared for equal use of the alphabet, the number of runs above and below
its middle, and serial correlation. A word that none of them rejects as random
still has to be unlikely as text: its evidence is how much more likely it is under the
encoding than under the pairs of letters of the whole corpus, so a longer word can give
more of it. Evidence of that kind bounds the chance of a false find, and a step-up rule
over all words of the corpus keeps the share of false finds below the rate asked for.
An equals sign parts a name from its value, each a word of its own; only at the end of a
word, up to twice, does it belong to it as padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.text import blocks, put_back, set_aside, small_batches, with_columns

# Fixed values of the base patterns.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Words put to the tests have this many characters or more.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
RATE = 0.01
#: A test below this level calls the word not random.
LEVEL = 0.001

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the narrowest alphabet to the widest.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _DIGITS + _LOWER),
    ("upper", _UPPER + _DIGITS),
    ("alphanumeric", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/_-"),
)


def _normal_tail(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def battery(word: str) -> tuple[str, int, float] | None:
    """Encoding, alphabet size and the smallest p-value of the tests; None without an encoding."""
    core = word.rstrip("=")
    found = next(((n, a) for n, a in ENCODINGS if set(core) <= set(a)), None)
    if found is None or len(core) < 2:
        return None
    name, alphabet = found
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in core], float)
    n, k = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # Wilson and Hilferty's normal form of chi-squared.
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))
    p = [erfc(z / sqrt(2)) / 2]
    above = x >= k / 2
    up = int(above.sum())
    down = n - up
    if up and down:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 2 * up * down / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_normal_tail((runs - mean) / sqrt(spread)) if spread > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    centred = x - x.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p.append(_normal_tail(serial * sqrt(n)))
    return name, k, min(p)


def _text_model(docs: DataFrame) -> np.ndarray:
    """log10 probability of each byte after each other one, over all texts."""

    def count(batches):
        pairs = np.zeros(1 << 16, np.int64)
        for _, data, at in blocks(batches):
            if len(data) > 1:
                pairs += np.bincount(data[:-1].astype(np.int64) * 256 + data[1:], minlength=1 << 16)
        seen = np.flatnonzero(pairs)
        yield pa.record_batch({"pair": pa.array(seen), "n": pa.array(pairs[seen])})

    rows = docs.select("text").mapInArrow(count, "pair long, n long")
    pairs = np.zeros(1 << 16)
    sums = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    pairs = pairs.reshape(256, 256) + 0.5
    return np.log10(pairs / pairs.sum(1, keepdims=True)).astype(np.float32)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; leftmost and apart within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [
            (m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16
        ]
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def evidence(word: str, model: np.ndarray) -> float | None:
    """log10 of how much likelier the word is at random than as text; None if not random."""
    tested = battery(word)
    if tested is None or tested[2] < LEVEL:
        return None
    codes = np.frombuffer(word.rstrip("=").encode(), np.uint8).astype(int)
    return float(-(len(codes) - 1) * log(tested[1], 10) - model[codes[:-1], codes[1:]].sum())


def candidates(text: str, taken: list[tuple[int, int, str]] | None = None) -> Iterator[re.Match]:
    """The words to test, those left out that touch a base span; both are read in order once."""
    spans, at, end = None, 0, 0
    for m in CANDIDATE.finditer(text):
        if spans is None:
            spans = base_spans(text) if taken is None else taken
        # Of all spans that begin before the word ends, the one that reaches farthest.
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][1])
            at += 1
        if end <= m.start():
            yield m


def random_spans(
    text: str, model: np.ndarray, taken: list[tuple[int, int, str]]
) -> Iterator[tuple[int, int, float]]:
    """(start, end, evidence) of the words outside the base spans that look random."""
    for m in candidates(text, taken):
        weight = evidence(m[0], model)
        if weight is not None and weight > 0:
            yield m.start(), m.end(), weight


def least_evidence(docs: DataFrame, model: np.ndarray, rate: float = RATE) -> float:
    """The evidence from which on words count as secrets, over all words of the corpus.

    The step-up rule for such evidence: the k strongest words are finds for the largest k
    for which the k-th has evidence of words / (rate * k) or more. Evidence is
    counted in tenths of a power of ten, rounded down, so a table of bounded size tells.
    """

    def count(batches):
        seen: dict[int, int] = {}
        for part, _, _ in blocks(batches):
            for text in part.column("text").to_pylist():
                for m in candidates(text or ""):
                    weight = evidence(m[0], model)
                    level = -1 if weight is None else max(-1, min(int(weight * 10), 10_000))
                    seen[level] = seen.get(level, 0) + 1
        yield pa.record_batch(
            {"level": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())}
        )

    rows = docs.select("text").mapInArrow(count, "level long, n long")
    levels = sorted(rows.groupBy("level").agg(F.sum("n")).collect(), reverse=True)
    words, k, least = sum(n for _, n in levels), 0, float("inf")
    for level, n in levels:
        k += n
        if level > 0 and 10 ** min(level / 10, 300) >= words / (rate * k):
            least = level / 10
    return least


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with the column secrets: an array of (kind, start, end), by start and kind.

    docs: any columns, among them text. Positions are code points, end exclusive. Base
    kinds: assign, access, hex; the tests add kind random for words that touch no base
    span. Null and empty texts have an empty array. Rows stay as they are, repeated
    ones too; a column of docs called secrets is replaced.
    """
    small_batches(docs.sparkSession)
    model = _text_model(docs)
    least = least_evidence(docs, model, rate)
    rest = [c for c in docs.columns if c != "secrets"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for part, _, _ in blocks(batches):
            rows = []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                found = [(s, e, KINDS.index(k)) for s, e, k in base]
                found += [(s, e, 3) for s, e, w in random_spans(text, model, base) if w >= least]
                found.sort(key=lambda s: (s[0], s[2]))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in found])
            yield pa.record_batch([*part.columns, pa.array(rows, kind)], [*rest, "secrets"])

    ddl = "secrets array<struct<kind:string,start:long,end:long>>"
    schema = with_columns(docs.select(*rest).schema, ddl)
    return docs.select(*rest).mapInArrow(scan, schema)


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """docs with every secret of their texts replaced by a mark; n_chars follows the text.

    Spans that overlap are replaced as one. All rows stay; texts without secrets, null
    ones too, stay as they are.
    """
    given, aside = set_aside(docs, ("secrets",))
    found = find_secrets(given, rate)

    def replace(batches):
        for part, _, _ in blocks(batches):
            out = []
            texts, spans = part.column("text").to_pylist(), part.column("secrets").to_pylist()
            for text, own in zip(texts, spans, strict=True):
                end = 0
                pieces = []
                for s in own:
                    if s["end"] <= end:
                        continue
                    if s["start"] >= end:
                        pieces += [text[end : s["start"]], mark]
                    end = s["end"]
                out.append("".join([*pieces, text[end:]]) if own else text)
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            columns["text"] = pa.array(out, pa.string())
            if "n_chars" in columns:
                lengths = [None if x is None else len(x) for x in out]
                columns["n_chars"] = pa.array(lengths).cast(columns["n_chars"].type)
            del columns["secrets"]
            yield pa.record_batch(columns)

    return put_back(found.mapInArrow(replace, given.schema), aside, docs.columns)
