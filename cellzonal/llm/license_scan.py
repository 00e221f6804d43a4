"""Licences named in texts: Aho-Corasick over words, and a parser of licence expressions.

One automaton holds the words of all notice phrases and identifier tags; each text passes
through it once. An expression behind an identifier tag is put into operator order
by shunting-yard and evaluated to the licences it names and whether they grant use.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellzonal.llm.text import TERMS, blocks, small_batches, with_columns

# The base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Further notices; the first words of a licence's usual notice or name.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu free documentation license": "gfdl",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"
EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*|[()]")
#: Identifiers that grant reuse, others and unknown ones do not count as granting.
OPEN = {
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0",
    "cc-by-4.0", "mpl-2.0", "0bsd",
}
ORDER = {"or": 1, "and": 2, "with": 3}
#: How sure a label is: an identifier tag, a full notice, a base phrase alone.
SURE = {"tag": 0.95, "notice": 0.8, "base": 0.5}


class Verdict(NamedTuple):
    """Licences named, whether they grant use, the normal form, and its parts under one operator."""

    licenses: frozenset[str]
    open: bool
    form: str
    parts: frozenset[str] = frozenset()
    operator: str = ""


def evaluate(expression: str) -> Verdict | None:
    """What a licence expression comes to; None if it is not one.

    AND grants if both sides do, OR if either does; WITH adds an exception to the licence on
    its left, which stays what it is. WITH binds tightest, then AND, then OR.
    The expression ends where what follows fits no more. In the normal form names are in
    lower case, what one operator joins is sorted and told once, and only an OR within an
    AND stands in brackets.
    """
    output: list[Verdict] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        right, left = output.pop(), output.pop()
        if op == "with":
            output.append(left._replace(form=f"{left.form} with {right.form}"))
            return
        grants = left.open and right.open if op == "and" else left.open or right.open
        parts: frozenset[str] = frozenset()
        for side in (left, right):
            inner = f"({side.form})" if (op, side.operator) == ("and", "or") else side.form
            parts |= side.parts if side.operator == op else {inner}
        form = f" {op} ".join(sorted(parts)) if len(parts) > 1 else left.form
        output.append(Verdict(left.licenses | right.licenses, grants, form, parts, op))

    want_name, depth = True, 0
    for token in TOKEN.findall(expression):
        word = token.lower()
        if want_name:
            if token == "(":
                waiting.append("(")
                depth += 1
            elif word not in ORDER and token != ")":
                name = word.rstrip(".")
                output.append(Verdict(frozenset([name]), name.rstrip("+") in OPEN, name))
                want_name = False
            else:
                return None
        elif token == ")" and depth:
            while waiting[-1] != "(":
                apply(waiting.pop())
            waiting.pop()
            depth -= 1
        elif word in ORDER:
            while waiting and waiting[-1] != "(" and ORDER[waiting[-1]] >= ORDER[word]:
                apply(waiting.pop())
            waiting.append(word)
            want_name = True
        else:
            break
    if want_name or depth:
        return None
    while waiting:
        apply(waiting.pop())
    return output[0]


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    """Phrases by their words, each in single blanks, so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


class Scan(NamedTuple):
    """What a text says: base places, labels of base phrases and of all, score, expressions, grant."""

    places: list[int]
    base: set[str]
    labels: set[str]
    score: float
    expressions: list[str]
    grants: bool | None


def scan_text(text: str, words: list[bytes], machine: ahocorasick.Automaton) -> Scan:
    """The automaton and the expressions pass over a text once each."""
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = [(end, phrase) for end, phrase in machine.iter(line)]
    if not found:
        return Scan([], set(), set(), 0.0, [], None)
    blanks = np.cumsum([0, *[len(w) + 1 for w in words]])
    places, base, sure, tagged = [], set(), {}, False
    for end, phrase in found:
        if phrase in BASE:
            start = end - len(phrase) - 1
            places.append(start)
            base.add(BASE[phrase])
            sure[BASE[phrase]] = max(sure.get(BASE[phrase], 0), SURE["base"])
        elif phrase == TAG:
            tagged = True
        else:
            sure[NOTICES[phrase]] = max(sure.get(NOTICES[phrase], 0), SURE["notice"])
    verdicts = {m[1] for m in EXPRESSION.finditer(text)} if tagged else set()
    verdicts = [v for v in map(evaluate, verdicts) if v]
    for verdict in verdicts:
        sure.update(dict.fromkeys(verdict.licenses, SURE["tag"]))
    return Scan(
        np.searchsorted(blanks, sorted(places)).tolist(),
        base,
        base | set(sure),
        1 - float(np.prod([1 - sure[name] for name in sorted(sure)])),
        sorted({v.form for v in verdicts}),
        all(v.open for v in verdicts) if verdicts else None,
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with n_words, places, base_labels, labels, score, expressions, grants.

    docs: any columns, among them text. Words are lower-cased in A-Z and hold letters, digits
    and what is not ASCII. places has the first words of the base phrases, from 0 and in
    order, once for each phrase. labels adds the licences of other notices and of
    ``SPDX-License-Identifier`` expressions to base_labels; both are sorted, different and
    joined by commas, and empty for texts without any, null ones too. score is how sure
    the labels are together, 0 without any. expressions has the normal forms of the text's
    different expressions, and grants whether every one of them grants use, null where there
    is none. All rows stay, repeated ones too; columns of docs of these names are replaced.
    """
    small_batches(docs.sparkSession)
    made = ("n_words", "places", "base_labels", "labels", "score", "expressions", "grants")
    rest = [c for c in docs.columns if c not in (*made, "text")]
    phrases = {**BASE, **NOTICES, TAG: ""}

    def scan(batches):
        machine = automaton(phrases)
        for part, data, at in blocks(batches):
            raw = data.tobytes().translate(TERMS)
            texts = part.column("text")
            rows = []
            for r, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                words = raw[a:b].split()
                own = scan_text(texts[r].as_py() or "", words, machine)
                labels = [",".join(sorted(names)) for names in (own.base, own.labels)]
                rows.append((len(words), own.places, *labels, own.score, own.expressions, own.grants))
            kinds = (
                pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.float64(),
                pa.list_(pa.string()), pa.bool_(),
            )
            columns = [part.column(c) for c in rest]
            columns += [
                pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)
            ]
            yield pa.record_batch(columns, [*rest, *made])

    ddl = (
        "n_words long, places array<long>, base_labels string, labels string, score double, "
        "expressions array<string>, grants boolean"
    )
    schema = with_columns(docs.select(*rest).schema, ddl)
    return docs.select(*rest, "text").mapInArrow(scan, schema)
