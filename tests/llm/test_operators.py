"""Every operator against brute force or SQL on small tables, odd rows included."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellzonal.llm import decontamination, jaccard_join, license_scan, lm, mixing
from cellzonal.llm import quality_classifier, quality_rules, secrets, toxicity, url_filter
from cellzonal.llm.queries import ORACLES, QUERIES, RULES
from cellzonal.llm.text import TERMS
from check import canonical, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n string, words string, size string, score string, x string"
ODD = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "One two THREE four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n\x0b ", "en", None),
    (6, "one two", "en", "a"),
    (7, "one  two\n", "fr", "a"),
    (None, "one two three four five six seven", None, None),
    (8, LONG, "en", "c"),
    (9, LONG + " end", "en", "c"),
    (9, LONG + " end", "en", "c"),
    (10, "\u00c9t\u00e9 \u212a\u017f \U0001f600 na\u00efve", "xx", "\U00010000"),
    (11, "a" * 200_000, "en", "\uffff"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeats, long texts, and columns with names the operators use."""
    rows = [(*r, 0, "k", "k", "k", "k", "k", "k") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    return dict(rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    db = connect(sf)
    found = QUERIES[name](spark, sf).toPandas().astype(object)
    wanted = db.execute(ORACLES[name]).fetchdf().astype(object)
    assert len(found) > 0
    assert canonical(found) == canonical(wanted)


# -- 1 ---------------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_groups(rows):
    """(doc_id, set size, smallest id reachable), sorted; ids may repeat."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    out = []
    for i, (doc, text) in enumerate(rows):
        out.append((doc, len(shingles(text)), min(x for x in least[root(i)]) if doc is not None else None))
    return sorted(out, key=str)


def test_jaccard_groups_of_odd_rows(odd, none):
    found = jaccard_join.jaccard_groups(odd).collect()
    got = sorted(((r[0], r[1], r[2]) for r in found), key=str)
    assert got == brute_groups([(r[0], r[1]) for r in ODD])
    assert jaccard_join.jaccard_groups(none).count() == 0


def test_jaccard_groups_of_crowded_blocks(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):  # near copies of one text, each some words apart
        words = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    for i in range(90, 130):  # a passage among words of their own
        rows.append((i, " ".join([*base[:30], *[f"y{i}-{k}" for k in range(rng.integers(2, 40))]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (4, 1000):
        found = jaccard_join.jaccard_groups(frame, part=part, rarity_bits=8).collect()
        assert sorted(((r[0], r[1], r[2]) for r in found), key=str) == brute_groups(rows)


def test_rtree_finds_all_points_that_may_be_similar():
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, 16))
    points[150:] = points[:150] + (rng.random((150, 16)) < 0.1)
    sizes = points.sum(1)
    beyond = rng.integers(0, 3, 300)
    tree = jaccard_join.RTree(points, sizes, beyond, leaf=8)
    for point, size, over in zip(points, sizes, beyond, strict=True):
        most = np.minimum(point, points).sum(1) + over + beyond
        wanted = np.flatnonzero(9 * most >= 4 * (size + sizes))
        assert sorted(tree.search(point, size, over)) == wanted.tolist()


def test_counts_beyond_a_byte_lose_no_pair(spark):
    """Sets whose members crowd in few groups; sizes on both sides of a power of two."""
    rng = np.random.default_rng(5)
    spread = rng.integers(0, 1 << 40, 2400, np.uint64) << np.uint64(16)
    pool = np.unique(spread | rng.integers(0, 4, 2400, np.uint64))
    sets = [pool[: 2047 + step] for step in range(0, 300, 30)]
    sets += [np.delete(s, rng.integers(0, len(s), 100)) for s in sets]
    sets += [pool[:1500], pool[900:]]
    held = [jaccard_join.count_vector(s) for s in sets]
    assert all(over > 0 and counts.max() == 127 for counts, over in held)
    assert all(int(c.sum()) + over == len(s) for s, (c, over) in zip(sets, held, strict=True))
    assert len({len(c) for c, _ in held}) == 2
    rows = [(i, len(s), c.tolist(), over) for i, (s, (c, over)) in enumerate(zip(sets, held, strict=True))]
    points = spark.createDataFrame(rows, "node long, n long, counts array<tinyint>, beyond long")
    table = pa.table(
        {
            "node": pa.array(range(len(sets)), pa.int64()),
            "comp": pa.array(range(len(sets)), pa.int64()),
            "n": pa.array([r[1] for r in rows], pa.int64()),
            "counts": pa.array([r[2] for r in rows], pa.list_(pa.int8())),
            "beyond": pa.array([r[3] for r in rows], pa.int64()),
            **{c: pa.array([0] * len(sets), pa.int32()) for c in ("part", "low", "high")},
            "fine": pa.array([np.sort(s.astype(np.uint16)).view(np.int16) for s in sets], pa.list_(pa.int16())),
            "refuted": pa.array([None] * len(sets), pa.list_(pa.int64())),
            "key": pa.array([7] * len(sets), pa.int64()),
        }
    )
    similar = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))
    }
    found = jaccard_join._search_block(table, jaccard_join.AT_LEAST)
    pairs = [*zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)]
    # A tree: it connects whatever similar pairs connect, with fewer pairs than points.
    at = list(range(len(sets)))
    for i, j in pairs:
        assert at[i] != at[j]
        at = [at[i] if k == at[j] else k for k in at]
    assert all(at[i] == at[j] for i, j in similar) and len(similar) > 100
    # Refuted pairs are given no more, and others take their place.
    refuted = defaultdict(list)
    for i, j in pairs:
        refuted[i].append(j)
        refuted[j].append(i)
    table = table.set_column(
        table.column_names.index("refuted"),
        "refuted",
        pa.array([refuted[i] for i in range(len(sets))], pa.list_(pa.int64())),
    )
    more = jaccard_join._search_block(table, jaccard_join.AT_LEAST)
    more = {*zip(more["a"].to_pylist(), more["b"].to_pylist(), strict=True)}
    assert more and not more & set(pairs)
    frame = spark.createDataFrame(sorted(similar), "a long, b long")
    kept = jaccard_join._bounded(frame, points, jaccard_join.AT_LEAST)
    assert {(r["a"], r["b"]) for r in kept.collect()} == similar


def test_similar_sets_of_very_different_size(spark):
    words = [f"w{i}" for i in range(517)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:214])), (3, " ".join(f"x{i}" for i in range(300)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_groups(frame, at_least=(40, 100)).collect()
    assert {(r[0], r[1], r[2]) for r in found} == {(1, 513, 1), (2, 210, 1), (3, 296, 3)}


def test_block_search_folds_as_often_as_sizes_need():
    sizes = {0: 64, 1: 256}
    counts = [np.full(g, 2, np.int8).tolist() for g in sizes.values()]
    table = pa.table(
        {
            "node": pa.array([10, 11]), "comp": pa.array([10, 11]), "part": pa.array([0, 0]),
            "low": pa.array([0, 0]), "high": pa.array([0, 0]), "n": pa.array([210, 513]),
            "beyond": pa.array([0, 0]), "counts": pa.array(counts, pa.list_(pa.int8())),
            "fine": pa.array([list(range(210)), list(range(513))], pa.list_(pa.int16())),
            "refuted": pa.array([None, []], pa.list_(pa.int64())), "key": pa.array([3, 3]),
        }
    )
    found = jaccard_join._search_block(table, (15, 100)).to_pylist()
    assert found == [{"a": 10, "b": 11, "a_n": 210, "b_n": 513, "key": 3}]


def test_refuted_pairs_hide_no_others(spark):
    """Pairs one shingle below the threshold, which 2^16 groups do not tell from similar ones."""
    base = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(14):  # each has other words in a place of its own; 333 lost shingles still link
        words, own = list(base), 158 + i % 9
        words[i * 200 + 20 : i * 200 + 20 + own] = [f"x{i}-{k}" for k in range(own)]
        rows.append((i, " ".join(words)))
    rows += [(50 + i, text.replace("w", "v")) for i, text in rows[6:9]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_groups(frame, rarity_bits=3).collect()
    assert sorted(((r[0], r[1], r[2]) for r in found), key=str) == brute_groups(rows)


def test_one_of_each_keeps_bare_rows_and_ones_without_id(odd):
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(odd).collect()]
    assert sorted(str(i) for i, _ in kept) == sorted(["1", "3", "4", "5", "6", "None", "8", "10", "11"])


# -- 2 ---------------------------------------------------------------------------------


def test_urls_of_all_kinds(spark):
    urls = [
        None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.net/x?y#z",
        "https://www.Example.net/en/1", "https://example.net/en", "http://badexample.net/en/",
        "http://x.example.com/de/../", "http://example.com/DE/", "a://b://org/fr/", "x://q.org/fr/?",
        "http://net:80/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "https://a.net/x?y#z",
    ]
    pages = spark.createDataFrame(
        [(i, u, "k", "k") for i, u in enumerate(urls)], "page_id int, url string, rule string, short string"
    )
    rules = spark.createDataFrame(
        [*RULES, *RULES, (None, "/", "block"), ("q.org", "/fr", "block")],
        "host string, path string, verdict string",
    )

    def judged(url):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = m[1].translate(UPPER), m[2]
        fits = [
            (len(h) + len(p), h + p, v)
            for h, p, v in [*RULES, ("q.org", "/fr", "block")]
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    found = url_filter.judge_urls(pages, rules).collect()
    assert len(found) == len(urls)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"]])
    bare = url_filter.judge_urls(pages, rules.limit(0))
    assert {r["verdict"] for r in bare.collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# -- 3 and 8 ---------------------------------------------------------------------------


@pytest.mark.parametrize("name, label, least", [("op3_toxicity", "toxic", 0.9), ("op8_quality_classifier", "quality", 0.9)])
def test_classifier_on_held_out_documents(spark, sf, name, label, least):
    sf = sf.replace("sf0.001", "sf0.01")
    found = QUERIES[name](spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").df()
    fold, held = (3, 1) if label == "toxic" else (5, 0)
    crc = found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % fold == held)
    assert (crc == found.held_out).all()
    assert found.score.between(0, 1).all()
    both = found[found.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both[label]).mean() >= least


def test_classifiers_take_odd_rows_and_few_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for frame, marks in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        assert toxicity.score_toxicity(frame, marks).count() == frame.count()
        rows = quality_classifier.score_quality(frame, marks).collect()
        assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(2, 1, 5000), rng.normal(-2, 1, 1500)
    mixed = np.concatenate([good[:3500], bad])
    assert abs(quality_classifier.estimate_prior(good[3500:], mixed) - 0.7) < 0.06


# -- 4 ---------------------------------------------------------------------------------


def test_mix_takes_near_its_targets(odd, none):
    rows = mixing.queue(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for r in rows:
        assert abs(by[r["source"]] - r["target"]) <= 1
    again = mixing.queue(odd.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.queue(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd).collect()
    assert [r["finishes"] for r in mixed] == sorted(r["finishes"] for r in mixed)
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(r["taken"] for r in rows)
    assert all(len(WORD.findall(r["text"])) == r["words"] for r in mixed)
    # Copies follow each other by finish time without a gap, up to the budget.
    copies = sorted((c["position"], c["words"], c["finishes"]) for r in rows for c in r["copies"] or ())
    assert [p for p, _, _ in copies] == [sum(w for _, w, _ in copies[:i]) for i in range(len(copies))]
    assert [f for *_, f in copies] == sorted(f for *_, f in copies)
    assert abs(sum(w for _, w, _ in copies) - 1.5 * sum(r["size"] for r in rows)) <= len(by)


def brute_mix(rows, share=1.5, weights=None):
    """Words taken of each row, by a queue that is read step by step."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    weight = {s: (weights or {}).get(s, (3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    total = Counter()
    for (*_, s), n in zip(rows, size, strict=True):
        total[s] += n
    left, open_sources, at = share * sum(size), {s for s in total if total[s]}, 0.0
    while open_sources and left > 0:
        speed = sum(weight[s] for s in open_sources)
        dry = min(2 * total[s] / weight[s] for s in open_sources)
        step = min(dry - at, left / speed)
        at, left = at + step, left - step * speed
        open_sources = {s for s in open_sources if 2 * total[s] / weight[s] > at + 1e-9}
    return {s: min(weight[s] * at, 2 * total[s]) for s in total}


@pytest.mark.parametrize("kind", ["one large source", "null ids", "many sources", "weights"])
def test_mix_of_lopsided_sources(spark, kind):
    rng = np.random.default_rng(3)
    names = {"one large source": ["a"] * 90 + ["b", "c", None], "many sources": [f"s{i}" for i in range(60)]}
    pool = names.get(kind, ["a", "b", None])
    rows = []
    for i in range(400):
        source = pool[int(rng.integers(len(pool)))]
        text = " ".join(["w"] * int(rng.integers(0, 30)))
        rows.append((None if kind == "null ids" else i, text, source))
    weights = {"a": 1.0, "b": 5.0, None: 2.5} if kind == "weights" else None
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = table.withColumns({c: F.lit("x") for c in ("part", "row", "size", "name", "doc", "key1", "nth")})
    found = mixing.queue(table, weights=weights).collect()
    targets, taken = brute_mix(rows, weights=weights), Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - targets[r["source"]]) < 1e-6
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    mixed = mixing.mix(table, weights=weights)
    assert mixed.columns[:5] == ["doc_id", "text", "source", "part", "row"]
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
        assert r["part"] == r["nth"] == "x"
    assert +words == +taken


def test_mix_is_range_sorted_and_counts_cut_texts(spark):
    rows = [(i, "word " * 40, "a" if i < 20 else "b", 200) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(table)
    assert "rangepartitioning(finishes" in mixed._jdf.queryExecution().executedPlan().toString()
    cut = [r for r in mixed.collect() if r["words"] < 40]
    assert cut and all(r["n_chars"] == len(r["text"]) for r in cut)


# -- 5 ---------------------------------------------------------------------------------


def brute_lm(rows):
    """Scores by dictionaries."""
    tokens = {i: [*WORD.findall((t or "").translate(UPPER)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    pairs, single = Counter(), Counter()
    for i, own in tokens.items():
        if not held[i]:
            single.update(own)
            pairs.update(zip(["<s>", *own], own, strict=False))
    after, follow, total = Counter(), defaultdict(Counter), Counter()
    for (u, w), c in pairs.items():
        after[w] += 1
        follow[u][min(c, 3)] += 1
        total[u] += c

    def off(counts):
        n = Counter(counts)
        d = [0.0]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        for k in (1, 2, 3):
            value = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5
            d.append(min(max(value, 0.05), k - 0.05))
        return d

    d2, d1 = off(pairs.values()), off(after.values())
    kinds = Counter(min(c, 3) for c in after.values())
    n, v = sum(single.values()), len(single)
    left1 = sum(d1[k] * kinds[k] for k in (1, 2, 3))

    def p1(w):
        return (after[w] - d1[min(after[w], 3)] + left1 / (v + 1)) / len(pairs)

    def p2(u, w):
        if not total[u]:
            return p1(w)
        c = pairs[u, w]
        left = sum(d2[k] * follow[u][k] for k in (1, 2, 3))
        return (c - d2[min(c, 3)] + left * p1(w)) / total[u]

    assert abs(sum(p2("<s>", w) for w in single) + p2("<s>", "no such word") - 1) < 1e-9
    return {
        i: (
            held[i],
            len(own),
            sum(single[w] > 0 for w in own),
            n,
            sum(log10((single[w] + 1) / (n + v + 1)) for w in own),
            sum(log10(p2(u, w)) for u, w in zip(["<s>", *own], own, strict=False)),
        )
        for i, own in tokens.items()
    }


def test_language_model_equals_dictionaries(spark, sf, docs):
    wanted = brute_lm(list(docs.items()))
    source = spark.read.parquet(f"{sf}/documents.parquet")
    for size in (lm.SHARD_BYTES, 50_000):
        found = lm.score_texts(source.repartition(4), size).collect()
        assert len(found) == len(wanted)
        for r in found:
            own = wanted[r["doc_id"]]
            assert tuple(r)[1:5] == own[:4]
            assert np.allclose(tuple(r)[5:7], own[4:], rtol=1e-9)


def test_language_model_of_odd_rows(odd, none):
    assert lm.score_texts(none).count() == 0
    rows = lm.score_texts(odd).collect()
    assert len(rows) == len(ODD) and all(r["score"] <= 0 for r in rows)
    held = odd.where("doc_id = 1").limit(0).union(odd.where("crc32(cast(doc_id as string)) % 7 = 2"))
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in lm.score_texts(held).collect())


def test_counts_beyond_a_byte_and_several_sends(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 1000)
    rows = [(i, "a b " * 400) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    wanted = brute_lm(rows)
    for r in lm.score_texts(frame).collect():
        assert np.isclose(r["score"], wanted[r["doc_id"]][5], rtol=1e-9)


def brute_triples(rows):
    """Scores of order three by dictionaries."""
    tokens = {i: ["<s>", *WORD.findall((t or "").translate(UPPER)), None] for i, t in rows}
    train = [own for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    triples = Counter(x for own in train for x in zip(own, own[1:], own[2:], strict=False))
    pairs = Counter((own[0], own[1]) for own in train) + Counter((v, w) for _, v, w in triples)
    after = Counter(w for _, w in pairs)

    def level(counts):
        n, total, follow = Counter(counts.values()), Counter(), defaultdict(Counter)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        off = [0.0]
        for k in (1, 2, 3):
            off.append(min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5, 0.05), k - 0.05))
        for x, c in counts.items():
            total[x[:-1]] += c
            follow[x[:-1]][min(c, 3)] += 1

        def p(x, lower):
            h = x[:-1]
            left = sum(off[k] * follow[h][k] for k in (1, 2, 3))
            c = counts[x]
            return (c - off[min(c, 3)] + left * lower) / total[h] if total[h] else lower

        return p

    p3, p2, p1 = level(triples), level(pairs), level(Counter({(w,): c for w, c in after.items()}))

    def p(*x):
        lower = p2(x[-2:], p1(x[-1:], 1 / (len(after) + 1)))
        return p3(x, lower) if len(x) > 2 else lower

    for h in (("<s>",), next(iter(triples))[:2]):
        assert abs(sum(p(*h, w) for w in [*after, "no such word"]) - 1) < 1e-9
    return {i: sum(log10(p(*own[max(0, j - 2) : j + 1])) for j in range(1, len(own))) for i, own in tokens.items()}


def test_language_model_of_order_three_equals_dictionaries(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 30_000)
    wanted = brute_triples(list(docs.items()))
    source = spark.read.parquet(f"{sf}/documents.parquet")
    split = lm.score_texts(source.repartition(4), 50_000, order=3)
    for found in (QUERIES["op5_lm_scoring"](spark, sf).collect(), split.collect()):
        assert len(found) == len(wanted)
        assert all(np.isclose(r["score"], wanted[r["doc_id"]], rtol=1e-9) for r in found)


def test_order_three_of_odd_rows_and_large_counts(spark, odd, none):
    assert lm.score_texts(none, order=3).count() == 0
    assert lm.score_texts(odd, order=3).count() == len(ODD)
    rows = [(i, "a b " * 400) for i in range(5)]
    wanted = brute_triples(rows)
    for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect():
        assert np.isclose(r["score"], wanted[r["doc_id"]], rtol=1e-9)


# -- 6 ---------------------------------------------------------------------------------


def brute_base(text):
    found = []
    for m in re.finditer(
        r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text, re.IGNORECASE | re.ASCII,
    ):
        found += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)), 1):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_secret_base_equals_patterns(spark, sf, docs):
    for r in QUERIES["op6_secret_scan"](spark, sf).collect():
        base = brute_base(docs[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert r["n_assign"] == sum(b.startswith("assign") for b in base)


def test_random_words_are_found_and_texts_are_not(spark, docs):
    rng = np.random.default_rng(9)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    random = "".join(rng.choice(letters, 44))
    rows = [(i, t) for i, t in docs.items()]
    rows += [(-1, f"\u00e9 x {random} y"), (-2, None), (-3, ""), (-4, 'API_KEY: "abcdefgh.ij" and AKIA' + "Q7" * 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find_secrets(frame).collect()}
    assert found[-1] == [("random", 4, 48)]
    assert found[-2] == [] and found[-3] == []
    assert [s[0] for s in found[-4]] == ["assign", "access"]
    assert sum(s[0] == "random" for own in found.values() for s in own) <= 2
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame).collect()}
    assert clean[-1] == "\u00e9 x [secret] y" and clean[-2] is None
    assert all(not brute_base(t or "") for t in clean.values())


def test_random_values_behind_names_are_found(spark, docs):
    rng = np.random.default_rng(10)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    forms = [
        "export AWS_SECRET_ACCESS_KEY={} # x",
        "AccountName=x;AccountKey={}==;EndpointSuffix=y",
        "see https://h.example/a?b=1&sig={}&c=2 there",
        "client_key={}",
        "id=={}= and",
    ]
    rows, wanted = [(i, t) for i, t in docs.items()], {}
    for k, form in enumerate(forms, 1):
        value = "".join(rng.choice(letters, 44))
        text = form.format(value)
        start, end = text.index(value), text.index(value) + 44
        end += {2: 2, 5: 1}.get(k, 0)
        rows.append((-k, text))
        wanted[-k] = [("random", start, end)], f"{text[:start]}[secret]{text[end:]}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find_secrets(frame).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame).collect()}
    assert {i: (found[i], clean[i]) for i in wanted} == wanted
    assert sum(s[0] == "random" for i, own in found.items() if i >= 0 for s in own) <= 2


def test_secrets_of_odd_rows(odd, none):
    assert secrets.redact(none).count() == 0
    assert secrets.redact(odd).schema == odd.schema
    wanted = ["[secret]" if r[0] == 11 else str(r[1]) for r in ODD]  # a long run of the letter a is hex
    assert sorted(str(r["text"]) for r in secrets.redact(odd).collect()) == sorted(wanted)


# -- 7 ---------------------------------------------------------------------------------


def brute_passages(text, items, window=13):
    words = TERM.findall((text or "").translate(UPPER))
    hit, ids = set(), set()
    for item, passage in items:
        own = TERM.findall((passage or "").translate(UPPER))
        k = min(window, len(own))
        for i in range(len(own) - k + 1) if k else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    ids.add(item)
    return len(words), len(hit), sorted(str(i) for i in ids - {None})


def test_passages_of_odd_items(spark, odd, none):
    items = [
        (1, "one TWO"), (2, None), (3, ""), (None, "w5 w6 w7"), (5, "three-four five, six seven"),
        (5, "one two"), (11, " ".join(f"w{i}" for i in range(40))), (12, "\u00e9t\u00e9"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(odd, benchmark, shard=1000)
    got = sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in found.collect())
    short = [r if r[0] not in (8, 9) else r for r in ODD]
    wanted = []
    known = {}
    for r in short:
        if r[1] not in known:
            known[r[1]] = brute_passages(r[1], items)
        wanted.append(str((r[0], *known[r[1]])))
    assert got == sorted(wanted)
    assert decontamination.find_passages(none, benchmark).count() == 0
    assert decontamination.clean(odd, benchmark.limit(0)).count() == len(ODD)
    longest = [m for r in found.where("doc_id = 8").collect() for m in r["matches"] if m["item_id"] == 11]
    assert {m["words"] for m in longest} == {40}


# -- 9 ---------------------------------------------------------------------------------


def test_license_base_equals_word_search(spark, sf, docs):
    for r in QUERIES["op9_license_scan"](spark, sf).collect():
        words = TERM.findall((docs[r["doc_id"]] or "").translate(UPPER))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            own = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_expressions(spark, odd, none):
    assert license_scan.evaluate("MIT")[:2] == ({"mit"}, True)
    assert license_scan.evaluate("GPL-3.0-only OR (MIT AND Apache-2.0)")[:2] == ({"gpl-3.0-only", "mit", "apache-2.0"}, True)
    assert license_scan.evaluate("GPL-2.0 WITH Classpath-exception-2.0 AND MIT")[:2] == ({"gpl-2.0", "mit"}, False)
    forms = {
        "MIT OR GPL-2.0": ("gpl-2.0 or mit", True),
        "MIT AND GPL-2.0": ("gpl-2.0 and mit", False),
        "(MIT OR ISC) AND GPL-2.0 AND MIT": ("(isc or mit) and gpl-2.0 and mit", False),
        "MIT AND ISC OR GPL-2.0": ("gpl-2.0 or isc and mit", True),
        "GPL-2.0 WITH Classpath-exception-2.0 OR mit or MIT": ("gpl-2.0 with classpath-exception-2.0 or mit", True),
        "(mit and MIT)": ("mit", True),
    }
    for text, wanted in forms.items():
        verdict = license_scan.evaluate(text)
        assert (verdict.form, verdict.open) == wanted
        again = license_scan.evaluate(verdict.form)
        assert (again.form, again.open, again.licenses) == (verdict.form, verdict.open, verdict.licenses)
    assert license_scan.evaluate("GPL-2.0 AND MIT OR ISC").open
    for bad in ("", "AND MIT", "(MIT", "MIT OR", ")"):
        assert license_scan.evaluate(bad) is None
    text = "CC by cc BY-cc by\n# SPDX-License-Identifier: MIT OR GPL-2.0\nAll rights, reserved."
    frame = spark.createDataFrame([(1, text, "k")], "doc_id long, text string, labels string")
    row = license_scan.scan_licenses(frame).first()
    assert row["places"] == [0, 2, 4, 14] and row["base_labels"] == "cc-by,reserved"
    assert row["labels"] == "cc-by,gpl-2.0,mit,reserved"
    assert row["expressions"] == ["gpl-2.0 or mit"] and row["grants"] is True
    none_there = spark.createDataFrame([(1, "CC by")], "doc_id long, text string")
    assert license_scan.scan_licenses(none_there).first()["grants"] is None
    assert license_scan.scan_licenses(odd).count() == len(ODD)
    assert license_scan.scan_licenses(none).count() == 0


def test_scans_take_time_in_proportion_to_a_text(spark):
    """A megabyte of tags, and of hex words with base spans among them, in a few seconds."""
    tags = "".join(f"# SPDX-License-Identifier: MIT OR L-{i}\n" for i in range(28_000))
    machine = license_scan.automaton({**license_scan.BASE, **license_scan.NOTICES, license_scan.TAG: ""})
    words = tags.encode().translate(TERMS).split()
    start = time.process_time()
    scan = license_scan.scan_text(tags, words, machine)
    assert time.process_time() - start < 6 and len(scan.expressions) == 28_000
    rng = np.random.default_rng(2)
    digits = np.array(list("0123456789abcdef"))
    text = " ".join("".join(digits[rng.integers(0, 16, 24 + 20 * (i % 2))]) for i in range(28_000))
    start = time.process_time()
    base = secrets.base_spans(text)
    left = [m.span() for m in secrets.candidates(text, base)]
    assert time.process_time() - start < 2 and len(base) == len(left) == 14_000
    taken = [(5, 40, "hex"), (6, 10, "assign"), (100, 140, "hex")]
    text = " " * 41 + "a" * 30 + " " * 20 + "b" * 30 + " " + "c" * 24
    assert [m.start() for m in secrets.candidates(text, taken)] == [41]


CLASHING = (
    "n_words", "n_hit", "items", "matches", "secrets", "kept_id", "kept_nth", "best_host",
    "best_path", "best_verdict", "rule_verdict", "part", "row", "size", "key1", "nth", "doc",
    "shuffled", "node", "n", "counts", "fine", "comp", "begins", "own_n_words", "own_secrets",
)


def test_columns_named_like_working_ones_stay(spark, odd, none):
    """All stages of the pipeline and the url filter on a table with every such column."""
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("mine").alias(c) for c in CLASHING])
    benchmark = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    for found in (
        jaccard_join.one_of_each(rows),
        decontamination.clean(rows, benchmark),
        secrets.redact(rows),
        mixing.mix(rows).drop("copy", "words", "starts", "finishes"),
    ):
        assert found.columns == rows.columns
        got = found.collect()
        assert got and all(r[c] == "mine" for r in got for c in CLASHING)
    pages = rows.withColumn("url", F.lit("http://a.net/x"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(pages, rules).collect()
    assert len(judged) == len(ODD) and all(r["verdict"] == "block" and r["best_host"] == "mine" for r in judged)


# -- 10 --------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if seen[w] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(repeated), n < 50 or 100 * len(repeated) > 50 * n,
    )


def test_quality_counts_equal_brute_force(spark, sf, docs, odd, none):
    found = QUERIES["op10_quality_rules"](spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:7] == brute_rules(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    got = [str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in quality_rules.quality_rules(odd).collect()]
    assert sorted(got) == sorted(str((r[0], *brute_rules(r[1]))) for r in ODD)
    assert quality_rules.quality_rules(none).count() == 0


def test_distances_are_jensen_shannon():
    a, b = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0.0, 1.0])
    assert np.allclose(quality_rules.distances(a, b), [1.0, np.sqrt(0.311278)], atol=1e-5)


def test_documents_are_judged_by_their_own_language(spark, docs, sf):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall()
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r["kept"]}
    english = next(t for i, t, lang in rows if i in kept and lang == "en" and len(t) > 1000)
    rng = np.random.default_rng(5)
    junk = [" ".join("".join(rng.choice(list("XQZJ0123456789"), 9)) for _ in range(80)) for _ in range(3 * len(rows))]
    more = [(-1, english, None), (-2, english, "xx")]
    more += [(-10 - k, t, (None, "xx")[k % 2]) for k, t in enumerate(junk)]
    more += [(-100_000 - k, "lorem $$ " * 200, "en") for k in range(2 * len(rows))]
    named = [(-3, english, "fr"), (-4, junk[0], "en"), (-5, junk[1], "fr")]
    for extra in (more, [*more, *named]):
        frame = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
        found = {r["doc_id"] for r in quality_rules.quality_rules(frame).collect() if r["kept"]}
        assert {i for i in found if i < 0} == {-1, -2}
        if extra is more:  # rows of no listed language and failed ones move no reference
            assert found - {-1, -2} == kept


# -- pipeline --------------------------------------------------------------------------


def test_pipeline_stages_on_their_own_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        path_rows = stage(spark, before, sf).collect()
        docs = spark.createDataFrame(path_rows, before.schema)
        assert docs.columns == columns
        kept[name] = (before.collect(), path_rows)
    before, after = kept["jaccard join"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in groups if i == c)
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    before, after = kept["decontamination"]
    left = set()
    for r in before:
        n, hit, _ = brute_passages(r["text"], items)
        left |= set() if hit and 20 * hit >= n else {r["doc_id"]}
    assert {r["doc_id"] for r in after} == left
    before, after = kept["secret scan"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert all(not brute_base(r["text"] or "") for r in after)
    mixed = corpus_pipeline.mixing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in after}


def test_pipeline_takes_empty_tables(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_toxicity_draws_each_label_up_to_its_own_bound(spark):
    marks = spark.range(30_000).selectExpr("id as label_id", "cast(id % 100 = 0 as int) as toxic")
    drawn = {r["toxic"]: r for r in toxicity.draw(marks, 2000).groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    assert drawn[1]["n"] == 300 and drawn[1]["weight"] == 300
    assert 1500 < drawn[0]["n"] < 1900 and abs(drawn[0]["weight"] / 29_700 - 1) < 0.1
    even = marks.withColumn("toxic", F.col("label_id").cast("int") % 2)
    sizes = dict(map(tuple, toxicity.draw(even, 2000).groupBy("toxic").count().collect()))
    assert all(850 < n < 1150 for n in sizes.values())
    assert toxicity.draw(marks, 50_000).where("weight = 1").count() == 30_000
    assert toxicity.draw(marks.limit(0), 10).count() == 0


def test_toxicity_mines_the_same_text_of_equal_sets(spark):
    texts = [("vile b a", 1), ("vile a b b", 1), ("a b vile a", 1), ("kind a", 0), ("a kind", 0)] * 6
    first, second = (
        toxicity.mine_terms(spark.createDataFrame(t, "text string, toxic int").repartition(k))
        for t, k in ((texts, 1), (texts[::-1], 5))
    )
    assert first == second
