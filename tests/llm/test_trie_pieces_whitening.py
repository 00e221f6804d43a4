"""The prefix trie, the piece encoder and the whitening against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cellzonal.llm import pieces, prefix_trie, whitening
from cellzonal.llm.queries import QUERIES

# -- prefix trie -----------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", len((text or "").encode()), text or ""))
    turns = {c: [(r, t) for *_, r, _, t in sorted(own)] for c, own in convs.items()}
    nodes = defaultdict(list)
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == path)
        out.append(
            (
                len(path),
                min(members),
                min(nodes[path[:-1]]) if path else None,
                len(members),
                sum(1 for p in nodes if p and p[:-1] == path),
                len(leaves),
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


NODE = (
    "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
TURNS = "conv_id long, turn long, role string, text string"


def found_nodes(spark, rows, more="", **options):
    table = spark.createDataFrame([(*r, *[0] * more.count(",")) for r in rows], TURNS + more)
    found = prefix_trie.prefix_trie(table.repartition(3), **options).select(*NODE)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def conversations(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 100), n):
        for turn in range(rnd.choice((0, 1, 3, 5, 9, 11)) or 1):
            text = rnd.choice(("a", "b", "Äpfel", "", None, "a longer one"))
            rows.append((c, turn, rnd.choice(("user", "user", None, "x")), text if turn else "hello"))
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 20_000])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = conversations(3)
    assert found_nodes(spark, rows, shard_turns=shard_turns) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a common conversation, names."""
    rows = [(c, t, "user", f"t{t}") for c in range(200, 260) for t in range(4)]
    rows += [(3, None, None, None), (3, None, "a", "x"), (3, 0, "b", "y"), (3, 0, "b", "y")]
    rows += [(3, 1, "b", "zz"), (3, 1, "b", "z"), (None, 0, "user", "lost"), (7, 0, "user", "t0")]
    rows += [(900, t, "user", "turn" * 500) for t in range(300)]
    more = ", k1 long, path long, depth long, n long, p1 long"
    assert found_nodes(spark, rows, more, shard_turns=20) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    assert found_nodes(spark, []) == []
    assert found_nodes(spark, [(None, 0, "user", "x")]) == []


def test_a_double_array_has_all_paths_and_no_others():
    rnd = random.Random(5)
    paths = [[rnd.randrange(50) for _ in range(rnd.randrange(6))] for _ in range(400)]
    paths += [[7] * 30, [k for k in range(500)], *([9, k] for k in range(300))]
    trie = prefix_trie.DoubleArray(paths)
    prefixes = {tuple(p[:d]) for p in paths for d in range(1, len(p) + 1)}
    slots = {}
    for p in prefixes:
        walked = list(trie.walk(p))
        assert len(walked) == len(p)
        slots[p] = walked[-1]
    assert len(set(slots.values())) == len(prefixes) == len(trie.order) - 1
    assert all(trie.check[slots[p]] == (slots[p[:-1]] if p[1:] else 0) for p in prefixes)
    for p in prefixes:
        for turn in (7, 51, 9999):
            goes_on = len(list(trie.walk((*p, turn)))) > len(p)
            assert goes_on == ((*p, turn) in prefixes)
    assert len(trie.check) < 1.5 * len(prefixes)


# -- pieces ----------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    None, "", " ", "  a  b ", "\n\n\ta", "a\0b", "▁x▁▁y", "éé", "​﻿x", "<s>hi</s><unk><0x41>",
    "\U0001d4b3\U0001f600 ﬁ Ａ", "中文字 かな", "x" * 5000, "ab" * 40 + "中" * 60 + " end", LONG, "the the", "the the",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(library, sf):
    own = pieces.Pieces(pieces.read_model(MODEL))
    rnd = random.Random(2)
    letters = "ab  ▁\n\t\0<s>é́中\U0001d4b3ﬁ1.,the "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(70))) for _ in range(3000)]
    texts += [t for t in TEXTS if t]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE text <> ''").fetchall()]
    ids = [i.tolist() for i in own.encode(texts)]
    assert ids == library.encode(texts)
    assert [own.merge(p) for p in list(own.known)[:2000]] == list(own.known.values())[:2000]
    assert [own.decode(i) for i in ids] == [library.decode(i) for i in ids]
    some = [[rnd.choice((rnd.randrange(32_000), rnd.randrange(262))) for _ in range(rnd.randrange(9))] for _ in range(4000)]
    assert [own.decode(i) for i in some] == [library.decode(i) for i in some]


def test_pieces_of_odd_rows_and_clashing_names(spark, library):
    rows = [(i, t, "k", "k", 1) for i, t in enumerate(TEXTS)] + [(None, "the", "k", "k", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded_agree string, x int")
    model = pieces.read_model(MODEL)
    found = pieces.decode_ids(pieces.encode_texts(table, model, keep_text=True), model)
    assert found.columns == ["doc_id", "text", "x", "ids", "ids_agree", "decoded", "decoded_agree"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == library.decode(r["ids"])
        assert r["ids_agree"] and r["decoded_agree"]
    assert pieces.encode_texts(table.limit(0), model).count() == 0


def test_piece_query_equals_the_library(spark, sf, library):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = QUERIES["op12_sentencepiece"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["library_agrees"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# -- whitening -------------------------------------------------------------------------


def brute_whitening(vectors, top=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    deviation = [sum(int(v) ** 2 for v in n * row - sums) for row in x]
    centred = x - sums / n
    variance = centred.T @ centred / n
    values, axes = np.linalg.eigh(variance)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    return deviation, centred @ axes / np.sqrt(values), values / np.trace(variance), values


def check_whitening(got, vectors, top=8):
    deviation, white, explained, values = brute_whitening(vectors, top)
    by_row = np.array([r["whitened"] for r in got])
    signs = np.sign((by_row * white).sum(0))
    assert np.allclose(by_row, white * signs, atol=1e-7)
    for r, d in zip(got, deviation, strict=True):
        assert r["n"] == len(vectors) and int(r["deviation"]) == d
        assert np.allclose(r["explained"], explained, rtol=1e-9)
        assert np.allclose(r["variances"], values, rtol=1e-9)
        assert r["identity_error"] < 1e-8


def test_whitening_equals_numpy(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(table).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [r[0] for r in rows]
    check_whitening(got, [r[1] for r in rows])
    flat = QUERIES["op13_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    assert len(flat) == 8 * len(rows)
    wide = [[r["whitened"] for r in flat[i : i + 8]] for i in range(0, len(flat), 8)]
    ours = np.array([r["whitened"] for r in got])
    signs = np.sign((np.array(wide) * ours).sum(0))
    assert np.allclose(np.array(wide) * signs, ours, atol=1e-7)
    assert [r["component"] for r in flat[:8]] == list(range(1, 9))


SHAPE = "vec_id long, embedding array<double>, label int, n string, place int, x int, AT int, carry_n int, white int"


def embeddings(spark, vectors):
    rows = [(i, v, 1, "kept", 5, 6, 7, 8, 9) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def test_whitening_of_odd_rows(spark, monkeypatch):
    """Rows that go, repeated rows, fewer dimensions than components, several blocks."""
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 15)
    monkeypatch.setattr(whitening, "TASK_BLOCKS", 2)
    rnd = np.random.default_rng(4)
    good = [list(map(float, v)) for v in rnd.normal(size=(70, 3))] * 2
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1.0, 1.0, -inf], [1.0, 2.0]]
    got = whitening.whiten(embeddings(spark, good + bad)).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(len(good)))
    check_whitening(got, good, 3)
    assert got[0]["place"] == 5 and got[0]["x"] == 6 and got[0]["AT"] == 7 and got[0]["carry_n"] == 8


def test_whitening_without_variance(spark):
    same = whitening.whiten(embeddings(spark, [[1.0, 2.0]] * 4)).collect()
    assert [r["whitened"] for r in same] == [[None, None]] * 4
    assert all(r["explained"] == [0.0, 0.0] and r["deviation"] == 0 for r in same)
    line = whitening.whiten(embeddings(spark, [[1.0, 2.0], [3.0, 2.0]])).collect()
    assert all(r["whitened"][1] is None and abs(abs(r["whitened"][0]) - 1) < 1e-12 for r in line)
    assert all(r["identity_error"] < 1e-9 for r in line)


def test_whitening_of_nothing(spark):
    none = whitening.whiten(embeddings(spark, [None, [float("nan")]]))
    assert none.count() == 0
    assert {"vec_id", "n", "deviation", "whitened", "identity_error"} <= set(none.columns)
