"""Blocks of op1 hold sets only that their sizes and the place of the shared shingle let be similar."""

import numpy as np
import pytest

from cellzonal.llm import jaccard_join
from tests.llm.test_operators import brute_groups


def test_codes_never_fall_as_sizes_rise():
    sizes = np.unique(np.concatenate([np.arange(1, 5000), 1.01 ** np.arange(800, 2150)]).astype(np.int64))
    codes = jaccard_join.size_code(sizes[sizes < 1 << 31]).astype(int)
    assert codes.min() == 0 and codes.max() < 4096
    assert (np.diff(codes) >= 0).all()


@pytest.mark.parametrize("at_least", [(80, 100), (1, 1), (40, 100), (15, 100)])
def test_similar_sets_reach_each_other_where_they_first_meet(at_least):
    x, y = at_least
    rng = np.random.default_rng(x)
    met = 0
    for _ in range(3000):
        shared = rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64) * np.uint64(2)
        apart = len(shared) * (y - x) // x
        own = rng.integers(0, 1 << 63, apart + 1, dtype=np.uint64) * np.uint64(2)
        cut = rng.integers(0, apart + 1)
        a, b = (np.unique(np.concatenate([shared, own[part]])) for part in (slice(cut), slice(cut, apart)))
        if y * len(np.intersect1d(a, b)) < x * len(np.union1d(a, b)):
            continue
        met += 1
        keys = {}
        for side, u in (("a", a), ("b", b)):
            keep = len(u) - -(-x * len(u) // y) + 1
            for key in jaccard_join.block_keys(u[:keep], len(u), at_least).tolist():
                keys.setdefault(key >> 24, {})[side] = (key >> 12 & 4095, key & 4095)
        first = keys[min(key for key, sides in keys.items() if len(sides) == 2)]
        (a_size, a_most), (b_size, b_most) = first["a"], first["b"]
        assert b_size <= a_most and a_size <= b_most
    assert met > 500


def _meetings(spark, sets):
    """Blocks of (node, size, place of the shingle that all share)."""
    rows = []
    for node, size, place in sets:
        others = np.arange(200, dtype=np.uint64) + np.uint64(1000 * (node + 1)) << np.uint64(40)
        others[place] = np.uint64(7 << 40)
        keys = jaccard_join.block_keys(others[: size // 5 + 1], size)
        rows.append((node, keys.view(np.int64).tolist()))
    found = jaccard_join._meetings(spark.createDataFrame(rows, "node long, rare array<long>")).collect()
    blocks = {}
    for r in found:
        blocks.setdefault((r["key"], r["hub"]), []).append(r["node"])
    assert all(hub == min(nodes) for (_, hub), nodes in blocks.items())
    return sorted(sorted(nodes) for nodes in blocks.values())


def test_chance_meetings_make_no_blocks(spark):
    assert _meetings(spark, [(1, 100, 0), (2, 200, 0), (3, 400, 0)]) == []  # sizes too far apart
    assert _meetings(spark, [(1, 100, 18), (2, 100, 18)]) == []  # too few shingles left
    assert _meetings(spark, [(1, 100, 18), (2, 100, 0)]) == []
    assert _meetings(spark, [(1, 100, 0), (2, 98, 1), (2, 98, 1)]) == [[1, 2]]
    assert _meetings(spark, [(1, 100, 0), (1, 100, 0)]) == []  # one set of two tasks
    chain = [(i, s, 0) for i, s in enumerate([100, 120, 140, 170, 400, 450, 900])]
    assert _meetings(spark, chain) == [[0, 1, 2, 3], [4, 5]]


def test_groups_of_texts_that_share_much_by_chance(spark):
    rng = np.random.default_rng(11)
    phrases = [" ".join(rng.choice(list("abcdefgh"), 7)) for _ in range(60)]
    rows = []
    for i in range(150):
        words = " ".join(rng.choice(phrases, rng.integers(1, 30))).split()
        rows.append((2 * i, " ".join(words)))
        words[: rng.integers(0, 1 + len(words) // 5)] = ["z"]  # a near copy, similar or not
        rows.append((2 * i + 1, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.jaccard_groups(frame, rarity_bits=8).collect()
    assert sorted(((r[0], r[1], r[2]) for r in found), key=str) == brute_groups(rows)
