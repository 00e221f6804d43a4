"""What a language model keeps on disk: keys and counts of few bits, found again as they were."""

import contextlib
import re
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import numpy as np

from cellzonal.llm import lm
from cellzonal.llm.text import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_keys_and_counts_in_few_bits_are_found_again(tmp_path):
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000, lm.MANY + 77):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        keys = np.append(keys, np.array([(1 << 64) - 1], np.uint64)) if n else keys
        counts = rng.choice([1, 2, 3, 4, 255, 70_000], len(keys))
        file = lm._save(str(tmp_path), "pairs-0", {**lm._keys("keys", keys), **lm._narrow("counts", counts)})
        assert sum(f.stat().st_size for f in tmp_path.glob(f"{file}.keys*")) < 6 * len(keys) + 400_000
        facts = lm.Facts((0,) * 4, (0,) * 4, (0,) * 4, 0, 0, 0, 0)
        trained = lm.Trained(lm.Words(str(tmp_path), {}, (0, 0)), {0: file}, 1, {}, {}, facts, 3)
        with contextlib.ExitStack() as stack:
            model = lm.Model(trained, stack)
            asked = np.concatenate([keys, rng.integers(0, 1 << 64, 5000, np.uint64), keys[:9] + np.uint64(1)])
            want = dict(zip(keys.tolist(), counts.tolist(), strict=True))
            found = model.pair_values(asked, "counts")
            assert found.tolist() == [want.get(k, 0) for k in asked.tolist()]


def test_packed_arrays_come_back():
    arrays = [np.arange(10) ** 19 % (1 << 62), np.array([0, 255, 256]), np.array([7], np.uint64)]
    for a, b in zip(arrays, lm._unpack(lm._pack(*arrays), 3), strict=True):
        assert a.tolist() == b.tolist()


def test_a_model_of_order_three_is_small(spark, sf):
    """Before, pairs that begin triples had keys of their own, and every key had 64 bits."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    scratch = Scratch(spark, "lm-size")
    trained = lm.train(texts, scratch, order=3)
    sizes = [f.stat().st_size for f in Path(urlparse(trained.words.folder).path).glob("*.npy")]
    tokens = [["<s>", *WORD.findall((t or "").translate(UPPER)), None] for t in docs.values()]
    pairs = {x for own in tokens for x in zip(own, own[1:], strict=False)}
    triples = {x for own in tokens for x in zip(own, own[1:], own[2:], strict=False)}
    assert trained.facts.followed == len(pairs)
    scratch.drop("model")
    assert sum(sizes) < 14 * (len(pairs) + len(triples))
