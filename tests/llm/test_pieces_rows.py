"""Parts merged as rows of a table, plain texts split at single blanks, and decoding all bytes at once."""

import random

import numpy as np
import public_tokenizers
import pytest

from cellzonal.llm import pieces


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def test_rows_of_all_widths_equal_the_library(own):
    rng = random.Random(3)
    letters = "aabeth ▁\n\té漢字😀\x00 "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(1500)]
    texts += ["".join(rng.choices("aeinorst", k=n)) for n in range(1, 120)]
    texts += ["", " ", "  a", "a ", "▁", "▁a b", "a  b", " a", "a b", "漢", "a\u0000b", "x" * 60 + " y" * 40]
    for _ in range(2):  # the second time from memory
        found = own.encode(texts)
        for text, a, b in zip(texts, found, own.library.encode(texts), strict=True):
            assert a.tolist() == b
            assert own.decode(b) == own.library.decode(b)
    # A single blank in front of a part is not kept with it, so no remembered part begins with one.
    own._held.clear()
    own.encode(["one two three"])
    assert set(own._held) == {"one", "two", "three"}
    assert own.known == {p: own.merge(p) for p in ("▁one", "▁two", "▁three")}


def test_any_ids_decode_as_the_library_does(own):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(0, rng.choice([3, 300, 32_000])) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == own.library.decode(ids)


def test_every_pair_is_found_in_the_table_and_no_other(own):
    held = own._pairs[own._pairs >= 0]
    left, right = held >> 32, held & 0xFFFFFFFF
    assert (own._ranks_of(left, right) < pieces.NONE).all()
    known = set(held.tolist())
    other = np.random.default_rng(5).integers(-500, 32_000, (2, 20_000))
    want = [a >= 0 and b >= 0 and (a << 32 | b) in known for a, b in other.T.tolist()]
    assert (own._ranks_of(*other) < pieces.NONE).tolist() == want
