"""The finer counts of op1 travel as steps of one byte, and come back as they were."""

import numpy as np
import pytest

from cellzonal.llm import jaccard_join


@pytest.mark.parametrize("n", [0, 1, 2, 60, 180, 500, 20_000, 100_000])
def test_packed_numbers_come_back(n):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint16))
    packed = jaccard_join.packed_steps(values)
    assert jaccard_join.unpacked_steps(packed).tolist() == values.tolist()
    assert len(packed) <= 2 * n + 1
    if n >= 500:  # two bytes each before
        assert len(packed) < 1.25 * n


@pytest.mark.parametrize("values", [[65535], [0, 0, 0], [254, 509, 764, 1020], [255] * 9, [0, 65535], list(range(300))])
def test_edges_of_steps(values):
    packed = jaccard_join.packed_steps(np.array(values, np.uint16))
    assert jaccard_join.unpacked_steps(packed).tolist() == values
