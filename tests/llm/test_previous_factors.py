"""Longest previous factors against their definition, and texts that share a hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.llm import substring_dedup as sd


def common(data, most):
    """Common prefix of the suffixes at i and j, from that at i + 1 and j + 1."""
    n = len(data)
    out = np.zeros((n + 1, n + 1), int)
    for i in range(n - 1, -1, -1):
        out[i, :n] = np.where(data == data[i], out[i + 1, 1:] + 1, 0)
    return np.minimum(out, most)


@pytest.mark.parametrize("length", [3, 8, 20, 200])
@pytest.mark.parametrize("letters", [1, 2, 3])
def test_factors_equal_their_definition(length, letters):
    rng = np.random.default_rng(length * letters)
    part = rng.integers(0, letters, 260 if length == 200 else 150).astype(np.uint8)
    data = np.concatenate([part, rng.integers(0, letters, 60).astype(np.uint8), part, part[20:]])
    levels = sd.rank_levels(data, length)
    at = np.arange(len(data) - length + 1)
    position = rng.permutation(len(at))
    got = sd.longest_previous_factors(data, levels, at, position)
    both = common(data, length)[: len(at), : len(at)]
    want = np.where(position[None, :] < position[:, None], both, 0).max(1).tolist()
    assert got.tolist() == want and max(want) == length
    assert np.array_equal(sd.longest_previous_factors(data, levels, at, position, least=length) >= length, got >= length)
    later = np.where(position[None, :] > position[:, None], both, 0).max(1).tolist()
    assert sd.longest_previous_factors(data, levels, at, position, later=True).tolist() == later
    assert (sd.longest_previous_factors(data, levels, at, position, least=length, later=True) >= length).tolist() == [x >= length for x in later]


def test_common_prefixes_end_where_the_data_ends():
    data = np.frombuffer(b"abcabcabcabd" * 3, np.uint8)
    levels = sd.rank_levels(data, 10)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(27), np.arange(27)))
    assert sd.common_prefixes(data, levels, i, j).tolist() == common(data, 10)[i, j].tolist()


def test_nearest_smaller_values():
    rng = np.random.default_rng(1)
    for x in (rng.permutation(200), np.arange(50), np.arange(50)[::-1], np.zeros(0, int), np.array([7])):
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert sd.previous_smaller(x).tolist() == want


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """A first hash that is only the text's length."""
    texts = ["a" * 30 + "x", "b" * 30 + "y", "a" * 30 + "x", "c" * 29 + "zz", None, "short", "d" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = lambda: sorted(map(tuple, sd.substring_dedup(docs, length=20, keep_first=False).collect()))
    want = rows()
    strong = sd.text_hash
    monkeypatch.setattr(sd, "text_hash", lambda seed: F.length("text").cast("bigint") if seed == 0 else strong(seed))
    assert rows() == want
