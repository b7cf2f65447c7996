import math

import numpy as np
import pytest

from tunegauge.llm import topk


def brute(rows, k):
    out = []
    good = [(n, i, [math.floor(1024 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, i, q in good:
        if i % 5:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in good if m != n and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j, _) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    vectors = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(400)]
    same = [(1000 + i, [0.5] * 8) for i in range(60)]
    odd = [(500, None), (505, [1.0, None] + [0.0] * 6), (510, [float("nan")] * 8), (515, [float("inf")] * 8), (None, [1.0] * 8), (520, []), (525, []), (530, [1.0, 2.0]), (535, [0.0] * 8)]
    return vectors + same + odd


@pytest.mark.parametrize("shard_rows, block_rows", [(65_536, 16_384), (40, 20)])
def test_matches_brute_force(spark, rows, shard_rows, block_rows):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, query string, at int")
    got = topk.top_k(table, "vec_id % 5 = 0", 10, shard_rows=shard_rows, block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10)


def test_branches_are_cut():
    rng = np.random.default_rng(1)
    vectors = np.floor(1024 * np.concatenate([c + 0.01 * rng.normal(size=(256, 8)) for c in rng.normal(size=(16, 8))])).astype(np.int64)
    opened = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                opened.append(len(key))
            return np.asarray(super().__getitem__(key))

    found = topk.search(vectors.view(Watched), np.arange(4096), np.arange(4096), vectors[:5], np.arange(5), [None] * 5, 10)
    assert len(found) == 50 and sum(opened[-200:]) < 5 * 4096


def test_large_numbers_stay_exact():
    rows = np.array([[2**62, -(2**62)], [2**61, 5], [3, 4]], dtype=np.int64)
    found = topk.search(rows, np.arange(3), np.arange(3), rows[:1], np.array([0]), [None], 2)
    assert sorted(s for _, _, s in found) == sorted([2**123 - 5 * 2**62, 3 * 2**62 - 4 * 2**62])


def test_empty_table(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").limit(0)
    assert topk.top_k(table, "vec_id % 5 = 0").count() == 0
