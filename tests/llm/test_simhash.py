import random

import numpy as np
import xxhash

from tunegauge.llm import simhash
from tunegauge.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Smallest id that links of at most three bits reach, by trying all pairs."""
    up = {i: i for i, _ in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in fps}


def sample():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    out = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 200))
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out + ["", " \n ", "a b"]


def test_golay_code_is_perfect():
    c = simhash.code()
    assert len(set(c["leader"].tolist())) == 2048 and np.bitwise_count(c["leader"]).max() == 3


def test_matches_brute_force(spark):
    texts = list(enumerate(sample()))
    fps = [(i, plain_fingerprint(t)) for i, t in texts]
    want = groups(fps)
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_every_pair_within_three_bits_meets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(-(2**63), 2**63 - 1)
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= np.int64(np.uint64(1 << int(bit)).astype(np.int64))
        anchor, row, home = simhash.replicas(np.array([a, b]))
        at = [{int(x): bool(h) for x, h in zip(anchor[row == i], home[row == i])} for i in (0, 1)]
        assert any(at[0][x] or at[1][x] for x in at[0].keys() & at[1].keys())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {j: 100 for j in range(101, 160)}


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 12
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({(r.component_id, r.fingerprint) for r in got})
    assert sorted(r.doc_id for r in kept.filter("text like 'One%'").collect()) == [1]


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
