import random

import numpy as np
import pytest

from tunegauge.llm import superminhash as sm

DOCUMENTS = "doc_id long, text string, node string, n int, component_id string, found int"


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(docs):
    sets, up = [plain(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(docs)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (id_, _) in enumerate(docs):
        if id_ is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), id_), id_)
    out = []
    for i, (id_, _) in enumerate(docs):
        component = least.get(root(i)) if sets[i] else id_
        out.append((id_, len(sets[i]), component, id_ == component))
    return sorted(out, key=repr)


def got(frame):
    assert frame.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def table(spark, docs, parts=5):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], DOCUMENTS).repartition(parts)


@pytest.fixture(scope="module")
def families():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(2000)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 250))
        texts += [base] * rng.choice([1, 1, 3]) + [edited(rng, base, rng.randint(0, 7)) for _ in range(rng.choice([0, 1, 4, 10]))]
    base = rng.choices(vocabulary, k=200)
    for _ in range(25):  # a chain, whose ends are far apart
        base = edited(rng, base, 2)
        texts.append(base)
    body = rng.choices(vocabulary, k=150)
    texts += [body + rng.choices(vocabulary, k=26) for _ in range(60)]  # alike, but all below the threshold: buckets that stay apart
    texts += [edited(rng, t, 1) for t in texts[-20:]]
    texts += [["two", "words"], ["Two", "WORDS"], ["one"], ["one", "two", "three"]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_matches_brute_force(spark, families):
    docs = families + [(500, None), (501, ""), (502, " \t\x0b"), (None, families[3][1]), (3, families[9][1]), (3, families[9][1])]
    assert got(sm.near_duplicates(table(spark, docs))) == expected(docs)


def test_similar_sets_unlike_a_lead_share_a_difference_to_look_up():
    rng, seen = random.Random(12), 0
    for _ in range(6000):
        least = rng.choice([60, 85, 95])
        lead = set(range(rng.randint(1, 60)))
        x = {e for e in lead if rng.random() < rng.choice([0.3, 0.8, 0.95])} | {1000 + rng.randrange(30) for _ in range(rng.randint(0, 12))}
        y = {e for e in x if rng.random() < 0.97} | {1000 + rng.randrange(30) for _ in range(rng.randint(0, 2))}
        if not x or not y or len({frozenset(s) for s in (lead, x, y)}) < 3 or 100 * len(x & y) < least * len(x | y):
            continue
        order = lambda s: np.array(sorted(s, key=lambda e: e * 7919 % 1009), dtype=np.int64)
        (like_x, dx, _, x_any), (like_y, dy, y_far, y_any) = (sm.differences(order(lead), order(s), least) for s in (x, y))
        assert like_x == (100 * len(x & lead) >= least * len(x | lead)) and set(dx.tolist()) == x ^ lead
        if not like_x:
            seen += 1
            assert set(dx[:x_any].tolist()) & set(dy[:y_far].tolist()) and y_far <= y_any
    assert seen > 1000


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 30, 400, 5000):
        one = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)).view(np.int64)
        two = np.union1d(one[rng.random(len(one)) < 0.9], rng.integers(0, 2**62, n // 20))
        bits = np.bitwise_count((sm.parities(one) ^ sm.parities(two)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(one, two)) and (bits + len(np.setxor1d(one, two))) % 2 == 0 and len(sm.parities(one)) == sm.PARITIES


def test_members_unlike_their_leads_are_found(spark):
    """Three families that share buckets only by chance of their keys: each is unlike the others, and similar within."""
    rng, known, texts = random.Random(2), sm.Words(42), []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(120)]
        texts += [base] + [edited(rng, base, rng.randint(1, 3)) for _ in range(9 - family)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [sm.shingles(t, 3, known) for _, t in docs]
    nodes = spark.createDataFrame([(sm.node_of(s), len(s), [1, 2]) for s in sets], "node long, n long, keys array<long>")
    found = sm.links(table(spark, docs), "text", nodes).collect()
    ids, up = {sm.node_of(s): i for i, s in enumerate(sets)}, list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in found:
        up[root(ids[a])] = root(ids[b])
    least = {}
    for i in range(len(docs)):
        least.setdefault(root(i), i)
    assert sorted(((i, len(s), least[root(i)], least[root(i)] == i) for i, s in enumerate(sets)), key=repr) == expected(docs)


def test_wanted_nodes_pass_the_sieve(spark):
    nodes = [(x * 0x9E3779B97F4A7C15 + 5) % 2**64 - 2**63 for x in range(5000)]
    bits = sm.marks(spark.createDataFrame([(n,) for n in nodes], "node long"))
    at = np.array(nodes) & ((1 << sm.MARKS) - 1)
    assert len(bits) == 1 << sm.MARKS - 3 and (bits[at >> 3] >> (at & 7) & 1).all() and np.unpackbits(bits).sum() <= 5000


def one_by_one(values, registers):
    """The signature of one set, each shingle for itself and through all levels."""
    out = [2**64 - 1] * registers
    for value in values.tolist():
        places = list(range(registers))
        for level in range(registers):
            drawn = int(sm.mixed(np.array([(value + sm.STEP * (level + 1)) % 2**64], dtype=np.uint64))[0])
            pick = level + ((drawn & 0xFFFFFFFF) * (registers - level) >> 32)
            places[level], places[pick] = places[pick], places[level]
            out[places[level]] = min(out[places[level]], level << 32 | drawn >> 32)
    return out


def test_early_stop_changes_no_register():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 0, 17, 150, 900, 3)]
    for held in (1 << 16, 64):
        found = sm.signatures(sets, 24, held)
        assert [r.tolist() for r in found] == [one_by_one(s, 24) for s in sets]


def test_estimates_vary_less_than_independent_hashes():
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(400):
        values = rng.integers(0, 2**64, 90, dtype=np.uint64)
        one, two = sm.signatures([values[:60], values[30:]], 64)
        errors.append((one == two).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.85 * (1 / 3) * (2 / 3) / 64


def test_recall_of_the_bands():
    rng, met, total, known = random.Random(8), 0, 0, sm.Words(42)
    while total < 1500:
        base = [f"word{rng.randrange(900)}" for _ in range(160)]
        a, b = (sm.shingles(" ".join(t), 3, known) for t in (base, edited(rng, base, 4)))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if 0.85 <= share < 0.89:
            total += 1
            one, two = sm.bands(sm.signatures([a, b]))
            met += bool((one == two).any())
    assert met >= 0.999 * total


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(sm.near_duplicates(odd)) == expected(rows)
    assert sm.near_duplicates(empty).count() == 0


def test_sets_go_to_their_leads_in_one_shuffle(spark, monkeypatch):
    """Each member meets the set of each lead, also of one under several keys; sets are not joined by node for it."""
    monkeypatch.setattr(sm, "SPREAD", 3)
    pairs = [(1, b) for b in range(10, 30)] + [(2, 10), (2, 1), (30, 31)]
    wanted = sm.led_by(spark.createDataFrame(pairs, "a long, b long"))
    rows = {r["node"]: (sorted(x["a"] for x in r["leads"]), r["ways"]) for r in wanted.collect()}
    assert rows[1] == ([2], 7) and rows[10] == ([1, 2], None) and rows[31] == ([30], None) and len(rows) == 24
    sets = wanted.selectExpr("*", "array(node) AS found")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sm.met(sets)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1
        assert sorted((r["one"][0], r["two"][0]) for r in found.collect()) == sorted((r["a"], r["b"]) for r in found.collect()) == sorted(pairs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
