import math
import random
import re

import numpy as np
import pytest

from tunegauge.llm import ranked

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score string, rank int, key string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    given = [(i, words(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in given), sum(len(w) for _, w in given)
    out = []
    for item, text in items:
        asked, scored = set(words(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in given) + 1))) for t in asked}
        for i, w in given:
            if w:
                m = 50 + (50 * len(w) * n_docs) // n_words
                score = sum(weight[t] * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in asked & set(w))
                if score > 0:
                    scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "ñu", "B2"]
    chance = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, chance, k=rng.randint(1, 60)))) for i in range(700)]
    docs += [(2000 + i, docs[5][1]) for i in range(90)] + [(7, docs[8][1]), (7, docs[8][1]), (None, docs[9][1]), (900, None), (901, ""), (902, "-- ||")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(3, docs[5][1]), (3, docs[5][1]), (None, "w1 W1 w2"), (40, None), (41, ""), (42, "nowhere to be found"), (43, "w0"), (44, "b2|é")]
    return docs, items


@pytest.mark.parametrize("k, bytes_", [(50, 4 << 20), (7, 150), (2000, 4 << 20)])
def test_matches_brute_force(spark, tables, k, bytes_):
    docs, items = tables
    given = spark.createDataFrame([(*d, "s", 1, "k") for d in docs], DOCS).repartition(6)
    asked = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, score int")
    assert found(ranked.ranked(given, asked, k, block_bytes=bytes_)) == brute(docs, items, k)


def test_small_segments_and_text_ids(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(ranked, "SEGMENT", 32)
    monkeypatch.setattr(ranked, "POSTINGS", 100)
    given = spark.createDataFrame([(None if i is None else f"{i:05}", t) for i, t in docs], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [(i, r, None if d is None else int(d), s) for i, r, d, s in found(ranked.ranked(given, asked, 10))]
    assert sorted(got, key=repr) == brute(docs, items, 10)


def test_long_lists_are_skipped():
    """A rare word settles the best documents; most documents of the frequent word are then never scored."""
    rng = np.random.default_rng(1)
    size = 20_000
    rare = np.sort(rng.choice(1000, 60, replace=False))
    lists = [(rare, np.full(60, 9000), 9000), (np.arange(size), rng.integers(1, 50, size), 50), (np.arange(0, size, 2), rng.integers(1, 60, size // 2), 60)]
    lists = [(p, v.astype(np.int64), int(v.max())) for p, v, _ in lists]
    top, ids, nulls = ranked.Top(50), np.arange(size), np.zeros(size, dtype=bool)
    scored = ranked.search(lists, ids, nulls, top)
    total = np.zeros(size, dtype=np.int64)
    for places, values, _ in lists:
        total[places] += values
    assert top.held[0].tolist() == sorted(total.tolist(), reverse=True)[:50] and scored <= 1100


def test_odd_rows(odd, empty):
    asked = odd.selectExpr("doc_id as item_id", "text", "score")
    got = ranked.ranked(odd, asked, 3)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(got) == brute(rows, rows, 3)
    assert ranked.ranked(empty, asked, 3).count() == 0 and ranked.ranked(odd, asked.limit(0), 3).count() == 0
