from itertools import permutations

import pytest

from tunegauge.llm import audit

LETTERS = "ABCDE"


def fails(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", text) if w]
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
    return out | ({"D"} if any(c in "#$%&*|" for c in text) else set())


def brute(docs, labels):
    labels = [x for x in labels if x[0] is not None]  # a null id labels nothing
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    marked = []
    for i, text, part in docs:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        marked.append((part or "", fails(text or "") | ({"E"} if copy else set()), i in good, i in toxic))
    out, total = [], {}
    for part in {m[0] for m in marked}:
        for order in permutations(LETTERS):
            left = [m for m in marked if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [m for m in left if f in m[1]]
                redundant = sum(f in m[1] for m in gone)
                left, gone = [m for m in left if f not in m[1]], gone + lost
                only = sum(m[1] == {f} for m in marked if m[0] == part)
                total[part, f] = total.get((part, f), 0) + len(lost)
                out.append((part, "".join(order), step, len(left), len(lost), redundant, only, sum(m[2] for m in lost), sum(m[3] for m in lost)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def rows(docs):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert docs.columns == names
    return sorted(tuple(r) for r in docs.collect())


def test_matches_removal_in_every_order(spark):
    plain = [f"word{i}" for i in range(60)]
    texts = [" ".join(plain), " ".join(plain), " ".join(plain[:30] * 2), "SHOUT " + " ".join(plain), "A | B", None, "", " \t\x0b", "x" * 5000, "É" * 40,
             " ".join(["LOUD"] * 80) + " #", " ".join(plain) + " é %", "a\x1cb " * 60]
    docs = [(i % 17 if i % 5 else None, texts[(i * 7) % len(texts)], [None, "", "a", "b"][i % 4]) for i in range(60)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (4, 1, 1), (4, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    known = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert rows(audit.filter_audit(table, known)) == brute(docs, labels)


def test_weights_are_those_of_all_orders():
    for count in (1, 2, 3, 5):
        weights = audit.shapley_weights(count)
        values = [(s * 37 + s * s * 11) % 101 if s else 0 for s in range(1 << count)]
        for i in range(count):
            total = 0
            for order in permutations(range(count)):
                before = sum(1 << j for j in order[: order.index(i)])
                total += values[before | 1 << i] - values[before]
            assert sum(w * v for w, v in zip(weights[i], values)) == total


def test_few_filters_and_null_masks(spark):
    frame = spark.createDataFrame([("p", 1, True), ("p", 3, False), ("p", None, True), ("q", 0, None)], "part string, mask int, t boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.t_lost, r.shapley)
           for r in audit.interactions(frame, "XY", counts={"t": frame["t"]}).collect()}
    assert got["p", "XY", 1] == (1, 2, 0, 1, 1, 3) and got["p", "XY", 2] == (1, 0, 1, 0, 0, 1)
    assert got["p", "YX", 1] == (2, 1, 0, 0, 0, 1) and got["q", "XY", 1] == (1, 0, 0, 0, 0, 0) and len(got) == 8


@pytest.mark.parametrize("no_labels", [False, True])
def test_odd_rows(odd, empty, no_labels):
    labels = odd.selectExpr("doc_id", "1 as quality", "0 as toxic", "text as source")
    docs = odd.withColumnRenamed("lang", "source")
    got = audit.filter_audit(docs, labels.limit(0) if no_labels else labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.kept + r.removed for r in got if r.step == 1} == {odd.count()}
    assert all(r.good_lost == 0 for r in got) == no_labels
    assert audit.filter_audit(empty.withColumnRenamed("lang", "source"), labels).count() == 0
