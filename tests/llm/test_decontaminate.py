import random
import re

from tunegauge.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - size + 1)) if v else ():
                window = v[k : k + size]
                for s in range(len(w) - len(window) + 1):
                    if w[s : s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "the", "THE"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 5, 9])))) for i in range(12)] + [(90, ""), (91, None), (3, "the the the the the")]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            at = rng.randint(0, len(w))
            w[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i % 50, ", ".join(w)))
    return docs + [(None, "the " * 30), (1, None)], items


def test_matches_brute_force(spark):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, size=5).collect()
    assert sorted(((r.doc, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == brute(docs, items, 5)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SENT_ROWS", -1)
    got = decontaminate.contamination(d, b, size=5).collect()
    assert sorted(((r.doc, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == brute(docs, items, 5)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "alpha z beta z z gamma"), (3, "gamma beta " + "n " * 9 + "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    cut = decontaminate.windows(items, 13)
    postings = decontaminate.index(docs, spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "word string"))
    rows = {r["row"]: r.doc for r in postings.filter("word = ''").collect()}
    got = {(rows[r["row"]], r.stretch) for r in decontaminate.proximity(postings, cut, slack=4).collect()}
    assert got == {(1, 0), (2, 3)} or got == {(1, 0), (2, 2)} or got == {(1, 0), (2, 1)}
    assert [(rows[r["row"]], r.start) for r in decontaminate.phrases(postings, cut).collect()] == [(1, 1)]


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three four five"), (None, "another text")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert len(got) == 12 and sorted(r.n_hit for r in got if r.n_hit) == [2, 5, 5, 5]
    assert [r["items"] for r in got if r.n_hit == 2] == [[]]
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0
