import random

import pytest

from tunegauge.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "na", "vi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [word() for _ in range(rng.randint(5, 150))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), "grolt" + word())
        docs.append((i, " ".join(text)))
        labels.append((i, 1 if toxic else 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + labels[:5] + [(None, 1), (5000, None)], "doc_id long, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = toxicity.classified(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 30 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 for r in rows)


def test_conflicting_labels_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert [(r.text, r.label) for r in toxicity.labelled(docs, labels).collect()] == [("b", 1)]


def test_long_text_gives_the_same_ngrams_in_pieces(monkeypatch):
    import numpy as np

    text = " ".join(f"w{i}" for i in range(5000))
    whole = np.unique(np.concatenate(list(toxicity.ngrams(text))))
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert (np.unique(np.concatenate(list(toxicity.ngrams(text)))) == whole).all()


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity.classified(odd, labels)
    assert set(odd.columns) < set(got.columns) and len(got.columns) == len(set(got.columns)) and got.count() == 12
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.classified(empty, labels).count() == 0
    assert {r.score for r in toxicity.classified(odd, labels.limit(0)).collect()} == {0.5}


def test_ratios_are_log_counts_of_all_rows(spark, tables):
    import math

    import numpy as np

    docs, labels = tables
    rows = docs.join(labels.filter("toxic is not null").dropDuplicates(["doc_id"]).withColumnRenamed("toxic", "label"), "doc_id").select("text", "label").repartition(5)
    given = rows.collect()
    got = toxicity.ratios(rows, 0.0, 4.0)
    counts, total = {}, [sum(r.label == y for r in given) for y in (0, 1)]
    for r in given:
        for at in np.unique(np.concatenate(list(toxicity.ngrams(r.text)))).tolist():
            counts.setdefault(at, [0, 0])[r.label] += 1
    want = {}
    for at, (clean, toxic) in counts.items():
        ratio = math.log((toxic + 1) / (total[1] + 2)) - math.log((clean + 1) / (total[0] + 2))
        if abs(ratio) >= 4 * math.sqrt(1 / (clean + 1) + 1 / (toxic + 1)):
            want[at] = ratio
    assert set(np.flatnonzero(got).tolist()) == set(want) and want
    assert all(abs(got[at] - x) < 1e-9 for at, x in want.items()) and any(abs(x) < 1.5 for x in want.values())
