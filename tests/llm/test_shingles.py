import random

import corpus_pipeline
from tunegauge.llm import shingles

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def plain(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(0, len(words), 12), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def made(rng):
    vocabulary = [f"word{i}" for i in range(900)]
    common = rng.choices(vocabulary, k=60)
    texts = []
    for k in range(40):
        base = rng.choices(vocabulary, k=rng.randint(80, 300))
        if k % 4 == 0:
            base[:60] = common
        texts += [base] + [edited(rng, base, rng.randint(0, 5)) for _ in range(rng.choice([0, 1, 3, 12]))]
    base = rng.choices(vocabulary, k=200)
    texts += [edited(rng, base, 2) for _ in range(60)]
    for _ in range(15):
        base = edited(rng, base, 1)
        texts.append(base)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def wanted(texts):
    sets, up = [plain(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if similarity(sets[a], sets[b]) >= 0.8:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i for i in range(len(texts)) if root(i) == i}


def test_edited_copies_at_four_fifths_go(spark):
    texts = made(random.Random(5))
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in enumerate(texts)], DOCUMENTS).repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == wanted(texts)


def test_recall_of_the_bands():
    rng, met, total = random.Random(8), 0, 0
    while total < 3000:
        base = [f"word{rng.randrange(900)}" for _ in range(150)]
        a, b = " ".join(base), " ".join(edited(rng, base, 3))
        if 0.8 <= similarity(plain(a), plain(b)) < 0.85:
            total += 1
            met += bool((shingles.bands(shingles.shingles(a)) == shingles.bands(shingles.shingles(b))).any())
    assert met >= 0.999 * total


def test_odd_rows(odd, empty):
    kept = shingles.keep_one(odd)
    assert kept.columns == odd.columns and shingles.keep_one(empty).count() == 0
    assert kept.filter("text like 'One two%'").count() == 1 and kept.filter("trim(coalesce(text, '')) = '' or text = ' \n\t '").count() == 1
