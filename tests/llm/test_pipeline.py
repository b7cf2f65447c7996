import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontaminate import brute
from test_simhash import plain_fingerprint
from tunegauge.llm import pii, toxicity
from tunegauge.llm.tables import share_code

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def made(rng):
    vocabulary = [f"word{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        words = rng.choices(vocabulary, k=rng.randint(20, 120))
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), f"grolt{rng.choice(vocabulary)}")
        if i % 11 == 3:
            words[5:5] = items[i % 5][1].split()
        if i % 7 == 2:
            words.append(f"me{i}@mail.example.org")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, 1 if i % 5 == 0 else 0))
    docs += [(1000 + i, t) for i, t in docs[1:40:3]] + [(2000 + i, t.upper()) for i, t in docs[2:30:4]]
    docs += [(3000, None), (3001, ""), (None, "alone without an id"), (7, docs[7][1]), (3002, " ".join(rng.choices(vocabulary, k=3000)))]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    share_code(spark)
    docs, labels, items = made(random.Random(9))
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", None, len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def components(rows):
    """Rows of one component each, by trying all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                up[root(b)] = root(a)
    out = {}
    for n, row in enumerate(rows):
        out.setdefault(root(n), []).append(row)
    return list(out.values())


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        frames[name] = [tuple(r) for r in docs.collect()]
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    clean = {r[0] for r in frames["toxicity"]}
    assert not [r for r in frames["toxicity"] if "grolt" in (r[1] or "").lower()]
    assert sum("grolt" in (r[1] or "").lower() for r in given) == len(given) - len(frames["toxicity"]) and {None, 3000, 3001} <= clean
    kept = {(r[0], r[1]) for r in frames["near_dedup"]}
    groups = components([(r[0], r[1]) for r in frames["toxicity"]])
    assert len(frames["near_dedup"]) == len(groups)
    for group in groups:
        least = min(group, key=lambda r: (r[0] is None, r[0]))
        assert [r for r in set(group) if r in kept] == [least]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    marks = brute([(n, r[1]) for n, r in enumerate(frames["near_dedup"])], items, 13)
    good = {frames["near_dedup"][m[0]] for m in marks if not m[4]}
    assert set(frames["decontamination"]) == good and len(good) < len(frames["near_dedup"])
    masked = {r[0]: r for r in frames["pii"]}
    for r in frames["decontamination"]:
        want = None if r[1] is None else pii.masked(r[1], pii.base_spans(r[1]))
        assert masked[r[0]][1] == want and masked[r[0]][4] == len(want or "")
    assert any("[EMAIL]" in (r[1] or "") for r in frames["pii"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for doc_id, piece, start, length, *_ in frames["packing"]:
        pieces.setdefault(doc_id, []).append((piece, start, length))
    assert set(pieces) == set(masked)
    for doc_id, parts in pieces.items():
        n = len(tokenizer.encode(masked[doc_id][1] or "", add_special_tokens=False).ids) + 1
        assert sorted(parts) == [(k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048))]
    fill = {}
    for row in frames["packing"]:
        fill[row[5]] = fill.get(row[5], 0) + row[3]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
    assert corpus_pipeline.run(spark, folder).count() == len(frames["packing"])


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_registered():
    import __spark_entry__ as spec

    names = spec.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(spec.oracle_sql()) <= set(names)
    assert np.isfinite(toxicity.BUCKETS)
