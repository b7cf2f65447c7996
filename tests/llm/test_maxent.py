import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunegauge.llm import maxent


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    after = {w: rng.sample(range(400), 3) for w in range(400)}
    out = []
    for i in range(300):
        w, text = rng.randrange(400), []
        for _ in range(rng.randint(0, 120)):
            text.append(f"Wort{w}" if w % 7 else f"wort{w},")
            w = rng.choice(after[w]) if rng.random() < 0.8 else rng.randrange(400)
        out.append((i, " ".join(text)))
    return out + [(300, None), (301, ""), (301, "new words entirely"), (None, "wort1 wort2")]


def test_counts_base_score_and_gain(spark, docs, monkeypatch):
    monkeypatch.setattr(maxent, "LEXICON", 300)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = maxent.scores(table, F.col("doc_id") % 5 != 1).collect()
    count = Counter(t for i, x in docs if i is None or i % 5 != 1 for t in tokens(x))
    total = sum(count.values())
    norm = math.log10(total + 0.5 * (len(count) + 1))
    want = sorted((repr(i), len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), round(sum(math.log10(count[t] + 0.5) - norm for t in tokens(x)), 6)) for i, x in docs)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    held = [r for r in got if not r.training and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_known_words_and_one_unknown_word_per_class_sum_to_one():
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(400)] + [b"\n"]
    counts = np.sort(rng.integers(1, 1000, len(words)))[::-1].copy()
    lex = maxent.Lexicon(words, counts, int(counts.sum()), len(words))
    for w, n in zip(words[maxent.HEAD :], counts[maxent.HEAD :]):
        lex.mass[maxent.tail_class(w)] += n + 0.5
    model = maxent.Weights.start(lex)
    model.outer[:] = rng.normal(size=model.outer.shape)
    model.inner[:] = rng.normal(size=model.inner.shape)
    n = len(words)
    rows = np.repeat([[5, 6, 7]], n, axis=0)
    at = np.arange(n)
    p = 10 ** model.log10(lex.kind[at], lex.slot[at], rows)
    tail = lex.slot[at] < 0
    p[tail] *= (counts[tail] + 0.5) / lex.mass[lex.kind[at][tail]]
    outer = model.outer_probabilities(rows[:1])[0]
    unknown = sum(outer[k] * 0.5 / lex.mass[k] for k in range(maxent.HEAD_CLASSES, maxent.CLASSES))
    assert abs(p.sum() + unknown - 1) < 1e-4


def test_odd_rows(odd, empty):
    got = maxent.scores(odd, F.lit(True)).collect()
    assert len(got) == 12 and all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
    assert maxent.scores(empty, F.lit(True)).count() == 0
    nothing = maxent.scores(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) and r.train_tokens == 0 for r in nothing)


ODD = [None, "", " \n\t ", " A b  A\x0bb\x0c", "É é\u00a0İ x\x1cy\x00z 名", "end", "a\r\nA", "\x85 q"]


def test_words_are_those_of_plain_splitting():
    for texts in (ODD, ODD[3:], ODD[5:6], ODD[:3], []):
        different, at, lengths = maxent.words(pa.array(["skipped", *texts], pa.string()).slice(1))
        plain = different.to_pylist()
        assert [plain[i].encode() for i in at] == [w for t in texts for w in tokens(t)[:-1]]
        assert lengths.tolist() == [len(tokens(t)) - 1 for t in texts]


def test_encode_looks_each_different_word_up_once():
    class Asked(dict):
        n = 0

        def get(self, *key):
            Asked.n += 1
            return super().get(*key)

    known = [b"\n", b"a", b"b", b"\xc3\x89"]
    lex = maxent.Lexicon(known, np.array([9, 5, 2, 1]), 17, 4)
    lex.place = Asked(lex.place)
    texts = ODD * 50
    at, kind, slot, code, document, different, token = lex.encode(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in tokens(t)]
    assert Asked.n == len(different) + 1 <= len(set(flat)) + 1 < len(flat)
    assert at.tolist() == [known.index(w) if w in known else -1 for w in flat]
    assert kind.tolist() == [0 if w in known else maxent.tail_class(w) for w in flat]
    assert slot.tolist() == [known.index(w) if w in known else -1 for w in flat]
    assert code.tolist() == [maxent.zlib.crc32(w) for w in flat]
    assert document.tolist() == [i for i, t in enumerate(texts) for _ in tokens(t)]
    plain = [*different.to_pylist(), "\n"]
    assert [plain[i].encode() for i in token] == flat


@pytest.mark.parametrize("size", [[1], [1] * 9, [8], [9], [700, 40, 9, 8, 8, 7, 3, 2, 2, 1, 1], [3, 1, 5, 1, 4], [30, 20], [1, 12, 2]])
def test_run_sums_are_bit_for_bit_those_of_reduceat(size):
    rng = np.random.default_rng(len(size))
    g = rng.normal(size=(sum(size), 32)).astype(np.float32)
    order, first = rng.permutation(len(g)), np.cumsum([0, *size[:-1]])
    got = maxent._run_sums(g, order, first, np.array(size))
    assert np.array_equal(got, np.add.reduceat(g[order], first, axis=0))


def test_softmax_and_step_are_bit_for_bit_the_plain_ones():
    rng = np.random.default_rng(3)
    lex = maxent.Lexicon([f"w{i}".encode() for i in range(300)], np.arange(300, 0, -1), 45150, 300)
    trainer = maxent.Trainer(maxent.Weights.start(lex), 0.15)
    trainer.w.outer[:] = rng.normal(size=trainer.w.outer.shape)
    # A third of the tokens share a row, as after a frequent word; most other rows are picked once.
    rows = rng.integers(0, maxent.ROWS, (2000, maxent.FEATURES))
    rows[:700, 0] = 5
    kind = rng.integers(maxent.HEAD_CLASSES, maxent.CLASSES, len(rows))
    table, squares = trainer.w.outer.copy(), np.full(maxent.ROWS, 1e-4, np.float32)
    z = table[rows[:, 0]] + table[rows[:, 1]] + table[rows[:, 2]] + trainer.w.outer_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    assert np.array_equal(trainer.w.outer_probabilities(rows), p)
    slot = np.full(len(rows), -1)
    assert np.array_equal(trainer.w.log10(kind, slot, rows), np.log10(p[np.arange(len(rows)), kind]))
    p[np.arange(len(rows)), kind] -= 1
    for f in range(maxent.FEATURES):
        order = np.argsort(rows[:, f], kind="stable")
        at, first = np.unique(rows[order, f], return_index=True)
        total = np.add.reduceat(p[order], first, axis=0)
        squares[at] += np.einsum("ij,ij->i", total, total)
        table[at] -= (0.15 / np.sqrt(squares[at]))[:, None] * total
    trainer.step(kind, slot, rows)
    assert np.array_equal(trainer.w.outer, table)


@pytest.mark.parametrize("most", [5, 100, 400_000])
def test_counts_passed_on_in_parts_add_up(spark, docs, most):
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = Counter(t.decode() for _, x in docs for t in tokens(x))
    assert {r.token: r.n for r in maxent.counted(table, "text", most).collect()} == want
    assert maxent.counted(table.limit(0), "text").count() == 0
