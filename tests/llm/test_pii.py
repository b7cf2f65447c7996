import random
import re

from tunegauge.llm import pii

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True,
                12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15,
            )[k]
            if good:
                out.append((m.start(), m.end(), pii.KINDS[k]))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "@", ".", "1", "23", " ", "-", "+", "(", ")", "é", "255", "256", "4111111111111111", "x@y.z", "%", "_", "٣", "+1 (509) 555-6973"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " + " " * 300_000, "a." * 150_000 + "@", "@" * 100_000):
        pii.base_spans(text)
        pii.graph([text], [[]])


def field(spark):
    texts = [f"call +1 (509) 555-{1000 + i} or mail a{i}@b{i}.org from 10.0.{i}.7 in {2000 + i}, {i} of {i * 7}" for i in range(60)]
    return pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_messages_carry_a_label_to_distant_repeats(spark):
    found = field(spark)
    text = "Call +1 (509) 555-6973 today. " + "Nothing here at all. " * 50 + "Once more: 1 (509) 555-6973 and 509-555-6973."
    base = pii.base_spans(text)
    spans = found.spans([text], [base])[0]
    assert set(base) < set(spans)
    assert any(k == "phone" and a > 1000 and text[a:b].endswith("(509) 555-6973") for a, b, k in spans)


def test_a_label_reaches_a_hundred_repeats():
    import numpy as np

    link = np.zeros((2, 5, 5))
    link[1] = 3 * np.eye(5) - 1
    found = pii.Field(np.zeros((3 * pii.SHAPES, 5)), np.array([1.0, 0, 0, 0, 0]), link)
    for order in (1, -1):
        marked = [" Nothing here at all. ".join((first, *["509-555-6973"] * 100)[::order]) for first in ("+1-509-555-6973", "none")]
        with_label, without = (found.marginals(pii.graph([t], [pii.base_spans(t)]))[:, 4] for t in marked)
        far = with_label[1:] if order == 1 else with_label[:-1]
        assert len(far) == len(without) == 100 and (far > without + 0.1).all()


def test_messages_agree_with_exact_sums(spark):
    import itertools

    import numpy as np

    found = field(spark)
    text = "+1 (509) 555-6973 x 12 y 5556973 z"
    nodes = pii.graph([text], [pii.base_spans(text)])
    nodes.links = nodes.links[: len(nodes.start) - 1]
    nodes.links = np.array([(i, i + 1, i % 2) for i in range(len(nodes.start) - 1)])
    score = found.node[nodes.features].sum(axis=1) + found.bias
    for n in np.flatnonzero(nodes.seen):
        score[n] = -12.0
        score[n, nodes.seen[n]] = 12.0
    total = np.zeros_like(score)
    for labels in itertools.product(range(5), repeat=len(score)):
        w = np.exp(sum(score[n, k] for n, k in enumerate(labels)) + sum(found.link[k, labels[a], labels[b]] for a, b, k in nodes.links))
        for n, k in enumerate(labels):
            total[n, k] += w
    assert np.abs(total / total.sum(axis=1, keepdims=True) - found.marginals(nodes)).max() < 0.02


def test_odd_rows_and_redaction(spark, odd, empty):
    found = field(spark)
    rows = pii.detect(odd, found)
    assert rows.count() == 12 and set(odd.columns) <= set(rows.columns)
    assert [s.kind for s in rows.filter("doc_id = 8").first().base_spans] == ["ip"]
    assert rows.filter("text is null and size(spans) = 0").count() == 2
    masked = pii.redacted(odd, found)
    assert masked.columns == odd.columns and masked.filter("text is null").count() == 2
    assert masked.filter("doc_id = 8").first().text.endswith("[IP]")
    assert pii.detect(empty, pii.fit(empty)).count() == 0


def test_masking_overlaps():
    assert pii.masked("ab12cd", [(1, 4, "card"), (2, 5, "phone")]) == "a[CARD]d"
