import corpus_pipeline
from test_shingles import DOCUMENTS, plain, similarity
from test_simhash import plain_fingerprint
from tunegauge.llm.shingles import sketched
from tunegauge.llm.tables import share_code


def test_near_fingerprints_and_near_sets_link(spark):
    share_code(spark)
    line = " ".join(f"line{i}" for i in range(9))
    tails = [" ".join(f"{kind}{i}" for i in range(14)) for kind in ("one", "two")]
    texts = [f"{line} " * 300 + t for t in tails]  # all but equal by fingerprint, unlike by set
    words = [f"word{i}" for i in range(200)]
    edits = [" ".join(words), " ".join([*words[:60], "new", *words[61:140], "newer", *words[141:]])]
    assert similarity(plain(texts[0]), plain(texts[1])) < 0.8 <= similarity(plain(edits[0]), plain(edits[1]))
    near = [(plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() for a, b in (texts, edits)]
    assert near[0] <= 3 < near[1]
    texts = [*texts, *edits, "something else altogether that is like nothing here", None, ""]
    rows = [(i, t, "en", None, len(t or "")) for i, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCUMENTS).repartition(3), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]


def test_sketches_and_fingerprints_take_one_python_step(spark):
    share_code(spark)
    texts = ["One two three four five six", "one TWO three four five six", "a b", "", None, "x " * 3000]
    rows = sketched(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", 5, 42, ["node", "n", "keys"], "fp")
    assert rows.columns == ["i", "t", "fp", "node", "n", "keys"]
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = sorted(rows.collect())
    assert [r["fp"] % 2**64 for r in found] == [plain_fingerprint(t) for t in texts]
    assert found[0]["node"] == found[1]["node"] and [r["n"] for r in found] == [2, 2, 1, 0, 0, 1]
