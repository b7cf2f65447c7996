"""Linear models from Gram matrices, boosting, sampled search, saved experts, landing and chunked lookups."""

import datetime

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tunegauge.operators import boosting, discover, gram, models, stats
from tunegauge.session import shared_folder
from tunegauge.sources import landing
from tunegauge.streaming import ingest

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(600):
        a, b, c = rng.normal(100, 3), rng.normal(), rng.uniform()
        group = [None, "x", "y"][i % 3]
        y = {None: 3 * a - b, "x": 2 * b + 7 * c, "y": -a + c}[group] + rng.normal(0, 0.1)
        out.append((i, group, float(a), float(b), float(c), float(y), float(rng.uniform(0.1, 2)), ["train", "train", "val", "test"][i % 4]))
    return spark.createDataFrame(out, "k long, g string, a double, b double, c double, y double, w double, split string").repartition(4)


def numpy_fit(rows, used, weight=True):
    x = np.array([[1.0, *(r[c] for c in used)] for r in rows])
    w = np.sqrt([r["w"] if weight else 1.0 for r in rows])
    return np.linalg.lstsq(x * w[:, None], np.array([r["y"] for r in rows]) * w, rcond=None)[0]


def test_every_group_and_set_is_its_least_squares_fit(rows):
    sets = {"one": ["a"], "two": ["c", "a"], "all": COLUMNS}
    fitted = gram.fit_groups(rows, COLUMNS, ["g"], weight="w", feature_sets=sets, shift={"a": 100.0, "y": 50.0}).collect()
    given = rows.collect()
    assert len(fitted) == 9
    for r in fitted:
        own = [x for x in given if x["g"] == r["g"]]
        used = sets[r["feature_set"]]
        want = numpy_fit(own, used)
        assert r["n"] == len(own) and r["intercept"] == pytest.approx(want[0], rel=1e-6)
        assert [r["coefficients"][COLUMNS.index(c)] for c in used] == pytest.approx(want[1:].tolist(), rel=1e-6)
        assert all(r["coefficients"][i] == 0 for i, c in enumerate(COLUMNS) if c not in used)


def test_fit_is_one_aggregate_and_scores_need_one_join(rows):
    plan = gram.products(rows, COLUMNS, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    fitted = gram.fit_groups(rows, COLUMNS, ["g"])
    plan = gram.score_groups(rows, fitted, COLUMNS, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_missing_values_singular_and_empty_input(spark, rows):
    odd = rows.unionByName(rows.limit(5).withColumn("a", F.lit(None).cast("double"))).unionByName(rows.limit(5).withColumn("y", F.lit(float("nan"))))
    assert gram.fit_groups(odd, COLUMNS).first()["n"] == 600
    twice = rows.withColumn("d", 2 * F.col("b"))
    first = gram.fit_groups(twice, ["b", "d"]).first()
    want = numpy_fit(rows.collect(), ["b"], False)
    assert first["coefficients"][0] + 2 * first["coefficients"][1] == pytest.approx(want[1], rel=1e-6)
    assert gram.fit_groups(rows.limit(0), COLUMNS, ["g"]).count() == 0
    assert gram.fit_groups(rows.limit(0), COLUMNS).count() == 0
    constant = gram.fit_groups(rows.withColumn("a", F.lit(4.0)), ["a"]).first()
    assert constant["intercept"] + 4 * constant["coefficients"][0] == pytest.approx(np.mean([r["y"] for r in rows.collect()]))
    assert abs(gram.fit_groups(rows, ["b"], ridge=1e6).first()["coefficients"][0]) < 1e-4


def test_unknown_group_has_no_forecast_and_contributions_add_up(spark, rows):
    fitted = gram.fit_groups(rows.where("g = 'x'"), COLUMNS, ["g"])
    out = gram.score_groups(rows, fitted, COLUMNS, ["g"])
    assert out.where("pred IS NULL").count() == rows.where("g IS NULL OR g <> 'x'").count() and out.columns == [*rows.columns, "pred"]
    joined = rows.where("g = 'x'").join(fitted.drop("n"), "g").withColumn("pred", gram.forecast(COLUMNS))
    parts = gram.contributions(joined, COLUMNS, {"a": 100.0, "b": 0.0, "c": 0.5})
    assert parts.where("abs(base + c_a + c_b + c_c - pred) > 1e-9").count() == 0


def test_ablation_and_ab_test_are_fits_of_their_columns(rows):
    frame = rows.select("split", "y", *COLUMNS)
    got = {(r["ablation"], r["split"]): r["mae"] for r in models.linear_ablation({"first": ["a"], "more": ["b", "c"]}, frame).collect()}
    train = rows.where("split = 'train'").collect()
    for name, used in (("first", ["a"]), ("more", COLUMNS)):
        beta = numpy_fit(train, used, False)
        for part in ("val", "test"):
            errors = [abs(r["y"] - beta[0] - sum(b * r[c] for b, c in zip(beta[1:], used))) for r in rows.where(F.col("split") == part).collect()]
            assert got[name, part] == pytest.approx(np.mean(errors), rel=1e-6)
    both = {r["split"]: (r["mae_without"], r["mae_with"]) for r in models.linear_ab_test(["a"], ["b", "c"], frame).collect()}
    assert both["test"] == pytest.approx((got["first", "test"], got["more", "test"]), rel=1e-9)


def test_rows_without_regime_fail(spark):
    frame = spark.createDataFrame([(1.0,), (None,)], "listeners_log double")
    assert models.gating_router(frame.limit(1)).first()["regime_id"] == 0
    with pytest.raises(Exception, match="cannot be routed"):
        models.gating_router(frame).collect()


# ---- boosting ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(rows):
    wild = F.when(F.col("k") % 50 == 0, 500.0).otherwise(0.0)
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows.withColumn("y", 2 * F.col("b") + 7 * F.col("c") + wild))


def test_squared_rounds_are_those_of_spark_ml(vectors):
    own = boosting.fit(vectors, "squared", rounds=6, depth=3, step=0.2, weight="w").model
    other = models.boosted("w", trees=6, depth=3, step=0.2).fit(vectors.where("split = 'train'")).setPredictionCol("other")
    assert other.transform(own.transform(vectors)).where("abs(pred - other) > 1e-6").count() == 0


def test_pseudo_huber_falls_every_round_and_heeds_outliers_less(vectors):
    fitted = boosting.fit(vectors, rounds=7, depth=3, step=0.9, slope=2.0)
    losses = [h["train"] for h in fitted.history]
    assert all(b < a for a, b in zip(losses, losses[1:])) and fitted.best == 7 and fitted.model.getNumTrees == 7
    error = lambda m: m.transform(vectors.where("split = 'train' AND k % 50 <> 0")).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    assert error(fitted.model) < error(boosting.fit(vectors, "squared", rounds=7, depth=3, step=0.9).model)


def test_stops_on_validation_loss_and_goes_on_where_it_stood(vectors):
    short = boosting.fit(vectors, "squared", rounds=30, depth=5, step=1.0, patience=2)
    assert short.rounds < 30 and short.best == min(short.history, key=lambda h: h["val"])["round"] == short.rounds - 2
    assert short.model.getNumTrees == short.best
    half = boosting.fit(vectors, rounds=3, depth=2, slope=5.0, patience=9)
    whole, resumed = (boosting.fit(vectors, rounds=6, depth=2, slope=5.0, patience=9, start=s) for s in (None, half))
    assert [h["val"] for h in resumed.history] == pytest.approx([h["val"] for h in whole.history])


def test_search_halves_and_its_winner_is_a_plain_fit(vectors):
    space = {"depth": (1, 3), "step": (0.1, 1.0, "log"), "loss": ["squared", "pseudo_huber"]}
    assert boosting.sampled(space, 5, 1) == boosting.sampled(space, 5, 1) != boosting.sampled(space, 5, 2)
    with pytest.raises(ValueError, match="fewer than"):
        boosting.sampled({"depth": [1, 2]}, 3)
    out, setting, fitted = boosting.search(vectors, space, 4, rungs=(1, 3))
    rows = out.collect()
    assert [(r["rung"], r["kept"]) for r in rows] == [(1, True)] * 2 + [(1, False)] * 2 + [(2, True), (2, False)]
    assert all(r["rounds"] <= {1: 1, 2: 3}[r["rung"]] for r in rows) and min(r["mae"] for r in rows if r["rung"] == 2) == rows[4]["mae"]
    plain = boosting.fit(vectors, rounds=fitted.best, **setting).model.transform(vectors.where("split = 'val'"))
    assert plain.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0] == pytest.approx(rows[4]["mae"], rel=1e-12)


def test_tree_contributions_add_up_to_the_forecast(vectors):
    from pyspark.ml.regression import DecisionTreeRegressor

    train = vectors.where("split = 'train'")
    kinds = {
        "tree": DecisionTreeRegressor(labelCol="y", predictionCol="pred", maxDepth=4).fit(train),
        "forest": models.forest(trees=4, depth=4).fit(train), "boosted": boosting.fit(vectors, rounds=4, depth=3).model}
    for name, model in kinds.items():
        out = discover.tree_contributions(model.transform(vectors), model, COLUMNS)
        assert out.where("abs(base + c_a + c_b + c_c - pred) > 1e-9").count() == 0, name
        assert out.agg(F.stddev("c_b")).first()[0] > 0 and out.columns[-4:] == ["base", "c_a", "c_b", "c_c"]


def test_block_correlations_with_missing_and_constant_columns(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(1e6, 1.0, (500, 6))
    data[:, 1] += 0.5 * data[:, 0]
    data[:, 5] = 3.0
    cells = [[None if (rng.random() < 0.2 and j < 4) else float(x) for j, x in enumerate(row)] for row in data]
    frame = spark.createDataFrame(cells, ", ".join(f"x{j} double" for j in range(6))).repartition(7)
    got = {(r["feature_1"], r["feature_2"]): r["corr"] for r in stats.correlation_pairs(frame, [f"x{j}" for j in range(6)]).collect()}
    want = {}
    for i in range(5):
        for j in range(i + 1, 5):
            both = np.array([(r[i], r[j]) for r in cells if r[i] is not None and r[j] is not None])
            want[f"x{i}", f"x{j}"] = np.corrcoef(both.T)[0, 1]
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    wide = spark.range(50).select(*[(F.col("id") * (j + 1) % 7).cast("double").alias(f"c{j}") for j in range(80)])
    plan = stats.correlation_pairs(wide, wide.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") < 100


# ---- landing -------------------------------------------------------------------------------------------------------

def events(spark, rows):
    return spark.createDataFrame(rows, "k string, ts int, v string")


def test_later_batches_read_their_own_buckets_only(spark):
    path = shared_folder(spark, "landing-test")
    land = lambda rows, n: landing.land_batch(events(spark, rows), n, path, ["k"], ["ts", "v"], 16)
    seen = lambda: sorted((r["k"] or "", r["v"]) for r in landing.landed(spark, path, events(spark, []).schema).collect())
    assert seen() == []
    land([(f"k{i}", 1, "old") for i in range(100)] + [("k1", 0, "older"), (None, 1, "null")], 0)
    assert len(seen()) == 101 and ("k1", "older") in seen() and ("", "null") in seen()
    second = [("k5", 0, "late"), ("new", 3, "b"), ("new", 2, "a"), (None, 0, "again")]
    touched = sorted({r["b"] for r in events(spark, second).select(landing.bucket_of(["k"], 16).alias("b")).collect()})
    files = landing.landed_before(spark, path, events(spark, []).schema, touched, 1).inputFiles()
    assert files and {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= set(touched) and len(touched) < 16
    land(second, 1)
    after = seen()
    assert len(after) == 102 and ("new", "a") in after and ("k5", "old") in after and ("", "null") in after
    land(second, 1)  # a replay
    assert seen() == after
    land([], 2)
    assert seen() == after


def test_stream_lands_batch_by_batch(spark):
    folder, path, state = (shared_folder(spark, n) for n in ("arrivals", "landed", "landing-state"))
    at = datetime.datetime(2024, 1, 1)
    for file, rows in enumerate([[(1, 7, "a"), (2, 8, "a")], [(3, 7, "a"), (4, 9, "a")]]):
        spark.createDataFrame([(i, at + datetime.timedelta(minutes=i), u, t, 1.0, None) for i, u, t in rows], ingest.EVENTS).coalesce(1).write.mode(
            "append").parquet(folder)
        stream = ingest.event_stream(spark, folder, "*.parquet")
        ingest.enrichment_ingest(stream, ["user_id"], ["ts", "event_id"], path, state)
    assert {(r["user_id"], r["event_id"]) for r in landing.landed(spark, path, stream.schema).collect()} == {(7, 1), (8, 2), (9, 4)}


def test_lookups_go_on_after_the_chunk_that_failed(spark):
    path, calls = shared_folder(spark, "chunk-test"), []
    work = spark.createDataFrame([(f"k{i}", i) for i in range(200)] + [("k0", 0), (None, 1)], "k string, n int")

    def enrich(rows, broken=False):
        calls.append(1)
        if broken and len(calls) == 3:
            raise ConnectionError("gone")
        return rows.withColumn("found", F.col("n") + 1)

    with pytest.raises(ConnectionError):
        landing.enrich_in_chunks(work, path, ["k"], lambda r: enrich(r, True), 41)
    schema = enrich(work).schema
    before = {r["k"] for r in landing.enriched(spark, path, schema).collect()}
    assert 0 < len(before) < 201 and len(calls) == 4
    calls.clear()
    assert landing.enrich_in_chunks(work, path, ["k"], enrich, 41) == 3 == len(calls)
    assert landing.enriched(spark, path, schema).count() == 201 and landing.enriched(spark, path, schema).where("found <> n + 1").count() == 0
    assert landing.enrich_in_chunks(work, path, ["k"], enrich, 41) == 0
    more = work.union(spark.createDataFrame([("late", 5)], "k string, n int"))
    assert landing.enrich_in_chunks(more, path, ["k"], enrich, 41) == 1 and landing.enriched(spark, path, schema).count() == 202


def test_a_chunk_that_was_written_but_not_marked_is_replaced(spark, monkeypatch):
    path = shared_folder(spark, "mark-test")
    work = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    mark, marked = landing._mark, []

    def failing(spark_, where, schema, row):
        if where.endswith("/done"):
            marked.append(row)
            if len(marked) == 2:
                raise OSError("lost")
        mark(spark_, where, schema, row)

    monkeypatch.setattr(landing, "_mark", failing)
    with pytest.raises(OSError):
        landing.enrich_in_chunks(work, path, ["k"], lambda r: r.withColumn("v", F.lit("first")), 10)
    monkeypatch.setattr(landing, "_mark", mark)
    landing.enrich_in_chunks(work, path, ["k"], lambda r: r.withColumn("v", F.lit("second")), 10)
    out = landing.enriched(spark, path, work.withColumn("v", F.lit("")).schema)
    counts = {r["v"]: r["count"] for r in out.groupBy("v").count().collect()}
    assert sum(counts.values()) == 50 and 0 < counts["first"] < 25


def test_streams_score_with_the_version_they_name(spark, rows):
    path = shared_folder(spark, "versions")
    arrivals, artists = shared_folder(spark, "scored-arrivals"), spark.createDataFrame([(1, 10**9)], "artist_id long, listeners long")
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at, 1, "x", 50.0, None), (2, at, 2, "x", 50.0, None)], ingest.EVENTS).write.parquet(arrivals)
    for version, slope in (("v1", 10.0), ("v2", 30.0)):
        train = spark.createDataFrame([(r, float(x), slope * x + r) for r in (0, 2) for x in range(5)], "regime_id int, energy double, y double")
        gram.save_groups(gram.fit_groups(train, ["energy"], ["regime_id"]), ["energy"], path, version)
    got = {}
    for version in ("v1", "v2"):
        out, state = shared_folder(spark, "out"), shared_folder(spark, "state")
        scored = ingest.score_saved(ingest.event_stream(spark, arrivals, "*.parquet"), artists, "user_id", {"energy": F.col("value") / 100}, path, version)
        ingest.run_available(scored.select("event_id", "regime_id", "version", "pred"), out, state)
        got[version] = {(r["event_id"], r["regime_id"], r["version"], round(r["pred"], 6)) for r in spark.read.parquet(out).collect()}
    assert got == {"v1": {(1, 2, "v1", 7.0), (2, 0, "v1", 5.0)}, "v2": {(1, 2, "v2", 17.0), (2, 0, "v2", 15.0)}}
    with pytest.raises(ValueError, match="no saved models"):
        gram.load_groups(spark, path, "v3")
    with pytest.raises(ValueError, match="no input"):
        ingest.score_saved(ingest.event_stream(spark, arrivals, "*.parquet"), artists, "user_id", {}, path, "v1")
