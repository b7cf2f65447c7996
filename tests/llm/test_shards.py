import math
from collections import Counter

from pyspark.sql import functions as F

from tunegauge.llm import shards


def test_draws_follow_the_hypergeometric_law(spark):
    long = lambda n: F.lit(n).cast("long")
    n = 20_000
    got = spark.range(n).select(shards.hypergeometric(long(50), long(20), long(10), F.rand(1)).alias("k")).groupBy("k").count().collect()
    for row in got:
        want = n * math.comb(20, row.k) * math.comb(30, 10 - row.k) / math.comb(50, 10)
        assert abs(row["count"] - want) < 5 * math.sqrt(want) + 1


def test_draws_at_the_ends(spark):
    cases = [(0, 0, 0, 0), (5, 5, 3, 3), (5, 0, 3, 0), (7, 3, 7, 3), (1, 1, 0, 0)]
    rows = spark.createDataFrame(cases, "p long, m long, d long, want long")
    got = rows.select("want", shards.hypergeometric(F.col("p"), F.col("m"), F.col("d"), F.lit(0.999999)).alias("k")).collect()
    assert all(r.k == r.want for r in got)


def test_matrix_sums(spark):
    chunks = spark.createDataFrame([(0, i, 10 + i) for i in range(13)], "part int, piece long, n long")
    got = shards.communication_matrix(chunks, 5, 3).collect()
    assert sorted((r.piece, sum(r.sends)) for r in got) == [(i, 10 + i) for i in range(13)]
    total = sum(10 + i for i in range(13))
    assert sorted(sum(r.sends[s] for r in got) for s in range(5)) == sorted(total // 5 + (s < total % 5) for s in range(5))
    assert all(x >= 0 for r in got for x in r.sends)


def test_shuffle_is_exact_and_spread(spark):
    out = shards.uniform_shuffle(spark.range(0, 6000, 1, 17), 7, 5, chunk_rows=100).collect()
    assert sorted(r.id for r in out) == list(range(6000))
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes.values()) == [857] * 6 + [858]
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    expected = 6000 / 17 / 7
    cells = Counter((r.id * 17 // 6000, r.shard) for r in out)
    assert sum((cells[p, s] - expected) ** 2 / expected for p in range(17) for s in range(7)) < 170
    first = [r.id for r in sorted((r for r in out if r.shard == 0), key=lambda r: r.slot)]
    assert abs(sum(a < b for a, b in zip(first, first[1:])) / len(first) - 0.5) < 0.08


def test_odd_rows(odd, empty):
    out = shards.uniform_shuffle(odd, 5)
    assert out.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"] and out.count() == 12
    assert shards.uniform_shuffle(empty, 5).count() == 0
