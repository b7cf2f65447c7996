"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each source chunk sends to each shard is drawn first, from the distribution that a uniform permutation of all
rows would give. Then chunks permute their rows locally and send them as drawn, and shards permute what they get. Only
DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegauge.llm.tables import stored


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items are marked ones, drawn without replacement: the inverse of the distribution at ``u``.

    Walks over the values within ten standard deviations and ten of the mean; what lies outside has a probability far below
    the resolution of a double. Weights come from ratios of neighbours, so no factorial is needed.
    """
    real = lambda c: c.cast("double")
    share = F.when(population > 0, real(marked) / population).otherwise(0.0)
    spread = 10 * F.sqrt(
        real(drawn) * share * (1 - share) * F.when(population > 1, real(population - drawn) / (population - 1)).otherwise(0.0)
    ) + 10
    least = F.greatest(F.lit(0).cast("long"), drawn - (population - marked), F.floor(drawn * share - spread))
    most = F.least(marked, drawn, F.ceil(drawn * share + spread))

    def ratio(k: Column) -> Column:
        return real(marked - k) * real(drawn - k) / (real(k + 1) * real(population - marked - drawn + k + 1))

    def walk(v: Column) -> Column:
        values = F.sequence(v["least"], v["most"])
        total = F.aggregate(
            values, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")),
        )["sum"]
        return _let(
            total * u,
            lambda goal: F.aggregate(
                values, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), v["least"].alias("k")),
                lambda s, k: F.struct(
                    (s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum"),
                    F.when((s["sum"] + s["w"] < goal) & (k < v["most"]), k + 1).otherwise(s["k"]).alias("k"),
                ),
            )["k"],
        )

    return _let(F.struct(least.alias("least"), most.alias("most")), walk)


def _divided(room: Column, drawn: Column, seed: int, node: Column) -> Column:
    """How ``drawn`` rows spread over shards with ``room`` places: one draw after the other, each from what is left."""
    start = F.struct(
        drawn.alias("rows"), F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("places"),
        F.array().cast("array<long>").alias("out"),
    )

    def step(s: Column, i: Column) -> Column:
        places = F.get(room, i)
        return _let(
            hypergeometric(s["places"], places, s["rows"], _uniform(F.lit(seed), node, i)),
            lambda k: F.struct(
                (s["rows"] - k).alias("rows"), (s["places"] - places).alias("places"), F.concat(s["out"], F.array(k)).alias("out")
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step)["out"]


def communication_matrix(chunks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, piece, sends): how many rows each chunk (part, piece, n) sends to each shard.

    A binary tree halves the list of chunks: at each node the rows of the left half are divided over the places of the
    node, the right half gets the others. The list has one entry per chunk, some rows / chunk_rows in all.
    """
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    nodes = chunks.agg(F.sort_array(F.collect_list(F.struct("part", "piece", "n"))).alias("chunks")).filter(F.size("chunks") > 0)
    nodes = nodes.select(
        "chunks", F.lit(1).cast("long").alias("node"),
        _let(total, lambda n: F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(n / shards) + (s < n % shards).cast("long")
        )).alias("room"),
    )
    for _ in range(max(0, chunks.count() - 1).bit_length()):
        half = F.greatest(F.lit(1), F.size("chunks").cast("int") / 2).cast("int")
        nodes = nodes.select("chunks", "node", "room", F.slice("chunks", F.lit(1), half).alias("one"))
        nodes = nodes.select("*", F.slice("chunks", F.size("one") + 1, F.size("chunks")).alias("two"))
        rows = F.aggregate("one", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        nodes = nodes.select("one", "two", "node", "room", _divided(F.col("room"), rows, seed, F.col("node")).alias("sends"))
        nodes = nodes.select(F.explode(F.array(
            F.struct(F.col("one").alias("chunks"), (F.col("node") * 2).alias("node"), F.col("sends").alias("room")),
            F.struct(F.col("two").alias("chunks"), (F.col("node") * 2 + 1).alias("node"),
                     F.zip_with("room", "sends", lambda a, b: a - b).alias("room")),
        )).alias("x")).select("x.*").filter(F.size("chunks") > 0)
    only = F.element_at("chunks", 1)
    return nodes.select(only["part"].alias("part"), only["piece"].alias("piece"), F.col("room").alias("sends"))


def uniform_shuffle(rows: DataFrame, shards: int, seed: int = 0, chunk_rows: int = 20_000) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard): a uniform permutation of all rows.

    Shard sizes differ by one row at most. Rows are told apart by where they were read, not by what they hold, so nulls,
    ties and repeated rows are spread like others; input columns named shard or slot are replaced. An empty table gives
    no rows. Chunks and the cells that shards are permuted in hold about ``chunk_rows`` rows, whatever the input.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    held = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("in"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"),
    )
    held = stored(held.select(
        "in", "part", F.floor((F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)) / chunk_rows).alias("piece"),
        F.xxhash64(F.lit(seed), F.lit("send"), "at").alias("first"), F.xxhash64(F.lit(seed), F.lit("place"), "at").alias("second"),
    ), "chunks")
    chunks = held.groupBy("part", "piece").agg(F.count("*").alias("n"))
    matrix = communication_matrix(chunks, shards, seed).select(
        "part", "piece",
        F.aggregate(
            "sends", F.array().cast("array<long>"),
            lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + x)),
        ).alias("ends"),
    )
    local = Window.partitionBy("part", "piece").orderBy("first", "second")
    sent = held.withColumn("rank", F.row_number().over(local)).join(matrix, ["part", "piece"])
    cells = max(1, -(-held.count() // (shards * chunk_rows)))
    sent = stored(sent.select(
        "in", F.size(F.filter("ends", lambda end: end < F.col("rank"))).alias("shard"),
        F.floor(F.shiftrightunsigned("second", 11) * F.lit(2.0**-53) * cells).alias("cell"), "second", "first",
    ), "sent")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("second", "first")) - 1
    return sent.withColumn("place", place).join(starts, ["shard", "cell"]).select(
        "in.*", "shard", (F.col("start") + F.col("place")).alias("slot")
    )
