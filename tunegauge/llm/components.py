"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegauge.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots; the root is the component's smallest node.

    Rounds of large-star and small-star: each node hands its larger, then its smaller neighbours to the smallest one it
    knows. The rounds needed grow with the logarithm of the longest path. No neighbour list is ever gathered: minima are
    partial aggregates, and the joins that hand them out read plain tables, so that Spark can split a hub's rows.
    Self-links and rows with a null end are ignored; no edges give no rows.
    """
    e = stored(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        both = e.union(e.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(
            both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large-star",
        )
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        e = stored(
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", "m")).distinct(),
            "small-star",
        )
