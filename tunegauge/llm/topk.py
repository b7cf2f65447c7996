"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Queries meet shards in blocks. A first wave sends each block to one shard; the kth scores found there go with the queries to
all other shards, where branches whose upper bound lies below it are never opened.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tunegauge.llm.tables import stored

LEAF = 32


class BallTree:
    """Balls around the means of rows, halved at the median of the widest axis."""

    def __init__(self, rows: np.ndarray):
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.rows = rows
        real = rows.astype(float)
        todo = [(np.arange(len(rows)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            part = real[members]
            centre = part.mean(axis=0)
            number = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())))
            self.members.append(members)
            self.children.append(None)
            if parent >= 0:
                one, two = self.children[parent]
                self.children[parent] = (number, two) if side == 0 else (one, number)
            if len(members) > LEAF and self.radius[-1] > 0:
                axis = int(np.argmax(np.ptp(part, axis=0)))
                order = np.argsort(part[:, axis], kind="stable")
                half = len(members) // 2
                self.children[number] = (-1, -1)
                todo += [(members[order[:half]], number, 0), (members[order[half:]], number, 1)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of a ball scores higher against a query: a row per query, a column per ball."""
        real = queries.astype(float)
        length = np.sqrt((real**2).sum(axis=1))
        centres, radius = np.array(self.centre), np.array(self.radius)
        reach = length[:, None] * radius[None, :]
        slack = 1e-9 * (reach + length[:, None] * np.sqrt((centres**2).sum(axis=1))[None, :]) + 1e-6
        return real @ centres.T + reach + slack


def search(rows: np.ndarray, ids: np.ndarray, at: np.ndarray, queries: np.ndarray, own: np.ndarray, least: list[int | None], k: int):
    """(query number, row number, score) of each query's k best rows, ties to the smaller id; rows below ``least`` may be missing."""
    big = max(1, rows.shape[1]) * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) >= 2.0**62
    if big:
        rows, queries = rows.astype(object), queries.astype(object)
    tree = BallTree(rows)
    bounds = tree.bounds(queries)
    out = []
    for n in range(len(queries)):
        query, floor = queries[n], least[n]
        best: list[tuple] = []
        heap = [(-bounds[n, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if (len(best) == k and -bound < best[0][0]) or (floor is not None and -bound < floor):
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    heapq.heappush(heap, (-bounds[n, child], child))
                continue
            members = tree.members[node]
            scores = rows[members] @ query
            if len(best) == k and not big:
                keep = scores >= best[0][0]
                members, scores = members[keep], scores[keep]
            for m, s in zip(members.tolist(), scores.tolist()):
                if at[m] == own[n] or (floor is not None and s < floor):
                    continue
                item = (s, -int(ids[m]), -int(at[m]), m)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        out += [(n, m, s) for s, _, _, m in best]
    return out


def top_k(
    vectors: DataFrame, queries: str, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding",
    shard_rows: int = 65_536, block_rows: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the SQL condition ``queries`` holds its k best other rows.

    Components become floor(scale * x), held within the range of long; scores are integers, ties go to the smaller id, then to
    the row read first. Rows with a null id or vector, or with a null or non-finite component, take no part; vectors of other
    lengths than the query's are no candidates. Repeated rows count one by one. Shards hold at most ``shard_rows`` rows, less if
    that gives fewer than 64 shards; blocks of queries hold ``block_rows``.
    """
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & good).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(F.expr(queries), F.lit(False)).alias("asks"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        F.size(embedding).alias("dim"), F.monotonically_increasing_id().alias("at"),
    )
    rows = stored(rows, "vectors")
    counts = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards = max(1, -(-counts[0] // shard_rows), min(64, -(-counts[0] // 1024)))
    blocks = max(1, -(-counts[1] // block_rows))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "at"), F.lit(n)).cast("int")
    held = rows.select("vec_id", "v", "dim", "at", deal("row", shards).alias("shard"))
    asked = rows.filter("asks").select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.col("dim").alias("length"), F.col("at").alias("asked"),
        deal("query", blocks).alias("in_block"),
    )
    found_schema = "query_id long, asked long, vec_id long, at long, score long"

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        kinds = [("query_id", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("at", pa.int64()), ("score", pa.int64())]
        if not one.num_rows or not two.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds})
        matrix = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        ids, at, asks, own = (t[c].to_numpy() for t, c in ((one, "vec_id"), (one, "at"), (two, "query_id"), (two, "asked")))
        found = search(matrix(one["v"]), ids, at, matrix(two["query"]), own, two["least"].to_pylist(), k)
        n, m = (np.array([f[i] for f in found], dtype=np.int64) for i in (0, 1))
        scores = [max(-(2**63), min(2**63 - 1, f[2])) for f in found]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds, (asks[n], own[n], ids[m], at[m], scores))})

    def wave(asked: DataFrame, first: bool) -> DataFrame:
        def meets(shard: str, block: str):
            home = F.col(shard) == F.col(block) % shards
            return home if first else ~home

        all_blocks, all_shards = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, shards))
        left = held.withColumn("block", all_blocks).filter(meets("shard", "block")).groupBy("dim", "shard", "block")
        right = asked.withColumn("in_shard", all_shards).filter(meets("in_shard", "in_block")).groupBy("length", "in_shard", "in_block")
        return left.cogroup(right).applyInArrow(meet, found_schema)

    first = stored(wave(asked.withColumn("least", F.lit(None).cast("long")), True), "first-wave")
    least = first.groupBy("asked").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    found = first.unionByName(wave(asked.join(least, "asked", "left"), False)) if shards > 1 else first
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
