"""Near copies by Jaccard similarity of word shingles: MinHash bands propose, the shingles themselves decide.

Texts with the same set of shingles are one node. Nodes that share the MinHash values of a band share a bucket. Each is first
compared with the least node of its bucket; what is then still apart in a bucket is compared there pair by pair, so that of all
pairs that share a bucket none is left unchecked unless other pairs link it already. A pair at similarity s shares a bucket
with probability 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8, more above. The links of near SimHash fingerprints can be added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tunegauge.llm import simhash
from tunegauge.llm.components import components
from tunegauge.llm.simhash import Forest, least_keys
from tunegauge.llm.tables import slices, stored, unused

#: Bands of the sketch and MinHash values in each.
BANDS, ROWS = 24, 5
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS, OFFSETS = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the different word shingles; a text of fewer words than ``width`` is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    parts = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in parts), dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key per band, from the least values that the hashes take under fixed random maps; none for no hashes."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, start : start + 4096] * FACTORS + OFFSETS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def sketched(docs: DataFrame, text: str, width: int, seed: int, names: list[str], fp: str | None = None) -> DataFrame:
    """``docs`` with three columns of the given names: node (hash of the set of shingles, 0 for none), its size, its bands.

    With ``fp`` the SimHash fingerprint goes before them in a column of that name, found in the same Python step, so that a
    task has one Python worker and its texts are sent there once.
    """
    at = docs.columns.index(text)
    fields = [*zip(names, (LongType(), LongType(), ArrayType(LongType())))]
    if fp is not None:
        fields = [(fp, LongType()), *fields]
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            if fp is not None:
                columns.append(pa.array(np.array([simhash.fingerprint(t, seed=seed) for t in texts], dtype=np.uint64).view(np.int64)))
            found = [shingles(t, width, seed) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), seed) if len(h) else 0 for h in found], dtype=np.uint64).view(np.int64)
            columns += [pa.array(node), pa.array([len(h) for h in found], pa.int64()), pa.array([bands(h) for h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (key, node, n, row) but the first of its key with that first one; rows come sorted by key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if last is not None:
            columns = [np.r_[x, c] for x, c in zip(last, columns)]
        key = columns[0]
        first = np.r_[True, key[1:] != key[:-1]]
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        rest = ~first
        lead = [c[at] for c in columns[1:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[rest]) for c in [*columns, *lead]], names=["key", "node", "n", "row", "lead", "lead_n", "lead_row"]
        )
        last = [c[at[-1:]] for c in columns]


def link(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float, forest: Forest) -> None:
    """Add to ``forest`` links that connect all nodes similar enough; nodes of one root count as connected already."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, part, sets = nodes[order], np.unique(roots[order], return_inverse=True)[1], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(n)]
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(flat.max() + 1, dtype=bool)
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(n * least, n[i], "right"))
        if stop <= i + 1 or (part[i + 1 : stop] == part[i]).all():
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[flat[starts[i + 1] : starts[stop]]], starts[i + 1 : stop] - starts[i + 1], dtype=np.int64)
        mark[own] = False
        for j in i + 1 + np.flatnonzero(both >= least * (n[i] + n[i + 1 : stop] - both)):
            if part[j] != part[i]:
                forest.add(int(nodes[i]), int(nodes[j]))
                part[part == part[j]] = part[i]


def links(rows: DataFrame, text: str, node: str, n: str, row: str, keys: str, width: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """Stored links (a, b) that connect all nodes of the stored ``rows`` that share a bucket and are similar enough."""
    once = rows.filter(F.col(n) > 0).select(F.col(node).alias("node"), F.col(n).alias("n"), F.col(row).alias("row"), F.col(keys).alias("keys")).dropDuplicates(["node"])
    shared = once.select(F.explode("keys").alias("key"), "node", "n", "row").repartition("key").sortWithinPartitions("key", "node")
    shared = stored(shared.mapInArrow(_lead, "key long, node long, n long, row long, lead long, lead_n long, lead_row long"), "buckets")
    wanted = shared.select("row").union(shared.select("lead_row")).distinct().withColumnRenamed("row", "_wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, width, seed).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    sets = rows.join(wanted, F.col(row) == F.col("_wanted"), "left_semi").select(F.col(node).alias("node"), F.col(text).alias("text"))
    sets = stored(sets.mapInArrow(hashed, "node long, found array<long>"), "shingles")

    pairs = shared.filter(F.least("n", "lead_n") >= least * F.greatest("n", "lead_n")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("one")), "b")
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("two")), "a")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("one", "two")))
    near = stored(pairs.filter(F.col("both") >= least * (F.size("one") + F.size("two") - F.col("both"))).select("a", "b"), "near")

    members = shared.select("key", "node").union(shared.select("key", "lead").distinct())
    members = members.join(components(near), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    members = stored(members, "members")
    apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    members = members.join(apart, "key", "left_semi").join(sets, "node").select("key", "node", "root", "found")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, held = Forest(), None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for i, (k, node, root) in enumerate(zip(*columns)):
                if k != key and held:
                    link(*(np.array(x) for x in list(zip(*held))[:2]), [h[2] for h in held], least, forest)
                    held = []
                    if len(forest.up) >= 1_000_000:
                        yield forest.batch()
                        forest = Forest()
                key = k
                held.append((node, root, batch.column(3)[i].values.to_numpy()))
        if held:
            link(*(np.array(x) for x in list(zip(*held))[:2]), [h[2] for h in held], least, forest)
        yield forest.batch()

    rest = members.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    return stored(near.union(rest), "near-all")


def fingerprint_links(rows: DataFrame, node: str, fp: str, bits: int) -> DataFrame:
    """Links (a, b) that connect all nodes of the stored ``rows`` whose fingerprints differ in at most ``bits`` bits."""
    prints = stored(rows.select(F.col(node).alias("node"), F.col(fp).alias("_fp")).distinct(), "prints")
    first = stored(prints.groupBy("_fp").agg(F.min("node").alias("first")), "first-nodes")
    equal = prints.join(first, "_fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(first, bits)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("_fp").alias(end), F.col("first").alias(f"_{end}")), end)
    return stored(equal.union(near.select("_a", "_b")), "fingerprint-links")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, seed: int = 42, bits: int | None = None
) -> DataFrame:
    """The rows of ``docs`` with one row of each component of texts whose shingles have a Jaccard similarity of ``least``.

    With ``bits`` texts also link, as in ``simhash.near_duplicates``, if their SimHash fingerprints differ in at most so many.
    It is the row with the smallest id, then the first one read; rows with a null id go last. Null and empty texts are
    copies of each other. All columns are kept as they are.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    node, n, row, keys, fp = unused(docs, "_node", "_n", "_row", "_keys", "_print")
    rows = docs.select(*own, F.monotonically_increasing_id().alias(row))
    rows = stored(sketched(rows, text, width, seed, [node, n, keys], None if bits is None else fp), "sketched")
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    found = links(rows, text, node, n, row, keys, width, least, seed)
    if bits is not None:
        found = found.union(fingerprint_links(rows, node, fp, bits))
    kept = least_keys(rows.select(key.alias("_key"), F.col(node).alias("_fp")), found).select(F.col("_least.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").select(*own)
