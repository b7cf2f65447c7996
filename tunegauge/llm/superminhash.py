"""Near copies by SuperMinHash signatures, banding, exact verification and union-find.

Each shingle of a text draws a random permutation of the signature's registers, one place after the other; at level j it offers
its register at place j the value j plus a random fraction, and a register keeps the least. So the ranks that one shingle
offers are correlated, registers fill more evenly than under independent hashes, and estimates vary less. As soon as all
registers of a text hold less than the next level, further levels cannot change them and are left out.

Texts of equal shingle sets are one node; nodes that share the registers of a band share a bucket. Every member of a bucket is
verified against its lead, the member that shares most buckets, and those that are unlike it against a second lead. What is
left are pairs of one bucket of which at least one is unlike the lead. Their distance follows from where each differs from the
lead, and if they are similar, enough of these differences are common. So they meet in an equality join on a few of the
differences, which proposes all similar pairs; parity bits of the sets sieve out most others. No bucket is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tunegauge.llm.components import components
from tunegauge.llm.simhash import Forest, least_keys
from tunegauge.llm.tables import slices, stored

#: Bands of the signature and registers in each. A pair at similarity s shares a bucket with probability
#: 1 - (1 - s^ROWS)^BANDS, 0.99999 at 0.85.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Shingles whose permutations are held at a time, and texts sketched together.
HELD, TEXTS = 1 << 16, 512
#: Members of a lead that are verified under one key; a lead with more has its set sent under several.
SPREAD = 1000
#: Words of 64 bits that tell sets apart which differ in too many shingles; for large sets they tell less.
PARITIES = 6
#: Bits of the number of marks that sieve the sets to keep: 2^26 marks are 8 MB.
MARKS = 26
STEP = 0x9E3779B97F4A7C15
_STEP, _A, _B = np.uint64(STEP), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of each value."""
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


class Words(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __init__(self, seed: int, room: int = 500_000):
        super().__init__()
        self.seed, self.room = seed, room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, self.seed)
        return found


def shingles(text: str | None, width: int, known: Words) -> np.ndarray:
    """Sorted hashes of the different word shingles; a text of fewer words than ``width`` is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    found = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        found = mixed(found + _STEP + hashes[i : len(words) - size + 1 + i])
    return np.unique(found)


def signatures(sets: list[np.ndarray], registers: int = REGISTERS, held: int = HELD) -> np.ndarray:
    """SuperMinHash registers of each set, one row per set; a register holds level << 32 | fraction. Empty sets keep all ones."""
    out = np.full((len(sets), registers), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for start in range(0, len(values), held):
        own, value = owner[start : start + held], values[start : start + held]
        places = None
        for level in range(registers):
            drawn = mixed(value + np.uint64(STEP * (level + 1) % (1 << 64)))
            pick = level + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(registers - level) >> np.uint64(32)).astype(np.int64)
            if places is None:
                register = pick
            else:
                each = np.arange(len(value))
                register = places[each, pick].astype(np.int64)
                places[each, pick] = places[:, level]
                places[:, level] = register
            np.minimum.at(flat, own * registers + register, np.uint64(level << 32) | drawn >> np.uint64(32))
            # texts whose registers are all below the next level are done
            going = (out[own[0] : own[-1] + 1].max(axis=1) >= np.uint64(level + 1 << 32))[own - own[0]]
            if not going.any():
                break
            if places is None:
                own, value, pick = own[going], value[going], pick[going]
                places = np.tile(np.arange(registers, dtype=np.uint16), (len(value), 1))
                places[np.arange(len(value)), pick] = 0
                places[:, 0] = pick
            elif not going.all():
                own, value, places = own[going], value[going], places[going]
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """A key per row and band of the registers."""
    parts = found.reshape(len(found), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = mixed((key ^ parts[:, :, i]) + _STEP)
    return key.view(np.int64)


def node_of(found: np.ndarray) -> int:
    """Signed hash of a set of shingles, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def sketched(docs: DataFrame, id: str, text: str, width: int = 3, seed: int = 42) -> DataFrame:
    """Stored (id, node, n, keys) of each text: hash and size of its set of shingles, and a key per band."""
    schema = StructType([
        StructField("id", docs.schema[id].dataType), StructField("node", LongType()), StructField("n", LongType()),
        StructField("keys", ArrayType(LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(seed)
        for batch in slices(batches, TEXTS):
            sets = [shingles(t, width, known) for t in batch.column(1).to_pylist()]
            keys = pa.array(bands(signatures(sets)).reshape(-1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys),
            ], names=schema.names)

    return stored(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "sketches")


def marks(nodes: DataFrame) -> np.ndarray:
    """A bit for each wanted node, folded to a fixed number of bits: a first sieve that lets all wanted nodes pass."""
    at = nodes.select((F.col("node").bitwiseAND((1 << MARKS) - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(1 << MARKS - 6, dtype=np.int64)
    for word, bits in words.collect():  # at most 2^(MARKS - 6) rows, whatever the data
        out[word] = bits
    return out.view(np.uint8)


def sets_of(docs: DataFrame, text: str, wanted: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Stored ``wanted`` (node, any more columns) with the shingles ``found`` of each node, one row for a node.

    Texts are read again, so that no table of all sets is kept.
    """
    more = [c for c in wanted.columns if c != "node"]
    sent = docs.sparkSession.sparkContext.broadcast(marks(wanted))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Words(seed), sent.value
        for batch in slices(batches):
            sets = [shingles(t, width, known) for t in batch.column(0).to_pylist()]
            nodes = np.array([node_of(s) for s in sets], dtype=np.int64)
            at = nodes & ((1 << MARKS) - 1)
            some = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array([sets[i].view(np.int64) for i in some], pa.list_(pa.int64()))], names=["node", "found"])

    every = docs.select(F.col(text).alias("text")).mapInArrow(run, "node long, found array<long>")
    return stored(every.join(wanted, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("found", *more)]), "sets")


def keyed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) as (a, b, way), and (a, ways): under how many keys a node ``a`` is met, each for a bounded number of pairs on average."""
    ways = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("ways"))
    return pairs.join(ways, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("way")), ways


def led_by(pairs: DataFrame) -> DataFrame:
    """Stored (node, leads, ways) of each node of the stored ``pairs`` (a, b) of a lead and a member.

    ``leads`` (a, way) are the leads that a member meets, no more than it has bands; a node that leads has ``ways``, others null.
    """
    some, ways = keyed(pairs)
    lead = F.struct("a", "way")
    ends = some.select(F.col("b").alias("node"), lead.alias("lead"), F.lit(None).cast("int").alias("ways")).unionByName(
        ways.select(F.col("a").alias("node"), F.lit(None).cast("struct<a: long, way: int>").alias("lead"), "ways"))
    return stored(ends.groupBy("node").agg(F.collect_list("lead").alias("leads"), F.max("ways").alias("ways")), "wanted")


def met(sets: DataFrame) -> DataFrame:
    """(a, b, one, two): the pairs of ``led_by`` with the sets of both, from rows (node, found, leads, ways).

    Sets know whom they meet, so that they go to their leads without a join that shuffles them by node before.
    """
    two = sets.select(F.col("node").alias("b"), F.col("found").alias("two"), F.explode("leads").alias("lead")).select("lead.a", "lead.way", "b", "two")
    one = sets.filter("ways is not null").select(
        F.col("node").alias("a"), F.col("found").alias("one"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    return two.join(one, ["a", "way"]).select("a", "b", "one", "two")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored ``pairs`` (a, b) as (a, b, one, two) with the sets of both.

    A node ``a`` of many pairs has its set copied under several keys, each for a bounded number of pairs on average.
    """
    some, ways = keyed(pairs)
    one = sets.join(ways.withColumnRenamed("a", "node"), "node").select(
        F.col("node").alias("a"), F.col("found").alias("one"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    two = some.join(sets.select(F.col("node").alias("b"), F.col("found").alias("two")), "b")
    return two.join(one, ["a", "way"]).select("a", "b", "one", "two")


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Stored links (a, b): a forest per task over those ``pairs`` (a, b) whose sets are similar enough, in percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            ones, twos = batch.column(2), batch.column(3)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, y = ones[i].values.to_numpy(), twos[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= least * (len(x) + len(y) - both):
                    forest.add(a, b)
            if len(forest.up) >= 1_000_000:
                yield forest.batch()
                forest = Forest()
        yield forest.batch()

    return stored(with_sets(pairs, sets).mapInArrow(run, "a long, b long"), "verified")


def differences(lead: np.ndarray, own: np.ndarray, least: int) -> tuple[bool, np.ndarray, int, int]:
    """Whether two sets link; where ``own`` differs from ``lead``, in an order that is the same for all; how much of it to look up.

    What it adds comes first, then what it lacks. Write d for the number of differences, and t for the share of two sizes
    up to which differences keep a link. A set that links with another one x, itself not linked with the lead, has at
    least (d + t (size of lead - own size)) / 2 differences in common with x, as x has over t (its size + size of lead).
    Any two sets that link have at least d - t (own size + largest size that can link) in common. If two sets of d
    differences have c in common, one of them is among the first d - c + 1 of each: these numbers come third (the other
    one is not linked with the lead) and fourth (the other one may be).
    """
    adds, lacks = np.setdiff1d(own, lead, assume_unique=True), np.setdiff1d(lead, own, assume_unique=True)
    d, both = len(adds) + len(lacks), len(own) - len(adds)
    linked = 100 * both >= least * (len(own) + len(lead) - both)
    # in whole numbers: t is (100 - least) / (100 + least), and the largest partner has 100 / least of the own size
    whole, part = 100 + least, 100 - least
    any_ = max(1, -(-(d * least - part * len(own)) // least))
    far = max(1, any_, -(-(d * whole + part * (len(lead) - len(own))) // (2 * whole)))
    ordered = np.concatenate([adds, lacks])
    return linked, ordered, max(0, d - far + 1), max(0, d - any_ + 1)


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of the elements falls on each of a fixed number of bits: sets that differ in d elements differ in d bits at most."""
    odd = np.bincount((own.view(np.uint64) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def compared(pairs: DataFrame, least: int) -> DataFrame:
    """Stored (a, b, n, linked, to_far, to_any, first, odd) of each of ``pairs`` (a, b, one, two): a lead a, a member b of size n, their sets.

    See ``differences`` for the numbers and the first differences, ``parities`` for the bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [differences(x.values.to_numpy(), y.values.to_numpy(), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(y) for y in batch.column(3)], pa.int64()), pa.array([f[0] for f in found], pa.bool_()),
                pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()),
                pa.array([f[1][: max(f[2:])] for f in found], pa.list_(pa.int64())),
                pa.array([parities(y.values.to_numpy()) for y in batch.column(3)], pa.list_(pa.int64())),
            ], names=["a", "b", "n", "linked", "to_far", "to_any", "first", "odd"])

    schema = "a long, b long, n long, linked boolean, to_far int, to_any int, first array<long>, odd array<long>"
    return stored(pairs.mapInArrow(run, schema), "compared")


def common_differences(seen: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of members of one lead, of different roots, with a common difference among those to look up.

    One of the two is outside the lead's component, so not linked with the lead; the other one is anywhere.
    """
    own = seen.join(roots.select(F.col("node").alias("b"), F.col("root").alias("of_b")), "b", "left")
    own = own.join(roots.select(F.col("node").alias("a"), F.col("root").alias("of_a")), "a", "left")
    own = own.withColumns({"root": F.coalesce("of_b", "b"), "lead_root": F.coalesce("of_a", "a")})
    bits = [F.get("odd", F.lit(i)).alias(f"odd{i}") for i in range(PARITIES)]

    def at(rows: DataFrame, upto: str) -> DataFrame:
        each = rows.select("a", "b", "n", "root", *bits, F.explode(F.slice("first", F.lit(1), F.col(upto))).alias("at"))
        return each.select(F.xxhash64("a", "at").alias("at"), "b", "n", "root", *[f"odd{i}" for i in range(PARITIES)])

    x, y = at(own.filter("root <> lead_root"), "to_any").alias("x"), at(own, "to_far").alias("y")
    alike = 100 * F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")
    apart = sum((F.bit_count(F.col(f"x.odd{i}").bitwiseXOR(F.col(f"y.odd{i}"))) for i in range(PARITIES)), F.lit(0))
    near = (100 + least) * apart <= (100 - least) * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.root") != F.col("y.root")) & alike & near)
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))


def links(docs: DataFrame, text: str, nodes: DataFrame, least: int = 85, width: int = 3, seed: int = 42) -> DataFrame:
    """Stored links (a, b) that connect all nodes (node, n, keys) that share a bucket and are similar enough."""
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    # counted where the rows of a bucket already are, so that the keys of all texts are shuffled once and not for a join again
    counted = members.withColumn("size", F.count("*").over(Window.partitionBy("key")))
    shared = stored(counted.filter("size > 1").select("key", "node", "n", "size"), "buckets")
    weight = stored(shared.groupBy("node").agg(F.sum("size").alias("weight")), "weights")

    def led(rows: DataFrame, name: str) -> DataFrame:
        top = rows.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("lead"))
        return stored(rows.join(top, "key").select("key", "node", "n", "size", F.col("lead.node").alias("a"), F.col("lead.n").alias("a_n")).filter("node <> a"), name)

    alike = 100 * F.least("n", "a_n") >= least * F.greatest("n", "a_n")
    first = led(shared, "led")
    pairs = stored(first.filter((F.col("size") > 2) | alike).select("a", F.col("node").alias("b")).distinct(), "lead-pairs")
    known = sets_of(docs, text, led_by(pairs), width, seed)
    one, sets = compared(met(known), least), known.select("node", "found")
    # members unlike the lead of their bucket, where it has two of them or more
    unlike = one.filter("not linked").select("a", F.col("b").alias("node"))
    left = stored(first.filter("size > 2").join(unlike, ["a", "node"], "left_semi").select("key", "node", "n"), "unlike")
    more = left.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    second = led(left.join(more, "key").select("key", "node", "n", "size"), "led-again")
    two = compared(with_sets(stored(second.select("a", F.col("node").alias("b")).distinct(), "second-pairs"), sets), least)
    near = stored(one.filter("linked").select("a", "b").union(two.filter("linked").select("a", "b")), "lead-links")
    roots = stored(components(near), "lead-roots")
    rest = stored(common_differences(one, roots, least).distinct(), "candidates")
    return near if rest.isEmpty() else stored(near.union(verified(rest, sets, least)), "all-links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 85, width: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: id, ``n_shingles`` (size of its set), ``component_id`` (smallest id that links reach), ``kept``.

    Documents link where 100 * common shingles >= ``least`` * shingles of either. Null and empty texts link with nothing and
    are their own component; a text of fewer words than ``width`` is one shingle. Repeated rows and ids give one row each
    and link by their texts only. A null id stays null and names a component only if all its ids are null. ``kept``: the id
    names the component. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    found = sketched(docs, doc_id, text, width, seed)
    filled = found.filter("n > 0")
    nodes = stored(filled.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    edges = links(docs, text, nodes, least, width, seed)
    classes = least_keys(filled.select(F.col("node").alias("_fp"), F.col("id").alias("_key")), edges)
    out = found.join(classes, F.col("node") == F.col("_fp"), "left")
    component = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
