"""Near-duplicates by SimHash fingerprints that are compared at the anchors of a covering code.

The anchors are the words of the binary Golay code on bits 0-22 times the same code on bits 23-45: every 23-bit word has
exactly one Golay word within 3 bits (the covering radius), its home. A fingerprint goes to its home and to each anchor that
is within the covering radius plus the threshold, the threshold shared between the two blocks. If two fingerprints differ
in ``bits`` or fewer bits, each one reaches the home of the other, so comparing per anchor loses no link. As this holds
both ways, only anchors numbered below a fingerprint's own home are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tunegauge.llm.components import components
from tunegauge.llm.tables import slices, stored, unused

#: The generator polynomial of the binary Golay code, its length and covering radius.
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3
BLOCK = (1 << LENGTH) - 1
#: Pairs compared at a time.
PAIRS = 2_000_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, repeats included; a bit is set if it is set in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42, into: str = "_fp") -> DataFrame:
    """``docs`` with a column ``into`` (the fingerprint as a signed long)."""
    at, schema = docs.columns.index(text), StructType([*docs.schema.fields, StructField(into, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width, seed) for t in batch.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def code() -> dict:
    """Tables of the Golay code: remainders, the home offset of each remainder, and the code words at each reach."""
    words = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        words ^= np.where(np.arange(4096) >> bit & 1, GOLAY << bit, 0)
    rest = np.zeros(LENGTH, dtype=np.int64)
    for bit in range(LENGTH):
        value = 1 << bit
        for top in range(LENGTH - 1, 10, -1):
            if value >> top & 1:
                value ^= GOLAY << (top - 11)
        rest[bit] = value

    def remainder(x):
        out = np.zeros_like(x)
        for bit in range(LENGTH):
            out ^= np.where(x >> bit & 1, rest[bit], 0)
        return out

    units = [1 << i for i in range(LENGTH)]
    errors = [0, *units]
    errors += [a | b for i, a in enumerate(units) for b in units[i + 1 :]]
    errors += [a | b | c for i, a in enumerate(units) for j, b in enumerate(units[i + 1 :], i + 1) for c in units[j + 1 :]]
    errors = np.array(errors, dtype=np.int64)
    leader = np.zeros(2048, dtype=np.int64)
    leader[remainder(errors)] = errors
    distance = np.bitwise_count(words[None, :] ^ leader[:, None]).astype(np.int64)
    reach = np.maximum(distance - RADIUS, 0)
    lists = []
    for t in range(4):
        row, column = np.nonzero(reach == t)
        count = np.bincount(row, minlength=2048)
        lists.append((words[column], np.cumsum(count) - count, count))
    return {"low": remainder(np.arange(4096)), "high": remainder(np.arange(2048) << 12), "leader": leader, "lists": lists}


def _syndrome(block: np.ndarray) -> np.ndarray:
    c = code()
    return c["low"][block & 4095] ^ c["high"][block >> 12]


def replicas(fps: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row in ``fps`` and whether it is the home, for each anchor that a fingerprint goes to."""
    c = code()
    unsigned = fps.view(np.uint64)
    blocks = [(unsigned & np.uint64(BLOCK)).astype(np.int64), (unsigned >> np.uint64(LENGTH) & np.uint64(BLOCK)).astype(np.int64)]
    rests = [_syndrome(b) for b in blocks]
    homes = [b ^ c["leader"][s] for b, s in zip(blocks, rests)]
    key = lambda a, b: (a >> 11) << 12 | b >> 11
    home = key(*homes)
    out = []
    for s in range(bits + 1):
        for t in range(bits + 1 - s):
            (wa, fa, na), (wb, fb, nb) = c["lists"][s], c["lists"][t]
            n = na[rests[0]] * nb[rests[1]]
            row = np.repeat(np.arange(len(fps)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            inner = nb[rests[1]][row]
            a = homes[0][row] ^ wa[fa[rests[0]][row] + k // inner]
            b = homes[1][row] ^ wb[fb[rests[1]][row] + k % inner]
            anchor = key(a, b)
            keep = anchor <= home[row]
            out.append((anchor[keep], row[keep]))
    anchor, row = (np.concatenate(x) for x in zip(*out))
    return anchor, row, anchor == home[row]


class Forest:
    """Union-find over the links of some anchors, so that a task passes on a forest and not all pairs."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        nodes = list(self.up)
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([self.root(x) for x in nodes], pa.int64())})


def _compare(anchor, home, fp, bits: int, forest: Forest) -> None:
    """Compare each row that is at home with all rows of its anchor; rows come sorted by anchor."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[starts, len(anchor)])
    group = np.repeat(np.arange(len(starts)), size)
    left = np.flatnonzero(home & (size[group] > 1))
    n = size[group[left]]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(left):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        part, count = left[begin:stop], n[begin:stop]
        one = np.repeat(part, count)
        two = np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[group[part]], count)
        near = np.bitwise_count((fp[one] ^ fp[two]).view(np.uint64)) <= bits
        near &= ~home[two] | (one < two)
        for a, b in zip(fp[one[near]].tolist(), fp[two[near]].tolist()):
            forest.add(a, b)
        begin = stop


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``_fp`` that differ in at most ``bits`` bits.

    The links of a task are a spanning forest, so a group of n near copies gives fewer than n links from each task.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            fp = batch.column(0).to_numpy()
            anchor, row, home = replicas(fp, bits)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(fp[row])], names=["anchor", "home", "_fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept, held = Forest(), [], 0

        def flush(last: bool):
            nonlocal kept, held
            if not kept:
                return
            anchor, home, fp = (np.concatenate(x) for x in zip(*kept))
            cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            kept, held = ([(anchor[cut:], home[cut:], fp[cut:])], len(anchor) - cut) if cut < len(anchor) else ([], 0)
            if cut:
                _compare(anchor[:cut], home[:cut], fp[:cut], bits, forest)

        for batch in batches:
            anchor, home, fp = batch.columns
            kept.append((anchor.to_numpy(), home.to_numpy(zero_copy_only=False), fp.to_numpy()))
            held += batch.num_rows
            if held >= 400_000:
                flush(False)
                if len(forest.up) >= 1_000_000:
                    yield forest.batch()
                    forest = Forest()
        flush(True)
        yield forest.batch()

    return (
        fps.select("_fp").distinct()
        .mapInArrow(spread, "anchor int, home boolean, _fp long")
        .repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(compare, "a long, b long")
    )


def classes(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(_fp, _least): for each fingerprint the smallest ``_key`` of its component. ``fps``: stored rows (_key, _fp)."""
    return least_keys(fps, links(fps, bits))


def least_keys(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` for any links (a, b) of values in ``_fp``."""
    joined = components(edges)
    own = fps.groupBy("_fp").agg(F.min("_key").alias("_own"))
    own = stored(own.join(joined.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_own", F.coalesce("root", "_fp").alias("root")), "roots")
    least = stored(own.groupBy("root").agg(F.min("_own").alias("_least")), "least")
    return stored(own.join(least, "root").select("_fp", "_least"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id that links reach).

    Null and empty texts have fingerprint zero and link like any other; a text of fewer words than ``width`` is one shingle.
    Repeated rows and ids give one row each. A null id stays null and names a component only if all its ids are null.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    fps = stored(fingerprints(rows, "_text", width, seed).select("_key", "_fp"), "fingerprints")
    found = classes(fps, bits)
    return fps.join(found, "_fp", "left").select(
        F.col("_key").alias(doc_id),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that with the smallest id, then the first one read.

    Rows with a null id go last. All columns are kept as they are.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    fp, row = unused(docs, "_fp", "_row")
    rows = stored(fingerprints(docs.select(*own, F.monotonically_increasing_id().alias(row)), text, width, seed, fp), "fingerprinted")
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    kept = classes(rows.select(key.alias("_key"), F.col(fp).alias("_fp")), bits).select(F.col("_least.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").select(*own)
