"""Ranked lexical search: short lists are summed first, long lists are then walked document by document and skipped through.

The index is a stored table of segments, a row each: some thousand documents with their ids and lengths, and the postings of
the words that queries use, by word, then by place in the segment. For a query, the lists of its rarer words in a segment are
summed into accumulators (term at a time). The accumulators become one more list with a bound, beside the long lists, and all
are walked document at a time: once k documents are known, documents that only stand in lists whose bounds together stay
below the kth score are passed over, and those lists are only looked into for documents that can still get there. Documents
are taken in runs, so that a step is an array operation. A task carries its kth scores from segment to segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tunegauge.llm.tables import slices, stored

#: Documents and postings at which a segment is closed; a document is never split.
SEGMENT, POSTINGS = 4096, 1 << 20
#: Documents of a run, and the share of a segment's documents up to which a list counts as short.
RUN, SHORT = 1024, 1 / 16
#: Bytes of query texts that are answered together; more queries take more passes over the documents.
BLOCK_BYTES = 4 << 20
_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: what lies between ASCII characters that are no letter or digit, A-Z lowered. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def index(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored segments (ids, n, words, lengths, places, tfs): all documents, the postings of the numbered vocabulary."""
    kind = docs.schema[doc_id].dataType
    schema = StructType([
        StructField("ids", ArrayType(kind)), StructField("n", ArrayType(LongType())),
        *(StructField(c, ArrayType(IntegerType())) for c in ("words", "lengths", "places", "tfs")),
    ])
    numbers = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, keys, counts, held = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            word, length = np.unique(key >> 32, return_counts=True)
            values = [
                pa.concat_arrays(ids), pa.array(n, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (word, length, key & 0xFFFFFFFF, count)),
            ]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], names=schema.names)

        for batch in slices(batches):
            ids.append(batch.column(0))
            for value in batch.column(1).to_pylist():
                found = terms(value)
                known = np.fromiter(map(numbers.get, found, repeat(-1)), np.int64, len(found))
                word, count = np.unique(known[known >= 0], return_counts=True)
                keys.append(word << 32 | len(n))
                counts.append(count)
                n.append(len(found))
                held += len(word)
            if len(n) >= SEGMENT or held >= POSTINGS:
                yield segment()
                ids, n, keys, counts, held = [], [], [], [], 0
        if n:
            yield segment()

    return stored(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "segments")


def best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id, null ids last."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[best_of(scores[some], ids[some], nulls[some], k)]
    return best_of(scores, ids, nulls, k)


def best_of(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    if ids.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], bool(nulls[i]), "" if nulls[i] else ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, nulls, -scores))[:k]


class Top:
    """The k best documents of a query so far; ``least`` is the score that a further one must reach."""

    def __init__(self, k: int):
        self.k, self.least, self.held = k, 1, None

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if self.held is not None:
            scores, ids, nulls = (np.concatenate(x) for x in zip(self.held, (scores, ids, nulls)))
        keep = best(scores, ids, nulls, self.k)
        self.held = scores[keep], ids[keep], nulls[keep]
        if len(keep) == self.k:
            self.least = int(scores[keep[-1]])


def search(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, nulls: np.ndarray, top: Top, short: float = SHORT, run: int = RUN) -> int:
    """Add a segment's documents to ``top``; gives the number of documents that were scored.

    ``lists``: (places, values, largest value) of each query word that the segment holds.
    """
    size, scored = len(ids), 0
    few = [l for l in lists if len(l[0]) <= short * size]
    walked = [l for l in lists if len(l[0]) > short * size]
    if few:
        sums = np.zeros(size, dtype=np.int64)
        for places, values, _ in few:
            sums[places] += values
        places = np.flatnonzero(sums)
        walked.append((places, sums[places], int(sums.max())))
    walked.sort(key=lambda l: l[2])
    bounds = np.cumsum([l[2] for l in walked])
    for start in range(0, size, run):
        stop = min(start + run, size)
        first = int(np.searchsorted(bounds, top.least))
        if first == len(walked):
            break
        totals = np.zeros(stop - start, dtype=np.int64)
        for places, values, _ in walked[first:]:
            a, b = np.searchsorted(places, (start, stop))
            totals[places[a:b] - start] += values[a:b]
        at = np.flatnonzero(totals)
        total = totals[at]
        scored += len(at)
        for j in range(first - 1, -1, -1):
            able = total + bounds[j] >= top.least
            at, total = at[able], total[able]
            if not len(at):
                break
            places, values, _ = walked[j]
            where = np.searchsorted(places, at + start)
            there = where < len(places)
            there[there] = places[where[there]] == at[there] + start
            total[there] += values[where[there]]
        able = total >= top.least
        if able.any():
            at = at[able] + start
            top.add(total[able], ids[at], nulls[at])
    return scored


def answers(segments: DataFrame, asked: list[tuple[str, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(key, id, score): the k best documents of each task for each query (key, word numbers)."""
    kind = segments.schema["ids"].dataType.elementType
    schema = StructType([StructField("key", StringType()), StructField("id", kind), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in asked]
        arrow = None
        for batch in batches:
            for row in range(batch.num_rows):
                given, n, words, lengths, places, tfs = (c[row].values for c in batch.columns)
                arrow = given.type
                nulls = given.is_null().to_numpy(zero_copy_only=False)
                ids = given.fill_null("" if pa.types.is_string(arrow) else 0).to_numpy(zero_copy_only=False)
                words, lengths, places = (x.to_numpy() for x in (words, lengths, places))
                tfs = tfs.to_numpy().astype(np.int64)
                if not len(words):
                    continue
                m = 50 + (50 * n.to_numpy() * n_docs) // n_words
                values = np.repeat(weights[words], lengths) * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[places]))
                starts = np.cumsum(lengths) - lengths
                largest = np.maximum.reduceat(values, starts)
                slot = {int(w): i for i, w in enumerate(words)}
                for (_, wanted), top in zip(asked, tops):
                    lists = []
                    for w in wanted.tolist():
                        i = slot.get(w)
                        if i is not None and largest[i] > 0:
                            a, b = starts[i], starts[i] + lengths[i]
                            lists.append((places[a:b], values[a:b], int(largest[i])))
                    if lists:
                        search(lists, ids, nulls, top)
        for (key, _), top in zip(asked, tops):
            if top.held is not None:
                scores, ids, nulls = top.held
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(ids)), pa.array(ids, arrow, mask=nulls), pa.array(scores)], names=schema.names)

    return segments.mapInArrow(run, schema)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item id, rank, document id, score): the k best documents of each row of ``items``, score above 0.

    N counts the documents with a word, L their words, n those of one document, df the documents of a word, tf its places in
    one. A word weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))); a document's m is 50 + 50 n N div L; its score sums
    w * (10^9 tf div (1000 tf + 20 m)) over the different words of the item. Equal scores go by id, null ids last.

    Null and empty texts have no words: such items have no answers. Every row of ``docs`` is ranked, repeated ids too; items
    of equal text are answered once and each row of them gets the answers. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).withColumn("key", F.sha2("text", 256)), "items")
    texts = asked.filter("text is not null").select("key", "text").dropDuplicates(["key"])
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-size // block_bytes)), []
    for block in range(blocks):
        own = [(r["key"], sorted(set(terms(r["text"])))) for r in texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()]
        vocabulary = sorted({w for _, words in own for w in words})
        numbers = {w: i for i, w in enumerate(vocabulary)}
        segments = index(docs, vocabulary, doc_id, text)
        sums = segments.agg(
            F.sum(F.size(F.filter("n", lambda x: x > 0))).alias("n_docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_words"),
        ).first()
        n_docs, n_words = int(sums["n_docs"] or 0), max(1, int(sums["n_words"] or 0))
        weights = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        holding = segments.select(F.explode(F.arrays_zip("words", "lengths")).alias("w")).groupBy("w.words").agg(F.sum("w.lengths").alias("df"))
        for word, df in holding.collect():  # at most a row per word of the block
            weights[word] = floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))
        queries = [(key, np.array([numbers[w] for w in words], dtype=np.int64)) for key, words in own if words]
        parts.append(answers(segments, queries, weights, n_docs, n_words, k).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # the best of each task, then of 64 groups of tasks, then of all
    order = [F.desc("score"), F.asc_nulls_last("id")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= k)
    found = stored(found.select("key", "rank", "id", "score"), "answers")
    return asked.join(found, "key").select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
