"""Toxicity by character n-grams: presence features scaled by naive Bayes log-count ratios under a linear classifier.

Both are fitted on a bounded sample of labelled documents (``most`` in ``labelled``). Ratios are counted in Spark, and only n-grams
whose ratio stands out stay features, which leaves little for the one task that fits the weights. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tunegauge.llm.tables import slices, stored

#: n-grams are hashed into this many buckets.
BUCKETS = 1 << 20
LENGTHS = (4, 5, 6)
MIX, STEP = np.uint32(0x9E3779B1), np.uint32(0x01000193)
#: Characters of a long text that are hashed at a time; pieces overlap by the longest n-gram.
PIECE = 1 << 18


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams, repeats included; case is folded and a run of white space is one blank."""
    plain = " " + " ".join((text or "").lower().split()) + " "
    for start in range(0, len(plain), PIECE):
        part = plain[start : start + PIECE + max(LENGTHS) - 1]
        part = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        value = part
        for n in range(2, max(LENGTHS) + 1):
            if len(part) < n:
                break
            value = value[: len(part) - n + 1] * STEP + part[n - 1 :]
            if n in LENGTHS:
                yield ((value + np.uint32(n)) * MIX >> np.uint32(12)).view(np.int32)


@dataclass
class Model:
    """``weights``: log-count ratio times linear weight of each bucket; most are zero."""

    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.used = self.weights != 0

    def score(self, text: str | None) -> float:
        found = [at[self.used[at]] for at in ngrams(text)]
        z = self.bias + (float(self.weights[np.unique(np.concatenate(found))].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def ratios(rows: DataFrame, least: float, deviations: float) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket over rows (text, label); zero where it doesn't stand out.

    It stands out if it is ``least`` or more and as many standard deviations away from zero, on either side.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
        for batch in slices(batches):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in ngrams(t):
                    seen[at] = True
                at = np.flatnonzero(seen)
                n[y, at] += 1
                seen[at] = False
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "clean", "toxic"]
        )

    found = rows.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket")
    found = found.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    total = rows.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
    n = np.vstack([found["clean"].to_numpy(), found["toxic"].to_numpy()]) + 1.0
    ratio = np.log(n[1] / (total[1] + 2)) - np.log(n[0] / (total[0] + 2))
    ratio[np.abs(ratio) < np.maximum(least, deviations * np.sqrt(1 / n[0] + 1 / n[1]))] = 0
    out = np.zeros(BUCKETS)
    out[found["bucket"].to_numpy()] = ratio
    return out


def fit(rows: DataFrame, sample_rows: int = 20_000, least: float = 0.0, deviations: float = 4.0, passes: int = 30) -> Model:
    """A model from rows (text, label 0 or 1). Without rows of both kinds every score is 0.5.

    n-grams whose log-count ratio is below ``least`` or within ``deviations`` standard deviations of zero are left out. The linear part is
    fitted on about ``sample_rows`` rows, chosen by a hash of the text; a task gets only their few chosen n-grams.
    """
    rows = rows.filter(F.col("label").isin(0, 1)).select("text", F.col("label").cast("int").alias("label"))
    total = rows.groupBy("label").count().collect()
    if len(total) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    ratio = ratios(rows, least, deviations)
    share = min(1.0, sample_rows / sum(r["count"] for r in total))
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    held = rows.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    used = rows.sparkSession.sparkContext.broadcast(ratio != 0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(np.concatenate([at[used.value[at]] for at in ngrams(t)] or [[]])) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few large arrays: a worker gives their memory back when the weights are found
        labels, sizes, found = [], [], []
        for batch in batches:
            labels.append(batch.column(0).to_numpy().astype(float))
            sizes.append(np.diff(batch.column(1).offsets.to_numpy()))
            found.append(batch.column(1).flatten().to_numpy())
        labels, sizes, found = (np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in (labels, sizes, found))
        weights, bias = gradient_steps(labels, found, np.r_[0, np.cumsum(sizes)], held.value, passes)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[bias, weights[at]])], names=["bucket", "weight"])

    found = chosen.mapInArrow(hashed, "label int, at array<int>").repartition(1).mapInArrow(train, "bucket int, weight double").toArrow()
    bucket, weight = found["bucket"].to_numpy(), found["weight"].to_numpy()
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return Model((weights * ratio).astype(np.float32), float(weight[bucket < 0].sum()))


def gradient_steps(y: np.ndarray, found: np.ndarray, starts: np.ndarray, ratio: np.ndarray, passes: int) -> tuple[np.ndarray, float]:
    """Normalized gradient steps on the logistic loss, row by row, over presence features times their ratio.

    Row i has the features ``found[starts[i] : starts[i + 1]]``.
    """
    w, b, rng, ratio = np.zeros(BUCKETS), -2.0, np.random.default_rng(0), ratio.astype(float)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            at = found[starts[i] : starts[i + 1]]
            x = ratio[at]
            size = 1 + x @ x
            step = 1 / (1 + np.exp(-np.clip(x @ w[at] + b, -30, 30))) - y[i]
            w[at] -= 0.4 * step * x / size + 5e-5 * w[at]
            b -= 0.05 * step / size
    return w, b


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) as column ``into``, which replaces one of that name. Null and empty texts get one too."""
    names = [c for c in docs.columns if c != into]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([held.value.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", most: int = 40_000) -> DataFrame:
    """Stored (text, label) of about ``most`` labelled documents, chosen by a hash of the id, all if there are fewer.

    A repeated label row counts once, ids with two labels and null ids not at all. As the choice is bounded, it is sent to the
    tasks that read the documents, and no text is shuffled.
    """
    once = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id)
    once = stored(once.agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other").select(doc_id, "label"), "labels")
    share = min(1.0, most / max(1, once.count()))
    chosen = once.filter(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < share * 1_000_000)
    return stored(docs.select(doc_id, "text").join(F.broadcast(chosen), doc_id).select("text", "label"), "labelled")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``, by a model that learned from the labelled rows not held out.

    Input columns of these names are replaced. Repeated documents get a row each; an empty table gives no rows.
    """
    model = fit(labelled(docs.filter(~held_out()), labels))
    return score(docs, model).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= least).cast("int"))
