"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class times that of the token in its class. Both are softmaxes over the sum of weight
rows that the context picks by hash: the word before, the pair of words before, and the word before that alone (a skip). The
most frequent tokens have classes of their own and weights in them; the others fall into classes by their ending, where their
counts decide. Counts and gradient updates cover every training document; tasks train on their share and the changes are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.llm.tables import slices, stored

#: The token that ends a text; no word holds white space.
END = "\n"
END_BYTES = END.encode()
HEAD_CLASSES, WIDTH, TAIL_CLASSES = 16, 16, 16
HEAD, CLASSES = HEAD_CLASSES * WIDTH, HEAD_CLASSES + TAIL_CLASSES
#: Weight rows of each table; contexts are hashed into them.
BITS = 15
ROWS = 1 << BITS
FEATURES = 3
#: Words whose counts every task holds, and distinct words a task counts before it passes them on.
LEXICON, COUNTED = 100_000, 400_000
BATCH = 8192
#: Rows up to this number are added one by one; numpy sums longer runs in another order.
SHORT = 8
MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, the place of each word among them, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    found, lengths = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    at, blank = found.indices.to_numpy(), pc.index(found.dictionary, "").as_py()
    if blank >= 0:  # before the first and after the last white space of a text
        full = at != blank
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[full], minlength=len(lengths))
        at = at[full]
    return found.dictionary, at, lengths


def tail_class(word: bytes) -> int:
    """Class of a word that is not among the most frequent: by its last two letters and whether a sign follows them."""
    plain = word.rstrip(b".,;:!?\"')#%&*$")
    return HEAD_CLASSES + zlib.crc32(plain[-2:]) % (TAIL_CLASSES // 2) * 2 + (len(plain) < len(word))


@dataclass
class Lexicon:
    """The most frequent training tokens by falling count, and the totals; HEAD of them have weights of their own."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray = field(default_factory=lambda: np.full(CLASSES, 0.5))

    def __post_init__(self):
        self.place = {t: i for i, t in enumerate(self.tokens)}
        n = len(self.tokens)
        # The last entry of each stands for tokens that are not in the lexicon.
        self.kind = np.array([*(i // WIDTH if i < HEAD else tail_class(t) for i, t in enumerate(self.tokens)), 0], dtype=np.int32)
        self.hash = np.array([*(zlib.crc32(t) for t in self.tokens), 0], dtype=np.uint32)
        self.slot = np.where(np.arange(n + 1) < min(n, HEAD), np.arange(n + 1) % WIDTH, -1).astype(np.int32)

    def encode(self, texts: pa.Array):
        """Place in the lexicon (-1: not there), class, slot, hash and document of each token, ends included.

        Also the different words, and the place of each token among them (an end's is one past the last).
        """
        different, word, lengths = words(texts)
        document = np.repeat(np.arange(len(lengths)), lengths + 1)
        token = np.full(len(document), len(different), np.int32)
        inside = np.ones(len(document), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        token[inside] = word
        plain = [*different.cast(pa.binary()).to_numpy(zero_copy_only=False), END_BYTES]
        at = np.fromiter(map(self.place.get, plain, repeat(-1)), np.int64, len(plain))
        kind, slot, code = self.kind.take(at, mode="wrap"), self.slot.take(at, mode="wrap"), self.hash.take(at, mode="wrap")
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rare = [plain[i] for i in missing.tolist()]
            kind[missing] = [tail_class(w) for w in rare]
            code[missing] = np.fromiter(map(zlib.crc32, rare), np.uint32, len(rare))
        return at.take(token), kind.take(token), slot.take(token), code.take(token), document, different, token


def contexts(code: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Weight rows that the words before each token pick: a column per feature."""
    one, two = np.full_like(code, 1), np.full_like(code, 2)
    same = document[1:] == document[:-1]
    one[1:][same] = code[:-1][same]
    same = document[2:] == document[:-2]
    two[2:][same] = code[:-2][same]
    shift = np.uint32(32 - BITS)
    return np.stack([
        (one * MIX[0]) >> shift, ((one * MIX[1]) ^ (two * MIX[2])) * MIX[0] >> shift, ((two + np.uint32(7)) * MIX[3]) >> shift,
    ]).astype(np.int64).T


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row exp(z - max), in place, and its sum."""
    half = z.shape[1] // 2
    # numpy takes maxima of columns many at a time, those of short rows one by one.
    z -= np.ascontiguousarray(np.maximum(z[:, :half], z[:, half:]).T).max(axis=0)[:, None]
    np.exp(z, out=z)
    return z, z.sum(axis=1, keepdims=True)


def _run_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order[first : first + size]`` of ``g``.

    The same additions as in ``np.add.reduceat``, which makes a call per run and column, but short runs side by side.
    """
    total = g.take(order.take(first), axis=0)
    run = np.flatnonzero(size > 1)
    run = run[np.argsort(-size[run], kind="stable")]
    first, size = first[run], size[run]
    longer = np.searchsorted(-size, -np.arange(SHORT + 1), side="left")  # runs with more rows than 0, 1, ...
    long = longer[SHORT]
    if long:
        ends = np.cumsum(size[:long])
        starts = ends - size[:long]
        inside = np.arange(ends[-1]) + np.repeat(first[:long] - starts, size[:long])
        total[run[:long]] = np.add.reduceat(g.take(order.take(inside), axis=0), starts, axis=0)
    if len(run) > long:
        rest = g.take(order.take(first[long:] + 1), axis=0)
        for r in range(2, SHORT):
            if longer[r] > long:
                rest[: longer[r] - long] += g.take(order.take(first[long : longer[r]] + r), axis=0)
        total[run[long:]] += rest
    return total


@dataclass
class Weights:
    """``outer``: rows for the classes; ``inner``: rows for the slots of a class; and what both add to without a context."""

    outer: np.ndarray
    inner: np.ndarray
    outer_bias: np.ndarray
    inner_bias: np.ndarray

    @staticmethod
    def start(lexicon: Lexicon) -> Weights:
        counts = np.full(HEAD, 1e-3)
        n = min(HEAD, len(lexicon.tokens))
        counts[:n] = lexicon.counts[:n] + 0.5
        inner = counts.reshape(HEAD_CLASSES, WIDTH)
        outer = np.r_[inner.sum(axis=1), lexicon.mass[HEAD_CLASSES:]]
        return Weights(
            np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WIDTH), np.float32),
            np.log(outer / outer.sum()).astype(np.float32), np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32),
        )

    def inner_rows(self, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        mixed = (rows.astype(np.uint32) * MIX[4] + kind.astype(np.uint32)[:, None]) * MIX[1]
        return (mixed >> np.uint32(32 - BITS)).astype(np.int64)

    def _outer(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.outer.take(rows[:, 0], axis=0)
        for f in range(1, FEATURES):
            z += self.outer.take(rows[:, f], axis=0)
        z += self.outer_bias
        return _exponentials(z)

    def _inner(self, rows: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.inner.take(rows[:, 0], axis=0)
        for f in range(1, FEATURES):
            z += self.inner.take(rows[:, f], axis=0)
        z += self.inner_bias.take(kind, axis=0)
        return _exponentials(z)

    def outer_probabilities(self, rows: np.ndarray) -> np.ndarray:
        z, total = self._outer(rows)
        z /= total
        return z

    def inner_probabilities(self, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        z, total = self._inner(rows, kind)
        z /= total
        return z

    def log10(self, kind: np.ndarray, slot: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class, and of a head token in its class."""
        out = np.empty(len(kind))
        for a in range(0, len(kind), BATCH):
            k, s, r = kind[a : a + BATCH], slot[a : a + BATCH], rows[a : a + BATCH]
            z, total = self._outer(r)
            p = z[np.arange(len(k)), k] / total[:, 0]
            head = np.flatnonzero(s >= 0)
            if len(head):
                z, total = self._inner(self.inner_rows(r[head], k[head]), k[head])
                p[head] *= z[np.arange(len(head)), s[head]] / total[:, 0]
            out[a : a + BATCH] = np.log10(np.maximum(p, 1e-30))
        return out


class Trainer:
    """Gradient steps on one task's share, each row with a step that shrinks as its squared gradients add up."""

    def __init__(self, weights: Weights, rate: float):
        self.w = Weights(weights.outer.copy(), weights.inner.copy(), weights.outer_bias, weights.inner_bias)
        self.rate = rate
        self.squares = {"outer": np.full(ROWS, 1e-4, np.float32), "inner": np.full(ROWS, 1e-4, np.float32)}

    def _descend(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        table, squares = getattr(self.w, name), self.squares[name]
        for f in range(FEATURES):
            row = rows[:, f].astype(np.uint16)  # a radix sort
            order = np.argsort(row, kind="stable")
            ordered = row[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            total = _run_sums(g, order, first, np.diff(first, append=len(row)))
            at = ordered[first].astype(np.int64)
            square = squares.take(at)
            square += np.einsum("ij,ij->i", total, total)
            squares[at] = square
            total *= (self.rate / np.sqrt(square))[:, None]
            np.subtract(table.take(at, axis=0), total, out=total)
            table[at] = total

    def step(self, kind: np.ndarray, slot: np.ndarray, rows: np.ndarray) -> None:
        g = self.w.outer_probabilities(rows)
        g[np.arange(len(kind)), kind] -= 1
        self._descend("outer", rows, g)
        head = np.flatnonzero(slot >= 0)
        if len(head):
            inner = self.w.inner_rows(rows[head], kind[head])
            g = self.w.inner_probabilities(inner, kind[head])
            g[np.arange(len(head)), slot[head]] -= 1
            self._descend("inner", inner, g)


def counted(docs: DataFrame, text: str, most: int = COUNTED) -> DataFrame:
    """Stored (token, n) over all texts, ends included; a task passes its counts on when more than ``most`` words differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, ends = [], 0, 0

        def merged():
            return pa.Table.from_batches(found).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in slices(batches):
            different, at, _ = words(batch.column(0))
            times = np.bincount(at, minlength=len(different))
            used = np.flatnonzero(times)
            found.append(pa.RecordBatch.from_arrays([different.take(pa.array(used)), pa.array(times[used])], names=["token", "n"]))
            held, ends = held + len(used), ends + batch.num_rows
            if held > 2 * most:
                few = merged()
                if few.num_rows > most:
                    yield from few.to_batches()
                    few = few.slice(0, 0)
                found, held = few.combine_chunks().to_batches(), few.num_rows
        if found:
            yield from merged().to_batches()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends])], names=["token", "n"])

    each = docs.select(text).mapInArrow(run, "token string, n long")
    return stored(each.groupBy("token").agg(F.sum("n").alias("n")), "token-counts")


def lexicon(counts: DataFrame) -> Lexicon:
    """The LEXICON most frequent tokens (a fixed bound on what is sent to all tasks) and totals over all tokens."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(LEXICON).toArrow()
    found = Lexicon([t.encode() for t in top["token"].to_pylist()], top["n"].to_numpy().astype(np.int64), total, distinct)
    head = set(found.tokens[:HEAD])

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(CLASSES)
        for batch in batches:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t.encode()
                if t not in head:
                    mass[tail_class(t)] += n + 0.5
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(mass)], names=["kind", "mass"])

    for row in counts.mapInArrow(masses, "kind int, mass double").groupBy("kind").agg(F.sum("mass").alias("mass")).collect():
        found.mass[row["kind"]] += row["mass"]
    return found


def train(docs: DataFrame, text: str, found: Lexicon, rounds: int = 2, rate: float = 0.15) -> Weights:
    """Weights after ``rounds`` rounds; each takes the documents whose text hash falls to it, so all take part once.

    A round's tasks start from the same weights and send how their rows changed; a row moves by the mean over tasks that
    changed it. What the driver gets is bounded by the size of the two tables.
    """
    weights, spark = Weights.start(found), docs.sparkSession
    columns = [f"w{i}" for i in range(CLASSES)]
    shared = spark.sparkContext.broadcast(found)
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(held.value, rate)
            for batch in slices(batches):
                _, kind, slot, code, document, _, _ = shared.value.encode(batch.column(0))
                rows = contexts(code, document)
                for a in range(0, len(kind), BATCH):
                    trainer.step(kind[a : a + BATCH], slot[a : a + BATCH], rows[a : a + BATCH])
            for number, name in enumerate(("outer", "inner")):
                change = getattr(trainer.w, name) - getattr(held.value, name)
                at = np.flatnonzero(change.any(axis=1))
                wide = np.zeros((len(at), CLASSES), np.float32)
                wide[:, : change.shape[1]] = change[at]
                yield pa.RecordBatch.from_arrays([pa.array(at + number * ROWS), *[pa.array(c) for c in wide.T]], names=["row", *columns])

        part = docs.select(text).filter(F.pmod(F.xxhash64(F.col(text)), F.lit(rounds)) == turn)
        moved = part.mapInArrow(run, "row long, " + ", ".join(f"{c} float" for c in columns))
        moved = moved.groupBy("row").agg(*[F.avg(c).cast("float").alias(c) for c in columns]).toArrow()
        at = moved["row"].to_numpy()
        change = np.stack([moved[c].to_numpy() for c in columns], axis=1) if len(at) else np.zeros((0, CLASSES), np.float32)
        outer, inner = at < ROWS, at >= ROWS
        weights.outer[at[outer]] += change[outer]
        weights.inner[at[inner] - ROWS] += change[inner][:, :WIDTH]
        held.unpersist()
    return weights


def scores(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, training (whether the model learned from it), n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the log10 probability by smoothed counts, ``score`` that by the model. A null or empty text is its end
    token alone; a null condition counts as training. Repeated rows are counted and scored each; without training rows all
    tokens are unknown. Words outside the lexicon get their counts by a join, so no task needs the whole vocabulary.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    learned = rows.filter("training")
    counts = counted(learned, "text")
    found = lexicon(counts)
    spark = docs.sparkSession
    weights = train(learned, "text", found, **options)
    shared, held = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(weights)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value, held.value
        base_of = np.r_[np.log10(lex.counts + 0.5), 0.0]
        mass = np.log10(lex.mass)
        for batch in slices(batches):
            at, kinds, slot, code, document, different, token = lex.encode(batch.column(1))
            n = batch.num_rows
            local = model.log10(kinds, slot, contexts(code, document))
            base = base_of[at]
            tail = slot < 0
            local[tail] += base[tail] - mass[kinds[tail]]
            sums = lambda x: np.bincount(document, x, minlength=n)
            missing = np.flatnonzero(at < 0)
            seen, times = np.unique(document[missing] * (len(different) + 1) + token[missing], return_counts=True)
            owner, rare = np.divmod(seen, len(different) + 1)
            row = batch.column(3)
            none = lambda t: pa.nulls(len(seen), t)
            yield pa.RecordBatch.from_arrays([
                row, batch.column(0), batch.column(2), pa.array(sums(np.ones(len(at))).astype(np.int64)),
                pa.array(sums(at >= 0).astype(np.int64)), pa.array(sums(base)), pa.array(sums(local)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
            ], names=names)
            if len(seen):
                yield pa.RecordBatch.from_arrays([
                    row.take(pa.array(owner)), none(batch.schema.field(0).type), none(pa.bool_()), none(pa.int64()), none(pa.int64()),
                    none(pa.float64()), none(pa.float64()), pa.concat_arrays([different, pa.array([END])]).take(pa.array(rare)), pa.array(times),
                ], names=names)

    names = ["row", "doc_id", "training", "n_tokens", "n_known", "base", "score", "token", "times"]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = stored(numbered.mapInArrow(
        run, f"row long, doc_id {kind}, training boolean, n_tokens long, n_known long, base double, score double, token string, times long"
    ), "scored-parts")
    rare = parts.filter("token is not null").select("row", "token", "times").join(counts, "token", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    norm = float(np.log10(found.total + 0.5 * (found.distinct + 1)))
    more = F.coalesce("rare", F.lit(0.0))
    return parts.filter("n_tokens is not null").join(rare, "row", "left").select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(found.total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
