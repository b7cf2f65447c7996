"""Packing of token sequences: documents become pieces, and groups of pieces are packed by best fit and swap-based local search.

Tokens come from a tokenizer that drops white space and never joins what white space parts, so a text's ids are those of its
white-space-parted chunks one after the other. Chunks repeat, so tasks keep a bounded table of their ids.
"""

from __future__ import annotations

import gc
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tunegauge.llm.tables import slices, stored

#: Runs of ASCII punctuation, and what lies between. The apostrophe is in neither, as it may start a token with letters.
SPLIT = re.compile(r"[!-&(-/:-@\[-`{-~]+|[^!-&(-/:-@\[-`{-~]+")
PUNCTUATION = frozenset(string.punctuation) - {"'"}
CLOSING = bytes(ord(c) for c in PUNCTUATION)
_coders: dict[str, Coder] = {}


def letters(text: str) -> bool:
    """Whether a text is letters and digits that normalizing and lowering leave so, and no sign can join them."""
    return text.isalnum() and (text.isascii() or not any(unicodedata.combining(c) for c in unicodedata.normalize("NFC", text).lower()))


class Coder:
    """Token ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, remembered: int = 1_000_000):
        #: Chunks whose ids a task remembers, and half as many parts of chunks; beyond that it starts anew.
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        #: For words of a-z, which normalizing leaves as they are: the same merges without the steps before them.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def of(path: str, remembered: int) -> Coder:
        if path not in _coders:
            _coders[path] = Coder(path)
        _coders[path].remembered = remembered
        return _coders[path]

    def _split(self, chunk: bytes) -> tuple[str, ...]:
        """Parts that the tokenizer never joins; the chunk itself where that isn't certain."""
        low = chunk.lower()
        body = low.rstrip(CLOSING)
        text = body.decode("utf-8", "replace")
        if letters(text):
            return (text,) if len(body) == len(low) else (text, low[len(body) :].decode())
        if b"'" in chunk or b"<|" in chunk:
            return (chunk.decode("utf-8", "replace"),)
        text = low.decode("utf-8", "replace")
        parts = SPLIT.findall(text)
        return tuple(parts) if all(p[0] in PUNCTUATION or letters(p) for p in parts) else (text,)

    def _encode(self, parts: list[str], bare: bool = False) -> list[np.ndarray]:
        found = (self.bare if bare else self.tokenizer).encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(f.ids, dtype="<u4") for f in found]

    def _learn(self, parts: list[str]) -> None:
        """Words of letters go through the tokenizer as one text, which their last tokens part again."""
        words, plain, others = [], [], []
        for p in parts:
            (others if not p.isalpha() else plain if p.isascii() and p.islower() else words).append(p)
        for bare, some in [(b, ws[a : a + 1024]) for b, ws in ((False, words), (True, plain)) for a in range(0, len(ws), 1024)]:
            ids = self._encode([" ".join(some)], bare)[0]
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                self.parts.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                self.parts.update((p, f.tobytes()) for p, f in zip(some, self._encode(some)))
        for start in range(0, len(others), 256):
            some = others[start : start + 256]
            self.parts.update((p, f.tobytes()) for p, f in zip(some, self._encode(some)))

    def _new(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        split = [self._split(c) for c in chunks]
        parts = {p for ps in split for p in ps}
        missing = parts.difference(self.parts)
        if len(self.parts) + len(missing) > self.remembered // 2:
            self.parts.clear()
            missing = parts
        self._learn(list(missing))
        known = self.parts
        return dict(zip(chunks, [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in split]))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. Some texts at a time cost less than one: a chunk they share is looked up once."""
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        needed = set().union(*split)
        known = self.chunks
        found = needed & known.keys()
        local = dict(zip(found, map(known.__getitem__, found)))
        if len(found) < len(needed):
            new = self._new(needed - found)
            if len(known) + len(new) > self.remembered:
                known.clear()
            known.update(new)
            local.update(new)
        return [b"".join(map(local.__getitem__, chunks)) for chunks in split]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, remembered: int = 1_000_000, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and then ``end``, cut into ``capacity`` tokens if longer.

    A null or empty text is the one token ``end``. Repeated rows give pieces of their own.
    """
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    tail = np.array([end], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(coder.ids(batch.column(1).to_pylist())):
            data = ids + tail
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                for column, value in ((row, i), (piece, k), (start, at // 4), (length, len(part) // 4), (crc, zlib.crc32(part))):
                    column.append(value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(tokenizer, remembered)
        gc.disable()  # there are no cycles, and the collector would walk the remembered chunks again and again
        try:
            for batch in slices(batches, 1024):
                yield cut(batch, coder)
        finally:
            gc.enable()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of items, found by the room that is left in them."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.rooms = 0

    def _set(self, b: int, room: int) -> None:
        old = self.by_room[self.room[b]]
        old.discard(b)
        if not old:
            self.rooms &= ~(1 << self.room[b])
        self.room[b] = room
        if self.items[b]:
            self.by_room[room].add(b)
            self.rooms |= 1 << room

    def open(self) -> list[int]:
        """The bins with items and room left."""
        return [b for room, found in self.by_room.items() if room > 0 for b in found]

    def best(self, length: int, other_than: int = -1) -> int | None:
        """The bin with the least room that still holds ``length``."""
        rooms = self.rooms >> length
        shift = length
        while rooms:
            step = (rooms & -rooms).bit_length() - 1
            room = shift + step
            for b in self.by_room[room]:
                if b != other_than:
                    return b
            rooms >>= step + 1
            shift = room + 1
        return None

    def put(self, item: int, b: int | None) -> None:
        if b is None:
            b = len(self.items)
            self.items.append([])
            self.room.append(self.capacity)
        self.items[b].append(item)
        self._set(b, self.room[b] - self.lengths[item])

    def drop(self, item: int, b: int) -> None:
        self.items[b].remove(item)
        self._set(b, self.room[b] + self.lengths[item])


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Best fit from long to short, then local search that empties the least filled bins.

    Every bin is tried, again and again until a whole round finds no exchange, or until no fewer bins are possible. Every
    exchange moves length from the emptier to the fuller bin, so the sum of squared fills grows and the search ends.
    """
    bins = Bins(lengths, capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins.put(item, bins.best(lengths[item]))
    least = -(-sum(lengths) // capacity)
    count = len(bins.items)
    moved = count > least
    table = _Table(bins) if moved else None
    while count > least and moved:
        moved = False
        for b in sorted(bins.open(), key=lambda b: (-bins.room[b], b)):
            while bins.items[b] and _step(bins, b, table):
                moved = True
            if not bins.items[b]:
                count -= 1
                if count == least:
                    break
    return [b for b in bins.items if b]


def _all_pairs(bins: Bins, b: int) -> np.ndarray:
    """Rows (item, item, bin) for every pair of lengths in a bin: two items stand for all of one length.

    The lengths of a bin of 2048 tokens add up to no more, so it has at most 63 different ones.
    """
    seen: dict[int, int] = defaultdict(int)
    kept = []
    for item in bins.items[b]:
        seen[bins.lengths[item]] += 1
        if seen[bins.lengths[item]] <= 2:
            kept.append(item)
    items = np.array(kept, dtype=np.int64)
    x, y = np.triu_indices(len(items), 1)
    return np.column_stack([items[x], items[y], np.full(len(x), b, dtype=np.int64)])


class _Table:
    """Bins with room left, by the lengths and the sums of two lengths in them, and by their room. Changed bins are put anew."""

    def __init__(self, bins: Bins):
        self.bins = bins
        #: For single items, then for pairs: the bins by (length, room), and by length the rooms there are, as bits.
        self.at: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
        self.rooms: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
        self.own: dict[int, tuple[int, list[set[int]]]] = {}
        for b in bins.open():
            self.put(b)

    @property
    def pairs(self) -> np.ndarray:
        """Rows (item, item, bin) for every pair of lengths of every bin."""
        return np.concatenate([np.zeros((0, 3), dtype=np.int64), *(_all_pairs(self.bins, b) for b in self.own)])

    def _sums(self, b: int) -> list[set[int]]:
        lengths = self.bins.lengths
        seen = Counter(lengths[i] for i in self.bins.items[b])
        different = list(seen)
        sums = {x + y for k, x in enumerate(different) for y in different[:k]}
        return [set(different), sums.union(2 * x for x, n in seen.items() if n > 1)]

    def drop(self, b: int) -> None:
        room, sums = self.own.pop(b, (0, []))
        for at, rooms, own in zip(self.at, self.rooms, sums):
            for length in own:
                found = at[length, room]
                found.discard(b)
                if not found:
                    del at[length, room]
                    rooms[length] &= ~(1 << room)

    def put(self, b: int) -> None:
        self.drop(b)
        room = self.bins.room[b]
        if not self.bins.items[b] or room <= 0:
            return
        self.own[b] = room, self._sums(b)
        for at, rooms, own in zip(self.at, self.rooms, self.own[b][1]):
            for length in own:
                at[length, room].add(b)
                rooms[length] |= 1 << room

    def best(self, size: int, most: int, count: int) -> tuple[int, list[int]] | None:
        """A bin, with ``most`` room at most, and ``count`` items of it that make place for ``size``: those that fill it most."""
        at, rooms = self.at[count - 1], self.rooms[count - 1]
        for gain in range(min(most, size), 0, -1):
            fits = rooms.get(size - gain, 0) >> gain & ((1 << (most - gain + 1)) - 1)
            if fits:
                length, room = size - gain, gain + (fits & -fits).bit_length() - 1
                to = next(iter(at[length, room]))
                return to, self._items(to, length, count)
        return None

    def _items(self, b: int, length: int, count: int) -> list[int]:
        lengths, seen = self.bins.lengths, {}
        for i in self.bins.items[b]:
            if count == 1 and lengths[i] == length:
                return [i]
            if count == 2 and length - lengths[i] in seen:
                return [seen[length - lengths[i]], i]
            seen.setdefault(lengths[i], i)
        raise KeyError(length)


def _step(bins: Bins, b: int, table: _Table) -> bool:
    """One move, one-for-one or two-for-one exchange that takes length out of bin ``b`` into a fuller one."""
    found = None
    table.drop(b)  # a bin makes no exchange with itself
    items = sorted(bins.items[b], key=lambda i: -bins.lengths[i])
    for item in items:
        to = bins.best(bins.lengths[item], b)
        if to is not None and bins.room[to] <= bins.room[b]:
            found = item, to, []
            break
    tried = set()
    for item in items if found is None else []:
        size = bins.lengths[item]
        if size not in tried:
            tried.add(size)
            best = table.best(size, bins.room[b], 1) or table.best(size, bins.room[b], 2)
            if best is not None:
                found = item, *best
                break
    if found is not None:
        item, to, back = found
        bins.drop(item, b)
        for x in back:
            bins.drop(x, to)
        bins.put(item, to)
        for x in back:
            bins.put(x, b)
        table.put(to)
    table.put(b)
    return found is not None


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, group_rows: int = 25_000, remembered: int = 1_000_000,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` tokens, pieces stand side by side.

    Pieces are dealt by row number to groups of about ``group_rows``, each packed by one task; the last bin of each group is
    what this costs. ``remembered`` bounds what a task keeps of the tokenizer's work (some 150 bytes each) and changes no
    result. An empty table gives no rows.
    """
    rows = pieces(docs, tokenizer, capacity, end, remembered, doc_id, text).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "pieces")
    groups = max(1, -(-rows.count() // group_rows))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))

    def run(batch: pa.Table) -> pa.Table:
        lengths = batch["length"].to_pylist()
        group = batch["_group"][0].as_py()
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for number, items in enumerate(pack(lengths, capacity)):
            done = 0
            for i in items:
                sequence[i], offset[i] = (group << 32) + number, done
                done += lengths[i]
        kept = batch.drop_columns(["_at", "_group"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.groupBy("_group").applyInArrow(run, schema)
