"""Personal data: patterns for e-mail, IP, card and phone, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the tokens of a document that hold a digit or an at sign; other tokens count as observed to be no
personal data. Neighbouring nodes are linked, and so is each node with the next one that repeats it or shares its ending
digits, however far away. What a pattern found is observed, and a node is also linked with the last and the next such node that it
repeats. Loopy message passing runs along the links until messages rest, so that a document's mentions of the same thing agree. Node and link weights are learned piece by piece from pattern labels on a bounded
sample of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tunegauge.llm.tables import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Patterns in a form that takes linear time; tests hold them against the plain ones.
MARK = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
NOISE = re.compile(r"[^a-z0-9@]+")
SHAPES = 1 << 12
STEP, TOLERANCE, CERTAIN = 0.7, 1e-4, 0.9
#: Rounds after which steps shrink, so that messages that swing come to rest too.
SETTLE = 50


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, by start and then kind as listed."""
    if not MARK.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
            found.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def shape(token: str) -> int:
    """Bucket of a token's outline: runs of letters as a, digits as 9 with the length of long runs, other characters as they are.

    A card number's check digit shows too.
    """
    out, run = [], 0
    for c in token[:200]:
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if out and out[-1] == kind and kind in "9a":
            run += 1
            continue
        if out and out[-1] == "9" and run > 3:
            out.append(str(min(run, 20)))
        out.append(kind)
        run = 1
    if out and out[-1] == "9" and run > 3:
        out.append(str(min(run, 20)))
    digits = "".join(c for c in token if "0" <= c <= "9") if len(token) <= 40 else ""
    if 12 <= len(digits) <= 19 and luhn(digits):
        out.append("L")
    return int.from_bytes(hashlib.blake2b("".join(out).strip(".,;:!?#$%&*\"'()|").encode("utf-8", "replace"), digest_size=4).digest(), "little") % SHAPES


@dataclass
class Nodes:
    """Tokens of some documents as one graph. ``links``: rows of (node, node, kind), kind 0 for neighbours, 1 for repeats, 2 for
    repeats of what a pattern found beyond the node before; these have the potential of kind 1 and are not learned from."""

    document: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    seen: np.ndarray
    links: np.ndarray


def graph(texts: list[str], spans: list[list[tuple[int, int, str]]]) -> Nodes:
    document, start, end, features, seen, links = [], [], [], [], [], []
    for d, (text, found) in enumerate(zip(texts, spans)):
        first, first_link, last_end, at = len(document), len(links), -9, 0
        last: dict[str, int] = {}
        keyed: list[set[str]] = []
        tokens = [m.span() for m in TOKEN.finditer(text)] if MARK.search(text) else []
        outlines = [shape(text[a:b]) for a, b in tokens]
        for i, (a, b) in enumerate(tokens):
            node = first + i
            while at < len(found) and found[at][1] <= a:
                at += 1
            label = next((KINDS.index(k) + 1 for s, e, k in found[at : at + 8] if s < b and e > a), 0)
            near = i > 0 and a - last_end <= 2
            after = i + 1 < len(tokens) and tokens[i + 1][0] - b <= 2
            document.append(d)
            start.append(a)
            end.append(b)
            seen.append(label)
            features.append((outlines[i], SHAPES + (outlines[i - 1] if near else 0), 2 * SHAPES + (outlines[i + 1] if after else 0)))
            if near:
                links.append((node - 1, node, 0))
            plain = NOISE.sub("", text[a:b].lower())
            digits = "".join(c for c in plain if c.isdigit())
            keys = {"=" + plain} if len(plain) >= 4 else set()
            if "@" in plain and len(plain.partition("@")[0]) >= 3:
                keys.add("@" + plain.partition("@")[0])
            if len(digits) >= 7:
                keys.add("#" + digits[-7:])
            linked = {last[k] for k in keys if k in last}
            links += [(other, node, 1) for other in linked]
            last.update(dict.fromkeys(keys, node))
            keyed.append(keys)
            last_end = b
        direct = {(other, node) for other, node, kind in links[first_link:] if kind == 1}
        for step in (1, -1):
            known: dict[str, int] = {}
            for i in range(len(keyed))[::step]:
                node, keys = first + i, keyed[i]
                if seen[node]:
                    known.update(dict.fromkeys(keys, node))
                    continue
                for other in {known[k] for k in keys if k in known}:
                    pair = (min(node, other), max(node, other))
                    if pair not in direct:
                        direct.add(pair)
                        links.append((*pair, 2))
    whole = lambda x, *s: np.array(x, dtype=np.int64).reshape(*s)
    return Nodes(whole(document, -1), whole(start, -1), whole(end, -1), whole(features, -1, 3), whole(seen, -1), whole(links, -1, 3))


@dataclass
class Field:
    """``node``: a weight per feature and label; ``link``: a log potential per kind of link and pair of labels."""

    node: np.ndarray
    bias: np.ndarray
    link: np.ndarray

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities by sum-product messages, sent along all links at once until none changes by more than a tolerance."""
        score = self.node[nodes.features].sum(axis=1) + self.bias
        fixed = nodes.seen > 0
        score[fixed] = -12.0
        score[fixed, nodes.seen[fixed]] = 12.0
        if not len(nodes.links):
            return _softmax(score)
        a, b, kind = nodes.links.T
        kind = np.minimum(kind, 1)
        source, target = np.r_[a, b], np.r_[b, a]
        potential = self.link[np.r_[kind, kind]]
        potential[len(a) :] = potential[len(a) :].transpose(0, 2, 1)
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        messages, incoming = np.zeros((len(source), len(LABELS))), np.zeros_like(score)
        free = ~fixed[target]  # what was observed sends but doesn't listen
        live, rounds, step = np.flatnonzero(free), 0, STEP
        while len(live):
            belief = (score + incoming)[source[live]] - messages[back[live]]
            joint = belief[:, :, None] + potential[live]
            top = joint.max(axis=1, keepdims=True)
            sent = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]
            sent -= sent.max(axis=1, keepdims=True)
            change = step * (sent - messages[live])
            messages[live] += change
            np.add.at(incoming, target[live], change)
            moved = live[np.abs(change).max(axis=1) > TOLERANCE]
            awake = np.zeros(len(score), dtype=bool)
            awake[target[moved]] = True
            again = awake[source]
            again[moved] = True
            live, rounds = np.flatnonzero(again & free), rounds + 1
            step *= 0.9 if rounds > SETTLE else 1.0
        return _softmax(score + incoming)

    def spans(self, texts: list[str], found: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
        """The given spans and those of tokens whose label is certain enough and that no given span touches, in order."""
        nodes = graph(texts, found)
        out = [list(f) for f in found]
        if len(nodes.start):
            p = self.marginals(nodes)
            label, last_own = p.argmax(axis=1), None
            for n in np.flatnonzero((label > 0) & (nodes.seen == 0) & (p.max(axis=1) >= CERTAIN)):
                a, b, text = int(nodes.start[n]), int(nodes.end[n]), texts[nodes.document[n]]
                while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
                    b -= 1
                while a < b and not (text[a].isalnum() or text[a] in "+("):
                    a += 1
                if a >= b:
                    continue
                own, kind = out[nodes.document[n]], KINDS[label[n] - 1]
                if own is last_own and own[-1][2] == kind and a - own[-1][1] <= 2:
                    a = own.pop()[0]
                own.append((a, b, kind))
                last_own = own
        return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for x in out]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def learn(nodes: Nodes, steps: int = 150) -> Field:
    """Piecewise training: a multinomial logistic model for nodes, smoothed log ratios of label pairs for links.

    A repeat of a labelled token takes its label with the strength of the pairs seen, of which a few agreeing pairs are assumed.
    """
    count = len(LABELS)
    weights, bias = np.zeros((3 * SHAPES, count)), np.zeros(count)
    if len(nodes.seen):
        wanted = np.eye(count)[nodes.seen]
        rate = 2.0 / (np.bincount(nodes.features.ravel(), minlength=3 * SHAPES) + 1)[:, None]
        for _ in range(steps):
            g = _softmax(weights[nodes.features].sum(axis=1) + bias) - wanted
            total = np.zeros_like(weights)
            for f in range(3):
                np.add.at(total, nodes.features[:, f], g)
            weights -= rate * total + 0.002 * weights
            bias -= g.mean(axis=0)
    link = np.zeros((2, count, count))
    share = np.bincount(nodes.seen, minlength=count) + 1.0
    share /= share.sum()
    for kind in (0, 1):
        pairs = nodes.links[nodes.links[:, 2] == kind] if len(nodes.links) else np.zeros((0, 3), dtype=np.int64)
        seen = np.outer(share, share) * 4 + (3 * np.eye(count) if kind else 0)
        np.add.at(seen, (nodes.seen[pairs[:, 0]], nodes.seen[pairs[:, 1]]), 1.0)
        seen = (seen + seen.T) / 2
        link[kind] = np.log(seen / seen.sum()) - np.log(np.outer(share, share))
        link[kind] = np.clip(link[kind], -3.0, 3.0)
    return Field(weights, bias, link)


def fit(docs: DataFrame, text: str = "text", sample_rows: int = 4_000) -> Field:
    """A field from about ``sample_rows`` documents, chosen by a hash of the text; none or no marks in them give a flat field."""
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = docs.select(F.col(text).alias("text")).filter("text is not null").filter(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, offset = [], 0
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            part = graph(texts, [base_spans(t) for t in texts])
            part.links[:, :2] += offset
            offset += len(part.seen)
            parts.append(part)
        whole = [np.concatenate([getattr(p, c) for p in parts]) if parts else np.zeros(shape, dtype=np.int64) for c, shape in (
            ("document", 0), ("start", 0), ("end", 0), ("features", (0, 3)), ("seen", 0), ("links", (0, 3)),
        )]
        found = learn(Nodes(*whole))
        flat = np.concatenate([found.node.ravel(), found.bias, found.link.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "value"])

    found = chosen.repartition(1).mapInArrow(train, "at long, value double").toArrow()
    count = len(LABELS)
    flat = np.zeros(3 * SHAPES * count + count + 2 * count * count)
    flat[found["at"].to_numpy()] = found["value"].to_numpy()
    node, bias, link = np.split(flat, [3 * SHAPES * count, 3 * SHAPES * count + count])
    return Field(node.reshape(-1, count), bias, link.reshape(2, count, count))


FOUND = "array<struct<start:long,end:long,kind:string>>"


def detect(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (start, end in code points, kind), which replace columns of those names.

    A null text has none. All other columns stay as they are, repeated rows too.
    """
    names = [c for c in docs.columns if c not in ("base_spans", "spans")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)
    held = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    as_dicts = lambda spans: pa.array([[dict(zip(("start", "end", "kind"), s)) for s in x] for x in spans], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, as_dicts(base), as_dicts(held.value.spans(texts, base))], names=[*batch.schema.names, "base_spans", "spans"]
            )

    spans = StructType.fromDDL(f"base_spans {FOUND}, spans {FOUND}").fields
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *spans]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, as in [EMAIL]."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, field: Field, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with spans masked in ``text``; a null text stays null, other columns stay as they are.

    A long column ``length``, if named, becomes the length of texts that changed.
    """
    size_at = docs.columns.index(length) if length else None
    at, held = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = batch.column(at).to_pylist()
            texts = [t or "" for t in given]
            spans = held.value.spans(texts, [base_spans(t) for t in texts])
            new = [None if g is None else masked(t, s) if s else t for g, t, s in zip(given, texts, spans)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if size_at is not None:
                old = batch.column(size_at).to_pylist()
                columns[size_at] = pa.array([n if t == g else len(t) for n, t, g in zip(old, new, given)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    fields = [StructField(text, StringType()) if f.name == text else f for f in docs.schema.fields]
    return docs.mapInArrow(run, StructType(fields))
