import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tunegauge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_chunks_give_the_tokens_of_the_whole_text():
    rng = random.Random(8)
    parts = ["a", "It's", "'S", "é", "ö,", "x²", "İ", "Σ", "...", "—", "«b»", " ", "\n", " ", "　", "\x1c", "\x00", "1234", "<|endoftext|>", "<|ENDOFTEXT|>", "名前", "🙂", "é", "don't", "_", "가"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    tokenizer, coder = Tokenizer.from_file(PATH), packing.Coder(PATH)
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        for text, got in zip(some, coder.ids(some)):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_changes_nothing():
    coder, tokenizer = packing.Coder(PATH, remembered=50), Tokenizer.from_file(PATH)
    for start in range(0, 400, 20):
        texts = [" ".join(f"w{(start + i * j) % 97}," for j in range(30)) for i in range(3)]
        for text, got in zip(texts, coder.ids(texts)):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("low, high", [(1, 100), (30, 60), (35, 52), (100, 100), (51, 70)])
def test_local_search_improves_on_best_fit(low, high):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(1500)]
    found = packing.pack(lengths, 100)
    assert sorted(i for b in found for i in b) == list(range(1500)) and all(sum(lengths[i] for i in b) <= 100 for b in found)
    fit = packing.Bins(lengths, 100)
    for i in sorted(range(1500), key=lambda i: -lengths[i]):
        fit.put(i, fit.best(lengths[i]))
    assert -(-sum(lengths) // 100) <= len(found) <= len(fit.items)


def test_two_for_one_exchange_empties_a_bin():
    assert len(packing.pack([6, 5, 5, 4, 4, 3, 3], 10)) == 3


def test_pairs_of_all_lengths_in_bins_of_many_pieces():
    rng = random.Random(4)
    lengths = [rng.randint(1, 9) for _ in range(300)]
    bins = packing.Bins(lengths, 2000)
    for i in range(300):
        bins.put(i, None if i in (0, 40, 43) else 0 if i < 40 else 1 if i < 43 else 2)
    table = packing._Table(bins)
    for b, items in enumerate(bins.items):
        wanted = {tuple(sorted((lengths[x], lengths[y]))) for k, x in enumerate(items) for y in items[k + 1 :]}
        own = table.pairs[table.pairs[:, 2] == b]
        assert {tuple(sorted((lengths[x], lengths[y]))) for x, y, _ in own} == wanted and wanted
        assert all(x != y and x in items and y in items for x, y, _ in own)


def test_two_for_one_exchange_with_a_bin_of_many_pieces():
    bins = packing.Bins([3] * 30 + [7], 91)
    for i in range(31):
        bins.put(i, None if i in (0, 30) else 0)
    assert packing._step(bins, 1, packing._Table(bins))
    assert bins.room[0] == 0 and [bins.lengths[i] for i in bins.items[1]] == [3, 3]


@pytest.mark.parametrize("low, high, capacity", [(25, 45, 100), (20, 60, 100), (500, 1100, 2048), (300, 900, 2048)])
def test_search_ends_only_where_no_exchange_is_left(low, high, capacity):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(3000)]
    found = packing.pack(lengths, capacity)
    assert sorted(i for b in found for i in b) == list(range(3000)) and len(found) > -(-sum(lengths) // capacity)
    bins = packing.Bins(lengths, capacity)
    for k, items in enumerate(found):
        for i in items:
            bins.put(i, None if i == items[0] else k)
    assert max(bins.room) <= capacity and min(bins.room) >= 0
    table = packing._Table(bins)
    assert not any(packing._step(bins, b, table) for b in bins.open())


def test_odd_rows(odd, empty):
    rows = packing.packed(odd, PATH, capacity=512, group_rows=40).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(plain_ids(r.text))
    wanted = sorted(
        (repr(d), k, at, len(ids[at : at + 512]), zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes()))
        for d, many in texts.items() for ids in many for k, at in enumerate(range(0, len(ids), 512))
    )
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 512
    assert packing.packed(empty, PATH).count() == 0
