"""Packing against an item-by-item best fit and the tokenizer's own ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from texts import prose

from basketwise.llm import packing, slices

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def one_by_one(items, window):
    """Room left in each window when every item is placed on its own."""
    rooms = []
    for size in sorted(items, reverse=True):
        fitting = [room for room in rooms if room >= size]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else window) - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_placements_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 8, 16, 31, 64, 100])
    sizes = range(1, window + 1) if seed % 3 else [1, max(window // 2, 1), window]
    items = [rng.choice(sizes) for _ in range(rng.randrange(150))]
    counts = Counter(items)
    content, numbers = defaultdict(list), defaultdict(list)
    for p in packing.place(counts, window):
        numbers[p.size] += range(p.piece, p.piece + p.count)
        for j in range(p.count):
            content[p.window + j].append((p.offset, p.size))
    assert {s: sorted(n) for s, n in numbers.items()} == {s: list(range(c)) for s, c in counts.items()}
    assert sorted(content) == list(range(len(content)))
    rooms = []
    for held in content.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        rooms.append(window - at)
    assert sorted(rooms) == one_by_one(items, window)


def test_placements_do_not_grow_with_the_pieces():
    few, many = ({s: factor * (s % 7 + 1) for s in range(1, 257)} for factor in (10, 10**6))
    assert len(packing.place(many, 256)) <= 2 * len(packing.place(few, 256))


def test_slices_join_to_the_text():
    text = ("aé " * 50 + "x" * 300 + " \n\t" + "b").encode()
    for size in (1, 7, 64, 10_000):
        assert b"".join(slices.slices(text, size)) == text
        assert b"".join([w for s in slices.slices(text, size) for w in s.split()]) == b"".join(text.split())


@pytest.mark.parametrize("window,remembered", [(16, 1 << 19), (64, 5), (4096, 1 << 19)])
def test_pieces_hold_every_id_once(spark, documents, monkeypatch, window, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "GROUP_BYTES", window * 20)
    definition = packing.given_tokenizer()
    whole = tokenizers.Tokenizer.from_str(definition)
    rng = random.Random(4)
    pool = "ab'sd tLlve12éÀÖÿß×÷ \n\t\r\x1c\x85　 中\U0001f600१Ⅷ²́Σİı'\"!.,<>/w\x00"
    texts = [None, "", " ", "\n\n  x", "a<|endoftext|>b <|startoftext|>", "x" * 30_000, prose(1, 5_000), "it's they'LL 'tis don't!'s </w> w</w>", "É́cole Straße ΟΔΟΣ"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(8, texts[8]), (None, texts[9]), (None, texts[9])] + [(1000 + i, "same text") for i in range(40)]
    packed = packing.pack(packing.cut_documents(documents(rows), definition, window=window, with_ids=True), window)
    assert packed.columns == ["row", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    got = packed.collect()
    want = Counter()
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for at in range(0, len(ids), window):
            piece = ids[at : at + window]
            want[i, at, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids), tuple(piece)] += 1
    assert Counter((r.row, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sorted(window - sum(n for _, n, _ in held) for held in by_sequence.values()) == one_by_one([r.length for r in got], window)
    for r in packing.sequences(packed, window).collect():
        ids = [i for _, _, part in sorted(by_sequence[r.sequence_id]) for i in part]
        assert r.used == len(ids) and r.ids[: r.used] == ids
        assert len(r.ids) == (r.used if r.used & (r.used - 1) == 0 else window) and not any(r.ids[r.used :])


def test_no_documents(spark, documents):
    assert packing.pack(packing.cut_documents(documents([(1, "x")]).limit(0), packing.given_tokenizer())).count() == 0
