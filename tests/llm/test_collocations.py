"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketwise.llm import collocations as co


def plain(rows, least, top):
    """Expected rows of collocations() for (lang, text)."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, found in counts.items():
        held = Counter()
        for phrase, a in found.items():
            if a >= least:
                for size in range(2, len(phrase)):
                    for i in range(len(phrase) - size + 1):
                        held[phrase[i : i + size]] = max(held[phrase[i : i + size]], a)
        own = []
        for phrase, a in found.items():
            if len(phrase) > 1 and a >= least and held[phrase] < a:
                cuts = [(1000 * a * n[lang] // (found[phrase[:k]] * found[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(phrase).encode(), found[phrase[:k]], found[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, count):
    """Texts of common and rare words, fixed phrases among them."""
    rng = random.Random(seed)
    fixed = ["new york city", "as soon as possible", "the quick brown fox jumps", "Über alles", "a a a a a a", "b a b a b"]
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    out = []
    for _ in range(count):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        out.append("".join(p + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "! ", "\x0b", "\xa0"]) for p in parts))
    return out


def run(spark, documents, rows, least, top):
    docs = documents([(i, text, lang) for i, (lang, text) in enumerate(rows)])
    return sorted(tuple(r) for r in co.collocations(docs, least=least, top=top).collect())


@pytest.mark.parametrize("head,block_bytes,merge", [(8, 3_000, 10), (1024, 8 << 20, 1 << 20)])
def test_equals_plain_counting(spark, documents, monkeypatch, head, block_bytes, merge):
    monkeypatch.setattr(co, "HEAD", head)
    monkeypatch.setattr(co, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(co, "MERGE", merge)
    rows = [("en", t) for t in texts(1, 120)] + [("de", t) for t in texts(2, 60)] + [(None, t) for t in texts(3, 30)] + [("und", t) for t in texts(4, 30)]
    rows += [("en", None), ("en", ""), ("en", " .,!\t"), ("one", "alone"), ("en", rows[0][1]), ("en", rows[0][1]), ("en", "new york city " * 5_000)]
    for least, top in ((5, 2000), (12, 7)):
        got = run(spark, documents, rows, least, top)
        assert got == plain(rows, least, top) and got


def test_one_hot_pair_in_a_large_share_of_texts(spark, documents):
    rows = [("en", "hot pair " * 200)] * 40 + [("en", t) for t in texts(5, 40)]
    assert run(spark, documents, rows, 20, 50) == plain(rows, 20, 50)


def test_nothing_frequent(spark, documents):
    assert run(spark, documents, [("en", "a b c d")], 2, 10) == []
    assert co.collocations(documents([(1, "x")]).limit(0)).count() == 0


def test_addresses_are_told_apart():
    rng = np.random.default_rng(1)
    ids = np.unique(np.concatenate([np.arange(5_000), rng.integers(0, 1 << 30, 5_000), 2 ** np.arange(6, 31), 2 ** np.arange(6, 31) - 1]))
    left, right = rng.permutation(ids), rng.permutation(ids)
    tile, address = co._address(left, right)
    for i in range(0, len(ids), 7):
        corner = co._Corner(int(tile[i]))
        assert corner.ids(address[i : i + 1]) == (left[i], right[i])
        assert 0 <= address[i] < corner.rows * corner.columns
        assert corner.dense or max(left[i], right[i]) >= co.HEAD


def test_exact_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", 1, "x", 3 * 10**10), ("en", 1, "y", 7 * 10**10), ("en", 2, "x y", 10**10 + 7)], "lang string, size int, phrase string, a long")
    totals = spark.createDataFrame([("en", 9 * 10**10 + 1)], "lang string, n long")
    got = co._weakest_cuts(phrases, totals).first()
    assert got.score == 1000 * (10**10 + 7) * (9 * 10**10 + 1) // (21 * 10**20)
