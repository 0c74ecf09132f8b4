"""The Merkle manifest against plain hashlib."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from basketwise.llm import merkle, sha256


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, fan=2):
    """All levels of a tree, bottom up."""
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(*below[i : i + fan]) for i in range(0, len(below), fan)])
    return out


def climb(tree, at, node, fan=2):
    """(top, siblings) if ``node`` stood at place ``at``."""
    siblings = []
    for level in tree[:-1]:
        first = at // fan * fan
        run = level[first : first + fan]
        siblings += [n for k, n in enumerate(run) if first + k != at]
        run[at - first] = node
        node, at = digest(*run), at // fan
    return node, siblings


def leaf(*fields):
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain(rows, fan=2):
    """Expected rows of manifest_of_documents."""
    lists = {}
    for row in rows:
        lists.setdefault(row[2], []).append((row[0], leaf(*row), row))
    names = sorted(lists, key=lambda n: (n is not None, (n or "").encode()))
    for rows_of in lists.values():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {n: levels([r[1] for r in lists[n]], fan) for n in names}
    top = levels([trees[n][-1][0] for n in names], fan)
    out = []
    for k, n in enumerate(names):
        for at, (i, own, (_, source, lang, chars, text)) in enumerate(lists[n]):
            changed = own
            if i is not None and chars is not None and zlib.crc32(str(i).encode()) % 7 == 0:
                changed = leaf(i, source, lang, chars + 1, text)
            subroot, near = climb(trees[n], at, changed, fan)
            root, far = climb(top, k, subroot, fan)
            out.append((i, own, trees[n][-1][0], top[-1][0], digest(*near, *far), root, root == top[-1][0]))
    return sorted(out, key=repr)


def test_states_resume_to_the_librarys_digests():
    rng = random.Random(1)
    nodes = [rng.randbytes(32) for _ in range(50)]
    state = np.repeat(sha256.START, 50, axis=1)
    first = sha256.compress(state, sha256.hex_block(sha256.from_bytes(b"".join(nodes))))
    resumed = sha256.from_bytes(sha256.to_bytes(first))  # stored and read again
    both = sha256.compress(resumed, sha256.hex_block(sha256.from_bytes(b"".join(nodes[::-1]))))
    got = sha256.to_bytes(sha256.finish(both, np.full(50, 2)))
    assert got == b"".join(hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in zip(nodes, nodes[::-1]))
    assert sha256.to_bytes(sha256.finish(state, np.zeros(50))) == hashlib.sha256().digest() * 50


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, list string, at long, leaf string, digest string, tile long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("tile_leaves", [2, 4, 1024])
def test_equals_plain_hashing(spark, monkeypatch, tile_leaves):
    monkeypatch.setattr(merkle, "TILE_LEAVES", tile_leaves)
    rng = random.Random(2)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en"] * 6 + ["de", None, "é", "z"]), rng.choice([None, 5, 12]), "tä" * rng.randrange(9)) for i in range(70)]
    rows += [(100, None, None, None, None), (101, "s", "alone", 1, "x" * 100_000), rows[3], rows[3], (None, "s", "en", 2, ""), (None, "s", "en", 2, ""), (3, "other", "en", 3, "t"), (7, "", "", 0, "")]
    got = sorted([tuple(r) for r in merkle.manifest_of_documents(documents(spark, rows)).collect()], key=repr)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_document_is_its_own_root(spark):
    rows = [(5, "s", "en", 1, "t")]
    assert [tuple(r) for r in merkle.manifest_of_documents(documents(spark, rows)).collect()] == plain(rows)


def test_no_documents(spark):
    assert merkle.manifest_of_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("fan", [3, 5])
def test_wider_runs(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "TILE_LEAVES", 10)
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"t{i}") for i in range(64)]
    leaves = spark.createDataFrame([(r[0], r[2], leaf(*r), leaf(*r[:3], 2, r[4]) if zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(*r)) for r in rows], "doc_id long, lang string, leaf string, changed string")
    folded = merkle.fold_leaves(merkle.build_manifest(leaves, "lang", ["doc_id"], "leaf", fan), "leaf", "changed", "doc_id")
    assert sorted([tuple(r) for r in folded.collect()], key=repr) == plain(rows, fan)
