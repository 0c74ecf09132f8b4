"""Exact and near duplicates against brute force."""

import random
import re
from collections import defaultdict

import pytest

from texts import prose

from basketwise.llm import exact_dedup as exact, ngram_join as ngram, paragraph_dedup as para, set_links
from basketwise.llm.components import components


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def edited(text, seed, edits):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


EDGES = [None, "", " \n\t", "one", "ONE", "one two", "one  two", "One\x0btwo\n", "a b c d e", "A B C D E", "a b c d", "ſ K", "x" * 20_000]


def test_exact_groups(spark, documents):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(100 + i, "hot copy") for i in range(60)] + [(5, EDGES[5]), (None, "hot copy"), (None, "lonely")]
    got = exact.exact_dedup(documents(rows), exact.fresh_index(spark)).collect()
    groups = defaultdict(list)
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        groups[normal(t)].append(i)
    want = []
    for i, t in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(want, key=repr)


def test_index_keeps_what_came_first(spark, documents):
    index = exact.fresh_index(spark)
    exact.exact_dedup(documents([(7, "a b"), (8, "c")]), index).collect()
    got = exact.exact_dedup(documents([(1, "a  b"), (2, "d"), (3, "d")]), index).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in got} == {1: (7, False), 2: (2, True), 3: (2, False)}
    assert index.rows().count() == 3
    plan = index.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert "digest" in plan and exact.exact_dedup(documents([]), index).count() == 0


def test_first_copies_stay_with_all_columns(spark, documents):
    df = documents([(2, "x y"), (1, "x  y"), (1, "x  y"), (3, None), (4, ""), (None, "z"), (None, "z"), (5, "z")])
    stay = exact.keep_first_copies(df, exact.fresh_index(spark))
    assert stay.columns == df.columns
    assert sorted([r.doc_id for r in stay.collect()]) == [1, 3, 5]


def near_rows():
    rng = random.Random(1)
    texts = list(EDGES)
    base = prose(1, 150, 10**6)
    texts += [edited(base, i, rng.randrange(0, 7)) for i in range(70)]  # a family whose ends aren't similar
    shared = prose(2, 40, 10**6)
    texts += [f"{prose(50 + i, 60, 10**6)} {shared} {prose(90 + i, 30, 10**6)}" for i in range(25)]  # a passage, no copies
    texts += [shared] * 4 + [prose(3, 2_000, 300), edited(prose(3, 2_000, 300), 5, 20), edited(prose(3, 2_000, 300), 6, 90)]
    chain = prose(4, 100, 10**6).split()
    texts += [" ".join(chain[i * 6 : i * 6 + 60]) for i in range(6)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("neighbours", [8, 1])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, neighbours):
    monkeypatch.setattr(set_links, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(set_links, "HUBS", neighbours)
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    want = roots(len(rows), links)
    got = ngram.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in range(len(rows))}


def test_near_duplicates_edges(spark, documents):
    assert ngram.near_duplicates(documents([(1, "x")]).limit(0)).count() == 0
    same = "a b c d e f g"
    got = ngram.near_duplicates(documents([(2, same), (2, same), (None, same), (None, ""), (3, None)])).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(2, 3, 2), (2, 3, 2), (None, 3, 2), (None, 0, None), (3, 0, 3)], key=repr)
    df = documents([(2, same), (1, same), (3, ""), (None, "other words are here now")])
    stay = ngram.keep_one_of_each(df)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == {1, 3, None}


def test_buckets_of_the_same_members_are_one(spark, documents, monkeypatch):
    text = prose(11, 300)
    seen = {}

    def kept(frame, label, keep=set_links.kept):
        seen[label] = keep(frame, label)
        return seen[label]

    monkeypatch.setattr(set_links, "kept", kept)
    docs = documents([(1, text), (2, text + " end"), (3, prose(12, 300))])
    got = {r.doc_id: r.component_id for r in ngram.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert [r["count"] for r in seen["meetings"].groupBy("token").count().collect()] == [2]

    posted = [(5, 1), (5, 2), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (9, 1), (9, 2), (9, 3), (7, 3)]
    folded = set_links._distinct_buckets(spark.createDataFrame([(t, k, 10, t) for t, k in posted], "token long, key long, n long, p int"))
    assert sorted((r.token, r.key) for r in folded.collect()) == [(3, 1), (3, 2), (4, 1), (4, 2), (4, 3)]


def test_wide_marks_fold_and_never_rule_out_what_is_similar(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from basketwise.llm.words import MARK_WORDS, parity_marks, wide_marks

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 1100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:k], rng.integers(0, 1 << 62, extra).astype(np.uint64)])) for k, extra in ((1100, 0), (1000, 0), (990, 0), (1000, 150), (700, 400), (0, 1000), (3, 0))]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    values, ends = wide_marks(np.concatenate(sets), bounds)
    wide = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    assert [len(w) for w in wide] == [32, 16, 16, 32, 32, 16, MARK_WORDS]
    folded = [np.bitwise_xor.reduce(w.reshape(-1, MARK_WORDS), axis=0).tolist() for w in wide]
    assert folded == parity_marks(np.concatenate(sets), bounds).tolist()

    pairs = [(i, j, len(sets[i]), wide[i].view(np.int64).tolist(), len(sets[j]), wide[j].view(np.int64).tolist()) for i in range(6) for j in range(i)]
    df = spark.createDataFrame(pairs, "i int, j int, n int, a array<long>, m int, b array<long>")
    near = set_links._wide_marks_near((F.col("n"), F.col("a")), (F.col("m"), F.col("b")), 80)
    got = {(r.i, r.j) for r in df.filter(near).collect()}
    assert got >= {(i, j) for i, j, *_ in pairs if similar(set(sets[i].tolist()), set(sets[j].tolist()))}
    assert not any(4 in pair or 5 in pair for pair in got)  # marks of 256 bits leave all of these


def test_small_buckets_go_no_further_and_long_sets_are_ruled_out_unsent(spark, documents, monkeypatch):
    seen = defaultdict(list)

    def kept(frame, label, keep=set_links.kept):
        seen[label].append(keep(frame, label))
        return seen[label][-1]

    monkeypatch.setattr(set_links, "kept", kept)
    text = prose(21, 1_500, 10**6).split()
    docs = documents([(i, " ".join(text[: 1_000] + prose(30 + i, 600, 10**6).split())) for i in range(3)])
    got = {r.doc_id: r.component_id for r in ngram.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2}
    assert [frame.count() for frame in seen["pairs"]] == [0] * 4
    assert [frame.count() for frame in seen["mixed"]][1:] == [0, 0]


def test_components_go_on_from_those_so_far(spark):
    def links(*pairs):
        return spark.createDataFrame(list(pairs), "a long, b long")

    label = set_links._joined(None, links((1, 2), (3, 2), (5, 6)))
    assert set_links._joined(label, links()) is label
    label = set_links._joined(label, links((6, 3), (8, 9)))
    assert {(r.node, r.component) for r in label.collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (8, 8), (9, 8)}


def test_probe_walks_the_tree(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.unique(rng.integers(0, 60, 40))
        probe = set_links.Probe(x, 80)
        probe.BLOCK = 3
        family = sorted((np.unique(np.concatenate([rng.choice(x, len(x) - rng.integers(0, 9), False), rng.integers(0, 60, rng.integers(0, 6))])).tolist()
                         for _ in range(20)))
        for y in family:
            assert probe.similar(np.array(y)) == similar(set(x.tolist()), set(y))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    got = components(spark.createDataFrame(links + [(7, 7), (None, 3)], "a long, b long")).collect()
    want = roots(600, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {i: want[i] for i in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_paragraphs(spark, documents):
    shared, other = prose(11, 60, 10**6), prose(12, 80, 10**6)
    rows = [(i, f"é{prose(100 + i, 55, 10**6)}\n{edited(shared, i, 1)}\nshort line\n") for i in range(12)]
    rows += [(20, shared), (21, f"\n\n{other}\n{other}"), (22, other + "\nshort line"), (23, None), (24, ""), (None, shared), (25, "a b c")]
    df = documents(rows)
    got = para.repeated_paragraphs(df).collect()
    lines = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 50]
    sets = [shingles(line) for _, _, line in lines]
    root = roots(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if similar(sets[a], sets[b])])
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(lines[k])
    want = {}
    for members in groups.values():
        first = min(members, key=lambda m: (m[0] is None, m[0] or 0, m[1]))
        for m in members:
            if len(members) > 1:
                want[m[:2]] = (m[2], first[:2], len(members), m[:2] != first[:2])
    texts = dict(rows)
    assert {(r.doc_id, r.line): (texts[r.doc_id][r.start : r.stop], (r.first_id, r.first_line), r.places, r.removed) for r in got} == want
    left = {r.doc_id: r.text for r in para.remove_repeats(df, para.repeated_paragraphs(df)).collect()}
    assert left[21] == f"\n\n{other}" and left[22] == "short line" and left[23] is None and left[25] == "a b c"
    assert para.repeated_paragraphs(df.limit(0)).count() == 0


def test_repeated_runs_cross_and_sit_inside_lines(spark, documents):
    """Every 50 words that stand elsewhere too, against all windows of all texts."""
    shared, other = prose(21, 70, 10**6).split(), prose(22, 54, 10**6).split()
    own = lambda i, n: prose(700 + i, n, 10**6)
    rows = [(i, f"é {own(i, 20)}\n{own(50 + i, 30)} {' '.join(shared[:25])}\n{' '.join(shared[25:])} {own(90 + i, 40)}\nend") for i in range(4)]
    rows += [(10, f"{own(200, 300)} {' '.join(shared)} {own(201, 200)}"), (11, " ".join(shared[5:60])), (12, " ".join(shared[:49])),
             (13, "\n".join(other[i : i + 9] and " ".join(other[i : i + 9]) for i in range(0, 54, 9))), (14, f"{own(202, 60)} {' '.join(other).upper()} tail"),
             (15, f"{own(203, 60)}\n{' '.join(other)} {own(204, 60)} {' '.join(other)}"), (16, "x " * 180), (None, " ".join(shared)), (17, None), (18, ""),
             (19, own(200, 300)), (20, "\n".join(own(i, 20) for i in range(8))), (20, "\n".join(own(i, 20) for i in range(8)))]
    df = documents(rows)
    got = para.repeated_runs(df).collect()
    words = {i: [(m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", t or "")] for i, t in rows}
    texts = dict(rows)
    windows = defaultdict(list)
    for i in texts:
        low = [texts[i][a:b].lower() for a, b in words[i]]
        for k in range(len(low) - 49):
            windows[tuple(low[k : k + 50])].append((i is None, i or 0, k))
    want = {False: defaultdict(set), True: defaultdict(set)}
    for found in windows.values():
        first = min(found)
        apart = [p for p in found if p == first or p[:2] != first[:2] or p[2] - first[2] >= 50]
        for no_id, i, k in apart if len(apart) > 1 or first[1] == 20 else []:
            want[(no_id, i, k) != first][None if no_id else i].update(range(k, k + 50))
    for removed in (False, True):
        covered = defaultdict(set)
        for r in (r for r in got if r.removed == removed):
            inside = {k for k, (a, b) in enumerate(words[r.doc_id]) if a >= r.start and b <= r.stop}
            assert len(inside) == r.n_words >= 50 and texts[r.doc_id].count("\n", 0, r.start) == r.line
            covered[r.doc_id] |= inside
        assert covered == want[removed]
    across = [r for r in got if r.doc_id in (0, 1, 2, 3, 10, 11, None) and r.first_id == 0]
    assert {(r.doc_id, r.n_words, r.places) for r in across} >= {(0, 70, 7), (1, 70, 7), (10, 70, 7), (11, 55, 7), (None, 70, 7)}
    left = {r.doc_id: r.text for r in para.remove_repeats(df, para.repeated_runs(df)).collect()}
    assert left[11] == "" and left[14].split() == [*own(202, 60).split(), "tail"] and left[1].split() == [*rows[1][1].split()[:51], *rows[1][1].split()[121:]]
    assert left[0] == texts[0] and left[17] is None and left[18] == "" and para.repeated_runs(df.limit(0)).count() == 0


def test_an_index_opened_by_another_session_keeps_its_buckets(spark, documents, tmp_path):
    from basketwise.llm.exact_dedup import DigestIndex, exact_dedup

    docs = documents([(i, f"text {i % 30}") for i in range(40)])
    first = DigestIndex(spark, "digests_first", f"{tmp_path}/index", buckets=4)
    before = sorted(map(tuple, exact_dedup(docs, first).collect()))
    assert first.rows().count() == 30
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", 7)
    again = DigestIndex(other, "digests_again", f"{tmp_path}/index", buckets=9)
    same = other.createDataFrame([(i, f"text {i % 30}") for i in range(40)], "doc_id long, text string")
    after = sorted(map(tuple, exact_dedup(same, again).collect()))
    assert after == before and again.rows().count() == 30
