"""The registered queries on the small tables: against their SQL, and the pipeline against plain Python."""

import base64
import hashlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from compare import duck, frame_difference
from test_duplicates import roots, shingles, similar

from basketwise.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    problem, rows = frame_difference(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name])
    assert not problem and rows


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_native_queries_run_no_python(spark):
    for name in ("op1_secret_scan", "op6_url_filter"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    import tiktoken

    con = duck(FOLDER)
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]  # every other text of these has a language
    seen, single = set(), []
    for i, t in docs:
        normal = " ".join(t.split())
        if normal not in seen:
            seen.add(normal)
            single.append((i, t))
    sets = [shingles(t) for _, t in single]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] & sets[b] and similar(sets[a], sets[b])]
    root = roots(len(sets), links)
    items = [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    left = [(i, t) for k, (i, t) in enumerate(single) if root[k] == k and not any(x in t for x in items)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in left:
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_stages_take_odd_documents(spark, tmp_path):
    """Nulls, repeated rows and further columns go through every stage; so does an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, _digest string"
    rows = [(1, "the cat of the house", "en", "s", 1, "a", "b"), (1, "the cat of the house", "en", "s", 1, "a", "b"), (2, None, None, None, None, None, None),
            (None, "le chat de la maison", "fr", None, None, None, None), (3, "", "en", "s", 0, "", ""), (4, "the cat  of the house", "xx", "s", 1, "a", "b")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == before or name == "byte_bpe"
        assert {r.doc_id for r in docs.collect()} == ({1, None} if given else set())
