import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.operators import corpus, retrieval
from basketwise.sources.documents import read_documents, read_snapshot, write_snapshot


def documents(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "source string, text string")


def chunks(spark, text, size=20, overlap=5):
    rows = corpus.chunk_documents(documents(spark, d=text), size, overlap).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert [r.id for r in rows] == [f"d::chunk_{i}" for i in range(len(rows))]
    return [r.text for r in rows]


def sections(spark, text):
    rows = corpus.document_sections(documents(spark, d=text)).orderBy("section_index").collect()
    return [r.text for r in rows]


def test_sections(spark):
    assert sections(spark, "no heading at all") == ["no heading at all"]
    assert sections(spark, "intro\n## A\nx\n## B\ny\n") == ["intro", "## A\nx", "## B\ny"]
    assert sections(spark, "## A\nx\n### deeper\n##not one\nin ## line") == ["## A\nx\n### deeper\n##not one\nin ## line"]
    assert sections(spark, "## A\n\n\n## B") == ["## A", "## B"]
    assert sections(spark, " \n\t  ") == []
    assert sections(spark, "") == []
    # only the line feed ends a line
    assert sections(spark, "a\r## b ## c") == ["a\r## b ## c"]


def test_strip_takes_all_white_space(spark):
    assert sections(spark, "　\x1c\x85 text  ") == ["text"]


def test_short_sections_are_one_chunk_each(spark):
    assert chunks(spark, "intro\n## A\n\ntwo\n\nthree\n## B") == ["intro", "## A\n\ntwo\n\nthree", "## B"]


def test_paragraphs_are_packed_with_overlap(spark):
    text = "aaaaaaaa\n\nbbbbbbbb\n\ncccccccc\n\n\n\ndd"
    # a+b are 18 long and fit; c does not and takes the last 5 characters along; dd fits in
    assert chunks(spark, text) == ["aaaaaaaa\n\nbbbbbbbb", "bbbbb\n\ncccccccc\n\ndd"]
    assert chunks(spark, text, overlap=0) == ["aaaaaaaa\n\nbbbbbbbb", "cccccccc\n\ndd"]


def test_long_paragraph_with_an_empty_buffer_is_cut(spark):
    text = "".join(chr(97 + i % 26) for i in range(47))
    assert chunks(spark, text) == [text[0:20], text[15:35], text[30:47], text[45:47]]
    # after the cut the buffer is empty again
    assert chunks(spark, text + "\n\nend") == [text[0:20], text[15:35], text[30:47], text[45:47], "end"]


def test_long_paragraph_after_a_short_one_may_exceed_the_size(spark):
    assert chunks(spark, "short\n\n" + "x" * 30) == ["short", "short\n\n" + "x" * 30]


def test_overlap_not_below_the_size_is_reduced(spark):
    text = "y" * 25
    assert chunks(spark, text, size=10, overlap=10) == chunks(spark, text, size=10, overlap=2)
    with pytest.raises(ValueError):
        corpus.chunks_of(F.lit("x"), 0)


def test_characters_count_not_bytes(spark):
    assert chunks(spark, "é" * 20) == ["é" * 20]
    assert chunks(spark, "é" * 21, overlap=0) == ["é" * 20, "é"]


def test_without_overlap_nothing_is_lost(spark):
    rng = random.Random(1)
    for _ in range(15):
        paragraphs = ["".join(rng.choice("abc d") for _ in range(rng.randrange(1, 60))).strip() or "z"
                      for _ in range(rng.randrange(1, 25))]
        found = chunks(spark, "\n\n".join(paragraphs), size=60, overlap=0)
        assert "\n\n".join(found) == "\n\n".join(paragraphs)
        assert all(len(c) <= 60 for c in found)


def test_defaults(spark):
    text = "\n\n".join(str(i) * 100 for i in range(10, 30))
    found = [r.text for r in corpus.chunk_documents(documents(spark, d=text)).collect()]
    assert len(found) > 1 and found[0] == "\n\n".join(str(i) * 100 for i in range(10, 14))
    assert found[1].startswith(found[0][-150:] + "\n\n14")


def test_manifest_and_summary(spark):
    docs = documents(spark, a="text", b=" \n", z="not expected")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    manifest = corpus.document_manifest(docs, expected)
    assert {tuple(r) for r in manifest.collect()} == {("a", "present"), ("b", "empty"), ("c", "missing")}
    made = corpus.chunk_documents(docs.filter("source = 'a'"))
    assert tuple(corpus.ingest_summary(manifest, made).first()) == (True, 1, 1, 1, 1, 1)
    snapshot, summary = corpus.ingest_documents(docs, expected, made.withColumn("id", F.lit("old")))
    assert {r.id for r in snapshot.collect()} == {"old", "a::chunk_0"}
    assert tuple(summary.first()) == (True, 1, 1, 1, 1, 1)
    nothing = corpus.ingest_summary(manifest.filter("status <> 'present'"), made.limit(0))
    assert tuple(nothing.first()) == (False, 0, 1, 1, 0, 0)


def test_upsert(spark, tmp_path):
    old = corpus.chunk_documents(documents(spark, a="x" * 50, b="bee"), 20, 0)
    new = corpus.chunk_documents(documents(spark, a="short", c="sea"), 20, 0)
    merged = {r.id: r.text for r in corpus.upsert_chunks(old, new).collect()}
    assert merged == {
        "a::chunk_0": "short", "a::chunk_1": "x" * 20, "a::chunk_2": "x" * 10, "b::chunk_0": "bee",
        "c::chunk_0": "sea",
    }
    assert corpus.upsert_chunks(old, new, reset=True).count() == 2
    assert corpus.upsert_chunks(None, new).count() == 2

    path = f"{tmp_path}/snapshot"
    assert read_snapshot(spark, path) is None
    write_snapshot(corpus.upsert_chunks(old, new), path)
    assert tuple(corpus.corpus_stats(read_snapshot(spark, path)).first()) == (True, 5)
    assert tuple(corpus.corpus_stats(None, spark).first()) == (False, 0)
    with pytest.raises(Exception):
        write_snapshot(new, path)


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("one\r\ntwo\rthree\n".encode())
    (tmp_path / "b.md").write_text("x")
    rows = {r.source: r.text for r in read_documents(spark, f"{tmp_path}/*.md").collect()}
    assert rows == {"a.md": "one\ntwo\nthree\n", "b.md": "x"}


# --- retrieval ------------------------------------------------------------------------------


def vector_frame(spark, matrix, ids=None, sources=None):
    ids = ids or list(range(len(matrix)))
    sources = sources or ["s"] * len(matrix)
    rows = [(i, s, [float(x) for x in v]) for i, s, v in zip(ids, sources, matrix)]
    kind = "string" if isinstance(ids[0], str) else "int"
    return spark.createDataFrame(rows, f"id {kind}, source string, embedding array<float>")


def query_frame(spark, matrix):
    return spark.createDataFrame(
        [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(matrix)], "query_id string, embedding array<float>"
    )


def brute(matrix, queries, k):
    v = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    d = np.round(1 - v @ q.T, 9)
    return {
        f"q{j}": [(i, d[i, j]) for i in sorted(range(len(v)), key=lambda i: (d[i, j], i))[:k]]
        for j in range(len(q))
    }


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    queries = rng.normal(size=(7, 8)).astype(np.float32).astype(np.float64)
    hits = retrieval.vector_top_k(
        vector_frame(spark, vectors).repartition(5), query_frame(spark, queries), 5
    )
    want, got = brute(vectors, queries, 5), found(hits)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(got[q], want[q]))


def test_small_batches_and_many_equal_vectors(spark):
    # two thirds are copies of one vector: ties go to the smaller id
    base = np.array([[1.0, 0.0], [1.0, 0.0], [0.6, 0.8]])
    vectors = np.vstack([base] * 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        hits = retrieval.vector_top_k(vector_frame(spark, vectors).repartition(3), query_frame(spark, [[2.0, 0.0]]), 4)
        assert found(hits) == {"q0": [(0, 0.0), (1, 0.0), (3, 0.0), (4, 0.0)]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_filter_and_edges(spark):
    frame = vector_frame(
        spark, [[1, 0], [-1, 0], [0, 0], [0, 1]], ids=["a", "b", "c", "d"], sources=["x", "x", "y", "y"]
    )
    queries = query_frame(spark, [[1, 0]])
    rows = {r.id: (r.distance, r.relevance_score) for r in retrieval.vector_top_k(frame, queries, 10).collect()}
    assert rows == {"a": (0.0, 1.0), "b": (2.0, 0.0), "c": (1.0, 0.5), "d": (1.0, 0.5)}
    only = retrieval.vector_top_k(frame, queries, 1, source_filter="y").collect()
    assert [(r.id, r["rank"]) for r in only] == [("c", 1)]
    assert retrieval.vector_top_k(frame.limit(0), queries).count() == 0
    assert retrieval.vector_top_k(frame, queries, source_filter="none").count() == 0


def test_bad_queries(spark):
    frame = vector_frame(spark, [[1, 0]])
    with pytest.raises(ValueError):
        retrieval.vector_top_k(frame, query_frame(spark, [[]]))
    with pytest.raises(ValueError):
        retrieval.vector_top_k(frame, query_frame(spark, [[1, 0]]).limit(0))
    with pytest.raises(ValueError):
        retrieval.vector_top_k(frame, query_frame(spark, [[1, 0]]), 0)
    with pytest.raises(Exception, match="components"):
        retrieval.vector_top_k(frame, query_frame(spark, [[1, 0, 0]])).collect()


def test_vectors_of_another_length_are_an_error(spark):
    frame = vector_frame(spark, [[1.0], [1.0, 2.0, 3.0]]).coalesce(1)
    with pytest.raises(Exception, match="components"):
        retrieval.vector_top_k(frame, query_frame(spark, [[1, 0]])).collect()


def test_undefined_vectors_are_near_to_nothing(spark):
    frame = vector_frame(spark, [[1.0, 0.0], [float("nan"), 1.0], [float("inf"), 0.0], [0.5, 0.5]])
    hits = retrieval.vector_top_k(frame, query_frame(spark, [[1, 0]]), 4).collect()
    assert [r.id for r in sorted(hits, key=lambda r: r["rank"])] == [0, 3]
    assert {r.id for r in retrieval.unusable_vectors(frame).collect()} == {1, 2}


def test_more_queries_than_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 64)
    frame, queries = vector_frame(spark, [[1, 0], [0, 1]]), query_frame(spark, [[1, 0], [0, 1], [1, 1], [2, 1], [1, 3]])
    hits = retrieval.vector_top_k(frame, queries, 1).collect()
    assert len(hits) == 5


def test_chunking_takes_time_in_proportion(spark):
    import time

    def seconds(df):
        began = time.perf_counter()
        corpus.chunk_documents(df).count()
        return time.perf_counter() - began

    one = spark.createDataFrame([("a",)], "source string")
    for unit, n in (("abcdefghi ", 100_000), ("word " * 30 + "\n\n", 4_000)):
        frames = [one.withColumn("text", F.repeat(F.lit(unit), times)) for times in (n, n, 2 * n)]
        warm, single, double = (seconds(f) for f in frames)
        assert double < 2.5 * single + 1


def test_topics_keep_the_first(spark):
    frame = vector_frame(spark, [[1, 0], [0.9, 0.1], [0, 1]])
    texts = spark.createDataFrame(
        [(0, "p.md", 0, "zero"), (1, "p.md", 1, "one"), (2, "a.md", 0, "two")],
        "id int, source string, chunk_index int, text string",
    )
    topics = spark.createDataFrame(
        [("late", 2, [1.0, 0.0]), ("early", 1, [0.9, 0.1])], "topic string, topic_order int, embedding array<float>"
    )
    hits = retrieval.multi_topic_retrieval(frame, topics, texts, 2)
    assert {(r.topic, r.text) for r in hits.collect()} == {("early", "zero"), ("early", "one")}
    all_hits = retrieval.multi_topic_retrieval(frame, topics, texts, 3)
    assert retrieval.sources_used(all_hits).first()[0] == ["a.md", "p.md"]
    assert {r.topic for r in all_hits.collect()} == {"early"}


def test_many_queries_stay_on_the_cluster(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(5)
    vectors = vector_frame(spark, rng.normal(size=(300, 8)).tolist()).repartition(5)
    queries = query_frame(spark, rng.normal(size=(90, 8)).tolist())
    want = sorted(map(tuple, retrieval.vector_top_k(vectors, queries, 4).collect()))
    received, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: received.append(df.columns) or collect(df))
    blocks = retrieval.vector_top_k(vectors, queries, 4, block_bytes=1_000)
    monkeypatch.undo()
    assert not any("embedding" in columns for columns in received)
    assert "Cartesian" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, blocks.collect())) == want
    assert retrieval.vector_top_k(vectors.limit(0), queries, block_bytes=1_000).count() == 0
    for bad in ([[]], [[1.0, float("nan")]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            retrieval.vector_top_k(vectors, query_frame(spark, bad), block_bytes=1)


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    for n in (1, 10, 1_000):  # a hundredth of the vectors as queries: what is sent grows with the vectors
        vectors = n << 20
        query_blocks, vector_blocks = retrieval._grid(vectors // 100, vectors)
        assert vectors * query_blocks + vectors // 100 * vector_blocks <= 2 * vectors
        assert vectors / vector_blocks <= retrieval.GRID_BYTES
    rng = np.random.default_rng(6)
    vectors, queries = vector_frame(spark, rng.normal(size=(200, 8)).tolist()), query_frame(spark, rng.normal(size=(60, 8)).tolist())
    want = sorted(map(tuple, retrieval.vector_top_k(vectors, queries, 4).collect()))
    monkeypatch.setattr(retrieval, "GRID_BYTES", 2_000)
    assert retrieval._grid(60 * 96, 200 * 96) == (3, 10)
    assert sorted(map(tuple, retrieval.vector_top_k(vectors, queries, 4, block_bytes=1_000).collect())) == want
