"""Tokens, benchmark leaks and page texts."""

import base64
import hashlib
import random

import pytest

from texts import prose

from basketwise.llm import byte_bpe as bpe, chunks, decontaminate as leaks, page_text as pages

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [1 << 26, 2_000])
def test_ids_equal_the_library(spark, documents, monkeypatch, chunk_bytes):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk_bytes)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    pool = "ab'sd tLl12é\n \t\r\x1c\x85　中\U0001f600ß१Ⅷ²́'\"!.\x00<|endoftext|>"
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "x" * 30_000, prose(1, 5_000)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(8, texts[8]), (None, texts[9]), (None, texts[10])]
    got = bpe.encode_texts(documents(rows), bpe.given_vocabulary(), with_ids=True)
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode()), ids))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    unique = got.filter("doc_id is not null and doc_id <> 8").select("doc_id", "ids")
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(unique, bpe.given_vocabulary()).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts) if i != 8}
    assert bpe.encode_texts(documents(rows).limit(0), bpe.given_vocabulary()).count() == 0


def test_words_of_a_chunk_take_little_memory(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(bpe, "LOOKED_UP", 3)
    vocabulary = bpe.given_vocabulary()
    kind, pieces, pack = vocabulary.id_type(), vocabulary.piece_encoder(), zstandard.ZstdCompressor().compress
    words = ["some", " some", " words", " é", *[f" w{i}" for i in range(100_000)]]
    ids = [np.array(pieces.encode_ordinary(w), dtype=kind).tobytes() for w in words]
    dictionary = pa.concat_tables([pa.table({"word": pa.array(words[a:b], pa.string()), "ids": pa.array(ids[a:b], pa.binary())}) for a, b in ((0, 5), (5, 5), (5, len(words)))])
    texts = ["", "some words é", "", " é", "some words words words é some", " words"]
    packed = pa.table({"row": list(range(6)), "packed": pa.array([pack(t.encode()) for t in texts], pa.binary())})
    reassemble = bpe._reassemble(vocabulary, True)
    none = packed.slice(0, 0)

    def most(words):
        tracemalloc.start()
        reassemble(none, words)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert most(dictionary) - most(dictionary.slice(0, 0)) < 20 * len(words)  # bytes; 194 with a Python object for each
    got = reassemble(packed, dictionary).to_pylist()
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    assert [r["ids"] for r in got] == [library.encode_ordinary(t) for t in texts]
    assert [r["decoded_sha256"] for r in got] == [digest(t.encode()) for t in texts]


def test_chunks_spread_equal_ids(spark, documents):
    dealt = chunks.deal(documents([(1, f"t{i} " * 100) for i in range(50)]), "doc_id", "text", 2_000)
    assert dealt.select("chunk").distinct().count() > 3


def item(i):
    return f"{prose(1000 + i, 25, 10**5)}. The answer is {prose(2000 + i, 6, 10**5)}"


def test_leaks_are_found_wherever_they_stand(spark, documents):
    items = [(i, item(i)) for i in range(40)] + [(50, "too short"), (51, None), (52, ""), (7, item(7))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{prose(i, 7 * i % 300)} {item(i).upper()} {prose(i + 50, 11 * i % 200)}") for i in range(30)]
    rows += [(100 + i, prose(5000 + i, 400, 10**5)) for i in range(20)]
    broken = item(35).split()
    broken[3] = "changed"
    rows += [(200, " ".join(broken)), (201, " ".join(item(36).split()[:12])), (202, item(37) + "\n" + item(38)), (203, None), (204, ""),
             (205, "too short"), (3, rows[3][1]), (None, item(39)), (206, prose(9, 30_000) + item(34))]
    got = leaks.find_leaks(documents(rows), benchmark).collect()
    want = [(i, i) for i in range(30)] + [(7, 7), (3, 3), (200, 35), (202, 37), (202, 38), (None, 39), (206, 34)]
    assert sorted([(r.doc_id, r.item_id) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.overlap >= 0.8 and r.score > 0.6 for r in got)
    df = documents(rows)
    clean = leaks.drop_leaks(df, benchmark)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {*range(100, 120), 201, 203, 204, 205}
    assert leaks.find_leaks(df.limit(0), benchmark).count() == 0 and leaks.find_leaks(df, benchmark.limit(0)).count() == 0


def test_a_large_benchmark_is_searched_index_by_index(spark, documents, monkeypatch):
    monkeypatch.setattr(leaks, "INDEX_BYTES", 3_000)
    benchmark = spark.createDataFrame([(i, item(i)) for i in range(40)], "item_id long, text string")
    got = leaks.find_leaks(documents([(i, item(i)) for i in range(40)]), benchmark)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(40)]


BODY = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='nav'><header>Site <b>name</b></header>"
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-banner'>We use cookies</div><main><article><header><h1>Head &amp line</h1>"
    "</header><p>First&nbsp; <i>para</i>graph<br>goes on<p>Second<script>var t='</p>';</script> one<div class='ad'>Buy</div>"
    "<form><input><button>Go</button></form><ul><li>a<li>b</ul><table><tr><td>x<td>y</table></article>"
    "<section id=readerComments><p>Reader says</p></section><div class='ad300'>Ad</div><p style='display: none'>no</p></main><aside>Side</aside><footer>&copy; Site</footer>"
)


def test_marked_pages():
    marks = pages.read_blocks(BODY)
    text = [t for t, mark in marks if mark == pages.MAIN]
    assert text == ["Head & line", "First paragraph goes on", "Second one", "a", "b", "x", "y"]
    assert not [t for t, mark in marks if mark == pages.UNMARKED]
    assert pages.read_blocks("") == pages.read_blocks(None) == [] and pages.read_blocks("a < b &am; <p>c") == [("a < b &am;", 0), ("c", 0)]


def test_unmarked_pages_lose_what_their_neighbour_has(spark):
    def html(i, lines):
        return f"<div>My site</div><div>Go to top</div>{''.join(f'<p>{x}</p>' for x in lines)}<div>All rights {'x' * (i % 1)}reserved</div>"

    rows = [(i, f"http://h.org/news/{i:03}", html(i, [f"only {i}", f"and {i}"])) for i in range(40)]
    rows += [(50, "http://lone.org/a", html(0, ["lone"])), (51, None, html(0, ["no url"])), (52, "http://h.org/news/001", None),
             (53, "http://copy.org/a", html(0, ["same"])), (54, "http://copy.org/b", html(0, ["same"])), (55, "http://m.org/x", BODY), (55, "http://m.org/x", BODY)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as page", "'x' as text", "2 as drop").repartition(5)
    got = pages.main_texts(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"only {i}\nand {i}" for i in range(40) if i not in (0, 1, 2))
    assert text[50].split("\n") == ["My site", "Go to top", "lone", "All rights reserved"] and "no url" in text[51]
    assert text[52] == "" and "same" in text[53] and "same" in text[54] and text[55].startswith("Head & line\n")
    assert pages.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_comparison_passes_over_copies_and_serves_marked_pages(spark, parts):
    def html(own, teaser=""):
        return f"<div>My site</div><div>Go to top</div><div>{own}</div>{teaser}<div>All rights reserved</div>"

    rows = [(i, f"http://h.org/a/{i:02}", html("copied")) for i in range(12)]
    rows += [(20, "http://h.org/b/1", html("plain text", "<article>teaser</article>")), (21, "http://h.org/b/2", html("another"))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in range(12)] == ["copied"] * 12
    assert text[20] == "plain text\nteaser" and text[21] == "another"


def test_common_lines_is_a_longest_common_subsequence():
    import numpy as np

    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(12))]
        b = [rng.randrange(6) for _ in range(rng.randrange(12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        shared = pages.common_lines(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        picked, at = [x for x, s in zip(a, shared) if s], 0
        for x in b:
            at += at < len(picked) and x == picked[at]
        assert at == len(picked) == table[-1][-1]
