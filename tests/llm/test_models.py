"""Language ID and the hidden Markov model."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from texts import prose

from basketwise.llm import hidden_markov as hmm, language_id as lang
from basketwise.llm.words import Words

SENTENCES = {
    "en": "the weather in the north was cold and the people of the town stayed inside with their books",
    "fr": "le temps dans le nord est froid et les gens de la ville restent chez eux avec leurs livres",
    "de": "das wetter im norden war kalt und die leute der stadt blieben mit ihren büchern zu hause",
    "es": "el tiempo en el norte era frío y la gente de la ciudad se quedaba en casa con sus libros",
}


def rows_of(n=40):
    rows = []
    for k, (code, text) in enumerate(SENTENCES.items()):
        words = text.split()
        rows += [(k * 1000 + i, " ".join(words[i % 5 :] + words[: i % 5]), code, f"src{k}") for i in range(n)]
    return rows


def test_languages_and_edges(spark, documents):
    extra = [(9001, None, "en", "src0"), (9002, "", None, None), (9003, "123 !? |", "fr", "src1"), (9004, "the books of the town", None, None),
             (9005, SENTENCES["de"], "en", "src2"), (0, rows_of()[0][1], "en", "src0"), (None, SENTENCES["es"], "es", "src3"),
             (9006, "zu", "de", "src2"), (9007, SENTENCES["fr"] * 3_000, "fr", "other")]
    df = documents(rows_of() + extra)
    got = lang.identify_documents(df, ["doc_id"]).collect()
    assert len(got) == 160 + len(extra)
    by_id = {r.doc_id: r for r in got}
    for i, _, code, _ in rows_of():
        assert by_id[i].language == code and by_id[i].kept
    assert [by_id[i].language for i in (9001, 9002, 9003)] == ["und"] * 3 and not by_id[9001].kept
    assert by_id[9004].language == "en" and by_id[9005].language == "de" and by_id[9006].language == "de"
    assert by_id[None].language == "es" and by_id[9007].language == "fr"
    kept = lang.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(got) - 3
    assert sorted(kept.filter("doc_id = 0").select("text", "row").distinct().collect())[0].row == "row"
    assert lang.identify_documents(df.limit(0), ["doc_id"]).count() == 0


def test_evidence_beside_the_text(spark, documents):
    """Where the text says nothing, the declared language and the host decide; a rare host leans on its suffix."""
    df = documents(rows_of())
    model = lang.fit_trigrams(df.select(F.col("lang").alias("label"), "text"))
    suffix = F.substring("source", -1, 1)
    got = lang.identify(df, F.col("text"), F.col("lang"), F.lit(None), F.col("source"), suffix, model, ["doc_id"]).collect()
    told = {r.doc_id: r for r in got}
    assert told[1001].language == "fr" and told[2001].posterior > 0.9
    lone = documents(rows_of() + [(7005, "xq", "fr", "src1"), (7006, "xq", None, "src2")])
    told = {r.doc_id: r.language for r in lang.identify_documents(lone, ["doc_id"]).collect()}
    assert told[7005] == "fr" and told[7006] == "de"


def test_forward_and_counts_are_exact():
    model = hmm.starting_model(3)
    texts = ["a b c", "", None, "x " * 200 + "end foo", "hello World", "one two three"]
    for part in Words().slices(pa.array(texts)):
        classes = hmm.word_classes(part)
        blocks = hmm.Blocks(classes, part.bounds)
        _, logs = blocks.forward(model, *blocks.matrices(model))
        counts = hmm.Model(*[np.zeros_like(x) for x in model])
        total = blocks.expected(model, counts)
        want = hmm.Model(*[np.zeros_like(x) for x in model])
        for i in range(len(texts)):
            seen = [*classes[part.bounds[i] : part.bounds[i + 1]], hmm.CLASSES]
            alphas, log = [model.start], 0.0
            for o in seen:
                a = alphas[-1] @ model.move * model.emit[o]
                log += math.log(a.sum())
                alphas.append(a / a.sum())
            assert logs[i] == pytest.approx(log)
            beta = np.ones(3)
            for t in range(len(seen) - 1, -1, -1):
                gamma = alphas[t + 1] * beta
                want.emit[seen[t]] += gamma / gamma.sum()
                xi = alphas[t][:, None] * model.move * (model.emit[seen[t]] * beta)[None, :]
                want.move[:] += xi / xi.sum()
                beta = model.move @ (model.emit[seen[t]] * beta)
                beta /= beta.sum()
            want.start[:] += alphas[0] * beta / (alphas[0] * beta).sum()
        assert total == pytest.approx(logs.sum())
        for got, exact in zip(counts, want):
            assert np.allclose(got, exact)


def test_the_least_emissions_are_scaled_in_time():
    """Blocks of all lengths, in columns by length; emissions as small as a model of 30 GB has them."""
    model = hmm.starting_model(3)
    model = model._replace(emit=model.emit * 1e-17 / model.emit.max())
    for part in Words().slices(pa.array(["w " * n for n in (0, 1, 7, 8, 62, 63, 64, 200, 500)])):
        classes = hmm.word_classes(part)
        blocks = hmm.Blocks(classes, part.bounds)
        assert blocks.live.tolist() == [int((row >= 0).sum()) for row in blocks.grid] == sorted(blocks.live, reverse=True)
        _, logs = blocks.forward(model, *blocks.matrices(model))
        for i in range(len(logs)):
            state, log = model.start, 0.0
            for o in [*classes[part.bounds[i] : part.bounds[i + 1]], hmm.CLASSES]:
                state = state @ model.move * model.emit[o]
                log += math.log(state.sum())
                state = state / state.sum()
            assert logs[i] == pytest.approx(log)


def test_probabilities_add_up():
    """Over all words a class can give, and over all classes a state can."""
    model = hmm.starting_model(4)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_scores_equal_plain_python(spark, documents, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK_BYTES", 4_000)
    rows = [(i, f"{prose(i, 30 + i % 50)} {SENTENCES[list(SENTENCES)[i % 4]]}") for i in range(120)]
    rows += [(500, None), (501, ""), (502, "W1 É é unseen-word"), (3, rows[3][1]), (3, rows[3][1]), (None, "no id here"), (503, "w1 " * 30_000)]
    got = hmm.score_texts(documents(rows), states=3, rounds=1).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    counts, training = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(split(t))
            training += 1
    tokens, types = sum(counts.values()) + training, len(counts) + 1
    want = []
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((counts[w] + 1) / (tokens + types + 1)) for w in words) + math.log10((training + 1) / (tokens + types + 1))
        want.append((i, held(i), len(words) + 1, sum(w in counts for w in words) + 1, tokens, round(base, 5)))
    assert sorted([(*tuple(r)[:5], round(r.base_score, 5)) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score_texts(documents([(1, "x")]).limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    from basketwise.llm.queries import QUERIES

    rows = QUERIES["op3_hmm_score"](spark, "/root/testdata/sf0.001").filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_without_training_rows(spark, documents):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score_texts(documents([(only, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and math.isfinite(row.score)


def test_training_reads_every_text_and_keeps_its_states_apart(spark, monkeypatch):
    """Many copies of few texts too, whichever way their hashes fall."""
    texts = spark.createDataFrame([(f"{prose(i, 20)} z{i}",) for i in range(40)], "text string")
    texts = texts.filter("pmod(xxhash64(text), 3) <> 0").limit(2).crossJoin(spark.range(6_000 // 2).withColumnRenamed("id", "row")).select("row", "text")
    read, gather = [], hmm.gather_counts

    def counted(some, model):
        read.append(some.count())
        return gather(some, model)

    monkeypatch.setattr(hmm, "gather_counts", counted)
    model = hmm.train(texts, states=2, rounds=1)
    assert sum(read[:-1]) == read[-1] == 6_000 and len(read) == hmm.WARM_ROUNDS + 1 and min(read) > 0
    assert abs(model.emit[:, 0] - model.emit[:, 1]).max() > 0.01
    empty = hmm.train(texts.limit(0), states=2, rounds=1)
    assert all((a == b).all() for a, b in zip(empty, hmm.starting_model(2)))
