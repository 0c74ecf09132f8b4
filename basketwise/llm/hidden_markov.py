"""A hidden Markov language model trained by Baum-Welch over all training texts.

A latent state emits the class of a word (from its last bytes), the class gives the word by its corpus count:
P(text) = P(classes | model) * product of P(word | class). The class part has a size of its own choosing and goes to
every task; the word counts grow with the corpus and stay a distributed table that is joined. Expected counts are
made per task and summed by class.

The forward recursion is exact for texts of any length: a text is cut into blocks, the recursion of a block is run
from every state at once, which gives a matrix per block, and the matrices are multiplied in order. Blocks of all texts run
side by side in NumPy; each step is scaled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.functions.durable import scratch_path
from basketwise.llm.chunks import deal, unpack, words_of_chunks
from basketwise.llm.store import kept, table
from basketwise.llm.words import Slice, Words, mix

STATES = 6
#: Classes of words; the end of a text is one more.
CLASSES = 1 << 14
#: Tokens of a block of the recursion.
BLOCK = 64
#: Steps between two scalings of a block's matrix; a step shrinks it by the least emission at most, some 1e-17.
SCALE_STEPS = 8
#: Shards of the training texts, each read by one of the first rounds; then come rounds over all training texts.
WARM_ROUNDS, ROUNDS = 12, 2
#: What the counts of earlier shards weigh beside those of the next one.
KEEP = 0.5
CHUNK_BYTES = 32 << 20


class Model(NamedTuple):
    start: np.ndarray  # of the state before the first token
    move: np.ndarray
    emit: np.ndarray  # class by state


def word_classes(part: Slice) -> np.ndarray:
    """The class of each word, from its last four bytes (A-Z lower-cased)."""
    lower = part.data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    code = np.zeros(len(part.starts), dtype=np.uint64)
    for back in range(1, 5):
        at = part.ends - back
        code = code * np.uint64(257) + np.where(at >= part.starts, lower[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code + np.uint64(1)) >> np.uint64(64 - CLASSES.bit_length() + 1)).astype(np.int64)


class Blocks:
    """The class sequences of a slice's texts, each with its end, cut into blocks (columns) of BLOCK steps (rows).

    Longer blocks stand before shorter ones, so those that still go on at a step are the first columns. Arrays have a
    block's or text's values in their last axis, the states before it.
    """

    def __init__(self, classes: np.ndarray, bounds: np.ndarray):
        lengths = np.diff(bounds) + 1
        self.texts = len(lengths)
        self.per_text = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(self.per_text)])
        n = int(first[-1])
        grid = np.full(n * BLOCK, -1, dtype=np.int64)  # -1: after the end
        text = np.repeat(np.arange(self.texts), lengths - 1)
        grid[first[:-1][text] * BLOCK + np.arange(len(classes)) - (bounds[:-1] - bounds[0])[text]] = classes
        grid[first[:-1] * BLOCK + lengths - 1] = CLASSES
        grid = grid.reshape(n, BLOCK)
        sizes = np.full(n, BLOCK)
        sizes[first[1:] - 1] = lengths - (self.per_text - 1) * BLOCK
        columns = np.argsort(-sizes, kind="stable")
        self.grid = np.ascontiguousarray(grid[columns].T)
        self.live = np.searchsorted(-sizes[columns], -np.arange(BLOCK), side="left")  # columns that have step t
        self.column = np.empty(n, dtype=np.int64)  # of the blocks, text by text
        self.column[columns] = np.arange(n)
        self.first = first
        self.steps = int(self.per_text.max()) if self.texts else 0
        self.order = np.argsort(-self.per_text, kind="stable")

    def emissions(self, m: Model) -> list[np.ndarray]:
        """What each state gives for each step of the blocks that have it."""
        emit = np.ascontiguousarray(m.emit.T)
        return [emit.take(classes[:live], axis=1) for classes, live in zip(self.grid, self.live)]

    def matrices(self, m: Model, emissions: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled product over each block of move and emission, from every state (first axis), and its log scale."""
        n, s = self.grid.shape[1], len(m.start)
        product = np.repeat(np.eye(s)[:, :, None], n, axis=2)
        scale, move = np.zeros(n), np.ascontiguousarray(m.move.T)
        for t, given in enumerate(self.emissions(m) if emissions is None else emissions):
            live = given.shape[1]
            if not live:
                break
            step = np.matmul(move, product[:, :, :live])
            step *= given
            if t % SCALE_STEPS == SCALE_STEPS - 1:  # what a shorter block lacks, the text's recursion scales
                norm = step.max(axis=(0, 1))
                step /= norm
                scale[:live] += np.log(norm)
            if live == n:
                product = step
            else:
                product[:, :, :live] = step
        return product, scale

    def _texts_at(self, k: int) -> np.ndarray:
        """Texts that have a k-th block."""
        return self.order[: int(np.searchsorted(-self.per_text[self.order], -k, side="left"))]

    def forward(self, m: Model, product: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state distribution before each block, log likelihood of each text)."""
        state = np.repeat(m.start[:, None], self.texts, axis=1)
        logs = np.zeros(self.texts)
        before = np.zeros((len(m.start), len(scale)))
        for k in range(self.steps):
            texts = self._texts_at(k)
            block = self.column[self.first[texts] + k]
            here = state[:, texts]
            before[:, block] = here
            after = np.einsum("in,ijn->jn", here, product[:, :, block])
            norm = after.sum(axis=0)
            state[:, texts] = after / norm
            logs[texts] += np.log(norm) + scale[block]
        return before, logs

    def backward(self, m: Model, product: np.ndarray) -> np.ndarray:
        """Scaled likelihood of what follows each block, by the state at its end."""
        rest = np.ones((len(m.start), self.texts))
        after = np.zeros((len(m.start), product.shape[2]))
        for k in range(self.steps - 1, -1, -1):
            texts = self._texts_at(k)
            block = self.column[self.first[texts] + k]
            here = rest[:, texts]
            after[:, block] = here
            back = np.einsum("ijn,jn->in", product[:, :, block], here)
            rest[:, texts] = back / back.sum(axis=0)
        return after

    def expected(self, m: Model, counts: Model) -> float:
        """Add the expected counts of starts, moves and emissions; the log likelihood."""
        emissions = self.emissions(m)
        product, scale = self.matrices(m, emissions)
        before, logs = self.forward(m, product, scale)
        beta = self.backward(m, product)
        move = np.ascontiguousarray(m.move.T)
        alphas = [before]
        for given in emissions:
            alpha = move @ alphas[-1][:, : given.shape[1]]
            alpha *= given
            alpha /= alpha.sum(axis=0)
            alphas.append(alpha)
        for t in range(BLOCK - 1, -1, -1):
            live = int(self.live[t])
            if not live:
                continue
            alpha, later = alphas[t][:, :live], beta[:, :live]
            onward = emissions[t] * later
            both = np.multiply(alphas[t + 1], later, out=emissions[t])  # its emissions are done with
            both /= both.sum(axis=0)
            back = m.move @ onward
            onward /= (alpha * back).sum(axis=0)
            counts.move[:] += m.move * (alpha @ onward.T)
            beta[:, :live] = back / back.sum(axis=0)
        seen = np.concatenate([classes[:live] for classes, live in zip(self.grid, self.live)])
        for s, weights in enumerate(np.concatenate(emissions, axis=1)):
            counts.emit[:, s] += np.bincount(seen, weights=weights, minlength=CLASSES + 1)
        opening = self.column[self.first[:-1]]
        firsts = before[:, opening] * beta[:, opening]
        counts.start[:] += (firsts / firsts.sum(axis=0)).sum(axis=1)
        return float(logs.sum())


def starting_model(states: int = STATES) -> Model:
    """Sticky states with emissions that differ at random, the same on every run."""
    random = np.random.default_rng(7)
    emit = random.gamma(1.0, 1.0, (CLASSES + 1, states)) + 0.05
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _expected_counts(model: Model):
    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expected counts of the task: a row per class, one for the starts (-1) and one per state's moves (-2 - state)."""
        words = Words()
        counts = Model(*[np.zeros_like(x) for x in model])
        for batch in batches:
            for part in words.slices(batch.column("text")):
                Blocks(word_classes(part), part.bounds).expected(model, counts)
        some = np.flatnonzero(counts.emit.any(axis=1))
        keys = np.concatenate([some, [-1], -2 - np.arange(len(counts.start))])
        rows = np.concatenate([counts.emit[some], counts.start[None, :], counts.move])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(rows[:, s]) for s in range(rows.shape[1])]], ["class", *_columns(model)])

    return expected


def _columns(model: Model) -> list[str]:
    return [f"s{i}" for i in range(len(model.start))]


def gather_counts(texts: DataFrame, model: Model) -> Model:
    """Expected counts over all texts: made per task, summed by class."""
    names = _columns(model)
    parts = texts.select("text").mapInArrow(_expected_counts(model), "class long, " + ", ".join(f"{c} double" for c in names))
    summed = parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in names])
    counts = Model(*[np.zeros_like(x) for x in model])
    for row in summed.toLocalIterator():  # CLASSES + STATES rows, whatever the input
        key, values = row[0], list(row)[1:]
        if key >= 0:
            counts.emit[key] = values
        elif key == -1:
            counts.start[:] = values
        else:
            counts.move[-2 - key] = values
    return counts


def fitted(counts: Model, model: Model) -> Model:
    """The counts, smoothed and normalised; without any the model stays, as equal emissions of all states could never part again."""
    if not counts.emit.any():
        return model
    share = (counts.emit.sum(axis=1, keepdims=True) + 0.1) / (counts.emit.sum() + 0.1 * len(counts.emit))
    emit = counts.emit + share * 2.0 + 1e-6
    start, move = counts.start + 0.1, counts.move + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _in_shards(texts: DataFrame, shards: int) -> list[DataFrame]:
    """The texts, written once, as frames that together hold every row; rows are dealt by id and text."""
    path = scratch_path(texts.sparkSession, "shards")
    dealt = texts.select("text", F.pmod(F.xxhash64("row", "text"), F.lit(shards)).cast("int").alias("shard"))
    dealt.write.partitionBy("shard").parquet(path)
    stored = texts.sparkSession.read.schema("text string, shard int").parquet(path)
    return [stored.filter(F.col("shard") == k).select("text") for k in range(shards)]


def train(texts: DataFrame, states: int = STATES, warm_rounds: int = WARM_ROUNDS, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over ``texts`` (row, text).

    The first rounds read one shard each, all texts together, and step on with the counts so far (stepwise EM): the model
    changes ``warm_rounds`` times in one reading, at every size. Every round after that reads all.
    """
    model = starting_model(states)
    counts = Model(*[np.zeros_like(x) for x in model])
    for shard in _in_shards(texts, warm_rounds) if warm_rounds else []:
        more = gather_counts(shard, model)
        if more.emit.any():
            counts = Model(*[KEEP * old + new for old, new in zip(counts, more)])
            model = fitted(counts, model)
    for _ in range(rounds):
        model = fitted(gather_counts(texts, model), model)
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of the task, handed on whenever there are many."""
    from collections import Counter

    def rows():
        items = list(counts.items())
        for i in range(0, len(items), 100_000):
            some = items[i : i + 100_000]
            words = pa.array([w for w, _ in some], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array([c for _, c in some], pa.int64())], ["word", "c"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(text.as_py().encode().lower().split())
            if len(counts) > 500_000:
                yield from rows()
                counts.clear()
    yield from rows()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts."""
    return texts.select("text").mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    total, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        c = batch.column("c").to_numpy()
        for part in words.slices(batch.column("word")):
            of = word_classes(part)
            total += np.bincount(of, weights=c[part.rows], minlength=CLASSES).astype(np.int64)
            kinds += np.bincount(of, minlength=CLASSES)
    some = np.flatnonzero(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(kinds[some])], ["class", "n", "v"])


class _Totals(NamedTuple):
    tokens: int  # training tokens, ends included
    texts: int
    types: int  # distinct training tokens, the end included
    class_tokens: np.ndarray
    class_types: np.ndarray


def _score(model: Model, totals: _Totals):
    def score(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        """Scores of a chunk's texts; the dictionary has the counts of those of its words that occur in training."""
        words = Words()
        hashes = [s.hashes for s in words.slices(dictionary.column("word"))]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], dictionary.column("c").to_numpy()[order]
        base_norm = np.log10(totals.tokens + totals.types + 1)
        out = []
        for batch in texts.select(["row", "held_out", "packed"]).to_batches(max_chunksize=2_000):
            for part in words.slices(unpack(batch.column("packed"))):
                c = np.zeros(len(part.hashes), dtype=np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, part.hashes), len(hashes) - 1)
                    c = np.where(hashes[at] == part.hashes, counts[at], 0)
                classes = word_classes(part)
                blocks = Blocks(classes, part.bounds)
                _, logs = blocks.forward(model, *blocks.matrices(model))
                given = np.log10((c + 1) / (totals.class_tokens[classes] + totals.class_types[classes] + 1))

                def per_text(values):
                    total = np.add.reduceat(np.append(values, 0), part.bounds[:-1]) if len(part.rows) else values
                    return np.where(np.diff(part.bounds) > 0, total, 0)

                rows = slice(int(part.rows[0]), int(part.rows[-1]) + 1)
                n = len(part.rows)
                out.append(
                    pa.table(
                        {
                            "row": batch.column("row")[rows],
                            "held_out": batch.column("held_out")[rows],
                            "n_tokens": np.diff(part.bounds) + 1,
                            "n_known": per_text((c > 0).astype(np.int64)) + int(totals.texts > 0),
                            "train_tokens": np.full(n, totals.tokens),
                            "base_score": per_text(np.log10(c + 1) - base_norm) + np.log10(totals.texts + 1) - base_norm,
                            "score": logs / np.log(10) + per_text(given),
                        }
                    )
                )
        return pa.concat_tables(out)

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose crc32 of the id as text leaves 2 modulo 7 are held out of all training; a null id counts as the
    empty text. Null and empty texts are one token, the end. Repeated rows count as often as they stand there. An empty
    table gives no rows; without training rows every word is unknown and the model is the starting one.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held_out = F.pmod(F.crc32(id_text.cast("binary")), F.lit(7)) == 2
    whole = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = docs.filter(~held_out).select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = kept(count_words(training), "counts")
    n_texts = training.count()
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = counts.mapInArrow(_class_sizes, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    class_tokens, class_types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for of, n, v in sizes.toLocalIterator():  # CLASSES rows at most
        class_tokens[of], class_types[of] = n, v
    totals = _Totals(tokens + n_texts, n_texts, types + int(n_texts > 0), class_tokens, class_types)
    model = train(training, states, rounds=rounds) if n_texts else starting_model(states)

    dealt = deal(whole, "row", "text", CHUNK_BYTES)
    dealt_id = F.coalesce(F.col("row").cast("string"), F.lit(""))
    dealt = dealt.withColumn("held_out", F.pmod(F.crc32(dealt_id.cast("binary")), F.lit(7)) == 2)
    words = words_of_chunks(dealt, lambda: lambda text: text.encode().lower().split())
    known = words.join(counts, "word").select("chunk", "word", "c")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(model, totals), schema)
    return scored.withColumnRenamed("row", id_col)


def op3_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability under the hidden Markov model and under the unigram base."""
    return score_texts(table(spark, folder, "documents"))
