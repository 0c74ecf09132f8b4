"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Passages are overlapping windows of words, twice as long as the longest item, so that an item that stands in a
text lies within one of them. Impacts are normalised so that 1 is the threshold of each item: then the largest
impact of a term in a block of items bounds what any of them can gain from it. For a window and a block these bounds are
summed, and only where they reach 1 the items of the block are scored (block-max WAND). All items above the threshold are
retrieved; those whose shingles stand in the window are reported. The windows of a slice are worked on together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.functions.durable import broadcast_if_small
from basketwise.llm.store import kept, table
from basketwise.llm.words import Words, shingles

K1, B = 1.2, 0.75
#: Blocks of the items, alike in length.
BLOCKS = 16
#: Share of the score that an item has for its own words from which a window is verified.
LEAST_SCORE = 0.6
#: Shares of the item's, its question's and its answer's parts that must stand in the window.
LEAST_OVERLAP, LEAST_ANSWER = 0.8, 0.5
SHINGLE = 5
#: Bytes of items in one index; a larger benchmark is searched index by index.
INDEX_BYTES = 16 << 20
_LAST_SENTENCE = re.compile(r"[.!?:]\s+(?=\S)|\n+(?=\S)")


def split_answer(text: str) -> int:
    """Where the answer starts: after the last sentence end or line break within the text; 0 if there is none."""
    at = 0
    for found in _LAST_SENTENCE.finditer(text):
        at = found.end()
    return at


class ItemIndex:
    """BM25 impacts of items by term, in blocks, and the items' shingles."""

    def __init__(self, items: list[tuple[object, str]]):
        """Items of fewer than five words are left out: they can't be told from chance. Null texts count as empty."""
        words = Words()
        parts = []
        for item_id, text in sorted(items, key=lambda x: (len((x[1] or "").split()), repr(x[0]))):
            text = text or ""
            cut = split_answer(text)
            halves = [self._hashes(words, h) for h in (text, text[cut:])]
            if len(halves[0]) >= SHINGLE:
                parts.append((item_id, *halves))
        self.ids = [p[0] for p in parts]
        self.longest = max((len(p[1]) for p in parts), default=0)
        self.shingles = [np.unique(shingles(p[1], np.array([0, len(p[1])]), SHINGLE)[0]) for p in parts]
        self.answers = [np.unique(p[2]) for p in parts]
        n = len(parts)
        of_item = np.repeat(np.arange(n), [len(p[1]) for p in parts])
        every = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.terms, term = np.unique(every, return_inverse=True)
        pairs, tf = np.unique(np.stack([term, of_item]), axis=1, return_counts=True) if n else (np.zeros((2, 0), np.int64), np.zeros(0))
        df = np.bincount(pairs[0], minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        lengths = np.bincount(of_item, minlength=n)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        impact = idf[pairs[0]] * tf * (K1 + 1) / (tf + norm[pairs[1]])
        own = np.bincount(pairs[1], weights=impact, minlength=n)
        impact = impact / (LEAST_SCORE * own[pairs[1]])
        self.items, self.impacts = pairs[1], impact
        self.first = np.searchsorted(pairs[0], np.arange(len(self.terms) + 1))
        # the largest impact of each term in each block
        self.block = np.arange(n) * BLOCKS // max(1, n)
        self.block_max = np.zeros((len(self.terms), BLOCKS))
        np.maximum.at(self.block_max, (pairs[0], self.block[pairs[1]]), impact)

    @staticmethod
    def _hashes(words: Words, text: str) -> np.ndarray:
        return np.concatenate([s.hashes for s in words.slices(pa.array([text]))])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for words of no item."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, places: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) of all items above the threshold 1; window i holds the words start[i] to stop[i]."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        counts = stop - start
        window = np.repeat(np.arange(len(start)), counts)
        term = places[np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(len(window))]
        pairs = np.unique(window[term >= 0] * len(self.terms) + term[term >= 0])  # a word counts once
        if not len(pairs):
            return none
        window, term = np.divmod(pairs, len(self.terms))
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        bound = np.add.reduceat(self.block_max[term], first, axis=0)
        opened = np.zeros((len(start), BLOCKS), dtype=bool)
        opened[window[first]] = bound >= 1 - 1e-9
        some = opened.any(axis=1)[window]
        window, term = window[some], term[some]
        counts = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        window, item = np.repeat(window, counts), self.items[at]
        scored = opened[window, self.block[item]]
        codes, inverse = np.unique(window[scored] * len(self.ids) + item[scored], return_inverse=True)
        if not len(codes):
            return none
        scores = np.bincount(inverse, weights=self.impacts[at[scored]])
        above = scores >= 1 - 1e-9
        window, item = np.divmod(codes[above], len(self.ids))
        return window, item, scores[above]

    def overlaps(self, item: int, window: np.ndarray) -> tuple[float, float]:
        """Shares of the item's shingles and of its answer's words that stand in the window."""
        seen, _ = shingles(window, np.array([0, len(window)]), SHINGLE)
        mine, answer = self.shingles[item], self.answers[item]
        share = np.isin(mine, seen).mean()
        return float(share), float(np.isin(answer, window).mean()) if len(answer) else 1.0


def _query(index: ItemIndex, id_type: pa.DataType, item_type: pa.DataType):
    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = Words(), max(index.longest, SHINGLE)
        for batch in batches:
            ids, hits = batch.column("row"), []
            for part in words.slices(batch.column("text")):
                places = index.places(part.hashes)
                lengths = np.diff(part.bounds)
                windows = np.maximum(1, -(-(lengths - step) // step))  # the last one reaches the end
                unit = np.repeat(np.arange(len(lengths)), windows)
                start = part.bounds[:-1][unit] + step * (np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows))
                stop = np.minimum(start + 2 * step, part.bounds[1:][unit])
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for w, item, score in zip(*index.search(places, start, stop)):
                    share, answer = index.overlaps(item, part.hashes[start[w] : stop[w]])
                    if share >= LEAST_OVERLAP and answer >= LEAST_ANSWER:
                        key = (int(part.rows[unit[w]]), int(item))
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, answer, float(score) * LEAST_SCORE))
                hits.extend((*key, *value) for key, value in best.items())
            rows, items, shares, answers, scores = zip(*hits) if hits else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())).cast(id_type),
                    pa.array([index.ids[i] for i in items], item_type),
                    pa.array(shares, pa.float64()),
                    pa.array(answers, pa.float64()),
                    pa.array(scores, pa.float64()),
                ],
                ["row", "item", "overlap", "answer_overlap", "score"],
            )

    return query


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document row and item it holds: (id, item_id, overlap, answer_overlap, score).

    ``overlap`` is the share of the item's five-word shingles in the best window, ``score`` its BM25 score as a share
    of the item's own. Null and empty texts hold nothing, items of fewer than five words are held by nothing. Repeated
    rows and items are reported each. Without items or documents there are no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tests = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = int(size // INDEX_BYTES) + 1
    kinds = [f.dataType for f in (texts.schema["row"], tests.schema["item"])]
    ddl = f"row {kinds[0].simpleString()}, item {kinds[1].simpleString()}, overlap double, answer_overlap double, score double"
    found = None
    for shard in range(shards):  # one index unless the benchmark is larger than INDEX_BYTES
        mine = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        index = ItemIndex([(r["item"], r["text"]) for r in mine.collect()])
        hits = texts.mapInArrow(_query(index, *map(to_arrow_type, kinds)), ddl)
        hits = hits if shards == 1 else kept(hits, "leaks")
        found = hits if found is None else found.unionByName(hits)
    return found.withColumnsRenamed({"row": id_col, "item": item_id})


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns. Rows that share an id are one document."""
    leaked = find_leaks(docs, items).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(broadcast_if_small(leaked), F.col("doc_id").eqNullSafe(F.col("_leaked")), "left_anti")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item it holds."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
