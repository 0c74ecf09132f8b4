"""Exact Jaccard join of word-shingle sets: candidates from a prefix index, links from a prefix tree.

Every set is held in one global order, common shingles last. Two sets as similar as asked share a shingle
among their first ones (their prefixes), so sets meet by the shingles of their prefixes. The sets that meet one
probe are then visited in the order of their sequences: that walks the tree of their common beginnings, overlaps are
counted once per shared beginning, and whole subtrees are left as soon as what remains can't suffice.

Equal sets are one set throughout, so a group of copies is one row from the first shuffle on. Groups of near copies are
linked along a chain first; after that only sets of different components are compared, so a group of any size
isn't paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.functions.durable import broadcast_if_small
from basketwise.llm.set_links import similar_in_buckets
from basketwise.llm.store import kept, table
from basketwise.llm.words import MARK_WORDS, Words, distinct_per_unit, list_array, mix, parity_marks, shingles, wide_marks

SHINGLE = 5
#: Counters of the frequency sketch, whose size doesn't depend on the input. They only set the global order; any
#: order gives the same links.
BINS = 1 << 22
SEGMENT = 1 << 12
_BITS = np.uint64(58)  # a token is its level of frequency (6 bits) and 58 bits of its hash


def _distinct_shingles(part) -> tuple[np.ndarray, np.ndarray]:
    return distinct_per_unit(*shingles(part.hashes, part.bounds, SHINGLE))


def _bin(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the task the shingles of each counter occur, segment by segment."""
    import zlib

    words, counts = Words(), np.zeros(BINS, dtype=np.int32)
    for batch in batches:
        for part in words.slices(batch.column("text")):
            values, _ = _distinct_shingles(part)
            at, n = np.unique(_bin(values), return_counts=True)
            counts[at] += n.astype(np.int32)
    full = [s for s in range(BINS // SEGMENT) if counts[s * SEGMENT : (s + 1) * SEGMENT].any()]
    blobs = [zlib.compress(counts[s * SEGMENT : (s + 1) * SEGMENT].tobytes(), 1) for s in full]
    yield pa.RecordBatch.from_pydict({"segment": pa.array(full, pa.int32()), "counts": pa.array(blobs, pa.binary())})


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each counter, how many times the mean it holds, as a power of two: 0 for usual shingles, more for common ones."""
    import zlib

    partial = texts.select("text").mapInArrow(_count_bins, "segment int, counts binary")
    summed = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_sum_long, "segment int, counts binary")
    counts = np.zeros(BINS, dtype=np.int64)
    for row in summed.collect():  # BINS counters, whatever the input
        counts[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    mean = max(1.0, counts.mean())
    return np.floor(np.log2(np.maximum(counts / mean, 1.0))).astype(np.uint8)


def _sum_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each segment as 64-bit counters; rows come sorted by segment."""
    import zlib

    def row():
        blob = zlib.compress(total.tobytes(), 1)
        return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "counts": pa.array([blob], pa.binary())})

    now, total = None, None
    for batch in batches:
        for segment, blob in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
            counts = np.frombuffer(zlib.decompress(blob), dtype=np.int32)
            if segment == now:
                total += counts
            else:
                if now is not None:
                    yield row()
                now, total = segment, counts.astype(np.int64)
    if now is not None:
        yield row()


def _ordered_sets(part, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's shingles as tokens in the global order: by level of frequency, then by hash."""
    values, bounds = _distinct_shingles(part)
    tokens = (levels[_bin(values)].astype(np.uint64) << _BITS) | (values >> (np.uint64(64) - _BITS))
    return distinct_per_unit(tokens, bounds)


def _set_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per set, the same for equal sets."""
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(mix(tokens + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
    sums = total[bounds[1:]] - total[bounds[:-1]]
    return mix(sums + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _prefixes(levels: np.ndarray, percent: int, kind: pa.DataType):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, code, n, key, mark, wide, prefix) of each text."""
        words = Words()
        for batch in batches:
            ids = batch.column("row")
            for part in words.slices(batch.column("text")):
                tokens, bounds = _ordered_sets(part, levels)
                n = np.diff(bounds)
                first = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                unit = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(tokens)) - bounds[:-1][unit] < first[unit]
                starts = np.concatenate([[0], np.cumsum(first)])
                wide, wide_ends = wide_marks(tokens, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.rows[0], len(part.rows)).cast(kind),
                        batch.column("code").slice(part.rows[0], len(part.rows)),
                        pa.array(n.astype(np.int64)),
                        pa.array(_set_keys(tokens, bounds), mask=n == 0),
                        list_array(parity_marks(tokens, bounds).ravel().view(np.int64), np.arange(len(n) + 1) * MARK_WORDS),
                        list_array(wide.view(np.int64), wide_ends),
                        list_array(tokens[inside].view(np.int64), starts),
                    ],
                    ["row", "code", "n", "key", "mark", "wide", "prefix"],
                )

    return prefixes


def _full_sets(levels: np.ndarray):
    def full(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The set of each text that has words, see ``set_links.Sets``."""
        words = Words()
        for part in words.slices(texts):
            tokens, bounds = _ordered_sets(part, levels)
            some = np.diff(bounds) > 0  # the others take no tokens
            yield part.rows[some], _set_keys(tokens, bounds)[some], tokens, np.append(bounds[:-1][some], bounds[-1])

    return full


def similar_sets(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, label): each row's (row, n, key), the links (a, b) that connect keys of similar sets, and the components (node, component) they make.

    Links between all similar sets are found, except such as join two sets that other links connect already.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("row"), F.xxhash64(text).alias("code"), text.alias("text"))
    field = docs.schema[id_col].dataType
    levels = frequency_levels(texts)
    schema = f"row {field.simpleString()}, code long, n long, key long, mark array<long>, wide array<long>, prefix array<long>"
    members = kept(texts.mapInArrow(_prefixes(levels, percent, _arrow_type(texts)), schema), "members")
    sets = members.filter(F.col("n") > 0).groupBy("key")
    posted = sets.agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted = posted.select("key", "n", F.posexplode("prefix").alias("p", "token"))
    found_in = F.min(F.struct(F.col("row").isNull().alias("no_id"), "row", "code")).alias("place")
    known = sets.agg(found_in, F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("wide").alias("wide"))
    known = known.select("key", "place.row", "place.code", "n", "mark", "wide")
    links, label = similar_in_buckets(posted, known, texts, _full_sets(levels), percent)
    return members.drop("code", "prefix", "mark", "wide"), links, label


def _arrow_type(texts: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(texts.schema["row"].dataType)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id), the smallest id reachable by links of ``percent`` or more.

    A text of fewer than five words is one shingle; null, empty and wordless texts have none and are linked
    with nothing: their component is their own id. Repeated rows and equal texts are in one component. Null ids
    come after all others: a component of which no row has an id has none. An empty table gives no rows.
    """
    members, _, label = similar_sets(docs, percent, id_col, text_col)
    label = label.select(F.col("node").alias("key"), "component")
    smallest = members.filter(F.col("n") > 0).groupBy("key").agg(F.min("row").alias("least"))
    smallest = smallest.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    reach = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = smallest.join(reach, "component").select("key", "component_id")
    return members.join(ids, "key", "left").select(
        F.col("row").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Rows that share an id are one document: they stay if any of them does.
    """
    told = near_duplicates(docs, percent).groupBy("doc_id")
    told = told.agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    others = broadcast_if_small(told.filter(~F.col("stays")).select(F.col("doc_id").alias("_other")))
    return docs.join(others, F.col("doc_id").eqNullSafe(F.col("_other")), "left_anti")


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the size of its set and its component of near duplicates."""
    return near_duplicates(table(spark, folder, "documents"))
