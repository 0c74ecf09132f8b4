"""Exact nearest chunks of query vectors by cosine distance.

Every task scores its vectors against all queries with one matrix product per Arrow batch and lets
only its own best k per query out, so what is shuffled is tasks x queries x k rows, whatever the
size of the corpus. Vectors and queries are never paired as rows. Query sets beyond the size for broadcasts are joined
with the vectors block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from basketwise.functions.durable import BROADCAST_BYTES, broadcast_if_small

#: Queries scored by one matrix product; a task goes through all queries block by block.
QUERY_BLOCK = 512
#: Bytes of a block of queries, or of vectors, that one task holds where queries are too many for broadcasts; and of the least
#: block that vectors are cut into for the sake of more tasks.
GRID_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: Distances are compared to this many decimals, then by id, so ranks do not depend on batch layout.
DISTANCE_DECIMALS = 9
TINY = 1e-30


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + TINY)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row per vector; missing components are NaN."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dims).any():
        raise ValueError(f"every vector must have {dims} components, as the queries have; one has {lengths[lengths != dims][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _local_best(query_ids: list, unit_queries: np.ndarray, k: int, id_type: pa.DataType, query_type: pa.DataType):
    """The mapInArrow function: the best k ids per query of one task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in query_ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(1), unit_queries.shape[1])
            usable = np.isfinite(matrix).all(axis=1)
            ids = batch.column(0).filter(pa.array(usable)).to_pylist()
            vectors = _unit_rows(matrix[usable])
            for first in range(0, len(query_ids) if ids else 0, QUERY_BLOCK):
                distances = np.round(1.0 - vectors @ unit_queries[first : first + QUERY_BLOCK].T, DISTANCE_DECIMALS)
                for q, column in enumerate(np.ascontiguousarray(distances.T), start=first):
                    if len(column) > k:
                        bound = np.partition(column, k - 1)[k - 1]
                        if len(kept[q]) == k:
                            bound = min(bound, kept[q][-1][0])
                        near = np.flatnonzero(column <= bound)
                    else:
                        near = range(len(column))
                    kept[q] = sorted(kept[q] + [(float(column[i]), ids[i]) for i in near])[:k]
        rows = [(query_ids[q], i, d) for q in range(len(query_ids)) for d, i in kept[q]]
        if rows:
            queries, found, dists = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries, query_type), pa.array(found, id_type), pa.array(dists, pa.float64())],
                names=["query_id", "id", "distance"],
            )

    return best


def _score_block(vectors: DataFrame, block: list[Row], k: int, query_type: T.DataType) -> DataFrame:
    if any(row["embedding"] is None or len(row["embedding"]) == 0 for row in block):
        raise ValueError("a query must not be empty")
    if len({len(row["embedding"]) for row in block}) > 1 or not np.isfinite([x for r in block for x in r["embedding"]]).all():
        raise ValueError("queries must have the same number of components, all finite")
    unit = _unit_rows(np.array([row["embedding"] for row in block], dtype=np.float64))
    id_type = vectors.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    best = _local_best(
        [row["query_id"] for row in block], unit, k, to_arrow_type(id_type), to_arrow_type(query_type)
    )
    return vectors.select("id", "embedding").filter(F.col("embedding").isNotNull()).mapInArrow(best, schema)


def _grid(query_bytes: int, vector_bytes: int) -> tuple[int, int]:
    """How many blocks queries and vectors are dealt into.

    Every vector is sent to each block of queries and every query to each block of vectors, so blocks are as large as a task may
    hold. Vectors are cut further, for more tasks, only as long as the copies of the queries weigh no more than the vectors.
    """
    query_blocks, vector_blocks = query_bytes // GRID_BYTES + 1, vector_bytes // GRID_BYTES + 1
    spread = min(vector_bytes // LEAST_BYTES, vector_bytes // max(query_bytes, 1))
    return query_blocks, max(vector_blocks, spread)


def _in_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of every pair of a block of queries and a block of vectors; neither passes through the driver.

    Both sides are dealt into blocks of bounded size by a hash of their id. A block of queries goes to the tasks of all blocks
    of vectors and the other way round, and each such task scores its two blocks like any batch.
    """
    sizes = F.size("embedding")
    empty = F.col("embedding").isNull() | (sizes <= 0)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    told = queries.agg(F.count_if(empty).alias("empty"), F.count_if(odd).alias("odd"), F.min(sizes).alias("least"), F.max(sizes).alias("most")).first()
    if told["empty"]:
        raise ValueError("a query must not be empty")
    if told["odd"] or told["least"] != told["most"]:
        raise ValueError("queries must have the same number of components, all finite")
    vectors = vectors.select("id", "embedding").filter(F.col("embedding").isNotNull())

    def bytes_of(df: DataFrame) -> int:
        return df.agg(F.sum(8 * F.size("embedding") + 32)).first()[0] or 0

    query_blocks, vector_blocks = _grid(bytes_of(queries), bytes_of(vectors))

    def block_of(key: str, count: int):
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asked = queries.withColumn("query_block", block_of("query_id", query_blocks)).withColumn("vector_block", every(vector_blocks))
    held = vectors.withColumn("vector_block", block_of("id", vector_blocks)).withColumn("query_block", every(query_blocks))
    id_type, query_type = vectors.schema["id"].dataType, queries.schema["query_id"].dataType
    id_arrow, query_arrow = to_arrow_type(id_type), to_arrow_type(query_type)
    empty_result = pa.schema([("query_id", query_arrow), ("id", id_arrow), ("distance", pa.float64())]).empty_table()
    dims = told["least"]

    def score(block: pa.Table, content: pa.Table) -> pa.Table:
        if not len(block) or not len(content):
            return empty_result
        unit = _unit_rows(_matrix(block.column("embedding").combine_chunks(), dims))
        best = _local_best(block.column("query_id").to_pylist(), unit, k, id_arrow, query_arrow)
        found = list(best(iter(content.select(["id", "embedding"]).to_batches(max_chunksize=10_000))))
        return pa.Table.from_batches(found) if found else empty_result

    keys = ["query_block", "vector_block"]
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, schema)


def vector_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    top_k: int = 4,
    source_filter: str | None = None,
    block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query_id, rank, id, distance, relevance_score): the ``top_k`` nearest vectors of every query.

    ``vectors`` has id and embedding (and source, for the filter), ``queries`` query_id and
    embedding. Queries of no more than ``block_bytes`` go to every task, and the vectors are read once; more of them stay on the
    cluster, where blocks of queries meet blocks of vectors, see _grid. Vectors with a missing or infinite component are near to
    nothing (unusable_vectors has them); one of another length is an error.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    if source_filter is not None:
        vectors = vectors.filter(F.col("source") == source_filter)
    queries = queries.select("query_id", "embedding")
    count, size = queries.agg(F.count(F.lit(1)), F.sum(8 * F.size("embedding") + 32)).first()
    if not count:
        raise ValueError("there must be at least one query")
    if size <= block_bytes:
        candidates = _score_block(vectors, queries.collect(), top_k, queries.schema["query_id"].dataType)
    else:
        candidates = _in_blocks(vectors, queries, top_k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / 2))
    return (
        candidates.withColumn("rank", place)
        .filter(F.col("rank") <= top_k)
        .select(
            "query_id", "rank", "id", "distance", F.round(relevance.cast("decimal(20,12)"), 4)
            .cast("double").alias("relevance_score"),
        )
    )


def unusable_vectors(vectors: DataFrame) -> DataFrame:
    """The vectors that no query can find: null, or with a missing, infinite or undefined component."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col("embedding").isNull() | odd)


def attach_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with source, chunk_index and text. The hits are broadcast where their measured size
    allows it, so the texts of the corpus are read once and not shuffled."""
    return chunks.join(broadcast_if_small(hits), "id")


def retrieve_chunks(
    vectors: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 4, source_filter: str | None = None
) -> DataFrame:
    """(query_id, rank, source, chunk_index, text, distance, relevance_score) of the nearest chunks."""
    hits = vector_top_k(vectors, queries, top_k, source_filter)
    return attach_chunks(hits, chunks).select(
        "query_id", "rank", "source", "chunk_index", "text", "distance", "relevance_score"
    )


def multi_topic_retrieval(
    vectors: DataFrame, topics: DataFrame, chunks: DataFrame, top_k_per_topic: int = 3
) -> DataFrame:
    """The nearest chunks of several topics; a chunk found twice stays with the topic declared first.

    ``topics`` has topic, topic_order and embedding; ``chunks`` has id, source, chunk_index and text.
    """
    hits = vector_top_k(vectors, topics.withColumnRenamed("topic", "query_id"), top_k_per_topic)
    order = topics.select(F.col("topic").alias("query_id"), "topic_order")
    found = attach_chunks(hits.join(order, "query_id"), chunks)
    first = Window.partitionBy("source", "chunk_index").orderBy("topic_order", "rank")
    return (
        found.withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") == 1)
        .select(
            F.col("query_id").alias("topic"), "topic_order", "rank", "source", "chunk_index", "text",
            "relevance_score",
        )
    )


def sources_used(found: DataFrame) -> DataFrame:
    """One row: the sorted distinct sources of retrieved chunks."""
    return found.agg(F.array_sort(F.collect_set("source")).alias("sources_used"))
