"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch is summed to one row per digest first, so a text
with any number of copies is one row from there on; a sort-merge anti-join finds the digests the index lacks,
and these are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.functions.durable import scratch_path
from basketwise.llm.store import kept, table
from basketwise.sources.versions import Versions, VersionTaken

SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of white space turned into one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ").cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, each with the id that stays and the number of rows seen."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        """Open the index at ``path``, or make it.

        ``buckets`` is fixed when the index is made, by default as the session's number of shuffle partitions, and stored beside the data:
        another session or table name takes it from there, whatever its own settings are. A table of this name must lie at ``path``.
        """
        self.spark, self.name = spark, name
        settings = Versions(spark, f"{path.rstrip('/')}.settings")
        if not settings.latest():
            try:
                settings.commit(1, {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))})
            except VersionTaken:  # another session made it first
                pass
        buckets = settings.read(1)["buckets"]
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, seen BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (digest, keep_id, seen; one row per digest) that the index lacks.

        Digests the index has keep their id. Running a batch again adds nothing.
        """
        known = self.rows().select("digest")
        unseen = batch.join(known.hint("merge"), "digest", "left_anti")
        unseen.select("digest", "keep_id", "seen").write.insertInto(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the smallest id stays, or the one an earlier batch has put into the index. Null and
    empty texts are equal. Rows that repeat both id and text are one document: each of them says kept. A null id
    comes after all others; it stays only where no row of the group has an id. group_size counts the rows of this batch. An empty table gives no rows.
    """
    marked = kept(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "marked")
    batch = marked.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("seen"))
    index.add(batch)
    groups = batch.select("digest", F.col("seen").alias("group_size")).join(
        index.rows().select("digest", "keep_id"), "digest"
    )
    return marked.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, under a name of its own."""
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}", scratch_path(spark, "digests"))


def keep_first_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, with all their columns.

    The row of a group that stays is told by (digest, id). Rows that repeat both are rare: only they are
    compared with each other, so that one of them stays.
    """
    marked = docs.withColumn("_digest", text_digest(F.col("text")))
    ids = marked.groupBy("_digest", "doc_id").agg(F.count(F.lit(1)).alias("_same"))
    first = F.min_by(F.struct("doc_id", "_same"), F.struct(F.col("doc_id").isNull(), F.col("doc_id")))
    batch = ids.groupBy("_digest").agg(first.alias("_first"), F.sum("_same").alias("seen"))
    index.add(batch.select(F.col("_digest").alias("digest"), F.col("_first.doc_id").alias("keep_id"), "seen"))
    stays = (
        index.rows()
        .select(F.col("digest").alias("_digest"), F.col("keep_id"))
        .join(batch.select("_digest", "_first._same"), "_digest")
        .withColumnRenamed("keep_id", "_keep")
    )
    held = marked.join(stays, "_digest").filter(F.col("doc_id").eqNullSafe(F.col("_keep"))).drop("_keep")
    repeated = held.filter(F.col("_same") > 1).dropDuplicates(["_digest"])
    return held.filter(F.col("_same") == 1).unionByName(repeated).select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return exact_dedup(table(spark, folder, "documents"), fresh_index(spark))


SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
