"""Documents to sections to overlapping chunks, and upserting chunks into a snapshot.

Chunking is one narrow projection: no shuffle, no Python, whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketwise.functions.durable import durable
from basketwise.functions.expressions import WHITESPACE, is_blank, let, strip

# Characters per chunk, characters repeated, and where a section starts.
CHUNK_SIZE = 900
CHUNK_OVERLAP = 150
SECTION_START = r"(?md)(?=^## )"


def document_manifest(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """(source, status) of every expected document: present, empty (white space only) or missing."""
    have = documents.select("source", is_blank(F.col("text")).alias("blank"))
    status = (
        F.when(F.col("blank").isNull(), "missing").when(F.col("blank"), "empty").otherwise("present")
    )
    return expected.select("source").join(have, "source", "left").select("source", status.alias("status"))


def split_sections(text: Column) -> Column:
    """Sections of a Markdown text: a new one starts at every line that begins with '## '."""
    parts = F.transform(F.split(text, SECTION_START), strip)
    return F.filter(parts, lambda part: F.length(part) > 0)


def _hard_split(paragraph: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before.

    The text is cut once into steps; a window is a step and the beginning of what follows.
    """
    step = size - overlap
    steps = F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    more = -(-size // step)
    return let(
        steps,
        lambda cut: F.transform(cut, lambda _, i: F.substring(F.array_join(F.slice(cut, i + 1, more), ""), 1, size)),
    )


#: Paragraphs folded together before their chunks are handed on, so that a step copies few of them.
FOLD = 64


def _pack_section(section: Column, size: int, overlap: int) -> Column:
    """Chunks of one section: paragraphs are joined while they fit.

    On overflow the buffer is emitted, and its last characters open the next one together with the
    paragraph that did not fit, whatever its length. A long paragraph that meets an empty buffer is
    cut hard.
    """
    paragraphs = F.filter(
        F.transform(F.split(section, "\n\n"), strip), lambda paragraph: F.length(paragraph) > 0
    )

    def state_of(chunks: Column, text: Column) -> Column:
        return F.struct(chunks.alias("done"), text.alias("buffer"))

    def add(state: Column, paragraph: Column) -> Column:
        done, buffer = state["done"], state["buffer"]
        empty = buffer == ""
        # neither the buffer nor the paragraph has white space at its ends, but the cut tail may start with it
        joined = F.when(empty, paragraph).otherwise(F.concat(buffer, F.lit("\n\n"), paragraph))
        tail = F.ltrim(F.right(buffer, F.lit(overlap)), F.lit(WHITESPACE))
        reopened = F.concat(tail, F.lit("\n\n"), paragraph) if overlap else paragraph
        separator = F.when(empty, 0).otherwise(2)
        fits = F.length(buffer) + separator + F.length(paragraph) <= size
        return (
            F.when(fits, state_of(done, joined))
            .when(empty, state_of(F.concat(done, _hard_split(paragraph, size, overlap)), F.lit("")))
            .otherwise(state_of(F.concat(done, F.array(buffer)), reopened))
        )

    def add_block(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, state_of(F.array().cast("array<string>"), state["buffer"]), add)
        return let(inner, lambda folded: state_of(F.concat(state["done"], F.array(folded["done"])), folded["buffer"]))

    def finish(state: Column) -> Column:
        rest = F.when(state["buffer"] != "", F.array(state["buffer"])).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.flatten(state["done"]), rest)

    def blocks_of(all_paragraphs: Column) -> Column:
        count = F.ceil(F.size(all_paragraphs) / FOLD).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda b: F.slice(all_paragraphs, b * FOLD + 1, FOLD))

    start = state_of(F.array().cast("array<array<string>>"), F.lit(""))
    packed = F.aggregate(let(paragraphs, blocks_of), start, add_block, finish)
    return F.when(F.length(section) <= size, F.array(section)).otherwise(packed)


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """All chunks of a text, in order; none for white space."""
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    if overlap >= size:
        overlap = size // 5
    return F.flatten(F.transform(split_sections(text), lambda s: _pack_section(s, size, overlap)))


def document_sections(documents: DataFrame) -> DataFrame:
    """(source, section_index, text)"""
    return documents.select("source", F.posexplode(split_sections(F.col("text"))).alias("section_index", "text"))


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id, source, chunk_index, text): one row per chunk, numbered over the whole document."""
    exploded = documents.select(
        "source", F.posexplode(chunks_of(F.col("text"), size, overlap)).alias("chunk_index", "text")
    )
    return exploded.select(
        F.concat(F.col("source"), F.lit("::chunk_"), F.col("chunk_index").cast("string")).alias("id"),
        "source",
        "chunk_index",
        "text",
    )


def upsert_chunks(base: DataFrame | None, new: DataFrame, reset: bool = False) -> DataFrame:
    """The snapshot after writing ``new`` over ``base``: equal ids are replaced, all others stay,
    also those an earlier, longer version of a document left behind. ``reset`` keeps nothing.
    """
    if base is None or reset:
        return new
    new = durable(new)  # read twice; chunking again would cost more
    return base.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def ingest_summary(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents by status, chunks made and stored, and whether there was anything to store."""
    documents = manifest.agg(
        *[
            F.count_if(F.col("status") == status).alias(f"documents_{name}")
            for status, name in (("present", "loaded"), ("missing", "missing"), ("empty", "empty"))
        ]
    )
    created = chunks.agg(F.count(F.lit(1))).scalar()
    success = (F.col("documents_loaded") > 0) & (F.col("chunks_created") > 0)
    return documents.withColumn("chunks_created", created).select(
        success.alias("is_success"),
        "*",
        F.when(success, F.col("chunks_created")).otherwise(F.lit(0).cast("long")).alias("chunks_upserted"),
    )


def ingest_documents(
    documents: DataFrame,
    expected: DataFrame,
    base: DataFrame | None = None,
    reset: bool = False,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """(snapshot, summary): the expected documents that are there and not blank, chunked and upserted."""
    wanted = documents.join(expected.select("source").distinct(), "source", "left_semi")
    chunks = durable(chunk_documents(wanted, size, overlap))
    summary = ingest_summary(document_manifest(documents, expected), chunks)
    return upsert_chunks(base, chunks, reset), summary


def corpus_stats(chunks: DataFrame | None, spark=None) -> DataFrame:
    """One row: does the corpus exist, and how many chunks has it?"""
    if chunks is None:
        return spark.createDataFrame([(False, 0)], "exists boolean, chunk_count long")
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count")).select(F.lit(True).alias("exists"), "chunk_count")
