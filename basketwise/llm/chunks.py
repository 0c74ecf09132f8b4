"""Texts dealt into chunks of bounded size, and the distinct words of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F


def deal(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(row, packed, chunk): the texts (null as empty), compressed and shuffled into chunks of about ``chunk_bytes``.

    They are dealt by id and content, so rows that share an id, or a text, don't meet in one chunk.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    whole = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(size // chunk_bytes) + 1
    dealt = whole.withColumn("chunk", F.pmod(F.xxhash64("row", "text"), F.lit(chunks)))
    kind = whole.schema["row"].dataType
    packed = dealt.mapInArrow(_pack(to_arrow_type(kind)), f"row {kind.simpleString()}, packed binary, chunk long")
    return packed.repartition("chunk")


def _pack(kind: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the shuffle would write for a text shrinks by a third."""
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([compress(text.as_buffer()) for text in batch.column("text").cast(pa.large_string())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(kind), packed, batch.column("chunk")], ["row", "packed", "chunk"])

    return pack


def unpack(packed: pa.Array) -> pa.Array:
    """The texts."""
    return pa.array(map(unpacker(), packed), pa.large_binary()).cast(pa.large_string())


def unpacker() -> Callable[[pa.Scalar], bytes]:
    """A function that restores one text, in UTF-8."""
    decompress = zstandard.ZstdDecompressor().decompress
    return lambda value: decompress(value.as_buffer())


def words_of_chunks(dealt: DataFrame, split: Callable[[], Callable[[str], list]]) -> DataFrame:
    """(chunk, word), distinct. ``split`` makes the function that splits a text, once per task.

    All columns of ``dealt`` are read, so that its shuffle is the one that a cogroup with the words reads.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_text, restore, now, seen = split(), unpacker(), None, set()

        def rows():
            found = sorted(seen)  # neighbours alike: the shuffle compresses them better
            for i in range(0, len(found), 100_000):
                part = pa.array(found[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(part), pa.int64()), part.cast(pa.string())], ["chunk", "word"])

        for batch in batches:
            texts = batch.column("packed")
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                if chunk != now:
                    yield from rows()
                    now, seen = chunk, set()
                seen.update(split_text(restore(texts[i]).decode()))
        yield from rows()

    return dealt.sortWithinPartitions("chunk").mapInArrow(words, "chunk long, word string")
