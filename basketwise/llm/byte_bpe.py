"""Byte-level BPE encoding and decoding, with each distinct word of the corpus encoded once.

Texts are split into pre-tokens, whose positions stay with their text. The corpus is dealt into chunks of bounded
size; a chunk hands on its distinct words, these are shuffled by word over the whole corpus, each is encoded once,
and the ids return to the chunks that asked, where they are put back by position. So what is shuffled besides the
texts is one row per word and chunk, not one per token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.llm.chunks import deal, unpacker, words_of_chunks
from basketwise.llm.store import table

#: Bytes of text in a chunk, about; a chunk and its dictionary are held by one task.
CHUNK_BYTES = 48 << 20
#: Words after which a task looks up those of the texts it has split.
LOOKED_UP = 1 << 19


class Vocabulary:
    """Ranks of byte strings, read from a file of lines ``base64(token) rank``; its size is fixed."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.lines, self.pattern = file.read(), pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines()) if a}

    def token_bytes(self) -> dict[int, bytes]:
        """The token-byte table."""
        return {rank: token for token, rank in self.ranks().items()}

    def id_type(self) -> str:
        """The smallest integer that holds every rank."""
        return "<u2" if max(self.ranks().values()) < 1 << 16 else "<u4"

    def piece_encoder(self) -> tiktoken.Encoding:
        """Encodes its whole input as one piece: the pattern was applied before."""
        return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks(), special_tokens={})


def _encode_words(vocabulary: Vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word: each word is encoded once, its ids go to every chunk that asked."""
        encoder, kind = vocabulary.piece_encoder(), vocabulary.id_type()
        last, last_ids = None, None
        for batch in batches:
            words = batch.column("word").dictionary_encode()
            ids = [
                last_ids if word == last else np.array(encoder.encode_ordinary(word), dtype=kind).tobytes()
                for word in words.dictionary.to_pylist()
            ]
            if len(words):
                last, last_ids = words[-1].as_py(), ids[words.indices[-1].as_py()]
            encoded = pa.array(ids, pa.binary()).take(words.indices)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("word"), encoded], ["chunk", "word", "ids"])

    return encode


def _whole(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """The column as one array that begins at its buffers' first byte."""
    return pa.concat_arrays([*column.cast(kind).chunks, pa.array([], kind)])


def _reassemble(vocabulary: Vocabulary, with_ids: bool):
    def reassemble(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        """Ids of each text by position, and the bytes they stand for. The dictionary stays in Arrow; of its words none becomes a Python object."""
        split, table_of, kind = regex.compile(vocabulary.pattern).findall, vocabulary.token_bytes(), vocabulary.id_type()
        decimal_of = {i: str(i) for i in table_of}
        restore = unpacker()
        words = _whole(dictionary.column("word"), pa.large_string())
        encoded = _whole(dictionary.column("ids"), pa.large_binary())
        ends = np.frombuffer(encoded.buffers()[1], dtype=np.int64)[: len(encoded) + 1] // np.dtype(kind).itemsize if len(encoded) else np.zeros(1, np.int64)
        values = np.frombuffer(encoded.buffers()[2] or b"", dtype=kind)
        rows, counts, id_digests, byte_digests, lists = [], [], [], [], []

        def looked_up(found: list[str], stops: list[int]) -> None:
            at = pc.index_in(pa.array(found, pa.large_string()), value_set=words).to_numpy().astype(np.int64)
            have = ends[at + 1] - ends[at]
            after = np.concatenate([[0], np.cumsum(have)])
            ids = values[np.repeat(ends[at] - after[:-1], have) + np.arange(after[-1])]
            for start, stop in zip([0, *stops], stops):
                own = ids[after[start] : after[stop]].tolist()
                counts.append(len(own))
                id_digests.append(hashlib.sha256(" ".join([decimal_of[i] for i in own]).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(b"".join([table_of[i] for i in own])).hexdigest())
                if with_ids:
                    lists.append(own)

        found, stops = [], []
        for batch in texts.select(["row", "packed"]).to_batches(max_chunksize=1_000):
            rows.extend(batch.column(0).to_pylist())
            for packed in batch.column(1):
                found.extend(split(restore(packed).decode()))
                stops.append(len(found))
                if len(found) >= LOOKED_UP:
                    looked_up(found, stops)
                    found, stops = [], []
        if stops:
            looked_up(found, stops)
        out = [pa.array(rows, texts.schema.field("row").type), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(byte_digests, pa.string())]
        names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            out.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        return pa.table(out, names)

    return reassemble


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per input row: (id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for.

    ids_sha256 is the digest of the decimal ids joined by one space, decoded_sha256 that of the bytes the ids decode
    to. Null and empty texts have no ids. Repeated rows and repeated or null ids give a row each. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = deal(docs, id_col, text_col, CHUNK_BYTES)
    pattern = vocabulary.pattern
    words = words_of_chunks(dealt, lambda: regex.compile(pattern).findall)
    asked = words.repartition("word").sortWithinPartitions("word")
    dictionary = asked.mapInArrow(_encode_words(vocabulary), "chunk long, word string, ids binary")
    schema = f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    encoded = dealt.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(_reassemble(vocabulary, with_ids), schema)
    return encoded.withColumnRenamed("row", id_col)


def decode_ids(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) -> (id, decoded): the bytes, by a join of the ids with the token-byte table and their positions.

    Rows are told apart by their id, which must be unique. No ids decode to no bytes.
    """
    spark = tokens.sparkSession
    pairs = [(rank, bytearray(token)) for rank, token in vocabulary.token_bytes().items()]
    bytes_of = spark.createDataFrame(pairs, "token int, bytes binary")
    placed = tokens.select(id_col, F.posexplode_outer("ids").alias("at", "token"))
    met = placed.join(F.broadcast(bytes_of), "token", "left")  # the vocabulary's size is fixed
    parts = F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("hex"))))
    return met.groupBy(id_col).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), "")).alias("decoded"))


def given_vocabulary() -> Vocabulary:
    """The vocabulary of the query."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    return encode_texts(table(spark, folder, "documents"), given_vocabulary())
