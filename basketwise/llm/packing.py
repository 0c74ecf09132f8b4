"""Packing of documents into sequences of one length by best-fit decreasing.

A document's ids are cut into full windows and one remainder. Best fit places the remainders, longest first, each
into the open window with the least room that holds it. It never looks at more of a piece than its length, so the whole
corpus is packed by its histogram of lengths: all pieces of one length are placed run by run, and a run of
windows that were filled alike stays one entry. The histogram has at most as many rows as a sequence has tokens, whatever
the input. Pieces are numbered within their length over all tasks, and their number tells their window.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from basketwise.llm.slices import slices
from basketwise.llm.store import kept, numbered, table

# The tokens of a sequence, and the id that ends a document.
WINDOW = 4096
END_ID = 2
#: Words whose ids a task remembers; beyond that it starts anew, which changes no result.
REMEMBERED = 1 << 19
#: Bytes of text worked on together, about.
GROUP_BYTES = 4 << 20
_PIECE = 1 << 44  # numbers within a length stay below this


class OpenWindows:
    """Windows with room left, in runs of windows with equal room; a segment tree over the room finds the tightest."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.used = [False] * (2 * self.leaves)
        self.runs: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        """Remove the last run of windows with this room: (first window, windows)."""
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def _mark(self, room: int, used: bool) -> None:
        node = self.leaves + room
        self.used[node] = used
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """The least room of ``size`` or more that any window has."""
        node = self.leaves + size
        while not self.used[node]:  # to the next subtree on the right
            while node & (node + 1) == 0 or node % 2:  # the last of its level, or a right child
                if node & (node + 1) == 0:
                    return None
                node //= 2
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.used[2 * node])
        return node - self.leaves


class Placement(NamedTuple):
    """Pieces number ``piece`` to ``piece + count - 1`` of ``size`` tokens go, in order, to the windows from ``window`` on."""

    size: int
    piece: int
    count: int
    window: int
    offset: int


def place(counts: dict[int, int], window: int = WINDOW) -> list[Placement]:
    """Best-fit decreasing of ``counts`` {tokens: pieces}. Windows are numbered from 0 without gap.

    The number of placements follows from the window's length and not from the number of pieces: a size splits one run at most.
    """
    placed, opened = [], OpenWindows(window)
    windows = 0
    for size in sorted(counts, reverse=True):
        done, total = 0, counts[size]
        while done < total:
            room = opened.tightest(size)
            if room is None:
                room, first, count = window, windows, -(-(total - done) // (window // size))
                windows += count
            else:
                first, count = opened.take(room)
            # the window that took a piece is the tightest for the next one, so each is filled before another is begun
            each = room // size
            full = min(count, (total - done) // each)
            for j in range(each if full else 0):
                placed.append(Placement(size, done, full, first, window - room + j * size))
                done += full
            if full and room > each * size:
                opened.add(room - each * size, first, full)
            first, count = first + full, count - full
            rest = min(total - done, each - 1) if count else 0
            for j in range(rest):
                placed.append(Placement(size, done, 1, first, window - room + j * size))
                done += 1
            if rest:
                opened.add(room - rest * size, first, 1)
                first, count = first + 1, count - 1
            if count:
                opened.add(room, first, count)
    return placed


# How the tokenizer cuts a lower-case word of plain letters, and the words whose letters these are.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds:
    """Ids of words, each as bytes of unsigned 32-bit numbers, little-endian; make one per task.

    Nearly all words of a text are new only once, but a corpus has very many of them. So words of plain letters, for which
    lower case and cut are beyond doubt, are cut here, and their pieces are encoded a thousand at once without
    the tokenizer's normalizing; every other word is left to the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        marks = [re.escape(token.content) for token in self.whole.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(marks) or "(?!)")
        self.bare = Tokenizer.from_str(definition)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        end = json.loads(definition)["model"]["end_of_word_suffix"]
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def of(self, texts: list[bytes]) -> list[memoryview]:
        """The ids of each text. Only its distinct words become Python objects."""
        parts = [list(slices(text)) for text in texts]
        words = pc.ascii_split_whitespace(pa.array([p for part in parts for p in part], pa.large_binary()).cast(pa.large_string()))
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        new = [word for word in distinct if word not in self.words]
        if new:
            if len(self.words) > REMEMBERED:
                self.words, self.pieces, new = {}, {}, distinct
            self._learn(new)
        ids = pa.array(map(self.words.__getitem__, distinct), pa.large_binary()).take(flat.indices)
        offsets, data = ids.buffers()[1:]
        bounds = np.frombuffer(offsets, dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        bounds = bounds[words.offsets.to_numpy()][np.cumsum([0, *map(len, parts)])].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [view[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, words: list[str]) -> None:
        marked = self.marks.search("\n".join(words)) is not None  # hardly ever: the words aren't searched one by one
        plain, other = [], []
        for word in words:
            (plain if PLAIN.fullmatch(word) and not (marked and self.marks.search(word)) else other).append(word)
        cut = [PLAIN_PIECES.findall(word.lower()) for word in plain]
        pieces = list(set(chain.from_iterable(cut)).difference(self.pieces))
        for i in range(0, len(pieces), 1000):
            some = pieces[i : i + 1000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            bounds = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.pieces.update(zip(some, [data[a:b] for a, b in zip([0, *bounds], bounds)], strict=True))
        known = self.pieces.__getitem__
        self.words.update(zip(plain, [known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for p in cut]))
        found = self.whole.encode_batch_fast(other, add_special_tokens=False) if other else []
        self.words.update((word, np.array(f.ids, dtype="<u4").tobytes()) for word, f in zip(other, found))


def _cut(definition: str, window: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every text's ids, cut. No token crosses ASCII white space, so a word's ids are the same wherever it stands."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        known = WordIds(definition)
        end = np.array([end_id], dtype="<u4").tobytes()
        columns = ["start", "length", "ids_crc32", "doc_tokens"]

        def pieces(rows: list[int], texts: list[bytes], column: pa.Array) -> pa.RecordBatch:
            row, numbers, ids = [], [], []
            for i, found in zip(rows, known.of(texts)):
                data = b"".join([found, end])
                tokens = len(data) // 4
                for at in range(0, tokens, window):
                    piece = data[4 * at : 4 * (at + window)]
                    row.append(i)
                    numbers.append((at, len(piece) // 4, zlib.crc32(piece), tokens))
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
            out = [column.take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in zip(*numbers)]]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, ["row", *columns] + (["ids"] if with_ids else []))

        for batch in batches:
            texts, rows, size = [], [], 0
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                texts.append(text.as_py())
                rows.append(i)
                size += len(texts[-1])
                if size >= GROUP_BYTES:
                    yield pieces(rows, texts, batch.column("row"))
                    texts, rows, size = [], [], 0
            if texts:
                yield pieces(rows, texts, batch.column("row"))

    return cut


def cut_documents(
    docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: (row, start, length, ids_crc32, doc_tokens), and the ids if asked for.

    ``definition`` is the tokenizer as JSON. Null and empty texts have the end id alone.
    """
    given = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"row {given.schema['row'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return given.mapInArrow(_cut(definition, window, end_id, with_ids), schema + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces (``length`` from 1 to ``window``), with sequence_id and offset: whole sequences, numbered from 0 without gap.

    Other columns are kept. Any number of pieces may be alike; an empty table gives no rows.
    """
    pieces = kept(pieces, "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # window rows at most
    placed = sorted(place(counts, window))
    keys = np.array([p.size * _PIECE + p.piece for p in placed], dtype=np.int64)
    first = np.array([p.window - p.piece for p in placed], dtype=np.int64)
    offset = np.array([p.offset for p in placed], dtype=np.int64)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_number").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * _PIECE + number, side="right") - 1
            kept_columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(first[at] + number), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered(pieces, "length", [], "_number").mapInArrow(locate, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used) of packed pieces that carry their ids: padded to the window unless ``used`` is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # window tokens at most
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.sum("length").alias("used"))
    exact = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    padding = F.array_repeat(F.lit(pad_id), F.when(exact, F.lit(0)).otherwise(window - F.col("used")).cast("int"))
    return whole.select("sequence_id", F.concat("ids", padding).alias("ids"), "used")


def given_tokenizer() -> str:
    """The tokenizer of the query; its file has a fixed size."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, packed."""
    return pack(cut_documents(table(spark, folder, "documents"), given_tokenizer())).withColumnRenamed("row", "doc_id")
