"""Mining of collocations: phrases of two to five words that are frequent and hold together.

Texts are coded once into blocks of bounded size, each with its own word numbers. The corpus's frequent words get ids by
frequency, and the ids return to the blocks that have the words. Pairs of ids are counted by tile: ids are cut into ranges that grow with the
rank, so that tiles hold about as many occurrences as each other, and a tile is the pairs of two ranges. Among the most
frequent ids a block counts by direct address in one dense array; all other pairs are a sorted list of (address, count). Tiles are summed
over all blocks, each in one pass along its rows. Frequent pairs are ranked in turn and return as ids of their own,
from which phrases of three words (pair and word), four (pair and pair) and five (triple and pair) are counted the same way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketwise.functions.durable import broadcast_if_small
from basketwise.llm.slices import slices
from basketwise.llm.store import kept, numbered, table

# What ends a piece, the least count of a phrase, rows returned per language, and the name of a missing language.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LEAST = 100
TOP = 2000
NO_LANGUAGE = "und"

#: Bytes of text in a block, about; a block and its words are held by one task.
BLOCK_BYTES = 16 << 20
#: Ids below this are counted by direct address.
HEAD = 1024
#: Entries of a sparse tile held before they are merged.
MERGE = 1 << 20
#: Ranks up to here are cut into ranges of eight; beyond, each doubling of the rank is cut into eight ranges.
FIRST_RANKS = 64
#: Parts over which a language's phrases are ranked before the last ranking.
RANK_PARTS = 64

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if c in BREAKS else 0x20 if c == 9 else c for c in range(256))


class _Block:
    """Texts of one language, coded by their own words; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.codes[_BREAK] = 0
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        for part in slices(text):
            words = part.lower().translate(_TABLE).replace(_BREAK, b" \xff ").split()  # lower() knows A-Z only
            self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words)))
        self.parts.append(np.zeros(1, np.uint32))


_CODED = "block long, lang string, code long, word string, n long, codes binary"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a block's distinct words with their code and count, and its sequence of codes."""
    pack = zstandard.ZstdCompressor(level=3).compress
    number = TaskContext.get().partitionId() << 32
    blocks: defaultdict[str, _Block] = defaultdict(_Block)

    def rows(lang: str, block: _Block, number: int) -> Iterator[pa.RecordBatch]:
        sequence = np.concatenate(block.parts)
        counts = np.bincount(sequence, minlength=len(block.codes))
        words = [word.decode() for word in block.codes if word != _BREAK]
        n = len(words)
        columns = [[number] * n, [lang] * n, range(1, n + 1), words, counts[1:].tolist(), [None] * n]
        last = [number, lang, None, None, None, pack(sequence.astype("<u4").tobytes())]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["block", "lang", "code", "word", "n", "codes"]
        yield pa.RecordBatch.from_arrays([pa.array([*c, v], kind) for c, v, kind in zip(columns, last, kinds)], names)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang, block in blocks.items():
            yield from rows(lang, block, number)
            number += 1
        blocks.clear()

    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            data = text.as_py()
            blocks[lang].add(data)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def _ranges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ids from 0: the number of their range, its first id and its length."""
    octave = np.frexp(np.maximum(ids, FIRST_RANKS).astype(np.float64))[1] - FIRST_RANKS.bit_length()
    tail = ids >= FIRST_RANKS
    base = np.where(tail, FIRST_RANKS << octave, 0)
    side = np.where(tail, (FIRST_RANKS // 8) << octave, FIRST_RANKS // 8)
    eighth = (ids - base) // side
    return np.where(tail, 8 + 8 * octave, 0) + eighth, base + eighth * side, side


def _address(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tile of each pair of ids and its address there."""
    (a, first_a, _), (b, first_b, side_b) = _ranges(left), _ranges(right)
    return (a << 16) | b, (left - first_a) * side_b + right - first_b


class _Corner:
    """A tile's place: its first ids and lengths."""

    def __init__(self, tile: int):
        (self.left, self.rows), (self.right, self.columns) = map(self._range, (tile >> 16, tile & 0xFFFF))

    @staticmethod
    def _range(number: int) -> tuple[int, int]:
        if number < 8:
            return number * (FIRST_RANKS // 8), FIRST_RANKS // 8
        octave, eighth = divmod(number - 8, 8)
        side = (FIRST_RANKS // 8) << octave
        return (FIRST_RANKS << octave) + eighth * side, side

    @property
    def kind(self) -> str:
        """The numbers that hold its addresses."""
        return "<u4" if self.rows * self.columns <= 1 << 32 else "<u8"

    @property
    def dense(self) -> bool:
        return self.left < HEAD and self.right < HEAD

    def ids(self, addresses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.left + addresses // self.columns, self.right + addresses % self.columns


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per stretch of ``values``."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


_TILES = "list string, tile long, block long, addresses binary, counts binary"


def _tiles(name: str, block: int, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """The pairs (left[i], right[i]) of ids from 1, 0 being none, counted and cut into tiles."""
    some = (left > 0) & (right > 0)
    left, right = left[some] - 1, right[some] - 1
    head = (left < HEAD) & (right < HEAD)
    grid = np.bincount(left[head] * HEAD + right[head], minlength=HEAD * HEAD) if head.any() else np.zeros(0, np.int64)
    found = np.flatnonzero(grid)
    rest, times = np.unique((left[~head] << 32) | right[~head], return_counts=True)
    left = np.concatenate([found // HEAD, rest >> 32])
    right = np.concatenate([found % HEAD, rest & 0xFFFFFFFF])
    counts = np.concatenate([grid[found], times])
    tile, address = _address(left, right)
    order = np.lexsort((address, tile))
    tile, address, counts = tile[order], address[order], counts[order]
    first = np.flatnonzero(np.diff(tile, prepend=-1))
    bounds = np.append(first, len(tile))
    n = len(first)
    kinds = [_Corner(t).kind for t in tile[first].tolist()]
    addresses = _binary(address.astype("<u4"), bounds)
    if "<u8" in kinds:  # ids beyond some hundred thousands
        addresses = pa.array([address[a:b].astype(kind).tobytes() for a, b, kind in zip(bounds, bounds[1:], kinds)], pa.binary())
    return pa.table(
        [pa.array([name] * n, pa.string()), pa.array(tile[first], pa.int64()), pa.array([block] * n, pa.int64()),
         addresses, _binary(counts.astype("<u4"), bounds)],
        ["list", "tile", "block", "addresses", "counts"],
    )


def _ids_at(codes: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of each code, 0 where ``keys`` (ascending) lacks it."""
    if not len(keys):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, ids[at], 0)


def _pair_codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per pair of ids, 0 if either is none."""
    return np.where((left > 0) & (right > 0), (left << 32) | right, 0)


def _after(ids: np.ndarray, n: int) -> np.ndarray:
    """The id ``n`` places further on; 0 past the end."""
    return np.concatenate([ids[n:], np.zeros(min(n, len(ids)), np.int64)])


def _count(longest_known: int):
    """Count what can be counted with the ids of phrases up to ``longest_known`` words."""

    def count(sequences: pa.Table, dictionary: pa.Table) -> pa.Table:
        block, lang, packed = (sequences.column(name)[0].as_py() for name in ("block", "lang", "codes"))
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype="<u4").astype(np.int64)
        known = {}
        for k in range(1, longest_known + 1):
            packed = dictionary.filter(pc.equal(dictionary.column("size"), k))
            keys, ids = (np.frombuffer(b"".join(packed.column(n).to_pylist()), dtype=kind).astype(np.int64) for n, kind in (("keys", "<u8"), ("ids", "<u4")))
            order = np.argsort(keys)
            known[k] = keys[order], ids[order]
        table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        table[known[1][0]] = known[1][1]
        words = table[codes]
        if longest_known == 1:
            return _tiles(f"2:{lang}", block, words, _after(words, 1))
        pairs = _ids_at(_pair_codes(words, _after(words, 1)), *known[2])
        if longest_known == 2:  # a frequent phrase has frequent parts only
            inner = np.where(_after(pairs, 1) > 0, pairs, 0)
            longer = np.where(_after(inner, 1) > 0, inner, 0)
            return pa.concat_tables([_tiles(f"3:{lang}", block, inner, _after(words, 2)), _tiles(f"4:{lang}", block, longer, _after(pairs, 2))])
        triples = _ids_at(_pair_codes(pairs, _after(words, 2)), *known[3])
        inner = np.where((_after(triples, 1) > 0) & (_after(triples, 2) > 0), triples, 0)
        return _tiles(f"5:{lang}", block, inner, _after(pairs, 3))

    return count


_FREQUENT = "list string, tile long, address long, left long, right long, total long"


def _sum_tiles(least: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by tile: each tile's counts summed, dense ones by address, sparse ones as a sorted list."""
        now, corner, dense, waiting, held = None, None, None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            addresses, counts = (np.concatenate(part) for part in zip(*waiting))
            order = np.argsort(addresses, kind="stable")
            addresses, counts = addresses[order], counts[order]
            first = np.flatnonzero(np.diff(addresses, prepend=-1))
            return addresses[first], np.add.reduceat(counts, first)

        def done() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if corner.dense:
                addresses = np.flatnonzero(dense >= least)
                totals = dense[addresses]
            else:
                addresses, totals = merged()
                addresses, totals = addresses[totals >= least], totals[totals >= least]
            left, right = corner.ids(addresses)
            n = len(addresses)
            columns = [pa.array([now[0]] * n, pa.string()), *[pa.array(c, pa.int64()) for c in ([now[1]] * n, addresses, left + 1, right + 1, totals)]]
            yield pa.RecordBatch.from_arrays(columns, ["list", "tile", "address", "left", "right", "total"])

        for batch in batches:
            for name, tile, addresses, counts in zip(*[batch.column(c).to_pylist() for c in ("list", "tile", "addresses", "counts")]):
                if (name, tile) != now:
                    yield from done()
                    now, corner, waiting, held = (name, tile), _Corner(tile), [], 0
                    dense = np.zeros(corner.rows * corner.columns, np.int64) if corner.dense else None
                addresses = np.frombuffer(addresses, dtype=corner.kind).astype(np.int64)
                counts = np.frombuffer(counts, dtype="<u4").astype(np.int64)
                if corner.dense:
                    dense[addresses] += counts
                    continue
                waiting.append((addresses, counts))
                held += len(addresses)
                if held > MERGE:
                    waiting = [merged()]
                    held = len(waiting[0][0]) // 2
        yield from done()

    return add


def _by_tile(rows: DataFrame, *then: str) -> DataFrame:
    return rows.repartition("list", "tile").sortWithinPartitions("list", "tile", *then)


def _frequent(tiles: DataFrame, least: int) -> DataFrame:
    """The pairs counted ``least`` times or more, ranked within their list from 1."""
    summed = _by_tile(tiles.select("list", "tile", "addresses", "counts")).mapInArrow(_sum_tiles(least), _FREQUENT)
    ordered = kept(summed.withColumn("order", -F.col("total")), "frequent")
    return numbered(ordered, "list", ["order", "left", "right"], "id").drop("order").withColumn("id", F.col("id") + 1)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, its frequent pairs before the blocks that ask: the ids of those a block has."""
    now, known, arrays = None, [], None
    for batch in batches:
        out = []
        for name, tile, block, addresses, address, rank in zip(*[batch.column(c).to_pylist() for c in ("list", "tile", "block", "addresses", "address", "id")]):
            if (name, tile) != now:
                now, known, arrays = (name, tile), [], None
            if block is None:
                known.append((address, rank))
                continue
            if not known:
                continue
            if arrays is None:
                arrays = np.array(sorted(known), dtype=np.int64).T
            corner = _Corner(tile)
            asked = np.frombuffer(addresses, dtype=corner.kind).astype(np.int64)
            ids = _ids_at(asked, *arrays)
            left, right = corner.ids(asked[ids > 0])
            if len(left):
                out.append((block, int(name.split(":", 1)[0]), (((left + 1) << 32) | (right + 1)).astype("<u8").tobytes(), ids[ids > 0].astype("<u4").tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["block", "size", "keys", "ids"])


_KNOWN = "block long, size int, keys binary, ids binary"


def _packed_words(words: pa.Table) -> pa.Table:
    """One block's words: their codes and ids."""
    arrays = [words.column(name).to_numpy().astype(kind).tobytes() for name, kind in (("code", "<u8"), ("id", "<u4"))]
    columns = [pa.array([words.column("block")[0].as_py()], pa.int64()), pa.array([1], pa.int32()), *[pa.array([a], pa.binary()) for a in arrays]]
    return pa.table(columns, ["block", "size", "keys", "ids"])


def _return_ids(frequent: DataFrame, tiles: DataFrame) -> DataFrame:
    """(block, size, key, id): the ids of the frequent pairs, for every block that has them."""
    none = F.lit(None)
    found = frequent.select("list", "tile", none.cast("long").alias("block"), none.cast("binary").alias("addresses"), "address", "id")
    asked = tiles.select("list", "tile", "block", "addresses", none.cast("long").alias("address"), none.cast("long").alias("id"))
    return kept(_by_tile(found.unionByName(asked), "block").mapInArrow(_answer, _KNOWN), "known")  # nulls come first


def _phrases(words: DataFrame, found: dict[int, DataFrame]) -> DataFrame:
    """(lang, size, phrase, a) of the frequent words and phrases; ids become words again."""
    texts = {1: words.select("lang", "id", F.col("word").alias("phrase"), F.col("total").alias("a"))}
    for size, (first, rest) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2)}.items():
        pairs = found[size].select(F.substring("list", 3, 1 << 30).alias("lang"), "id", "left", "right", F.col("total").alias("a"))
        left = texts[first].select("lang", F.col("id").alias("left"), F.col("phrase").alias("_left"))
        right = texts[rest].select("lang", F.col("id").alias("right"), F.col("phrase").alias("_right"))
        met = pairs.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        texts[size] = kept(met.select("lang", "id", F.concat_ws(" ", "_left", "_right").alias("phrase"), "a"), "phrases")
    parts = [rows.select("lang", F.lit(size).alias("size"), "phrase", "a") for size, rows in texts.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return kept(whole, "phrases")


def _weakest_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with the cut that scores least, exactly; of equal scores the first cut."""
    words = F.split("phrase", " ")
    longer = phrases.filter("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = longer.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    met = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(broadcast_if_small(totals), "lang")
    # decimals of 38 digits: products of three counts below 1e11 each fit, and a score is below 1000 n / a
    number = {name: F.col(name).cast("decimal(19,0)") for name in ("a", "l", "r", "n")}
    score = F.expr("(cast(1000 as decimal(4,0)) * _a * _n) div (_l * _r)")
    scored = met.withColumns({f"_{name}": value for name, value in number.items()}).withColumn("score", score)
    return scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select(
        "lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score"
    )


def _held_whole(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): phrases within longer frequent ones, and the highest count of these."""
    words = F.split("phrase", " ")
    starts = F.sequence(F.lit(1), F.col("size") - 1)
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.col("size") - s + 1), lambda n: F.struct(s.alias("s"), n.alias("n")))))
    inner = phrases.filter("size > 2").withColumn("span", F.explode(spans)).filter("span.n < size")
    part = F.array_join(F.slice(words, F.col("span.s"), F.col("span.n")), " ")
    return inner.groupBy("lang", part.alias("phrase")).agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two to five words.

    A phrase stands within one piece and occurs a >= ``least`` times; l and r count the parts of its weakest cut, n all words of the
    language, and score is floor(1000 a n / (l r)). Phrases that only ever stand within one longer frequent phrase are left out. A null
    language is NO_LANGUAGE, a null or empty text has no words, and repeated rows count each. An empty table gives no rows.
    """
    given = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = kept(given.mapInArrow(_code, _CODED), "coded")
    block_words = coded.filter(F.col("word").isNotNull()).select("block", "lang", "code", "word", "n")
    sequences = coded.filter(F.col("codes").isNotNull()).select("block", "lang", "codes")
    totals = block_words.groupBy("lang").agg(F.sum("n").alias("n"))
    # a word has one row per block: with its total put beside each of them, only frequent words are shuffled again
    total = F.sum("n").over(Window.partitionBy("lang", "word"))
    common = kept(block_words.withColumn("total", total).filter(F.col("total") >= least).drop("n"), "words")
    distinct = common.groupBy("lang", "word").agg(F.max("total").alias("total"))
    ordered = kept(distinct.withColumn("order", -F.col("total")), "words")
    words = numbered(ordered, "lang", ["order", "word"], "id").withColumn("id", F.col("id") + 1)
    ids = common.join(words.select("lang", "word", "id"), ["lang", "word"])
    known = kept(ids.select("block", "code", "id").groupBy("block").applyInArrow(_packed_words, _KNOWN), "known")

    def count(longest_known: int) -> DataFrame:
        counted = sequences.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_count(longest_known), _TILES)
        return kept(counted, "tiles")

    found = {}
    tiles = count(1)
    found[2] = _frequent(tiles, least)
    known = known.unionByName(_return_ids(found[2], tiles))
    tiles = count(2)
    both = _frequent(tiles, least)
    found |= {size: both.filter(F.col("list").startswith(f"{size}:")) for size in (3, 4)}
    known = known.unionByName(_return_ids(found[3], tiles.filter(F.col("list").startswith("3:"))))
    found[5] = _frequent(count(3), least)

    phrases = _phrases(words, found)
    scored = _weakest_cuts(phrases, totals).join(_held_whole(phrases), ["lang", "phrase"], "left")
    own = scored.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 100))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task ranks a whole one
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    near = own.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Every language's best phrases."""
    return collocations(table(spark, folder, "documents"))


SQL = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY 1),
places AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM (SELECT lang, words, unnest(range(1, 6)) AS size FROM w) WHERE len(words) >= size),
f AS (SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, n.n, CAST(CAST(1000 AS HUGEINT) * cuts.a * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.words[1:k], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.words[k + 1:cuts.size], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT *, unnest(range(1, size)) AS s FROM c),
inner_spans AS (SELECT lang, words, a, s, size, unnest(range(2, size - s + 2)) AS len FROM spans),
held AS (SELECT lang, array_to_string(words[s:s + len - 1], ' ') AS phrase, max(a) AS longer FROM inner_spans WHERE len < size GROUP BY 1, 2),
own AS (SELECT weakest.* FROM weakest LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * weakest.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM own QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
}
