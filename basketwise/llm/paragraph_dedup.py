"""Substring deduplication: lines that nearly repeat and runs of words that repeat wherever they stand.

Lines are found by MinHash bands and verified by their exact Jaccard. 64 minima in 16 bands of four let a pair of Jaccard 0.8 meet with a probability
of 0.9998. Equal paragraphs are one from the first shuffle on; those that meet are verified on their whole
shingle sets, and all but the first place of each component are removals.

Runs take no notice of line breaks. Each window of LEAST_WORDS words is keyed by the least hash of its ANCHOR-word
shingles, so equal windows have equal keys, and neighbouring windows mostly share theirs: what is shuffled is one row per
stretch of windows with one key. Where all stretches of a key are equal they repeat as they are; where they differ (at the
ends of a shared run) their windows are compared one by one. Windows that follow each other in a text and in their first place are one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketwise.functions.durable import broadcast_if_small
from basketwise.llm.set_links import similar_in_buckets
from basketwise.llm.store import kept, table
from basketwise.llm.words import MARK_WORDS, Words, distinct_per_unit, list_array, mix, parity_marks, shingles, wide_marks

SHINGLE = 5
BANDS, ROWS = 16, 4
#: Words from which on a line or a run is compared; shorter ones repeat by chance or by custom.
LEAST_WORDS = 50
#: Words of the shingles that key a window.
ANCHOR = 16
PERCENT = 80


def _long_paragraphs(part, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit numbers, tokens, bounds) of the lines long enough, tokens being their distinct shingles in order of hash."""
    lengths = np.diff(part.bounds)
    units = np.flatnonzero(lengths >= least_words)
    inside = np.repeat(lengths >= least_words, lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths[units])])
    values, bounds = shingles(part.hashes[part.bounds[0] : part.bounds[-1]][inside], bounds, SHINGLE)
    values, bounds = distinct_per_unit(values >> np.uint64(1), bounds)
    return units, values, bounds


def _set_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(mix(tokens + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _bands(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per paragraph and band: equal where the minima of the band are."""
    out = np.zeros((len(bounds) - 1, BANDS), dtype=np.uint64)
    if not len(tokens):
        return out
    spread = mix(tokens)
    for band in range(BANDS):
        for row in range(ROWS):
            factor = mix(np.array([band * ROWS + row + 1], dtype=np.uint64))[0] | np.uint64(1)
            least = np.minimum.reduceat(mix_high(spread * factor), bounds[:-1])
            out[:, band] = mix(out[:, band] + least + np.uint64(band + 1))
    return out


def mix_high(x: np.ndarray) -> np.ndarray:
    """Fold the high bits, which a product spreads best, into the low ones."""
    return x ^ (x >> np.uint64(29))


def _paragraphs(least_words: int, kind: pa.DataType):
    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, code, line, start, stop, n_words, n, key, mark, wide, bands) of each paragraph; start and stop in code points of the text."""
        words = Words()
        for batch in batches:
            ids = batch.column("row")
            for part in words.slices(batch.column("text"), lines=True):
                units, tokens, bounds = _long_paragraphs(part, least_words)
                if not len(units):
                    continue
                points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                first_unit = np.searchsorted(part.rows, part.rows, side="left")
                text_start = points[part.offsets[:-1][first_unit]]
                stops = part.offsets[1:] - (np.append(part.data, 0)[np.maximum(part.offsets[1:] - 1, 0)] == 10)
                bands = _bands(tokens, bounds)
                wide, wide_ends = wide_marks(tokens, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(part.rows[units])).cast(kind),
                        batch.column("code").take(pa.array(part.rows[units])),
                        pa.array((units - first_unit[units]).astype(np.int32)),
                        pa.array(points[part.offsets[:-1][units]] - text_start[units]),
                        pa.array(points[stops[units]] - text_start[units]),
                        pa.array(np.diff(part.bounds)[units].astype(np.int64)),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(_set_keys(tokens, bounds)),
                        list_array(parity_marks(tokens, bounds).ravel().view(np.int64), np.arange(len(units) + 1) * MARK_WORDS),
                        list_array(wide.view(np.int64), wide_ends),
                        list_array(bands.ravel().view(np.int64), np.arange(len(units) + 1) * BANDS),
                    ],
                    ["row", "code", "line", "start", "stop", "n_words", "n", "key", "mark", "wide", "bands"],
                )

    return paragraphs


def _full_sets(least_words: int):
    def full(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The set of each line long enough, see ``set_links.Sets``."""
        words = Words()
        for part in words.slices(texts, lines=True):
            units, tokens, bounds = _long_paragraphs(part, least_words)
            if len(units):
                yield part.rows[units], _set_keys(tokens, bounds), tokens, bounds

    return full


def repeated_paragraphs(
    docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every place of every paragraph that repeats: (id, line, start, stop, n_words, cluster_id, first_id, first_line, places, removed, kind).

    ``start`` and ``stop`` are code points of the text, ``line`` counts from 0. The first place of a cluster (by id, then line)
    stays, the others are removed; ``places`` counts both. Paragraphs below ``least_words`` words, null and
    empty texts have none. Repeated rows count as places of their own; where they share an id and line too, all but those of the first
    place are removed. Null ids come last. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("row"), F.xxhash64(text).alias("code"), text.alias("text"))
    field = texts.schema["row"].dataType
    ddl = f"row {field.simpleString()}, code long, line int, start long, stop long, n_words long, n long, key long, mark array<long>, wide array<long>, bands array<long>"
    found = kept(texts.mapInArrow(_paragraphs(least_words, to_arrow_type(field)), ddl), "paragraphs")
    place = F.struct(F.col("row").isNull().alias("no_id"), "row", "line", "code")
    distinct = found.groupBy("key").agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("places"), F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("wide").alias("wide"), F.first("bands").alias("bands")
    )
    distinct = kept(distinct, "distinct")
    posted = distinct.select("key", "n", F.posexplode("bands").alias("band", "value"))
    posted = posted.select(F.xxhash64("band", "value").alias("token"), "key", "n", F.lit(0).alias("p"))
    known = distinct.select("key", "place.row", "place.code", "n", "mark", "wide")
    _, label = similar_in_buckets(posted, known, texts, _full_sets(least_words), percent)
    label = label.select(F.col("node").alias("key"), "component")
    labelled = distinct.select("key", "place", "places").join(label, "key", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "key"))
    clusters = labelled.groupBy("component").agg(F.min("place").alias("first"), F.sum("places").alias("places"))
    repeats = labelled.select("key", "component").join(clusters.filter(F.col("places") > 1), "component")
    here = found.select("key", "row", "line", "start", "stop", "n_words").join(repeats, "key")
    same = F.col("row").eqNullSafe(F.col("first.row")) & (F.col("line") == F.col("first.line"))
    return here.select(
        F.col("row").alias(id_col),
        "line",
        "start",
        "stop",
        "n_words",
        F.col("component").alias("cluster_id"),
        F.col("first.row").alias("first_id"),
        F.col("first.line").alias("first_line"),
        "places",
        (~same).alias("removed"),
        F.lit("line").alias("kind"),
    )


def _least_over(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _windows(least_words: int, kind: pa.DataType, each: bool):
    """Stretches of windows with one anchor; or, with ``each``, every window whose anchor is in the row's list."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, doc, at, n, start, stop, line, anchor, key): n windows from word ``at`` on; start and stop in code points of the text."""
        words = Words()
        size = min(ANCHOR, least_words)
        for batch in batches:
            wanted = batch.column("anchors") if each else None
            for part in words.slices(batch.column("text")):
                count = len(part.hashes)
                if count < least_words:
                    continue
                total = np.concatenate([[np.uint64(0)], np.cumsum(part.hashes * words.up[:count], dtype=np.uint64)])

                def hashed(a, b, total=total):
                    return mix((total[b] - total[a]) * words.down[a] + (b - a).astype(np.uint64))

                at = np.arange(count - size + 1)
                least = _least_over(hashed(at, at + size), least_words - size + 1)
                lengths = np.diff(part.bounds)
                unit = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
                at = np.flatnonzero(np.arange(len(least)) + least_words <= part.bounds[1:][unit])
                least, unit = least[at].view(np.int64), unit[at]
                if each:
                    ends = np.searchsorted(unit, np.arange(len(lengths) + 1))
                    some = [np.isin(least[a:b], wanted[int(part.rows[k])].values.to_numpy()) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
                    some = np.concatenate(some) if some else np.zeros(0, dtype=bool)
                    at, least, unit = at[some], least[some], unit[some]
                    last = at
                else:
                    new = np.ones(len(at), dtype=bool)
                    new[1:] = (least[1:] != least[:-1]) | (unit[1:] != unit[:-1])
                    lengths = np.diff(np.append(np.flatnonzero(new), len(at)))
                    new |= np.repeat(lengths > least_words - size + 1, lengths)  # the least shingle stands there twice, so windows may repeat within
                    first = np.flatnonzero(new)
                    last = at[np.append(first[1:], len(at)) - 1] if len(at) else at
                    at, least, unit = at[first], least[first], unit[first]
                if not len(at):
                    continue
                points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                breaks = np.concatenate([[0], np.cumsum(part.data == 10)])
                begin = part.offsets[:-1][unit]
                owner = pa.array(part.rows[unit])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(owner).cast(kind),
                        batch.column("doc").take(owner),
                        pa.array(at - part.bounds[:-1][unit]),
                        pa.array(last - at + 1),
                        pa.array(points[part.starts[at]] - points[begin]),
                        pa.array(points[part.ends[last + least_words - 1]] - points[begin]),
                        pa.array((breaks[part.starts[at]] - breaks[begin]).astype(np.int32)),
                        pa.array(least),
                        pa.array(hashed(at, last + least_words).view(np.int64)),
                    ],
                    ["row", "doc", "at", "n", "start", "stop", "line", "anchor", "key"],
                )

    return windows


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place of every run of ``least_words`` words or more that repeats; columns as repeated_paragraphs, kind is ``run``.

    Words are equal but for A-Z and a-z, what is between them doesn't matter. A run is as long as it and its first place (by id, then
    position) go on alike; ``line`` is where it starts, ``places`` are those of its most frequent window, ``cluster_id``
    tells the first place. A window that overlaps its first place is no place of its own. Rows that share id and text are one document
    in the result and count as places of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("doc", F.xxhash64("row", "text"))
    field = texts.schema["row"].dataType
    ddl = f"row {field.simpleString()}, doc long, at long, n long, start long, stop long, line int, anchor long, key long"
    found = kept(texts.mapInArrow(_windows(least_words, to_arrow_type(field), False), ddl), "stretches")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("low"), F.max("key").alias("high"))
    anchors = anchors.filter(F.col("c") > 1).select("anchor", (F.col("low") == F.col("high")).alias("alike"))
    met = kept(found.join(anchors, "anchor"), "met")
    differing = met.filter(~F.col("alike")).groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    differing = broadcast_if_small(kept(differing.withColumnRenamed("row", "_row"), "differing"))
    again = texts.join(differing, F.col("row").eqNullSafe(F.col("_row"))).select("row", "doc", "text", "anchors")
    singles = again.mapInArrow(_windows(least_words, to_arrow_type(field), True), ddl)
    rows = kept(met.filter("alike").select(found.columns).unionByName(singles).drop("anchor"), "windows")

    place = F.struct(F.col("row").isNull().alias("no_id"), "row", "at", "doc", "line")
    firsts = rows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).drop("c")
    apart = F.col("at") - F.col("first.at")
    overlaps = (F.col("doc") == F.col("first.doc")) & (apart > 0) & (apart < least_words)
    here = kept(rows.join(firsts, "key").filter(~overlaps), "places")
    places = here.groupBy("key").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > 1)
    here = here.join(places, "key").withColumns({"of": F.col("first.doc"), "apart": apart}).drop("key")
    here = here.dropDuplicates(["doc", "of", "apart", "at"])
    along = Window.partitionBy("doc", "of", "apart").orderBy("at")
    here = here.withColumn("before", F.max(F.col("at") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    here = here.withColumn("run", F.sum(F.when(F.col("at") <= F.col("before"), 0).otherwise(1)).over(along))
    runs = here.groupBy("doc", "of", "apart", "run").agg(
        F.first("row").alias(id_col),
        F.min("line").alias("line"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.max(F.col("at") + F.col("n")) - F.min("at") + least_words - 1).alias("n_words"),
        F.min(F.struct("at", "first")).getField("first").alias("first"),
        F.max("places").alias("places"),
    )
    return runs.select(
        id_col,
        "line",
        "start",
        "stop",
        "n_words",
        F.xxhash64("of", "first.at").alias("cluster_id"),
        F.col("first.row").alias("first_id"),
        F.col("first.line").alias("first_line"),
        "places",
        (~(F.col(id_col).eqNullSafe(F.col("first.row")) & (F.col("apart") == 0))).alias("removed"),
        F.lit("run").alias("kind"),
    )


def _without(text: str, lines: list[int], starts: list[int], stops: list[int]) -> str:
    """The text without these lines, and without these stretches of the others; a line that goes whole takes its break along."""
    gone, spans, left, at = set(lines), sorted(zip(starts, stops)), [], 0
    for number, line in enumerate(text.split("\n")):
        parts, done = [], 0
        for a, b in spans:
            a, b = max(a - at, done), min(b - at, len(line))
            if a < b:
                parts.append(line[done:a])
                done = b
        parts.append(line[done:])
        rest = "".join(parts)
        if number not in gone and (rest.strip() or not line.strip()):
            left.append(rest)
        at += len(line) + 1
    return "\n".join(left)


def remove_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """The documents with all their columns, without the lines and runs that ``repeats`` (from repeated_paragraphs, repeated_runs or both) removes."""
    line, run = F.col("kind") == "line", F.col("kind") == "run"
    cuts = repeats.filter("removed").groupBy(F.col("doc_id").alias("_of")).agg(
        F.collect_set(F.when(line, F.col("line"))).alias("_lines"),
        F.collect_list(F.when(run, F.col("start"))).alias("_starts"),
        F.collect_list(F.when(run, F.col("stop"))).alias("_stops"),
    )
    joined = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    cut = F.udf(_without, "string", useArrow=False)
    changed = F.col("_lines").isNotNull() & F.col("text").isNotNull()
    safe = [F.coalesce("text", F.lit("")), *[F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in (("_lines", "int"), ("_starts", "long"), ("_stops", "long"))]]
    return joined.withColumn("text", F.when(changed, cut(*safe)).otherwise(F.col("text"))).select(*docs.columns)


def op7_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of every line of 50 words or more that nearly repeats, and of every run of 50 words or more that repeats, in the documents."""
    docs = table(spark, folder, "documents")
    return repeated_paragraphs(docs).unionByName(repeated_runs(docs))
