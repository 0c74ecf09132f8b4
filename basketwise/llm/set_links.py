"""Links between similar sets that meet in buckets, without pairing the members of a bucket with each other.

Candidates of one probe are compared in the order of their sequences, which walks the prefix tree of their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.functions.durable import broadcast_if_small
from basketwise.llm.components import components
from basketwise.llm.store import kept
from basketwise.llm.words import MARK_WORDS, list_array


#: Members of a bucket that each one is compared with before the last round.
NEIGHBOURS, HUBS = 8, 16
#: Candidates that a task gets for one probe at a time, and requests that go with one reading of a text.
SLOT_ROWS = 256
#: Tokens in one batch of sets.
SENT_TOKENS = 1 << 18
#: Makes the sets of a batch of texts: (row in the batch of each set, its key, tokens, bounds of each set's tokens), part by part.
Sets = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


class Probe:
    """One set, and the walk over the tree of the sets it is compared with, which come in the order of their sequences."""

    BLOCK = 256

    def __init__(self, tokens: np.ndarray, percent: int):
        self.x, self.percent = tokens, percent
        self.path = np.zeros(0, dtype=np.int64)  # the last sequence
        self.overlaps = np.zeros(1, dtype=np.int64)  # overlap with each beginning of it, as far as it was walked
        self.dead = None  # depth of the node under which nothing can be similar

    def similar(self, y: np.ndarray) -> bool:
        x, n = self.x, len(y)
        k = min(len(self.path), n)
        differ = np.flatnonzero(self.path[:k] != y[:k])
        shared = int(differ[0]) if len(differ) else k
        self.path = y
        if self.dead is not None and shared >= self.dead:
            return False  # pruned with its subtree
        self.dead = None
        done = min(shared, len(self.overlaps) - 1)
        overlaps = [self.overlaps[: done + 1]]
        have = int(overlaps[0][-1])
        while done < n:
            block = y[done : done + self.BLOCK]
            at = np.searchsorted(x, block)
            hit = x[np.minimum(at, len(x) - 1)] == block
            overlaps.append(have + np.cumsum(hit))
            have, done = int(overlaps[-1][-1]), done + len(block)
            left = len(x) - int(at[-1]) - int(hit[-1])
            if 100 * (have + left) < self.percent * len(x):
                self.dead = done  # too little of x remains, however long the set
                break
            if not self._enough(have + min(left, n - done), n):
                break
        self.overlaps = np.concatenate(overlaps)
        return done == n and self.dead is None and self._enough(have, n)

    def _enough(self, overlap: int, n: int) -> bool:
        return 100 * overlap >= self.percent * (len(self.x) + n - overlap)


def _walk(percent: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by a: the probe's own row (b is null) first, then its candidates in the order of their tokens."""
        probe, now = None, None
        for batch in batches:
            lists = batch.column("tokens")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            found: tuple[list[int], list[int]] = ([], [])
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                tokens = values[offsets[i] : offsets[i + 1]]
                if b is None:
                    probe, now = Probe(tokens, percent), a
                elif a == now and probe.similar(tokens):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return walk


def _sends(sets: Sets):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, slot, b, tokens) for everything that is wanted of each text, a bounded number of tokens at a time."""
        given = set()  # repeated rows of a task send nothing twice
        for batch in batches:
            wanted, shares = batch.column("wanted"), batch.column("share").to_pylist()
            bounds = wanted.offsets.to_numpy()
            asked = [wanted.values.field(c) for c in ("key", "a", "slot", "b")]
            keys_asked = asked[0].to_numpy(zero_copy_only=False)
            out, size = [], 0
            for rows, keys, tokens, ends in sets(batch.column("text")):
                for unit, (row, key) in enumerate(zip(rows.tolist(), keys.tolist())):
                    lo, hi = bounds[row], bounds[row + 1]
                    at = lo + np.flatnonzero(keys_asked[lo:hi] == key)
                    if not len(at) or (key, shares[row]) in given:
                        continue
                    given.add((key, shares[row]))
                    values = tokens[ends[unit] : ends[unit + 1]]
                    for place in at:
                        out.append((place, values))
                        size += len(values)
                        if size >= SENT_TOKENS:
                            yield _sent(out, asked)
                            out, size = [], 0
            if out:
                yield _sent(out, asked)

    return send


def _sent(out: list[tuple[int, np.ndarray]], asked: list[pa.Array]) -> pa.RecordBatch:
    places = pa.array([place for place, _ in out], pa.int64())
    ends = np.concatenate([[0], np.cumsum([len(values) for _, values in out])])
    tokens = list_array(np.concatenate([values for _, values in out]).view(np.int64), ends)
    return pa.RecordBatch.from_arrays([*[column.take(places) for column in asked[1:]], tokens], ["a", "slot", "b", "tokens"])


def _in_slots(rows: DataFrame, of: list[str], other: str, most: int, to: str) -> DataFrame:
    """Number the rows of each group ``of`` with slots of about ``most`` rows, so that no group stays in one task."""
    large = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    large = large.select(*[F.col(c).alias(f"_{c}") for c in of], F.ceil(F.col("_rows") / most).cast("long").alias("_slots"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of]
    slot = F.pmod(F.xxhash64(other), F.coalesce("_slots", F.lit(1)))
    return rows.join(large, same, "left").withColumn(to, slot).select(*rows.columns, to)


def _verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar.

    Sets aren't stored: each text is read with the list of the probes that want a set of it, and sends the set there. A probe with
    many candidates is dealt into slots, each of which gets the probe's own set before its candidates.
    """
    dealt = _in_slots(pairs, ["a"], "b", SLOT_ROWS, "slot")
    probes = dealt.select(F.col("a").alias("key"), "a", "slot", F.lit(None).cast("long").alias("b")).distinct()
    asked = probes.unionByName(dealt.select(F.col("b").alias("key"), "a", "slot", "b"))
    asked = asked.join(known.select("key", "row", "code"), "key")
    asked = _in_slots(asked, ["row", "code"], "a", SLOT_ROWS, "share")
    wanted = asked.groupBy("row", "code", "share").agg(F.collect_list(F.struct("key", "a", "slot", "b")).alias("wanted"))
    wanted = broadcast_if_small(wanted.select(F.col("row").alias("_row"), F.col("code").alias("_code"), "share", "wanted"))
    here = texts.join(wanted, F.col("row").eqNullSafe(F.col("_row")) & (F.col("code") == F.col("_code")))
    sent = here.select("text", "share", "wanted").mapInArrow(_sends(sets), "a long, slot long, b long, tokens array<long>")
    sent = sent.repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").isNotNull(), "tokens")
    return sent.select("a", "b", "tokens").mapInArrow(_walk(percent), "a long, b long")


def _may_link(x: tuple[Column, Column], y: tuple[Column, Column], percent: int) -> Column:
    """Size and position bounds for (n, position) of a shared token; a similar pair meets them at its first one."""
    (n, p), (m, q) = x, y
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    most = F.least(n - p, m - q)
    return sizes & ((100 + percent) * most >= percent * (n + m))


def _marks_near(x: tuple[Column, Column], y: tuple[Column, Column], percent: int) -> Column:
    """Parity marks differ in no more bits than similar sets may differ in tokens; for (n, mark) of two sets."""
    (n, a), (m, b) = x, y
    differ = F.lit(0)
    for word in range(MARK_WORDS):
        differ = differ + F.bit_count(a[word].bitwiseXOR(b[word]))
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def _wide_marks_near(x: tuple[Column, Column], y: tuple[Column, Column], percent: int) -> Column:
    """As _marks_near, for wide marks; the wider one is folded to the width of the other."""
    (n, a), (m, b) = x, y
    words = F.least(F.size(a), F.size(b))

    def folded(mark: Column, at: Column) -> Column:
        parts = F.sequence(F.lit(0), (F.size(mark) / words).cast("int") - 1)
        return F.aggregate(parts, F.lit(0).cast("long"), lambda bits, part: bits.bitwiseXOR(F.get(mark, at + part * words)))

    each = F.sequence(F.lit(0), words - 1)
    differ = F.aggregate(each, F.lit(0), lambda sum_, at: sum_ + F.bit_count(folded(a, at).bitwiseXOR(folded(b, at))))
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def similar_in_buckets(posted: DataFrame, known: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, label): links (a, b) between keys of similar sets that share a bucket, and the components (node, component) they make.

    ``posted``: (token, key, n, p), a row for each bucket (token) a set is in; ``n`` is its size and ``p`` the position of the
    token in it (0 where positions mean nothing). ``known``: (key, row, code, n, mark, wide), one row per set with its parity marks; ``row``
    and ``code`` find a text that has it in ``texts`` (row, code, text), of which ``sets`` makes the sets again.
    All links are found except such as join two sets that others connect.

    First each member of a bucket is compared with the next one in a random order that all buckets share, then with its
    NEIGHBOURS next ones, then with the HUBS members of its bucket that have most links so far. What these links connect
    need not be compared again: then only members outside the largest component of their bucket are held against those
    of other components. So a bucket of near copies costs its size, not its square, and its sets are sent about twice.
    A bucket of so few members that a round holds each against each goes no further: most meet by chance in twos and threes.
    Pairs that their parity marks rule out are never sent.
    """
    met = kept(_distinct_buckets(posted), "meetings")
    known = kept(known.join(met.select("key").distinct(), "key"), "known")
    rows = met.select("token", "key", "n", "p", F.col("key").alias("component"))
    links = done = label = None
    for nearby, settled in ((_next(1), 1), (_next(NEIGHBOURS), 2), (_hubs, 1 + NEIGHBOURS), (_across, max(1 + NEIGHBOURS, HUBS))):
        if links is not None:
            rows = _mixed_buckets(met.filter(F.col("size") > settled), label)
        pairs = nearby(rows, links, known, percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = kept(_not_ruled_out(pairs, known, percent), "pairs")
        more = kept(_verified(pairs, known, texts, sets, percent), "links")
        done = pairs if done is None else done.unionByName(pairs)
        label = _joined(label, more)
        links = more if links is None else links.unionByName(more)
    return links, label


def _joined(label: DataFrame | None, more: DataFrame) -> DataFrame:
    """The components after ``more`` links. Those so far stand in for the links that made them."""
    if label is None:
        return components(more)
    if more.isEmpty():
        return label
    return components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _distinct_buckets(posted: DataFrame) -> DataFrame:
    """The rows of the buckets with two members or more; of buckets with the same members, those of the least token.

    Near copies share most of their tokens, so they meet in many buckets that say the same. The least token of these is the first one that any
    two of its members share, and positions rule a pair out by no other; where positions mean nothing, one bucket is as good as another.
    """
    bucket = Window.partitionBy("token")
    members = {"size": F.count(F.lit(1)), "low": F.min("key"), "code": F.bit_xor(F.xxhash64("key"))}
    met = posted.withColumns({name: value.over(bucket) for name, value in members.items()}).filter("size > 1")
    met = kept(met, "buckets")
    first = met.filter("key = low").groupBy(*members).agg(F.min("token").alias("token")).select("token")
    return met.join(first, "token", "left_semi").select("token", "key", "n", "p", "size")


def _next(neighbours: int):
    def beside(rows: DataFrame, links: DataFrame | None, known: DataFrame, percent: int) -> DataFrame:
        """Pairs (a, b) next to each other in a random order of each bucket."""
        order = Window.partitionBy("token").orderBy(F.xxhash64("key", F.lit(1)), "key")
        here = F.struct("key", "n", "p", "component")
        others = F.array(*[F.lead(here, i + 1).over(order) for i in range(neighbours)])
        return _pairs(rows.withColumn("others", others).withColumn("other", F.explode("others")), percent)

    return beside


def _hubs(rows: DataFrame, links: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, b or a being among the members of the bucket with most links."""
    ends = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key")))
    degree = ends.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    ranked = rows.join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("token").orderBy(F.desc("degree"), "key")
    first = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HUBS)
    hubs = first.groupBy("token").agg(F.collect_list(F.struct("key", "n", "p", "component")).alias("others"))
    return _pairs(rows.join(hubs, "token").withColumn("other", F.explode("others")), percent)


def _not_ruled_out(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the parity marks of their sets leave. Wide marks are fetched for those only that the short ones leave."""
    x, y = F.col("of_a"), F.col("of_b")
    for mark, near in (("mark", _marks_near), ("wide", _wide_marks_near)):
        if mark == "wide":
            pairs = kept(pairs, "near")
            ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
            known = known.join(broadcast_if_small(ends), "key", "left_semi")
        for end in ("a", "b"):
            pairs = pairs.join(known.select(F.col("key").alias(end), F.struct("n", mark).alias(f"of_{end}")), end)
        pairs = pairs.filter(near((x["n"], x[mark]), (y["n"], y[mark]), percent)).select("a", "b")
    return pairs


def _pairs(beside: DataFrame, percent: int) -> DataFrame:
    beside = beside.filter(
        (F.col("other.component") != F.col("component"))
        & _may_link((F.col("n"), F.col("p")), (F.col("other.n"), F.col("other.p")), percent)
    )
    return beside.select(F.least("key", "other.key").alias("a"), F.greatest("key", "other.key").alias("b")).distinct()


def _mixed_buckets(met: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, with their component."""
    label = label.select(F.col("node").alias("key"), "component")
    labelled = met.select("token", "key", "n", "p").join(label, "key", "left")
    labelled = kept(labelled.withColumn("component", F.coalesce("component", "key")), "labelled")
    kinds = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = kinds.filter(F.col("low") != F.col("high")).select("token")
    return kept(labelled.join(mixed, "token"), "mixed")


def _across(rows: DataFrame, links: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket, of which one isn't in the bucket's largest component."""
    shares = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    major = shares.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("major"))
    open_rows = rows.join(major, "token").join(known.select("key", "mark"), "key")
    minor = open_rows.filter(F.col("component") != F.col("major")).select(
        "token", *[F.col(c).alias(f"m_{c}") for c in ("key", "n", "p", "component", "mark")]
    )
    cross = minor.join(open_rows, "token").filter(
        (F.col("m_component") != F.col("component"))
        & ((F.col("component") == F.col("major")) | (F.col("m_key") < F.col("key")))
        & _may_link((F.col("m_n"), F.col("m_p")), (F.col("n"), F.col("p")), percent)
        & _marks_near((F.col("m_n"), F.col("m_mark")), (F.col("n"), F.col("mark")), percent)
    )
    return cross.select(F.least("m_key", "key").alias("a"), F.greatest("m_key", "key").alias("b")).distinct()
