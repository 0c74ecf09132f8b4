"""A Merkle manifest of a dataset whose parents keep the hash states before each child.

Leaves are numbered within their list over all tasks and dealt into tiles of about a thousand consecutive ones; a task
builds the part of the tree above a tile, and the tiles' tops are the leaves of the next pass, until one node is left for each list.
The tops of all lists form one more tree. A stored tile holds its nodes and, for every parent, the copied SHA-256 states
before its child slots. A changed leaf is folded into a new root by resuming the state before its slot with the new digest
and the siblings to the right alone; what is to the left isn't hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketwise.llm.sha256 import START, compress, finish, from_bytes, hex_block, to_bytes
from basketwise.llm.store import kept, numbered, table

#: Leaves of a tile at most; bounds what a task holds.
TILE_LEAVES = 1024
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_TILE = "list string, tile long, size int, nodes binary, states binary, top binary"
_PATH = "list string, tile long, slots array<int>, counts array<int>, path_states binary, siblings binary, subroot binary, root binary"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) over each field: its bytes' number, a colon and its text in UTF-8; a null is a hyphen."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(field) for field in fields]).cast("binary"), 256)


def _levels_of(size: int, fan: int, whole: int) -> int:
    """Levels above ``size`` leaves; ``whole``: what a tile that has neighbours takes."""
    levels, left = 0, size
    while left > 1 or (whole and levels < whole):
        levels, left = levels + 1, -(-left // fan)
    return levels


class Tile:
    """Part of a tree: nodes by level from the leaves up, and for each parent the states before its slots 1, 2, ...

    The state before slot 0 is SHA-256's start.
    """

    def __init__(self, nodes: list[np.ndarray], states: list[list[np.ndarray]], fan: int):
        self.nodes, self.states, self.fan = nodes, states, fan

    @classmethod
    def grow(cls, leaves: np.ndarray, fan: int, whole: int) -> Tile:
        nodes, states = [leaves], []
        for _ in range(_levels_of(leaves.shape[1], fan, whole)):
            below = nodes[-1]
            n = below.shape[1]
            parents = -(-n // fan)
            state, before = np.repeat(START, parents, axis=1), []
            for slot in range(fan):
                here = -(-(n - slot) // fan)  # parents that have a child in this slot: all but the last, or all
                if slot:
                    before.append(state)
                state = np.concatenate([compress(state[:, :here], hex_block(below[:, slot::fan])), state[:, here:]], axis=1)
            nodes.append(finish(state, np.minimum(fan, n - fan * np.arange(parents))))
            states.append(before)
        return cls(nodes, states, fan)

    @classmethod
    def read(cls, size: int, nodes: bytes, states: bytes, fan: int) -> Tile:
        every, kept_states = from_bytes(nodes), from_bytes(states)
        levels, at, left = [], 0, size
        while at < every.shape[1]:
            levels.append(every[:, at : at + left])
            at, left = at + left, -(-left // fan)
        per_level, at = [], 0
        for level in levels[1:]:
            n = level.shape[1]
            per_level.append([kept_states[:, at + k * n : at + (k + 1) * n] for k in range(fan - 1)])
            at += (fan - 1) * n
        return cls(levels, per_level, fan)

    def node_bytes(self) -> bytes:
        return b"".join(map(to_bytes, self.nodes))

    def state_bytes(self) -> bytes:
        return b"".join(to_bytes(state) for level in self.states for state in level)

    def fold(self, at: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The tops that come out if the leaf ``at[i]`` alone is replaced by ``digests[:, i]``, for each i."""
        for level, before in enumerate(self.states):
            below, slot, parent = self.nodes[level], at % self.fan, at // self.fan
            state = np.repeat(START, len(at), axis=1)
            for k in range(1, self.fan):
                here = slot == k
                state[:, here] = before[k - 1][:, parent[here]]
            state = compress(state, hex_block(digests))
            n = below.shape[1]
            for k in range(1, self.fan):
                right = np.flatnonzero((slot < k) & (parent * self.fan + k < n))
                if len(right):
                    state[:, right] = compress(state[:, right], hex_block(below[:, parent[right] * self.fan + k]))
            digests, at = finish(state, np.minimum(self.fan, n - parent * self.fan)), parent
        return digests

    def siblings(self, at: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(level, slot, parent, places of the siblings, left to right) from leaf ``at`` up."""
        for level in range(len(self.states)):
            parent, slot, n = at // self.fan, at % self.fan, self.nodes[level].shape[1]
            yield level, slot, parent, [p for p in range(parent * self.fan, min((parent + 1) * self.fan, n)) if p != at]
            at = parent


class Path(NamedTuple):
    """Steps from a tile's top to the root: slot and run of each, the state before the slot, and the siblings."""

    slots: list[int]
    counts: list[int]
    states: bytes
    siblings: bytes

    def fold(self, digests: np.ndarray) -> np.ndarray:
        """The roots that come out if the top is replaced by each of ``digests``."""
        states, siblings, before = from_bytes(self.states), from_bytes(self.siblings), 0
        n = digests.shape[1]
        for step, (slot, count) in enumerate(zip(self.slots, self.counts)):
            state = compress(np.repeat(states[:, step : step + 1], n, axis=1), hex_block(digests))
            for right in range(before + slot, before + count - 1):
                state = compress(state, np.repeat(hex_block(siblings[:, right : right + 1]), n, axis=1))
            digests, before = finish(state, np.full(n, count)), before + count - 1
        return digests


def _grow_tiles(fan: int, whole: int):
    def grow(key: tuple[pa.Scalar, ...], leaves: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        tile, n = key[1].as_py(), len(leaves)
        # every tile but the last of its list is full; one that is alone in its list ends where one node is left
        grown = Tile.grow(from_bytes(b"".join(leaves.column("digest").to_pylist())), fan, whole if tile or n == fan**whole else 0)
        row = {
            "list": [key[0].as_py()], "tile": [tile], "size": [n], "nodes": [grown.node_bytes()],
            "states": [grown.state_bytes()], "top": [to_bytes(grown.nodes[-1])],
        }
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(row.items(), kinds)})

    return grow


def _paths_down(fan: int):
    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each leaf of each tile: the steps to the tile's top, then those above it."""
        for batch in batches:
            for row in batch.to_pylist():
                tile = Tile.read(row["size"], row["nodes"], row["states"], fan)
                out = {name: [] for name in ("list", "tile", "slots", "counts", "path_states", "siblings", "subroot", "root")}
                for at in range(row["size"]):
                    slots, counts, states, siblings = [], [], [], []
                    for level, slot, parent, others in tile.siblings(at):
                        slots.append(slot)
                        counts.append(len(others) + 1)
                        states.append(to_bytes(tile.states[level][slot - 1][:, parent : parent + 1] if slot else START))
                        siblings.append(to_bytes(tile.nodes[level][:, others]))
                    out["slots"].append(slots + row["slots"])
                    out["counts"].append(counts + row["counts"])
                    out["path_states"].append(b"".join(states) + row["path_states"])
                    out["siblings"].append(b"".join(siblings) + row["siblings"])
                size = row["size"]
                first = row["tile"] * fan**whole_levels(fan)
                out["list"], out["tile"] = [row["list"]] * size, list(range(first, first + size))
                out["subroot"], out["root"] = [row["subroot"]] * size, [row["root"]] * size
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return down


def whole_levels(fan: int) -> int:
    """Levels of a full tile."""
    levels = 1
    while fan ** (levels + 1) <= TILE_LEAVES:
        levels += 1
    return levels


def _forest(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The tiles, pass by pass, of (list, at, digest); the last pass has one tile for each list."""
    whole = whole_levels(fan)
    passes, nodes = [], leaves
    while True:
        tile = F.expr(f"at div {fan**whole}").alias("tile")
        passes.append(kept(nodes.groupBy("list", tile).applyInArrow(_grow_tiles(fan, whole), _TILE), "tiles"))
        if passes[-1].filter("tile > 0").isEmpty():
            return passes
        nodes = passes[-1].select("list", F.col("tile").alias("at"), F.col("top").alias("digest"))


def _down(passes: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The paths of the first pass's tiles; ``above`` has those of the last pass's tops."""
    for tiles in reversed(passes[1:]):
        above = kept(tiles.join(above, ["list", "tile"]).mapInArrow(_paths_down(fan), _PATH), "paths")
    return above


class Manifest(NamedTuple):
    """The stored tree of a dataset."""

    leaves: DataFrame  # the rows given, with list and place (at) in it
    tiles: DataFrame  # nodes and states above each tile of leaves
    paths: DataFrame  # steps from each tile to the root, subroot and root
    fan: int


def build_manifest(rows: DataFrame, list_col: str, order: list[str], digest: str, fan: int = 2) -> Manifest:
    """The tree over ``rows``, which have a SHA-256 in ``digest`` (hex).

    A list is the rows with one value of ``list_col`` (null is a list of its own and comes first), ascending by ``order``, nulls
    first, and then by digest; rows alike in all of these are leaves of their own, side by side. Every ``fan`` consecutive nodes
    become their parent, also a last run with fewer, until one is left. The lists' tops, ascending by ``list_col``, give the root likewise.
    """
    named = F.when(F.col(list_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(list_col).cast("string")))
    given = kept(rows.withColumn("list", named), "leaves")  # each text is read and hashed once
    leaves = numbered(given, "list", [*order, digest], "at")
    passes = _forest(leaves.select("list", "at", F.unhex(digest).alias("digest")), fan)
    tops = passes[-1].select(F.col("list").alias("name"), F.col("top").alias("subroot"))
    listed = numbered(tops.withColumn("list", F.lit("")), "list", ["name"], "at")
    top_passes = _forest(listed.select("list", "at", F.col("subroot").alias("digest")), fan)
    empty, none = F.array().cast("array<int>"), F.lit(b"")
    root = top_passes[-1].select(
        "list", "tile", empty.alias("slots"), empty.alias("counts"), none.alias("path_states"), none.alias("siblings"),
        none.alias("subroot"), F.col("top").alias("root"),
    )
    # the tops' own tiles too: a path then begins at a list's top
    ways = kept(top_passes[0].join(_down(top_passes, root, fan), ["list", "tile"]).mapInArrow(_paths_down(fan), _PATH), "paths")
    above = listed.join(ways.withColumnRenamed("tile", "at").drop("list", "subroot"), "at").select(
        F.col("name").alias("list"), F.lit(0).cast("long").alias("tile"), "slots", "counts", "path_states", "siblings", "subroot", "root"
    )
    return Manifest(leaves, passes[0], _down(passes, above, fan), fan)


def fold_leaves(manifest: Manifest, digest: str, replacement: str, id_col: str) -> DataFrame:
    """For each leaf: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    folded_root is the root if ``replacement`` (hex) stood in place of that leaf alone; verified tells whether it is the root.
    proof_sha256 is the digest of all siblings on the way to the root, level by level, left to right.
    """
    fan = manifest.fan
    kind = manifest.leaves.schema[id_col].dataType.simpleString()
    span = fan ** whole_levels(fan)

    def fold(leaves: pa.Table, tiles: pa.Table) -> pa.Table:
        row = tiles.to_pylist()[0]
        tile = Tile.read(row["size"], row["nodes"], row["states"], fan)
        path = Path(row["slots"], row["counts"], row["path_states"], row["siblings"])
        at = leaves.column("at").to_numpy() % span
        tops = tile.fold(at, from_bytes(b"".join(leaves.column("replacement").to_pylist())))
        distinct, which = np.unique(tops, axis=1, return_inverse=True)  # unchanged leaves share their tile's top
        folded = to_bytes(path.fold(distinct)).hex()
        hexes = [to_bytes(level).hex() for level in tile.nodes]
        above = path.siblings.hex()
        proofs = []
        for place in at.tolist():
            near = [hexes[level][64 * p : 64 * p + 64] for level, _, _, others in tile.siblings(place) for p in others]
            proofs.append(hashlib.sha256(("".join(near) + above).encode()).hexdigest())
        n, root = len(leaves), row["root"].hex()
        roots = [folded[64 * i : 64 * i + 64] for i in which.ravel().tolist()]
        return pa.table(
            [leaves.column("id"), leaves.column("leaf"), pa.array([row["subroot"].hex()] * n, pa.string()), pa.array([root] * n, pa.string()),
             pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array([r == root for r in roots], pa.bool_())],
            ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    place = F.expr(f"at div {span}").alias("tile")
    leaves = manifest.leaves.select(
        "list", place, "at", F.col(id_col).alias("id"), F.col(digest).alias("leaf"), F.unhex(replacement).alias("replacement")
    )
    tiles = manifest.tiles.drop("top").join(manifest.paths, ["list", "tile"])
    folded = leaves.groupBy("list", "tile").cogroup(tiles.groupBy("list", "tile")).applyInArrow(
        fold, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return folded.withColumnRenamed("id", id_col)


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """The documents' tree by language, each leaf folded again after a planted change, see fold_leaves.

    Where 7 divides the CRC-32 of the id (decimal), the change adds 1 to n_chars; a null n_chars or id is left as it is. Null fields are
    told apart from empty ones. Repeated rows and repeated or null ids are leaves of their own. An empty table gives no rows.
    """
    planted = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(f) + F.when(planted, 1).otherwise(0) if f == "n_chars" else F.col(f) for f in FIELDS]
    leaf = leaf_digest([F.col(f) for f in FIELDS])
    rows = docs.select(
        "doc_id", "lang", leaf.alias("leaf"), F.when(planted & F.col("n_chars").isNotNull(), leaf_digest(changed)).otherwise(leaf).alias("changed")
    )
    return fold_leaves(build_manifest(rows, "lang", ["doc_id"], "leaf"), "leaf", "changed", "doc_id")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the tree, with planted changes."""
    return manifest_of_documents(table(spark, folder, "documents"))


def _hashed(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


#: DuckDB has no CRC-32: one step per byte and bit, by the polynomial of zlib.
_CRC32 = """xor(4294967295, list_reduce(
  [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT] || [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""

SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS list, {_hashed("n_chars")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 7 = 0 THEN {_hashed("n_chars + 1")} ELSE {_hashed("n_chars")} END AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS k FROM d),
tree AS (
  SELECT list, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY list) AS n FROM leaves
  UNION ALL
  SELECT list, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY list, lvl, n, pos // 2),
subroots AS (SELECT list, h AS subroot, row_number() OVER (ORDER BY list) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, n, pos // 2),
sizes AS (SELECT DISTINCT list, lvl, n FROM tree),
top_sizes AS (SELECT DISTINCT lvl, n FROM top),
climb AS (
  SELECT k, list, 0 AS lvl, pos, changed AS cur, '' AS siblings FROM leaves
  UNION ALL
  SELECT c.k, c.list, c.lvl + 1, c.pos // 2,
         sha256(CASE WHEN s.h IS NULL THEN cur WHEN c.pos % 2 = 0 THEN cur || s.h ELSE s.h || cur END), siblings || coalesce(s.h, '')
  FROM climb c JOIN sizes z ON z.list = c.list AND z.lvl = c.lvl AND z.n > 1
  LEFT JOIN tree s ON s.list = c.list AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1)),
up AS (
  SELECT c.k, 0 AS lvl, r.pos, c.cur, c.siblings
  FROM climb c JOIN sizes z ON z.list = c.list AND z.lvl = c.lvl AND z.n = 1 JOIN subroots r ON r.list = c.list
  UNION ALL
  SELECT u.k, u.lvl + 1, u.pos // 2,
         sha256(CASE WHEN s.h IS NULL THEN cur WHEN u.pos % 2 = 0 THEN cur || s.h ELSE s.h || cur END), siblings || coalesce(s.h, '')
  FROM up u JOIN top_sizes z ON z.lvl = u.lvl AND z.n > 1 LEFT JOIN top s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1))
SELECT doc_id, leaf, subroot, t.h AS root, sha256(u.siblings) AS proof_sha256, u.cur AS folded_root, u.cur = t.h AS verified
FROM leaves JOIN subroots USING (list) JOIN up u USING (k) JOIN top_sizes z ON z.lvl = u.lvl AND z.n = 1 JOIN top t ON t.n = 1
"""
}
