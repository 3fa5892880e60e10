"""Merkle manifest of a table, and membership proofs of all its rows by octopus multiproofs.

Every row is a leaf, the leaves of a group in order are a tree, and the trees'
roots in order are the leaves of one more tree. Trees are built bottom up in
blocks of whole subtrees, some levels at a time, and every interior node is kept
in a table under its coordinate (tree, level, index).

Proofs are not looked up leaf by leaf. The leaves are cut into stretches of equal
length; of a stretch only the nodes it cannot derive itself are needed, which is
the smallest set that proves all its leaves at once. The sets of all stretches
are fetched by one join, each stretch derives its shared interiors from its
leaves and the fetched nodes, and single proofs are read off them locally.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import bounded_batches, if_small, partitions, run_starts, runs, written

ARITY = 2
#: Leaves of a block of a tree, at most, and of a stretch of leaves that is proved at once.
BLOCK, STRETCH = 4096, 16384
#: Tree number of the tree over the groups' roots.
TOP = -1


@dataclass(frozen=True)
class Manifest:
    """``leaves``: rank, tree, n, idx, id, kind, leaf, presented; ``nodes``: tree, level, idx, n, hash; ``trees``: tree, kind, n, subroot.

    ``n`` is the number of nodes of the tree at that level, ``kind`` the group's value.
    ``presented`` is the leaf to be verified where it differs from the recorded one.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    arity: int


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's encoded values."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def ranked(rows: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """The rows with ``name``, their place from 0 in the order; written.

    Rows are dealt by ranges of the order, so no value of a leading column is one
    task. Of each range only its number of rows goes through the driver. A null
    comes first. The order must tell rows apart that are not alike.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    numbered = written(dealt.withColumn("spot", F.monotonically_increasing_id()), label)
    part = F.shiftright("spot", 33)
    sizes = sorted(tuple(r) for r in numbered.groupBy(part.alias("part")).count().collect())
    begins = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, begins)], "part bigint, part_begin bigint")
    within = F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(starts), part == F.col("part"))  # a row for each range
        .withColumn(name, F.col("part_begin") + within)
        .drop("spot", "part", "part_begin")
    )


def level_sizes(n: int, arity: int) -> list[int]:
    """Numbers of nodes of a tree of ``n`` leaves, level by level up to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def interiors(nodes: DataFrame, most: int, arity: int, label: str) -> list[DataFrame]:
    """All nodes above the given lowest ones (``tree, level, idx, n, hash``), a table for some levels at a time.

    ``most`` is the number of leaves of the largest tree. A block is a whole subtree
    of up to ``BLOCK`` nodes; a tree of any size is many blocks.
    """
    spark = nodes.sparkSession
    height = max(1, next(h for h in range(64) if arity ** (h + 1) > BLOCK))
    span = arity**height

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in runs(frames, "key"):
            tree, base, n, first = (int(block[c].iat[0]) for c in ("tree", "level", "n", "idx"))
            hashes, sizes = block["hash"].tolist(), level_sizes(n, arity)
            for up, size in enumerate(sizes[1 : height + 1], 1):
                hashes = [digest(hashes[i : i + arity]) for i in range(0, len(hashes), arity)]
                first //= arity
                yield pd.DataFrame({"tree": tree, "level": base + up, "idx": np.arange(first, first + len(hashes)), "n": size, "hash": hashes}).astype({"hash": object})

    found = []
    level = 0
    while most > 1:
        block = F.floor(F.col("idx") / span)
        keyed = nodes.where("n > 1").select(F.concat_ws(":", "tree", block).alias("key"), "tree", "level", "idx", "n", "hash")
        dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key", "idx")
        grown = written(dealt.mapInPandas(grow, "tree bigint, level int, idx bigint, n bigint, hash string"), label)
        found.append(grown)
        level, most = level + height, -(-most // span)
        nodes = grown.where(F.col("level") == level)
    return found


def manifest(rows: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of ``rows``: ``id``, ``kind`` (group), ``leaf`` and ``presented`` (null: as the leaf).

    Groups are ordered by the UTF-8 bytes of their names, the null group first.
    Inside a group leaves ascend by id, null ids first; equal ids by leaf, so rows
    that repeat an id have one order, and whole repeated rows are leaves of their
    own. An empty table has no root. Neither a group nor an id is one task.
    """
    bounded_batches(rows.sparkSession)
    kept = written(
        rows.select("id", F.col("kind").cast("string").alias("kind"), "leaf", "presented", F.monotonically_increasing_id().alias("row")),
        "leaves",
    )
    in_order = ranked(kept, ["kind", "id", "leaf", "presented", "row"], "rank", "ranked-leaves")
    groups = in_order.groupBy("kind").agg(F.min("rank").alias("begin"), F.count("*").alias("n"))
    groups = written(ranked(groups, ["kind"], "tree", "groups"), "trees")
    size = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    named = groups.select("tree", F.col("kind").alias("name"), "begin", "n")
    placed = in_order.join(if_small(named), F.col("kind").eqNullSafe(F.col("name")))
    leaves = written(placed.select("rank", "tree", "n", (F.col("rank") - F.col("begin")).alias("idx"), "id", "kind", "leaf", "presented"), "placed")

    coordinate = ["tree", "level", "idx", "n", "hash"]
    lowest = leaves.select("tree", F.lit(0).alias("level"), "idx", "n", F.col("leaf").alias("hash"))
    trees = lowest
    for grown in interiors(lowest, size.most or 0, arity, "nodes"):
        trees = trees.union(grown)
    subroots = written(trees.where("n = 1").select("tree", F.col("hash").alias("subroot")), "subroots")
    top_leaves = subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(size.groups).cast("bigint").alias("n"), F.col("subroot").alias("hash")
    )
    top = top_leaves
    for grown in interiors(top_leaves, size.groups, arity, "top-nodes"):
        top = top.union(grown)
    root = top.where("n = 1").select("hash").first()
    return Manifest(leaves, trees.union(top).select(coordinate), groups.join(subroots, "tree").select("tree", "kind", "n", "subroot"), root and root.hash, arity)


def missing(known: np.ndarray, n: int, arity: int) -> list[tuple[int, int]]:
    """The smallest set of nodes (level, index) that leads from known leaves of a tree of ``n`` to its root."""
    out = []
    for level, size in enumerate(level_sizes(n, arity)[:-1]):
        groups = np.unique(known // arity)
        mates = (groups[:, None] * arity + np.arange(arity)).reshape(-1)
        out += [(level, int(i)) for i in np.setdiff1d(mates[mates < size], known)]
        known = groups
    return out


def needed(found: Manifest, stretch: int) -> DataFrame:
    """``part, tree, level, idx`` of the nodes that each stretch of leaves cannot derive."""
    spark = found.leaves.sparkSession
    part = F.floor(F.col("rank") / stretch).cast("bigint").alias("part")
    ranges = found.leaves.groupBy(part, "tree", "n").agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    groups = found.trees.count()
    arity = found.arity

    def uncovered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in runs(frames, "part"):
            out = []
            for tree, n, low, high in some[["tree", "n", "low", "high"]].itertuples(index=False):
                out += [(tree, level, i) for level, i in missing(np.arange(low, high + 1), int(n), arity)]
            out += [(TOP, level, i) for level, i in missing(np.sort(some["tree"].to_numpy()), groups, arity)]
            at = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pd.DataFrame({"part": int(some["part"].iat[0]), "tree": at[:, 0], "level": at[:, 1].astype(np.int32), "idx": at[:, 2]})

    dealt = ranges.repartition(partitions(spark), "part").sortWithinPartitions("part", "tree")
    return written(dealt.mapInPandas(uncovered, "part bigint, tree bigint, level int, idx bigint"), "needed")


def derive(levels: list[dict[int, str]], sizes: list[int], arity: int) -> None:
    """Adds to known nodes, a map for each level, the interiors that follow from them."""
    for level, size in enumerate(sizes[:-1]):
        below, above = levels[level], levels[level + 1]
        for group in {i // arity for i in below}:
            if group not in above:
                above[group] = digest([below[i] for i in range(group * arity, min(size, (group + 1) * arity))])


def climb(levels: list[dict[int, str]], sizes: list[int], arity: int, at: int, presented: str, siblings: list[str]) -> str:
    """The root that a presented node leads to; its siblings, left to right on every level, are appended."""
    for level, size in enumerate(sizes[:-1]):
        known, begin = levels[level], at // arity * arity
        left = [known[i] for i in range(begin, at)]
        right = [known[i] for i in range(at + 1, min(size, begin + arity))]
        siblings += left
        siblings += right
        presented = digest([*left, presented, *right])
        at //= arity
    return presented


def proofs(found: Manifest, stretch: int = STRETCH, with_siblings: bool = False) -> DataFrame:
    """The proof of every leaf: ``rank, id, leaf, subroot, root, proof_sha256, folded_root, verified`` (and ``siblings``).

    ``folded_root`` is worked out from the presented leaf and the proof; the leaf is
    verified if it is the manifest's root. A task holds one stretch of leaves, its
    interiors and the fetched nodes, about two nodes on each level.
    """
    spark = found.leaves.sparkSession
    arity, groups = found.arity, found.trees.count()
    id_type = found.leaves.schema["id"].dataType
    none = F.lit(None).cast("string")
    coordinates = needed(found, stretch)
    fetched = found.nodes.drop("n").join(if_small(coordinates), ["tree", "level", "idx"])
    fetched = fetched.select("part", "tree", "level", "idx", "hash", F.lit(-1).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("n"), none.alias("id"), none.alias("presented"))
    own = found.leaves.select(
        F.floor(F.col("rank") / stretch).cast("bigint").alias("part"), "tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"), "rank", "n", F.col("id").cast("string").alias("id"), "presented"
    )
    listed = ", siblings array<string>" if with_siblings else ""

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in runs(frames, "part"):
            rank = some["rank"].to_numpy()
            given, mine = some[rank < 0], some[rank >= 0]
            known: dict[tuple[int, int], dict[int, str]] = {}
            for tree, level, i, h in given[["tree", "level", "idx", "hash"]].itertuples(index=False):
                known.setdefault((tree, level), {})[i] = h
            top_sizes = level_sizes(groups, arity)
            top = [known.get((TOP, level), {}) for level in range(len(top_sizes))]
            first = run_starts(mine["tree"].to_numpy()).tolist()
            stretches = []
            for a, b in zip(first, [*first[1:], len(mine)]):
                leaves = mine.iloc[a:b]
                tree, sizes = int(leaves["tree"].iat[0]), level_sizes(int(leaves["n"].iat[0]), arity)
                levels = [known.get((tree, level), {}) for level in range(len(sizes))]
                levels[0].update(zip(leaves["idx"].tolist(), leaves["hash"].tolist()))
                derive(levels, sizes, arity)
                top[0][tree] = levels[-1][0]
                stretches.append((tree, sizes, levels, leaves))
            derive(top, top_sizes, arity)
            for tree, sizes, levels, leaves in stretches:
                proof, folded, lists = [], [], []
                for i, h, shown in zip(leaves["idx"].tolist(), leaves["hash"].tolist(), leaves["presented"].tolist()):
                    siblings: list[str] = []
                    to_subroot = climb(levels, sizes, arity, i, shown or h, siblings)
                    folded.append(climb(top, top_sizes, arity, tree, to_subroot, siblings))
                    proof.append(digest(siblings))
                    if with_siblings:
                        lists.append(siblings)
                out = leaves[["rank", "id"]].assign(leaf=leaves["hash"], subroot=levels[-1][0], proof_sha256=proof, folded_root=folded)
                out = out.astype({c: object for c in out.columns if c != "rank"})
                yield out.assign(siblings=pd.Series(lists, index=out.index, dtype=object)) if with_siblings else out

    order = ["part", "tree", "level", "idx"]
    dealt = own.unionByName(fetched).repartition(partitions(spark), "part").sortWithinPartitions(*order)
    out = dealt.mapInPandas(expand, "rank bigint, id string, leaf string, subroot string, proof_sha256 string, folded_root string" + listed)
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("root", F.lit(found.root)).withColumn("verified", F.col("folded_root") == F.col("root"))


def dataset(documents: DataFrame, id_col: str, group_col: str, columns: list[str], tampered: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of a table: every row a leaf of the given columns.

    With ``where``, the rows it holds for present a leaf in which the ``tampered``
    columns have other values; null there is a value like any other. Texts are
    digested whole inside Spark and never leave it; other columns are not read.
    """
    record = leaf([documents[c] for c in columns])
    shown = F.lit(None).cast("string")
    if where is not None:
        shown = F.when(where, leaf([(tampered or {}).get(c, documents[c]) for c in columns]))
    return manifest(documents.select(documents[id_col].alias("id"), documents[group_col].alias("kind"), record.alias("leaf"), shown.alias("presented")))
