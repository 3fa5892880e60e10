"""MinHash banding and exact verification, shared by the document join and line dedup.

Texts become sets of 64-bit shingle hashes. A signature has ``bands * rows``
minima; each band is one 64-bit key, and texts that share a key are candidates.
Candidates are connected, and the members of a component are compared exactly,
all with all, in blocks of bounded size: a component of any size is many tasks,
each of two blocks at most, and a pair never becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import bounded_batches, mix, packs, partitions, pieces, run_starts

#: Shingles of the texts in a block, and the least a text counts for.
BLOCK_WEIGHT, LEAST_WEIGHT = 150_000, 300
#: Pairs of one comparison, over several small components.
PAIRS = 1 << 18
#: Shingles signed at a time: the minima of a slice are taken in cache.
SLICE = 1 << 17
_BASE = 0x9E3779B97F4A7C15

#: Gives, for some texts, the hashes of all their shingles and each text's number of them.
Shingler = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    @classmethod
    def choose(cls, threshold: float, recall: float, hashes: int) -> Banding:
        """The most rows a band can have (fewest false candidates) so that pairs at the
        threshold share a band with probability ``recall``, within a number of hashes."""
        best = cls(max(1, ceil(log(1 - recall) / log(1 - threshold))), 1)
        for rows in range(2, hashes + 1):
            bands = ceil(log(1 - recall) / log(1 - threshold**rows))
            if bands * rows > hashes:
                break
            best = cls(bands, rows)
        return best

    def keys(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Band keys (rows: texts, columns: bands) of texts that have ``counts`` shingles each, none zero."""
        draw = np.random.default_rng(20240229)
        factor = (draw.integers(0, 1 << 32, self.bands * self.rows, dtype=np.uint64) | 1).astype(np.uint32)
        offset = draw.integers(0, 1 << 32, self.bands * self.rows, dtype=np.uint64).astype(np.uint32)
        out = np.zeros((len(counts), self.bands), dtype=np.uint64)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            begin = int(ends[first] - counts[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
            part = short[begin : int(ends[last - 1])]
            starts = ends[first:last] - counts[first:last] - begin
            value = np.empty_like(part)
            for band in range(self.bands):
                key = np.full(last - first, band, dtype=np.uint64)
                for k in range(band * self.rows, (band + 1) * self.rows):
                    np.multiply(part, factor[k], out=value)
                    np.add(value, offset[k], out=value)
                    key = mix(key ^ np.minimum.reduceat(value, starts))
                out[first:last, band] = key
            first = last
        return out.view(np.int64)


def windows(values: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` values inside each text, and their numbers.

    A text has as many hashes as values: where no whole window begins, its first one
    is repeated, which changes neither a set nor a minimum. A text shorter than a
    window is one window of all its values.
    """
    starts = np.cumsum(lengths) - lengths
    out = pieces(np.r_[values, np.zeros(width, dtype=np.uint64)], len(values), width, _BASE)
    for i in np.flatnonzero((lengths > 0) & (lengths < width)):  # only its own values
        out[starts[i]] = pieces(values[starts[i] : starts[i] + lengths[i]], 1, int(lengths[i]), _BASE)[0]
    spare = np.minimum(lengths, width - 1) - (lengths < width)
    spare = np.maximum(spare, 0)
    ends = starts + lengths
    at = np.repeat(ends - np.cumsum(spare), spare) + np.arange(int(spare.sum()))
    out[at] = np.repeat(out[np.minimum(starts, max(len(out) - 1, 0))], spare) if len(out) else out
    return out, lengths


def candidates(keys: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all nodes which share a band key: each to the key's smallest node.

    ``keys`` has ``node`` and ``key``, 64-bit numbers. Rows are shuffled by key once and
    sorted; a key's nodes follow each other, across batches too, so a key that many
    nodes share takes no memory.
    """
    keys = keys.where("key is not null and node is not null").select("key", "node")
    dealt = keys.repartition(partitions(keys.sparkSession), "key").sortWithinPartitions("key", "node")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in batches:
            key, node = (column.to_numpy() for column in batch.columns)
            first = run_starts(key)
            if not len(first):
                continue
            low = node[first].copy()
            if key[0] == last:  # the last batch's key goes on
                low[0] = centre
            last, centre = key[-1], low[-1]
            low = np.repeat(low, np.diff(np.r_[first, len(key)]))
            far = node != low
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(low[far])], ["a", "b"])

    return dealt.mapInArrow(stars, "a bigint, b bigint").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """Adds ``block`` and ``blocks`` to members (``node, root, weight``): a component's weight decides their number."""
    size = members.groupBy("root").agg(F.sum(F.greatest("weight", F.lit(LEAST_WEIGHT))).alias("size"))
    number = F.ceil(F.col("size") / BLOCK_WEIGHT).cast("int")
    return (
        members.join(size, "root")
        .withColumn("blocks", number)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int"))
        .drop("size")
    )


def pair_counts(group: np.ndarray, row: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets in each group, one square after the other;
    each pair counts once, in the row of its first set.

    The sets are given as (group, row in the group, hash) without repeats, ordered by group
    and hash and then by row; ``n`` has the number of sets of each group. Hashes that few sets share are counted pair by
    pair, those that many share as products of incidence tables.
    """
    offset = np.cumsum(n * n) - n * n
    out = np.zeros(int((n * n).sum()), dtype=np.float32)
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])] if len(hashes) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(hashes)])
    limit = 64
    for r in np.unique(length[(length > 1) & (length <= limit)]):
        some = first[length == r]
        step = max(1, (1 << 18) // int(r * r))
        one, two = np.triu_indices(r, 1)
        for i in range(0, len(some), step):
            begin = some[i : i + step]
            members, g = row[begin[:, None] + np.arange(r)], group[begin]
            pair = (offset[g][:, None] + members[:, one] * n[g][:, None] + members[:, two]).reshape(-1)
            if 4 * len(pair) > len(out):
                out += np.bincount(pair, minlength=len(out)).astype(np.float32)
            else:
                np.add.at(out, pair, np.float32(1))
    wide = np.flatnonzero(length > limit)
    for g in np.unique(group[first[wide]]):
        mine = wide[group[first[wide]] == g]
        square = out[offset[g] : offset[g] + n[g] ** 2].reshape(n[g], n[g])
        for i in range(0, len(mine), 1024):
            some = mine[i : i + 1024]
            table = np.zeros((n[g], len(some)), dtype=np.float32)
            for c, k in enumerate(some):
                table[row[first[k] : first[k] + length[k]], c] = 1
            square += np.triu(table @ table.T, 1)
    return out


def ordered(hashes: np.ndarray, owner: np.ndarray, group_of: np.ndarray, bits: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """Owners and hashes of the shingles, each once per owner, by group, hash and owner.

    Hashes become numbers in their order; with group and owner they mostly fit the ``bits`` of one
    integer, which numpy sorts many times faster than three keys.
    """
    if not len(hashes):
        return owner, hashes
    values, code = np.unique(hashes, return_inverse=True)
    code_bits, owner_bits = len(values).bit_length(), len(group_of).bit_length()
    if code_bits + owner_bits + int(group_of[-1]).bit_length() <= bits:
        key = (group_of[owner] << (code_bits + owner_bits)) | (code << owner_bits) | owner
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        return key & ((1 << owner_bits) - 1), (key >> owner_bits) & ((1 << code_bits) - 1)
    order = np.lexsort((owner, code, group_of[owner]))
    owner, code = owner[order], code[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]
    return owner[new], code[new]


def similar(sets: tuple[np.ndarray, np.ndarray], n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``i, j`` of the texts of the same group whose Jaccard similarity is ``threshold`` or more.

    ``sets`` has the shingles of the texts, group after group of ``n`` texts; every
    pair is given in both orders.
    """
    hashes, counts = sets
    group_of = np.repeat(np.arange(len(n)), n)
    owner, hashes = ordered(hashes, np.repeat(np.arange(len(counts)), counts), group_of)
    begin = np.cumsum(n) - n
    size = np.bincount(owner, minlength=len(counts))
    common = pair_counts(group_of[owner], owner - begin[group_of[owner]], hashes, n)
    at = np.flatnonzero(common)
    start = np.cumsum(n * n) - n * n
    g = np.searchsorted(start, at, side="right") - 1
    i, j = np.divmod(at - start[g], n[g])
    i, j = i + begin[g], j + begin[g]
    shared = common[at].astype(np.float64)
    near = shared / (size[i] + size[j] - shared) >= threshold
    return np.r_[i[near], j[near]], np.r_[j[near], i[near]]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component, from links in both orders."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verify(members: DataFrame, shingler: Shingler, threshold: float) -> DataFrame:
    """Exact comparison inside candidate components.

    ``members`` has ``node, root, block, blocks, copies, text``. Returns per block
    pair and node with a similar one: ``node``, ``low`` (the smallest node it is
    connected to there), ``links`` (copies of similar nodes met there, each pair of
    nodes in exactly one place) and ``blocks``. Members are one row per node.
    """
    spark = members.sparkSession
    bounded_batches(spark)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.select("*", other).select(
        F.concat_ws(":", "root", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        (F.col("block") != F.col("other")).alias("cross"), "node", "block", "blocks", "copies", "text",
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in packs(frames, "task", PAIRS, "text"):
            begin = run_starts(frame["task"].to_numpy())
            n = np.diff(np.r_[begin, len(frame)])
            if (n < 2).all():
                continue
            block, node = frame["block"].to_numpy(), frame["node"].to_numpy()
            cross = frame["cross"].to_numpy()
            i, j = similar(shingler(frame["text"].tolist()), n, threshold)
            other = ~cross[i] | (block[i] != block[j])  # pairs inside a block meet in its own task
            i, j = i[other], j[other]
            if not len(i):
                continue
            root = local_roots(len(frame), i, j)
            low = np.full(len(frame), np.iinfo(np.int64).max)
            np.minimum.at(low, root, node)
            links = np.bincount(i, weights=frame["copies"].to_numpy()[j].astype(float), minlength=len(frame))
            linked = np.unique(i)
            yield pd.DataFrame({
                "node": node[linked], "low": low[root][linked], "links": links[linked].astype(np.int64), "blocks": frame["blocks"].to_numpy()[linked],
            })

    dealt = pairs.repartition(partitions(spark), "task").sortWithinPartitions("task")
    return dealt.mapInPandas(compare, "node bigint, low bigint, links bigint, blocks int")
