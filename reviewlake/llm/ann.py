"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are lifted onto a sphere (one more coordinate makes all norms equal), where
the largest inner product is the smallest distance. A table hashes a vector by its
slots on a few Gaussian projections. A neighbour at a given angle to a query has a
normal projection around the query's, so every bucket has a probability of holding
it; a query visits buckets of a table in descending probability until enough of it
is covered. The candidates of all tables meet in exact double-precision scores.

Buckets are cut into blocks, and a task compares one block of vectors with one
block of queries, so a crowded bucket is many tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, erf, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, collected, if_small, partitions, run_starts, runs, written

NEAREST = 20
TABLES = 3
#: Probability that a neighbour of the expected angle lies in a visited bucket of some table.
SUCCESS = 0.985
#: Vectors a bucket holds, about; its blocks of vectors and of queries.
BUCKET_ROWS, VECTOR_BLOCK, QUERY_BLOCK = 2048, 4096, 1024
#: Vectors drawn by hash to tell how near a query's neighbours are.
SAMPLE_ROWS = 16_384
#: Buckets of a table, about: with more rows they grow fuller, else a query would visit ever more of them.
MOST_BUCKETS = 4096
_SLOT_BITS, _SLOT_ZERO = 10, 512


@dataclass(frozen=True)
class Hashing:
    """Projections of all tables: ``directions[table, projection, coordinate]``, slots of ``width``."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    radius: float

    @classmethod
    def choose(cls, rows: int, dimension: int, radius: float, tables: int = TABLES, seed: int = 11) -> Hashing:
        """As many projections and as wide slots as leave about BUCKET_ROWS in a bucket, or MOST_BUCKETS buckets."""
        buckets = min(max(1.0, rows / BUCKET_ROWS), MOST_BUCKETS)
        count = min(5, ceil(log(buckets) / log(4))) if buckets > 1 else 0
        width = radius * 4.13 / buckets ** (1 / count) if count else radius
        draw = np.random.default_rng(seed)
        return cls(draw.standard_normal((tables, count, dimension + 1)), draw.uniform(0, width, (tables, count)), width, radius)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def aim(self, queries: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(queries, axis=1, keepdims=True)
        return np.column_stack([queries * (self.radius / norms), np.zeros(len(queries))])

    def key(self, table: int, slots: np.ndarray) -> np.ndarray:
        """One number per bucket: slots and table side by side."""
        out = np.zeros(slots.shape[:-1], dtype=np.int64)
        for i in range(slots.shape[-1]):
            out = (out << _SLOT_BITS) | np.clip(slots[..., i] + _SLOT_ZERO, 0, 1023)
        return out << 6 | table

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector (rows) in each table (columns)."""
        lifted = self.lift(vectors)
        columns = [
            self.key(t, np.floor((lifted @ self.directions[t].T + self.shifts[t]) / self.width).astype(np.int64))
            for t in range(len(self.directions))
        ]
        return np.column_stack(columns)

    def visits(self, query: np.ndarray, cosine: float, success: float) -> np.ndarray:
        """Buckets one query visits over all tables: per table the most probable ones, in that
        order, until they cover the table's part of ``success``.

        The least probable partial buckets are dropped, and slots far out not looked at,
        only as far as the rest holds more than that part.
        """
        share = 1 - (1 - success) ** (1 / len(self.directions))
        spare = (1 - share) / (4 * max(1, self.directions.shape[1]))
        reach = max(4.0, (2 * log(2 / spare)) ** 0.5)  # less than ``spare`` lies beyond
        sine = self.radius * max(1e-3, (1 - cosine**2) ** 0.5)
        aimed = self.aim(query[None, :])[0]
        out = []
        for t in range(len(self.directions)):
            slots, mass = np.zeros((1, 0), dtype=np.int64), np.ones(1)
            for at, shift in zip(self.directions[t] @ aimed, self.shifts[t]):
                middle = cosine * at
                low = int(np.floor((middle - reach * sine + shift) / self.width))
                high = int(np.floor((middle + reach * sine + shift) / self.width))
                edges = np.arange(low, high + 2) * self.width - shift
                below = np.array([0.5 * (1 + erf((e - middle) / (sine * 2**0.5))) for e in edges])
                found = np.diff(below)
                joint = (mass[:, None] * found[None, :]).reshape(-1)
                order = np.argsort(-joint, kind="stable")
                covered = np.cumsum(joint[order])
                order = order[: int(np.searchsorted(covered, covered[-1] - spare)) + 1]
                slots = np.column_stack([slots[order // len(found)], low + order % len(found)])
                mass = joint[order]
            need = int(np.searchsorted(np.cumsum(mass), share)) + 1
            out.append(self.key(t, slots[:need]))
        return np.concatenate(out)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part, each once: finite, not zero, of the most frequent length, with an id."""
    vec = F.col(vector_col).cast("array<double>")
    fine = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    has_other = F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), fine.alias("fine"))
    return written(rows.where(F.col("id").isNotNull() & F.col("fine") & has_other).select("id", "vec").distinct(), "vectors")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in an order of additions that does not depend on the rows around."""
    return (vectors * query).sum(axis=1)


def best_of_ids(ids: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Takes the scores of rows to the best score of each different id."""
    order = np.argsort(ids, kind="stable")
    starts = run_starts(ids[order])
    if len(starts) == len(ids):
        return lambda scores: scores
    return lambda scores: np.maximum.reduceat(scores[order], starts)


def nearest(
    df: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEAREST,
    success: float = SUCCESS,
    tables: int = TABLES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row that ``queries`` selects by ``id``.

    Scores are inner products of the original vectors in double precision, nearest
    first, ties to the smaller id. A row is no neighbour of a query of its id. Rows
    without id, and vectors that are null, zero, hold null or non-finite components
    or have another length than most, take no part. Rows that repeat an id are one
    candidate, with its best score. Of equal vectors the ``k + 1`` smallest ids are
    compared: no other can be among the nearest. Empty tables give no rows; other
    columns are not read.

    A query skips candidates below the k-th best score of a bounded sample, which
    is never above the true k-th best; where that leaves fewer than ``k``, it takes
    the nearest of all it visited.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("vec") == lengths.d)
    radius = rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    hashing = Hashing.choose(lengths["count"], lengths.d, radius * (1 + 1e-12), tables)

    order = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    vectors = rows.withColumn("n", order).where(F.col("n") <= k + 1).drop("n")
    asked = rows.where(queries)

    draw = F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1 << 30)) / float(1 << 30)
    drawn = collected(rows.where(draw < min(1.0, SAMPLE_ROWS / lengths["count"])))
    sample = spark.sparkContext.broadcast((drawn["id"].to_numpy(), matrix(drawn["vec"])))
    total = lengths["count"]

    @pandas_udf("array<bigint>")
    def place(vecs: pd.Series) -> pd.Series:
        return pd.Series(list(hashing.places(matrix(vecs))), index=vecs.index, dtype=object)

    @pandas_udf("least double, buckets array<bigint>")
    def visit(ids: pd.Series, vecs: pd.Series) -> pd.DataFrame:
        known, table = sample.value
        expected = max(1, round(k * len(known) / total))
        best = best_of_ids(known)
        least, buckets = [], []
        for one, query in zip(ids.to_numpy(), matrix(vecs)):
            scores = best(np.where(known == one, -np.inf, table @ query))
            scores = np.sort(scores[scores > -np.inf])[::-1]
            least.append(scores[k - 1] - 1e-9 * abs(scores[k - 1]) if len(scores) >= k else -np.inf)
            near = scores[min(expected, len(scores)) - 1] if len(scores) else 0.0
            cosine = near / (np.linalg.norm(query) * hashing.radius)
            buckets.append(hashing.visits(query, float(np.clip(cosine, 0.0, 0.999)), success))
        return pd.DataFrame({"least": least, "buckets": pd.Series(buckets, dtype=object)})

    indexed = vectors.select("id", "vec", F.explode(place("vec")).alias("bucket"))
    found = asked.select("id", "vec", visit("id", "vec").alias("found"))
    visits = written(found.select("id", "vec", "found.least", F.explode("found.buckets").alias("bucket")), "visits")
    indexed = written(indexed, "buckets")

    held = indexed.groupBy("bucket").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("vector_blocks"))
    seen = visits.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    sizes = if_small(written(held.join(seen, "bucket"), "bucket-sizes"))

    def dealt(frame: DataFrame, own: str, other: str, kind: int, least: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks").cast("bigint"))
        theirs = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        spread = frame.join(sizes, "bucket").withColumn(f"{own}_block", mine).withColumn(f"{other}_block", theirs)
        task = F.concat_ws(":", "bucket", "vector_block", "query_block").alias("task")
        return spread.select(task, F.lit(kind).alias("kind"), "id", "vec", least.alias("least"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(frames, "task"):
            asks = group["kind"].to_numpy() == 1
            if asks.all() or not asks.any():
                continue
            ids, table = group["id"].to_numpy()[~asks], matrix(group["vec"][~asks])
            scores = matrix(group["vec"][asks]) @ table.T
            best = best_of_ids(ids)
            hits = []
            for one, query, least, row in zip(group["id"][asks], matrix(group["vec"][asks]), group["least"][asks], scores):
                row = np.where(ids == one, -np.inf, row)
                each = best(row)
                if len(each) > k:
                    edge = np.partition(each, -k)[-k]
                    least = max(least, edge - 1e-9 * abs(edge))
                near = np.flatnonzero((row >= least) & (row > -np.inf))
                if len(near):
                    hits.append(pd.DataFrame({"query_id": one, "vec_id": ids[near], "score": products(query, table[near])}))
            if hits:
                yield pd.concat(hits)

    def search(visits: DataFrame) -> DataFrame:
        """Best score of every pair found."""
        both = dealt(indexed, "vector", "query", 0, F.lit(0.0)).union(dealt(visits, "query", "vector", 1, F.col("least")))
        tasks = both.repartition(partitions(spark), "task").sortWithinPartitions("task", "kind")
        met = tasks.mapInPandas(compare, "query_id bigint, vec_id bigint, score double")
        return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    best = written(search(visits), "neighbours")
    full = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = written(visits.join(full, "id", "left_anti").withColumn("least", F.lit(float("-inf"))), "short")
    if short.limit(1).count():  # queries whose visits hold fewer than k above the bound look at all they visited
        best = best.union(search(short)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
