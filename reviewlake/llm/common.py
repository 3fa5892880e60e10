"""Helpers shared by the corpus operators: columns, hold-out, byte arrays, hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import work_dir

#: Bytes of text in one Arrow batch: bounds a Python worker's memory whatever the length of texts.
BATCH_BYTES = 4 << 20


def released(spark: SparkSession) -> None:
    """Has Spark remove the broadcasts and shuffles that no plan reads any more.

    It does so once the driver's collector finds them unused, which a driver of little
    memory pressure may not do for half an hour; rounds of joins pile up until then,
    on the driver and on every executor. What the driver's JVM has freed of memory
    outside its heap, mostly that of its compilers, goes back to the system too:
    the C library keeps it otherwise, more after every plan.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trimmed(spark)


def _trimmed(spark: SparkSession) -> None:
    """The JVM's own command for it, by reflection: its management classes are not open to callers."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    call = gateway.new_array(jvm.java.lang.Object, 4)
    call[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    call[1] = "systemTrimNativeHeap"
    server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    try:
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # a JVM without this command keeps the memory
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, so that long texts do not add up in a worker.

    The driver keeps a description of every plan it has run. Operators that work in
    rounds run hundreds, so descriptions are cut short too.
    """
    released(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", "8192")
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name the frame does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: remainder 1, and rows without an id."""
    return F.coalesce(fold(doc_id) == 1, F.lit(True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def collected(df: DataFrame) -> pd.DataFrame:
    """A small result on the driver, moved by Arrow whatever the session's settings."""
    return df.toArrow().to_pandas()


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python objects: Arrow takes those in one piece whatever they were put together from."""
    return frame.astype({c: object for c, kind in frame.dtypes.items() if isinstance(kind, pd.StringDtype)})


#: Work tables hold hashes and ids: a dictionary does not pay, and small row groups keep writers small.
_TABLE_OPTIONS = {"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared work folder: it outlives lost executors and cuts the lineage."""
    path = work_dir(df.sparkSession, label)
    df.write.options(**_TABLE_OPTIONS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of up to this many narrow rows may be broadcast (some 50 MB).
SMALL_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has few rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunks(texts: Iterable[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    start, size, n = 0, 0, 0
    for n, text in enumerate(texts, 1):
        if size and size + len(text) > limit:
            yield start, n - 1
            start, size = n - 1, 0
        size += len(text)
    if n > start:
        yield start, n


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = h + _GOLDEN
    moved = h >> np.uint64(30)
    h ^= moved
    h *= _MIX1
    np.right_shift(h, np.uint64(27), out=moved)
    h ^= moved
    h *= _MIX2
    np.right_shift(h, np.uint64(31), out=moved)
    h ^= moved
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; an odd base keeps all of them odd."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def pieces(h: np.ndarray, n: int, width: int, base: int) -> np.ndarray:
    """Hashes of the first ``n`` windows of ``width`` consecutive values.

    Prefix sums of a polynomial give a window's sum as a difference; the inverse
    power brings it back to the window's own start.
    """
    up, down = _powers_both(base, 1 << max(12, (len(h) + 1).bit_length()))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[width : width + n] - total[:n]) * down[:n])


@lru_cache(maxsize=8)
def _powers_both(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(base, n), powers(pow(base, -1, 1 << 64), n)


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Positions where a run of equal values begins."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal key, across batches, of a partition sorted by it.

    Only the current group is held; callers bound the size of a group beforehand.
    """
    yield from packs(frames, key, 1)


def packs(frames: Iterator[pd.DataFrame], key: str, limit: int, text: str | None = None, letters: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """Whole groups of equal key, several small ones together, at least one: as many as have squared
    sizes of up to ``limit`` and up to ``letters`` characters of ``text``. The partition is sorted by the key."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        if frame.empty:
            continue
        if rest is not None:
            frame = pd.concat([rest, frame])
        first = run_starts(frame[key].to_numpy())
        ends = np.r_[first[1:], len(frame)].tolist()
        read = np.r_[0, np.cumsum(frame[text].map(len))].tolist() if text else [0] * (len(frame) + 1)
        begin = squares = last = 0
        for end in ends[:-1]:  # the last group may go on in the next batch
            square = (end - last) ** 2
            if last > begin and (squares + square > limit or read[end] - read[begin] > letters):
                yield frame.iloc[begin:last]
                begin, squares = last, 0
            squares += square
            last = end
        if last > begin:
            yield frame.iloc[begin:last]
        rest = frame.iloc[last:]
    if rest is not None and len(rest):
        yield rest
