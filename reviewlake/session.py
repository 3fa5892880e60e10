"""Session helpers: settings the jobs rely on and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that change results (time zone) or that the plans are tuned for.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Beyond this size the JVM leaves a generated method uncompiled; separate
    # projections, split into small methods, are then much faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The scan plan has more generated classes than the default cache holds; a
    # full cache makes every task compile them again.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # Recording a call site for every column expression makes plan building slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "reviewlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediate tables and stream checkpoints.

    The cluster names its shared folder in ``spark.checkpoint.dir``; a local
    temporary folder is used only where that setting is absent and the session
    is local (tests): on a cluster other executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="reviewlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def measured_joins(spark: SparkSession) -> None:
    """From now on Spark broadcasts a table only by its measured size, up to the limit the session had.

    Before a table is made its size is guessed from that of the files it comes from. A
    text built by an expression counts 20 bytes there and an exploded row nothing, so
    tables of many GB would pass for small and go through the driver.
    """
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(guessed) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(guessed))
        spark.conf.set(guessed, "-1")


def spread(df: DataFrame, *keys: str, by: Column | None = None, most: int = 0) -> DataFrame:
    """Hash rows by key over all shuffle partitions, ahead of an explode.

    The explicit number keeps adaptive execution from merging partitions by
    their compressed size, which says little about the rows they explode into. It is
    not that of the session: after a join by the same keys an equal one would be left
    out, and the join's partitions merged.
    With ``by``, the size of a row, there are as many partitions as keep each at
    about ``most``, so a task does not grow with the table; this reads ``df`` once more.
    """
    measured_joins(df.sparkSession)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    if by is not None:
        total = df.agg(F.sum(by.cast("bigint"))).first()[0] or 0
        partitions = max(partitions, -(-total // most))
    return df.repartition(partitions, *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the work folder, for plans that read them often.

    Unlike a cache it survives lost executors.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
