"""Retries by the clock: the queue alone, and the reviewing stream around it."""

import time
from collections import defaultdict

from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.session import work_dir
from reviewlake.sources import tables
from reviewlake.streaming import retrying
from reviewlake.streaming.reviewing import ReviewTables, start_retrying

POLICY = retrying.RetryPolicy(max_retries=3, first_delay_ms=300)


def until(query, done, seconds=120):
    """Wait for a running stream to reach a state, then stop it."""
    end = time.time() + seconds
    try:
        while not done():
            assert query.isActive, query.exception()
            assert time.time() < end, "the stream did not get there"
            time.sleep(0.3)
    finally:
        query.stop()


def job_rows(spark, numbers):
    return spark.createDataFrame([(1, "o/r", "o", "r", n, f"h{n}", "") for n in numbers], schemas.REVIEW_JOBS)


def rows_of(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        return []


def test_failed_jobs_come_again_by_the_clock_and_are_buried(spark):
    """Job n succeeds at its n-th attempt; jobs above the limit die. Events are delivered twice."""
    queued, back = work_dir(spark, "queued"), work_dir(spark, "back")
    job_rows(spark, [1, 2, 4, 9, 9]).write.parquet(queued)
    job_rows(spark, [1]).write.mode("append").parquet(queued)
    ended = job_rows(spark, []).withColumn("attempt", F.lit(1)).withColumn("failed", F.lit(False))
    ended.write.parquet(f"{back}/first")
    seen, times = [], defaultdict(list)

    def review(rows, batch):
        rows = rows.persist()
        for r in rows.collect():
            seen.append((r.pr_number, r.attempt, r.kind))
            times[r.pr_number].append(time.time())
        result = rows.where("kind = 'run'").withColumn("failed", F.col("attempt") < F.col("pr_number")).drop("kind")
        for copy in range(2):
            result.write.mode("overwrite").parquet(f"{back}/{batch}-{copy}")
        rows.unpersist()

    jobs = tables.stream_table(spark, "review_jobs", queued)
    outcomes = spark.readStream.schema(ended.schema).parquet(f"{back}/*")
    query = (
        retrying.handed_out(jobs, outcomes, POLICY)
        .writeStream.foreachBatch(review)
        .option("checkpointLocation", work_dir(spark, "ck"))
        .trigger(processingTime="100 milliseconds")
        .start()
    )
    until(query, lambda: (9, 4, "dead") in seen)
    want = [(1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (9, 1), (9, 2), (9, 3), (9, 4)]
    assert sorted(x[:2] for x in seen if x[2] == "run") == want
    assert [x for x in seen if x[2] == "dead"] == [(9, 4, "dead")]
    waits = [b - a for a, b in zip(times[4], times[4][1:])]
    assert all(wait >= 0.3 * 2**k for k, wait in enumerate(waits))


def test_reviewing_stream_tries_again_with_no_new_arrival(spark):
    raw = "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -1,3 +1,4 @@\n package p\n func f() {\n+\tpanic(1)\n }\n"
    queued, diffs = work_dir(spark, "queued"), work_dir(spark, "diffs")
    spark.createDataFrame([("o/r", 1, "h1", raw)], schemas.PR_DIFFS).write.parquet(diffs)
    sources = spark.createDataFrame([("o/r", "a.go", f"h{n}", "package p\nfunc f() {\n\tpanic(1)\n}\n") for n in (1, 2)], schemas.SOURCE_FILES)
    job_rows(spark, [1, 2, 3]).write.parquet(queued)
    out = ReviewTables(diffs, sources, None, None, *(work_dir(spark, x) for x in ("rev", "outc")), dead_path=work_dir(spark, "dead"))
    query = start_retrying(tables.stream_table(spark, "review_jobs", queued), out, work_dir(spark, "ck"), policy=POLICY, every="100 milliseconds")

    late = []

    def done():
        attempts = [r.attempt for r in rows_of(spark, out.outcomes_path) if r.pr_number == 2]
        if attempts and not late:  # the missing diff arrives after the first failure
            late.append(spark.createDataFrame([("o/r", 2, "h2", raw)], schemas.PR_DIFFS).write.mode("append").parquet(diffs))
        return any(r.pr_number == 3 for r in rows_of(spark, out.dead_path))

    until(query, done)
    assert sorted((r.pr_number, r.n_rule) for r in spark.read.parquet(out.reviews_path).collect()) == [(1, 1), (2, 1)]
    outcomes = sorted((r.pr_number, r.attempt, r.failed) for r in spark.read.parquet(out.outcomes_path).collect())
    assert [x for x in outcomes if x[0] != 2] == [(1, 1, False), (3, 1, True), (3, 2, True), (3, 3, True), (3, 4, True)]
    assert outcomes[-5][0] == 2 and not outcomes[-5][2]
    assert [(r.pr_number, r.attempt) for r in rows_of(spark, out.dead_path)] == [(3, 4)]


def test_waits_grow():
    assert [POLICY.delay(k) for k in (1, 2, 3)] == [300, 600, 1200]
