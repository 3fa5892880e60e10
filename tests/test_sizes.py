"""What must not grow with the tables: broadcasts that no one measured, the work of one task, tasks of a round of calls."""

from pyspark.sql import functions as F

from reviewlake.operators import seams
from reviewlake.operators.diffs import diff_rows
from reviewlake.operators.tokens import lexed
from reviewlake.plans import queries
from reviewlake.plans.review import configured_jobs
from reviewlake.session import spread
from reviewlake.sources import corpus

GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_only_measured_tables_are_broadcast(spark, tmp_path):
    rows = [(k, f"part {k}", "Brand#1", k % 50) for k in range(40)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set(GUESSED, "10485760")
    spark.conf.unset(MEASURED)
    jobs = configured_jobs(corpus.go_jobs(spark, str(tmp_path)), corpus.go_sources(spark, str(tmp_path)), None)
    assert "Broadcast" not in jobs._jdf.queryExecution().sparkPlan().toString()
    assert (spark.conf.get(GUESSED), spark.conf.get(MEASURED)) == ("-1", "10485760")
    assert jobs.count() == 40

def test_tasks_are_bounded_by_size(spark, monkeypatch):
    rows = spark.range(100).withColumn("size", F.lit(10))
    assert spread(rows, "id", by=F.col("size"), most=50).rdd.getNumPartitions() == 20
    assert spread(rows, "id", by=F.col("size"), most=5000).rdd.getNumPartitions() == 5
    assert spread(rows.limit(0), "id", by=F.col("size"), most=50).rdd.getNumPartitions() == 5
    monkeypatch.setattr("reviewlake.operators.tokens.TASK_CHARS", 30)
    files = spark.range(20).select(
        F.lit("r").alias("repo_full_name"), F.col("id").alias("pr_number"), F.lit(0).alias("file_idx"),
        F.lit("a.go").alias("path"), F.lit("package main\n\n").alias("content"), F.lit("").alias("go_version"),
    )
    assert lexed(files).rdd.getNumPartitions() == 10



def test_diffs_are_dealt_anew_after_a_join(spark):
    rows = spark.range(50).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo_full_name"), F.col("id").alias("pr_number"))
    diffs = rows.withColumn("raw", F.lit("diff --git a/x b/x\n"))
    joined = diffs.join(rows, ["repo_full_name", "pr_number"], "left_semi")
    plan = diff_rows(joined)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_rounds_of_calls_have_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seams, "MOST_ROUNDS", 2)
    asked = spark.range(100).select(
        F.lit("r").alias("repo_full_name"), F.col("id").alias("pr_number"), F.lit("a.go").alias("path"),
        F.lit("detector").alias("stage"), F.col("id").cast("string").alias("user"),
    )

    def provider(requests):
        return [(f"{len(requests) <= 3} {r['user']}", None) for r in requests]

    cache = str(tmp_path / "calls")
    answers = {r.pr_number: r.content for r in seams.complete_once(asked, provider, cache, per_task=3).collect()}
    assert answers == {k: f"True {k}" for k in range(100)}
    assert len(spark.read.parquet(cache).inputFiles()) <= 8


def test_deliveries_land_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [(k, k % 7, "view", k) for k in range(1, 61)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, s bigint")
    events.select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "LANDED_BYTES", 2000)
    landed = []
    stream = queries.tables.stream_table
    monkeypatch.setattr(queries.tables, "stream_table", lambda s, n, path, **k: landed.append((path, k["files_per_batch"])) or stream(s, n, path, **k))
    jobs = {r.pr_number for r in queries.stream_jobs(spark, str(tmp_path)).collect()}
    assert jobs == {r.pr_number for r in queries.review_jobs(spark, str(tmp_path)).collect()} and jobs
    (path, per_batch), = landed
    files = len(spark.read.parquet(path).inputFiles())
    assert files > 8 and per_batch == -(-files // 2)


def test_reviews_are_written_compressed_and_read_back(spark, tmp_path):
    from reviewlake.sources import tables

    comments = [(f"p{i}.go", i, "the same words again") for i in range(2000)]
    schema = "repo_full_name string, pr_number bigint, commit_id string, body string, event string, comments array<struct<path:string,position:bigint,body:string>>"
    reviews = spark.createDataFrame([("o/r", 1, "s", "b\nc", "e", comments), ("o/r", 2, None, None, "e", [])], schema)
    tables.write_reviews(reviews, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert sum(p.stat().st_size for p in files) < 40_000
    back = tables.read_table(spark, "reviews", str(tmp_path / "out"), "json").select("pr_number", "body", "comments").collect()
    assert sorted((r.pr_number, r.body, len(r.comments)) for r in back) == [(1, "b\nc", 2000), (2, None, 0)]
