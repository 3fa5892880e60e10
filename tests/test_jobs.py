import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.operators import config as cfg
from reviewlake.operators import history as hist
from reviewlake.operators import intake
from reviewlake.operators import model as mod
from reviewlake.operators import review as rev
from reviewlake.operators import seams
from reviewlake.plans import review as plan
from reviewlake.session import work_dir
from reviewlake.sources import tables
from reviewlake.streaming.intake import start_intake
from reviewlake.streaming.reviewing import ReviewTables, start_reviewing

SECRET = b"s3cret"
EVENT = {
    "action": "opened",
    "number": 7,
    "pull_request": {"head": {"sha": "abcdef0123"}, "base": {"sha": "b1"}},
    "repository": {"full_name": "o/r", "owner": {"login": "o"}, "name": "r"},
    "installation": {"id": 42},
}


def signed(body):
    return "sha256=" + hmac.new(SECRET, body, hashlib.sha256).hexdigest()


def deliveries(spark):
    def event(**change):
        return json.dumps({**EVENT, **change}).encode()

    good = event()
    cases = [
        ("ping", b"{}", signed(b"{}"), 200),
        ("pull_request", good, "sha256=00", 401),
        ("pull_request", good, "", 401),
        ("pull_request", good, None, 401),
        ("pull_request", good, signed(good), 202),
        ("pull_request", event(action="synchronize"), None, 202),
        ("pull_request", event(action="closed"), None, 200),
        ("pull_request", event(action="Opened"), None, 200),
        ("pull_request", b"{broken", None, 400),
        ("pull_request", good + b" {}", None, 400),
        ("pull_request", event(number="7"), None, 400),
        ("pull_request", b"{}", None, 200),
        ("push", b"{broken", None, 200),
    ]
    rows, want = [], []
    for i, (kind, body, signature, status) in enumerate(cases):
        if signature is None and i > 3:
            signature = signed(body)
        rows.append((i, kind, signature, bytearray(body), None))
        want.append(status)
    return spark.createDataFrame(rows, schemas.DELIVERIES), want


def test_intake_statuses_and_jobs(spark):
    df, want = deliveries(spark)
    got = intake.delivery_status(df, SECRET).orderBy("delivery_id").collect()
    assert [r.status for r in got] == want
    jobs = intake.review_jobs(df, SECRET).collect()
    assert len(jobs) == 2
    assert tuple(jobs[0]) == (42, "o/r", "o", "r", 7, "abcdef0123", "b1")


def test_stream_equals_batch(spark):
    df, _ = deliveries(spark)
    landed, out = work_dir(spark, "in"), work_dir(spark, "out")
    df.repartition(3).write.parquet(landed)
    stream = tables.stream_table(spark, "deliveries", landed, files_per_batch=1)
    for _ in range(2):  # a second run over the same checkpoint adds nothing
        start_intake(stream, SECRET, out, landed + "-ck", available_now=True).awaitTermination()
    got = tables.read_table(spark, "review_jobs", out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, intake.review_jobs(df, SECRET).collect()))


def test_configuration(spark):
    rules = [("a", False), ("a", True), ("b", None)]
    configs = spark.createDataFrame(
        [
            ("o/r", "base", 0, True, 1, rules, ["vendor/**", "["], "P", ""),
            ("o/r", "base", 1, True, 1, [("c", False)], [], "", ""),
            ("o/r", "head", 0, False, 1, [("c", False)], [], "", ""),
            ("o/r", "head", 1, True, 1, [("c", False)], [], "", ""),
        ],
        schemas.REPO_CONFIGS,
    )
    jobs = spark.createDataFrame(
        [(1, "o/r", "o", "r", 1, "head", "base"), (1, "o/r", "o", "r", 2, "head", ""), (1, "o/q", "o", "q", 3, "h", "b")],
        schemas.REVIEW_JOBS,
    )
    attached = cfg.attach_config(jobs, configs)
    flags = {r.pr_number: r.rule_flags for r in attached.collect()}
    assert flags == {1: {"a": False, "b": False}, 2: None, 3: None}
    named = attached.withColumn("rule", F.explode(F.array(F.lit("a"), F.lit("c"))))
    assert sorted((r.pr_number, r.rule) for r in cfg.only_enabled(named).collect()) == [
        (1, "c"), (2, "a"), (2, "c"), (3, "a"), (3, "c")
    ]
    paths = attached.withColumn("path", F.explode(F.array(F.lit("vendor/x.go"), F.lit("x.go"))))
    assert sorted((r.pr_number, r.path) for r in cfg.without_excluded(paths).collect()) == [
        (1, "x.go"), (2, "vendor/x.go"), (2, "x.go"), (3, "vendor/x.go"), (3, "x.go")
    ]
    chosen = cfg.model_choice(attached, "q", "m", ("p", "q")).orderBy("pr_number").collect()
    assert [(r.provider, r.model) for r in chosen] == [("p", "m"), ("q", "m"), ("q", "m")]


def answers(path, detector, suggester=None, *reviewer):
    rows = [("o/r", 1, "h1", path, "detector", 1, *detector)]
    if suggester:
        rows.append(("o/r", 1, "h1", path, "suggester", 1, *suggester))
    for attempt, answer in enumerate(reviewer, 1):
        rows.append(("o/r", 1, "h1", path, "reviewer", attempt, *answer))
    return rows


def test_stages(spark):
    found = ('{"candidates": [{"category": "logic", "line": 2, "message": "m"}]}', None)
    items = ('{"items": [{"category": "logic", "line": 2, "message": "m", "suggested_fix": "f"}]}', None)

    def review(decision, confidence=0.9, line=2):
        item = {"category": "x", "line": line, "message": "m", "confidence": confidence, "decision": decision}
        return (json.dumps({"items": [item]}), None)

    bad, error = ("oops", None), (None, "timeout")
    rows = [
        *answers("inline", found, items, review("inline")),
        *answers("lost", found, items, review("inline", line=9)),
        *answers("summary", found, items, review("summary", 0.1)),
        *answers("drop", found, items, review("drop")),
        *answers("retry", found, items, bad, bad, review("inline", 0.7)),
        *answers("fallback", found, items, bad, bad, bad, review("inline")),
        *answers("reviewer fails", found, items, bad, error, review("inline")),
        *answers("nothing reviewed", found, items, ('{"items": []}', None)),
        *answers("nothing found", ('{"candidates": null}', None), bad),
        *answers("bad detector", ('{"candidates": [{"line": 1.5}]}', None), items, review("inline")),
        *answers("detector fails", error),
        *answers("bad suggester", found, ('{"items": []} trailing {"a": 1}', None), review("inline")),
        *answers("no suggester", found),
    ]
    outcomes = mod.stage_outcomes(spark.createDataFrame(rows, schemas.MODEL_RESPONSES))
    failed = {r.path: r.failed_stage for r in mod.failures(outcomes).collect()}
    assert failed == {
        "reviewer fails": "reviewer", "bad detector": "detector", "detector fails": "detector",
        "bad suggester": "suggester", "no suggester": "suggester",
    }
    positions = outcomes.select(*mod.file_keys(outcomes), F.lit(2).cast("bigint").alias("line"), F.lit(5).cast("bigint").alias("diff_pos"))
    got = {r.path: (r.rule, r.severity, r.diff_pos, r.confidence, r.suggested_fix) for r in mod.model_findings(outcomes, positions).collect()}
    assert got == {
        "inline": ("llm-x", "error", 5, 0.9, ""),
        "lost": ("llm-x", "error", 0, 0.9, ""),
        "summary": ("llm-x", "info", 0, 0.1, ""),
        "retry": ("llm-x", "warning", 5, 0.7, ""),
        "fallback": ("llm-logic", "warning", 5, 0.75, "f"),
    }


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_nearest_findings_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    vectors[10] = vectors[3]
    vectors[20] = 0
    # One repository holds most of the rows.
    repos = ["hot" if i % 5 else f"r{i % 3}" for i in range(60)]
    rows = [(f"{i:03d}", repos[i], "f", "r", "m", [float(x) for x in v], 1, None) for i, v in enumerate(vectors)]
    history = spark.createDataFrame(rows, schemas.FINDING_HISTORY)
    queries = history.select(F.col("id").alias("query_id"), "repo", "embedding")
    got = {}
    for r in hist.similar_findings(queries, history, 4, block_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    wide = vectors.astype("float64")
    for i in range(60):
        def distance(j):
            lengths = np.linalg.norm(wide[i]) * np.linalg.norm(wide[j])
            return round(1 - wide[i] @ wide[j] / lengths, 12) if lengths else np.inf

        same = [j for j in range(60) if repos[j] == repos[i]]
        want = sorted(same, key=lambda j: (distance(j), j))[:4]
        assert got[f"{i:03d}"] == [f"{j:03d}" for j in want]


def test_seams(spark):
    requests = spark.createDataFrame(
        [("o/r", 1, "a", "detector", "u1"), ("o/r", 1, "b", "detector", "u22")],
        "repo_full_name string, pr_number bigint, path string, stage string, user string",
    )
    live = seams.complete(requests, lambda batch: [(None, "down") if len(r["user"]) > 2 else (r["user"], None) for r in batch])
    assert sorted((r.path, r.content, r.error) for r in live.collect()) == [("a", "u1", None), ("b", None, "down")]
    kept = seams.recorded(requests, live.where("path = 'a'"))
    assert sorted((r.path, r.error) for r in kept.collect()) == [("a", None), ("b", "no answer")]
    vectors = seams.embed(requests, "user", lambda texts: [[1.0] if len(t) == 2 else None for t in texts])
    assert sorted((r.path, r.embedding) for r in vectors.collect()) == [("a", [1.0]), ("b", None)]


def pull_request(spark):
    source = "package p\nfunc f() {\n\tpanic(1)\n}\n"
    raw = "diff --git a/a.go b/a.go\n--- a/a.go\n+++ b/a.go\n@@ -1,3 +1,4 @@\n package p\n func f() {\n+\tpanic(1)\n }\n"
    jobs = spark.createDataFrame([(1, "o/r", "o", "r", 1, "h1", ""), (1, "o/r", "o", "r", 2, "h2", "")], schemas.REVIEW_JOBS)
    diffs = spark.createDataFrame([("o/r", 1, "h1", raw)], schemas.PR_DIFFS)
    sources = spark.createDataFrame([("o/r", "a.go", "h1", source)], schemas.SOURCE_FILES)
    item = {"category": "c", "line": 2, "message": "[x] look", "confidence": 0.8, "decision": "inline", "suggested_fix": "y()"}
    found = ('{"candidates": [{"category": "c", "line": 2, "message": "m"}]}', None)
    rows = answers("a.go", found, ('{"items": [{"line": 2}]}', None), (json.dumps({"items": [item]}), None))
    return jobs, diffs, sources, spark.createDataFrame(rows, schemas.MODEL_RESPONSES)


def test_review_of_both_streams(spark):
    jobs, diffs, sources, responses = pull_request(spark)
    review = plan.reviews(jobs, diffs, sources, None, responses).collect()
    assert len(review) == 1
    review = review[0]
    assert (review.commit_id, review.event, review.body) == ("h1", "REQUEST_CHANGES", rev.HEADING)
    assert [(c.path, c.position) for c in review.comments] == [("a.go", 4), ("a.go", 3)]
    assert review.comments[1].body.startswith("look\n\n*Confidence: 80%*\n\n**Suggested Fix:**\n```go\ny()")
    assert (review.n_comments, review.n_rule, review.n_model) == (2, 1, 1)
    # A model outage leaves the rule findings in place.
    down = responses.withColumn("error", F.lit("down"))
    review = plan.reviews(jobs, diffs, sources, None, down).first()
    assert (review.n_rule, review.n_model) == (1, 0)
    payload = json.loads(rev.review_payload(plan.reviews(jobs, diffs, sources)).first().payload)
    assert sorted(payload) == ["body", "comments", "commit_id", "event"]


def test_two_revisions_in_one_run(spark):
    jobs, diffs, sources, responses = pull_request(spark)

    def other(df, column):
        return df.unionByName(df.where(F.col(column) == "h1").withColumn(column, F.lit("h9")))

    again = other(jobs, "head_sha"), other(diffs, "head_sha"), other(sources, "ref")
    made = plan.reviews(*again, None, responses).orderBy("commit_id").collect()
    assert [(r.commit_id, r.n_rule, r.n_model) for r in made] == [("h1", 1, 1), ("h9", 1, 0)]


def test_model_stream_reviews_what_the_rules_review(spark):
    jobs, diffs, sources, responses = pull_request(spark)
    alone = plan.configured_jobs(jobs, sources, None)
    outcomes = mod.stage_outcomes(responses.unionByName(responses.withColumn("path", F.lit("x.py"))))
    twice = diffs.withColumn("raw", F.concat("raw", "raw", F.lit("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n")))
    assert [r.file_idx for r in plan.model_stream(outcomes, alone, twice, sources).orderBy("file_idx").collect()] == [0, 1]
    shut = alone.withColumn("exclude_regex", F.lit("^a.*"))
    assert plan.model_stream(outcomes, shut, diffs, sources).count() == 0
    assert plan.model_stream(outcomes, alone, diffs, sources.where("path = 'none'")).count() == 0


def test_reviewing_stream_sees_later_diffs_and_buries_exhausted_jobs(spark):
    jobs, diffs, sources, _ = pull_request(spark)
    folder, queued, checkpoint = (work_dir(spark, x) for x in ("late", "queued", "ck"))
    diffs.limit(0).write.parquet(folder)
    out = ReviewTables(folder, sources, None, None, work_dir(spark, "rev"), work_dir(spark, "outc"), dead_path=work_dir(spark, "dead"))
    for k in range(5):
        if k == 1:
            diffs.write.mode("append").parquet(folder)
        jobs.coalesce(1).write.mode("append").parquet(queued)
        stream = tables.stream_table(spark, "review_jobs", queued)
        start_reviewing(stream, out, checkpoint, available_now=True).awaitTermination()
    assert [(r.pr_number, r.head_sha) for r in spark.read.parquet(out.reviews_path).collect()] == [(1, "h1")]
    assert [(r.pr_number, r.attempt) for r in spark.read.parquet(out.dead_path).collect()] == [(2, 4)]


def test_later_batches_are_shown_the_findings_of_earlier_ones(spark):
    jobs, diffs, sources, _ = pull_request(spark)
    jobs = jobs.where("pr_number = 1")

    def provider(requests):
        out = []
        for r in requests:
            seen = sum("(PR #" in x for x in r["user"].split("\n")) if r["stage"] == "detector" else 0
            item = {"category": "c", "line": 3, "message": f"saw {seen}", "confidence": 0.9, "decision": "inline"}
            if r["stage"] != "detector":
                item["message"] = r["user"].split("] ", 1)[1].split("\n")[0]
            out.append((json.dumps({"candidates" if r["stage"] == "detector" else "items": [item]}), None))
        return out

    queued, checkpoint = work_dir(spark, "queued"), work_dir(spark, "ck")
    every = diffs.unionByName(diffs.withColumn("pr_number", F.lit(5).cast("bigint")))
    out = ReviewTables(every, sources, None, None, work_dir(spark, "rev"), work_dir(spark, "outc"), work_dir(spark, "hist"), provider=provider)
    for number in (1, 5):
        jobs.withColumn("pr_number", F.lit(number).cast("bigint")).coalesce(1).write.mode("append").parquet(queued)
        stream = tables.stream_table(spark, "review_jobs", queued)
        embedder = lambda texts: [[1.0, 0.0] for _ in texts]
        start_reviewing(stream, out, checkpoint, embedder, available_now=True).awaitTermination()
    stored = spark.read.parquet(out.history_path).orderBy("pr_number").collect()
    assert [(r.pr_number, r.message) for r in stored] == [(1, "saw 0"), (5, "saw 1")]


def test_reviewing_stream_retries_and_stores_history(spark):
    jobs, diffs, sources, responses = pull_request(spark)
    queued = work_dir(spark, "queued")
    out = ReviewTables(
        diffs, sources, None, responses, work_dir(spark, "rev"), work_dir(spark, "outc"), work_dir(spark, "hist")
    )
    checkpoint = work_dir(spark, "ck")
    for k in (1, 2):  # the second arrival repeats the jobs
        jobs.coalesce(1).write.mode("append").parquet(queued)
        stream = tables.stream_table(spark, "review_jobs", queued)
        start_reviewing(
            stream, out, checkpoint, lambda texts: [[1.0, 0.0] for _ in texts], available_now=True
        ).awaitTermination()
    assert [r.pr_number for r in spark.read.parquet(out.reviews_path).collect()] == [1]
    outcomes = spark.read.parquet(out.outcomes_path).orderBy("pr_number", "attempt").collect()
    assert [(r.pr_number, r.attempt, r.failed) for r in outcomes] == [(1, 1, False), (2, 1, True), (2, 2, True)]
    stored = spark.read.parquet(out.history_path).collect()
    assert [(r.repo, r.rule, r.message, r.embedding) for r in stored] == [("r", "llm-c", "[x] look", [1.0, 0.0])]
