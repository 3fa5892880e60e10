"""Registered queries: each runs the operators over whole test tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.functions import text as tx
from reviewlake.functions.vectors import norm
from reviewlake.operators import config as cfg
from reviewlake.operators import diffs as dif
from reviewlake.operators import history as hist
from reviewlake.operators import intake
from reviewlake.operators import model as mod
from reviewlake.operators import prompts
from reviewlake.operators import review as rev
from reviewlake.operators import seams
from reviewlake.operators.rules import RuleSpec, default_rules, scan
from reviewlake.plans import review as plan
from reviewlake.plans.live import live_outcomes
from reviewlake.session import spread, work_dir, written
from reviewlake.sources import corpus, tables
from reviewlake.streaming.intake import start_intake
from reviewlake.streaming.retrying import MAX_RETRIES, RetryPolicy
from reviewlake.streaming.reviewing import ReviewTables, start_retrying, start_reviewing

Query = Callable[[SparkSession, str], DataFrame]

LOCAL_RULES = (
    "mutex-copied-by-value",
    "error-ignored",
    "empty-error-catch",
    "os-exit-in-library",
    "panic-outside-main",
    "fmt-sprintf-in-println",
    "reflect-deepequal-primitives",
    "todo-comment",
)
SCOPED_RULES = (
    "context-not-propagated",
    "naked-return",
    "deferred-close-in-a-loop",
    "time-after-in-loop",
    "goroutine-loop-capture",
)
STATEMENT_RULES = ("missing-cancel", "unreachable-code-after-return", "ineffective-assignment")
TAG_RULES = ("struct-tag-malformed", "struct-tag-duplicate")

#: Bytes of bodies in one file of landed deliveries.
LANDED_BYTES = 64 << 20
SITE_GLOBS = ["fr/**", "**/*.html", "en/?7*", "bad["]
PROBE_VECTOR = [((i % 7) - 3) / 10 for i in range(64)]


# -- intake --------------------------------------------------------------------


def delivery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.delivery_status(corpus.deliveries(spark, sf_dir), corpus.SECRET)


def delivery_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries whose bodies are as long as the limit, or a byte longer."""
    return intake.delivery_status(corpus.padded_deliveries(spark, sf_dir, 1000), corpus.SECRET, max_bytes=1000)


def review_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = intake.review_jobs(corpus.deliveries(spark, sf_dir), corpus.SECRET)
    return jobs.withColumn("short_sha", tx.short_sha(F.col("head_sha")))


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same jobs through a stream of several file batches."""
    landed, out = work_dir(spark, "deliveries"), work_dir(spark, "jobs")
    dealt = spread(corpus.deliveries(spark, sf_dir), "delivery_id", by=F.octet_length("body"), most=LANDED_BYTES)
    dealt.write.parquet(landed)
    files = len(spark.read.schema(schemas.DELIVERIES).parquet(landed).inputFiles())
    incoming = tables.stream_table(spark, "deliveries", landed, files_per_batch=-(-files // 2))
    query = start_intake(incoming, corpus.SECRET, out, work_dir(spark, "intake"), available_now=True)
    query.awaitTermination()
    jobs = tables.read_table(spark, "review_jobs", out)
    return jobs.withColumn("short_sha", tx.short_sha(F.col("head_sha")))


# -- diffs ---------------------------------------------------------------------


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dif.diff_lines(corpus.document_diffs(spark, sf_dir)).drop("n")


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dif.diff_files(corpus.document_diffs(spark, sf_dir))


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dif.diff_summary(corpus.document_diffs(spark, sf_dir))


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dif.added_lines(dif.diff_lines(corpus.document_diffs(spark, sf_dir)))
    return lines.select(*dif.PR_KEYS, "file_idx", "new_line", "content")


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dif.changed_lines(dif.diff_lines(corpus.document_diffs(spark, sf_dir)))


def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dif.line_positions(dif.diff_lines(corpus.document_diffs(spark, sf_dir)))


# -- rules ---------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, only: Sequence[str] | None, configured: bool = False) -> DataFrame:
    sources = corpus.go_sources(spark, sf_dir)
    configs = corpus.go_configs(spark, sf_dir) if configured else None
    jobs = plan.configured_jobs(corpus.go_jobs(spark, sf_dir), sources, configs)
    return plan.rule_findings(jobs, corpus.go_diffs(spark, sf_dir), sources, only=only)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("repo_full_name", "pr_number", "path", "rule", "severity", "line", "diff_pos")


def library_panics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines that bring a panic into library code, and where to comment."""
    return _flat(_found(spark, sf_dir, ["panic-outside-main"]))


def rules_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, LOCAL_RULES))


def rules_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, SCOPED_RULES))


def rules_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, STATEMENT_RULES))


def struct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, TAG_RULES))


def enabled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, None, configured=True))


def unparseable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of files that hold a sound or an unsound statement: the unsound ones have none."""
    found = scan(corpus.odd_sources(spark, sf_dir), only=["panic-outside-main"])
    return found.select("pr_number", "rule", "line")


def added_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the user's own beside the built-in ones."""
    own = RuleSpec(
        rule="channel-read", severity="info", message="reads a channel", when=F.col("tok") == "<-", line=F.col("line"), word="<-"
    )
    found = scan(corpus.odd_sources(spark, sf_dir), [*default_rules(), own], only=["channel-read", "panic-outside-main"])
    return found.select("pr_number", "rule", "severity", "line")


def go_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = plan.configured_jobs(corpus.go_jobs(spark, sf_dir), corpus.go_sources(spark, sf_dir), None)
    recent = tx.version_at_least(F.col("go_version"), 1, 22)
    return jobs.select("repo_full_name", "pr_number", "go_version", recent.alias("recent"))


# -- configuration ---------------------------------------------------------------


def excluded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths that no exclusion of their repository matches."""
    pages = corpus.page_files(spark, sf_dir).withColumn("base_sha", F.lit("")).withColumn("head_sha", F.lit("s1"))
    row = ("org/site", "s1", 0, True, 1, [], SITE_GLOBS, "", "")
    configs = spark.createDataFrame([row], schemas.REPO_CONFIGS)
    kept = cfg.without_excluded(cfg.attach_config(pages, configs))
    return kept.select("pr_number", "path")


def model_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = cfg.attach_config(corpus.go_jobs(spark, sf_dir), corpus.go_configs(spark, sf_dir))
    chosen = cfg.model_choice(jobs, "beta", "small", ("alpha", "beta"))
    return chosen.select("repo_full_name", "pr_number", "provider", "model")


# -- model answers ----------------------------------------------------------------


def stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mod.stage_candidates(mod.stage_outcomes(corpus.order_responses(spark, sf_dir)))


def strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of other types, other spellings and with tricks behind the value: which are taken, and as what."""
    decoded = mod.decoded_responses(corpus.odd_answers(spark, sf_dir))
    items = F.col("detector_items")
    return decoded.select(
        "pr_number", "ok", F.size(items).alias("n_items"), F.get(items, F.lit(0))["line"].alias("first_line"),
        F.get(items, F.lit(1))["message"].alias("second_message"),
    )


def stage_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mod.failures(mod.stage_outcomes(corpus.order_responses(spark, sf_dir)))


def reviewed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = mod.stage_outcomes(corpus.order_responses(spark, sf_dir))
    found = mod.model_findings(outcomes, corpus.order_positions(spark, sf_dir))
    return found.withColumn("severity_ordinal", tx.severity_ordinal(F.col("severity")))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hist.with_embedding_text(reviewed_findings(spark, sf_dir))
    return found.select("pr_number", "item_idx", "embedding_text")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded answers as a table, for queries that read them more than once."""
    return written(mod.stage_outcomes(corpus.order_responses(spark, sf_dir)), "outcomes")


def _order_findings(outcomes: DataFrame) -> DataFrame:
    """Items seen as static findings: the rule stream of the order files."""
    items = mod.stage_items(outcomes)
    tagged = F.concat(F.lit("[rule]  "), "message", F.lit("  "))
    position = F.when(F.col("line") % 2 == 0, F.col("line") + 1).otherwise(0)
    return items.select(
        *mod.FILE_KEYS,
        F.lit(0).alias("file_idx"),
        F.col("item_idx").cast("bigint").alias("ord"),
        F.concat(F.lit("rule-"), "category").alias("rule"),
        F.when(F.col("line") % 2 == 0, tagged).otherwise(F.col("explanation")).alias("message"),
        "line",
        position.cast("bigint").alias("diff_pos"),
    )


def _order_files(outcomes: DataFrame) -> DataFrame:
    files = outcomes.select(*mod.FILE_KEYS)
    return files.withColumn("content", F.concat(F.lit("package o"), F.col("pr_number").cast("string")))


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(spark, sf_dir)
    texts = prompts.query_text(_order_files(outcomes), _order_findings(outcomes))
    return texts.select("pr_number", "query_text")


def stage_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request texts of all stages, as length and digest."""
    outcomes = _outcomes(spark, sf_dir)
    files, found = _order_files(outcomes), _order_findings(outcomes)
    similar = mod.stage_items(outcomes).select(
        *mod.FILE_KEYS,
        F.col("item_idx").alias("rank"),
        F.concat(F.lit("llm-"), "category").alias("rule"),
        "message",
        F.col("line").alias("past_pr"),
        F.lit("old.go").alias("file_path"),
    )
    requests = (
        prompts.detector_requests(files, found, similar)
        .unionByName(prompts.suggester_requests(files, mod.stage_candidates(outcomes)))
        .unionByName(prompts.reviewer_requests(mod.stage_items(outcomes)))
    )
    return requests.select(
        "pr_number", "stage", F.length("user").alias("n_chars"), F.md5("user").alias("digest")
    )


def live_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completion seam: a provider that answers with the size of its request."""

    def provider(requests: Sequence[dict]) -> list[tuple[str | None, str | None]]:
        return [(f"{r['stage']} {len(r['user'])}", None) for r in requests]

    outcomes = _outcomes(spark, sf_dir)
    requests = prompts.suggester_requests(_order_files(outcomes), mod.stage_candidates(outcomes))
    answers = seams.complete(requests, provider)
    return answers.select("pr_number", "path", "stage", "attempt", "content", "error")


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the requests asked first, then all twice: the answers, and how often each request was asked.

    The provider raises for whole batches that hold a key divisible by 11, and for that request alone.
    """

    def provider(requests: Sequence[dict]) -> list[tuple[str | None, str | None]]:
        bad = [r["user"] for r in requests if r["bad"]]
        if bad:
            raise ValueError("no answer")
        return [(f"{r['stage']} {len(r['user'])}", None) for r in requests]

    outcomes, cache = _outcomes(spark, sf_dir), work_dir(spark, "calls")
    requests = prompts.suggester_requests(_order_files(outcomes), mod.stage_candidates(outcomes))
    requests = written(requests.withColumn("bad", F.col("pr_number") % 11 == 0), "requests")
    for part in (requests.where(F.col("pr_number") % 3 == 0), requests, requests):
        answers = seams.complete_once(part, provider, cache)
    calls = seams.stored_answers(spark, cache).groupBy("digest").agg(F.count("*").alias("calls"))
    keyed = requests.select("pr_number", seams.request_digest(requests, 1).alias("digest"))
    counted = keyed.join(calls, "digest").select("pr_number", "calls")
    return answers.join(counted, "pr_number").select("pr_number", "content", "error", "calls")


# -- history ------------------------------------------------------------------------


def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every stored finding, the nearest ones of its repository stored before it."""
    history = corpus.finding_history(spark, sf_dir)
    queries = history.select(
        F.col("id").alias("query_id"), "repo", "embedding", F.col("created_at").alias("as_of")
    )
    found = hist.similar_findings(queries, history)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def similar_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with every repository behind a cell index."""
    history = corpus.finding_history(spark, sf_dir)
    queries = history.select(F.col("id").alias("query_id"), "repo", "embedding", F.col("created_at").alias("as_of"))
    return hist.indexed_findings(queries, history).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def nearest_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hist.nearest_to(corpus.finding_history(spark, sf_dir), PROBE_VECTOR)
    return found.select("id", "repo", F.round("distance", 6).alias("distance"))


def history_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History appended in two writes and read back."""
    path = work_dir(spark, "history")
    history = corpus.finding_history(spark, sf_dir)
    for half in (0, 1):
        tables.append_history(history.where(F.col("pr_number") % 2 == half), path)
    back = tables.read_history(spark, path)
    return back.select(
        "id", "repo", "file_path", "rule", "message", "pr_number",
        F.size("embedding").alias("dims"),
        F.round(norm(F.col("embedding")), 6).alias("length"),
        F.unix_timestamp("created_at").alias("created_s"),
    )


def saved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model findings embedded through the seam and shaped for the history."""

    def provider(texts: Sequence[str]) -> list[list[float] | None]:
        return [None if len(t) % 5 == 0 else [float(len(t)), 1.0] for t in texts]

    found = reviewed_findings(spark, sf_dir).withColumn("repo_name", F.substring_index("repo_full_name", "/", -1))
    rows = hist.history_rows(seams.embed(hist.with_embedding_text(found), "embedding_text", provider))
    return rows.select(
        "repo", "file_path", "rule", "message", "pr_number",
        F.get("embedding", F.lit(0)).cast("double").alias("first_value"),
        (F.length("id") == 36).alias("has_id"),
    )


# -- reviews ------------------------------------------------------------------------


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both streams of the order files; only the items that they read are written."""
    outcomes = mod.stage_outcomes(corpus.order_responses(spark, sf_dir)).select(*mod.FILE_KEYS, "items", "reviewed")
    outcomes = written(outcomes, "outcomes")
    models = mod.model_findings(outcomes, corpus.order_positions(spark, sf_dir)).select(
        *mod.FILE_KEYS,
        F.lit(0).alias("file_idx"),
        F.col("item_idx").cast("bigint").alias("ord"),
        "rule", "message", "line", "diff_pos", "confidence", "suggested_fix",
    )
    return rev.merged_findings(_order_findings(outcomes), models)


def _flat_reviews(reviews: DataFrame) -> DataFrame:
    lines = F.transform("comments", lambda c: F.concat_ws("|", c["path"], c["position"].cast("string"), c["body"]))
    return reviews.select(
        "repo_full_name", "pr_number", "event", "body", F.array_join(lines, "\n").alias("comments")
    )


def review_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_reviews(rev.assemble_reviews(_merged(spark, sf_dir)))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rev.review_counts(_merged(spark, sf_dir))


def reviews_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews written as JSON documents and read back."""
    path = work_dir(spark, "reviews")
    tables.write_reviews(rev.assemble_reviews(_merged(spark, sf_dir)), path)
    return _flat_reviews(tables.read_table(spark, "reviews", path, "json"))


def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to post, written as text and read back: their keys, and what stands under them."""
    path = work_dir(spark, "payloads")
    tables.write_payloads(rev.review_payload(rev.assemble_reviews(_merged(spark, sf_dir))), path)
    posted = tables.read_payloads(spark, path)
    keys = F.array_join(F.array_sort(F.json_object_keys("payload")), ",")
    value = F.from_json("payload", schemas.REVIEWS)
    rows = posted.select("repo_full_name", "pr_number", keys.alias("keys"), value.alias("v"))
    lines = F.transform("v.comments", lambda c: F.concat_ws("|", c["path"], c["position"].cast("string"), c["body"]))
    return rows.select("repo_full_name", "pr_number", "keys", "v.event", "v.body", F.array_join(lines, "\n").alias("comments"))


def both_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part pull requests with findings of the rules and of recorded answers on the same files."""
    made = plan.reviews(
        corpus.go_jobs(spark, sf_dir),
        corpus.go_diffs(spark, sf_dir),
        corpus.go_sources(spark, sf_dir),
        corpus.go_configs(spark, sf_dir),
        corpus.go_responses(spark, sf_dir),
    )
    placed = F.aggregate("comments", F.lit(0).cast("bigint"), lambda n, c: n + c["position"])
    return made.select("repo_full_name", "pr_number", "commit_id", "n_comments", "n_rule", "n_model", placed.alias("positions"))


def two_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part pull request opened and updated within one run: a review for either revision."""

    def both(df: DataFrame, column: str = "head_sha") -> DataFrame:
        return df.unionByName(corpus.second_revision(df, column))

    jobs, diffs = both(corpus.go_jobs(spark, sf_dir)), both(corpus.go_diffs(spark, sf_dir))
    made = plan.reviews(jobs, diffs, both(corpus.go_sources(spark, sf_dir), "ref"))
    return made.select("repo_full_name", "pr_number", "commit_id", "n_comments", "n_rule")


def model_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model findings of the part pull requests: none on excluded, foreign or missing files, one per diff entry."""
    sources = corpus.go_sources(spark, sf_dir)
    jobs = plan.configured_jobs(corpus.go_jobs(spark, sf_dir), sources, corpus.go_configs(spark, sf_dir))
    outcomes = mod.stage_outcomes(corpus.go_responses(spark, sf_dir))
    found = plan.model_stream(outcomes, jobs, corpus.wider_diffs(spark, sf_dir), sources)
    return found.select("repo_full_name", "pr_number", "path", "file_idx", "rule", "severity", "line", "diff_pos")


def model_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to model findings against a fixed provider: similar findings, three stages, retries, overrides.

    The provider reports how many similar findings it was shown. Its reviewer
    answers broken JSON once where key % 3 = 0, and always where key % 5 = 0.
    """

    def provider(requests: Sequence[dict]) -> list[tuple[str | None, str | None]]:
        out = []
        for r in requests:
            key = r["pr_number"]
            if r["stage"] == "reviewer" and (key % 5 == 0 or (key % 3 == 0 and r["attempt"] == 1)):
                out.append(('{"items": [}', None))
                continue
            lines = [x for x in r["user"].split("\n") if x.startswith("- ")]
            said = f"{sum('(PR #' in x for x in lines)} similar" if r["stage"] == "detector" else lines[0].split("] ", 1)[1]
            item = {"category": f"{r['provider']}-{r['model']}", "line": 1, "message": said, "suggested_fix": "f"}
            if r["stage"] == "reviewer":
                item |= {"confidence": 0.9, "decision": "summary"}
            out.append((json.dumps({"candidates" if r["stage"] == "detector" else "items": [item]}), None))
        return out

    sources, diffs = corpus.go_sources(spark, sf_dir), corpus.go_diffs(spark, sf_dir)
    jobs = plan.configured_jobs(corpus.go_jobs(spark, sf_dir), sources, corpus.go_configs(spark, sf_dir))
    jobs = written(cfg.model_choice(jobs, "beta", "small", ("alpha", "beta")), "jobs")
    known = plan.rule_findings(jobs, diffs, sources, only=["panic-outside-main"])
    files = plan.changed_sources(jobs, diffs, sources).select(*plan.JOB, "path", "content", "repo_name", "provider", "model")
    history = corpus.part_history(spark, sf_dir)
    outcomes = live_outcomes(files, known, provider, history, lambda texts: [[float(len(t)), 1.0] for t in texts])
    found = plan.model_stream(outcomes, jobs, diffs, sources)
    return found.select("repo_full_name", "pr_number", "path", "rule", "severity", "message", "line", "diff_pos", "confidence")


def stream_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part pull requests reviewed from a stream of jobs."""
    landed = work_dir(spark, "queued")
    corpus.go_jobs(spark, sf_dir).repartition(2, "pr_number").write.parquet(landed)
    diffs = work_dir(spark, "diffs")
    corpus.go_diffs(spark, sf_dir).write.parquet(diffs)
    out = ReviewTables(
        diffs=diffs,
        sources=corpus.go_sources(spark, sf_dir),
        configs=corpus.go_configs(spark, sf_dir),
        responses=None,
        reviews_path=work_dir(spark, "reviews"),
        outcomes_path=work_dir(spark, "outcomes"),
    )
    jobs = tables.stream_table(spark, "review_jobs", landed, files_per_batch=1)
    start_reviewing(jobs, out, work_dir(spark, "reviewing"), available_now=True).awaitTermination()
    return spark.read.parquet(out.reviews_path).select(
        "repo_full_name", "pr_number", "head_sha", "event", "n_comments", "n_rule", "n_model"
    )


def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part pull requests from a retrying stream: what became of each job.

    Every fifth diff arrives after its job has failed, every seventh never does;
    nothing else arrives, so all retries come by the clock.
    """
    landed, diffs = work_dir(spark, "queued"), work_dir(spark, "diffs")
    jobs, every = corpus.go_jobs(spark, sf_dir), corpus.go_diffs(spark, sf_dir).where(F.col("pr_number") % 7 != 0)
    jobs.write.parquet(landed)
    every.where(F.col("pr_number") % 5 != 0).write.parquet(diffs)
    out = ReviewTables(
        diffs=diffs,
        sources=corpus.go_sources(spark, sf_dir),
        configs=corpus.go_configs(spark, sf_dir),
        responses=None,
        reviews_path=work_dir(spark, "reviews"),
        outcomes_path=work_dir(spark, "outcomes"),
        dead_path=work_dir(spark, "dead"),
    )
    stream = tables.stream_table(spark, "review_jobs", landed)
    query = start_retrying(stream, out, work_dir(spark, "retrying"), policy=RetryPolicy(first_delay_ms=2000), every="1 second")
    total, late = jobs.count(), False
    try:
        while True:
            query.awaitTermination(1)  # raises what ended the stream
            ended = tables.job_status(spark, out.outcomes_path, MAX_RETRIES)
            if not late and ended.limit(1).count():
                every.where(F.col("pr_number") % 5 == 0).write.mode("append").parquet(diffs)
                late = True
            buried = spark.read.schema("repo_full_name string, pr_number bigint, head_sha string, attempt int").parquet(out.dead_path)
            if ended.where("status = 'reviewed'").count() + buried.count() == total:
                break
    finally:
        query.stop()
    reviewed = spark.read.parquet(out.reviews_path).select("repo_full_name", "pr_number", "head_sha", "n_rule")
    keys = ["repo_full_name", "pr_number", "head_sha"]
    found = ended.join(reviewed, keys, "left").join(buried, keys, "left")
    return found.select(*keys, "status", F.col("attempt").alias("buried_after"), F.coalesce("n_rule", F.lit(0)).alias("n_rule"))


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that two batches store, each told how many earlier findings its repository had."""

    def provider(requests: Sequence[dict]) -> list[tuple[str | None, str | None]]:
        out = []
        for r in requests:
            lines = [x for x in r["user"].split("\n") if x.startswith("- ")]
            said = f"{sum('(PR #' in x for x in lines)} similar" if r["stage"] == "detector" else lines[0].split("] ", 1)[1]
            item = {"category": "seen", "line": 1, "message": said, "confidence": 0.9, "decision": "summary"}
            out.append((json.dumps({"candidates" if r["stage"] == "detector" else "items": [item]}), None))
        return out

    landed, jobs = work_dir(spark, "queued"), corpus.go_jobs(spark, sf_dir)
    out = ReviewTables(
        diffs=corpus.go_diffs(spark, sf_dir),
        sources=corpus.go_sources(spark, sf_dir),
        configs=corpus.go_configs(spark, sf_dir),
        responses=None,
        reviews_path=work_dir(spark, "reviews"),
        outcomes_path=work_dir(spark, "outcomes"),
        history_path=work_dir(spark, "history"),
        provider=provider,
    )
    checkpoint = work_dir(spark, "reviewing")
    for half in (0, 1):
        jobs.where(F.floor(F.col("pr_number") / 20) % 2 == half).write.mode("append").parquet(landed)
        stream = tables.stream_table(spark, "review_jobs", landed)
        embedder = lambda texts: [[1.0, float(len(t))] for t in texts]
        start_reviewing(stream, out, checkpoint, embedder, available_now=True).awaitTermination()
    return spark.read.parquet(out.history_path).select("repo", "pr_number", "file_path", "rule", "message")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        delivery_status,
        delivery_limits,
        review_jobs,
        stream_jobs,
        diff_lines,
        diff_files,
        diff_summary,
        added_lines,
        changed_lines,
        line_positions,
        library_panics,
        rules_local,
        rules_scoped,
        rules_statements,
        struct_tags,
        enabled_findings,
        unparseable_files,
        added_rule,
        go_versions,
        excluded_files,
        model_overrides,
        stage_candidates,
        stage_failures,
        strict_answers,
        reviewed_findings,
        embedding_texts,
        query_text,
        stage_prompts,
        live_answers,
        cached_answers,
        similar_topk,
        similar_topk_cells,
        nearest_global,
        history_roundtrip,
        saved_findings,
        review_bodies,
        review_counts,
        reviews_written,
        review_payloads,
        both_streams,
        two_revisions,
        model_filters,
        model_pipeline,
        stream_reviews,
        stream_retries,
        stream_history,
    )
}
