"""The two finding streams of a pull request, and its review, as one plan."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.text import go_version
from reviewlake.operators import config as cfg
from reviewlake.operators import diffs as dif
from reviewlake.operators import model as mod
from reviewlake.operators import review as rev
from reviewlake.operators.rules import RuleSpec, gated, scan, second_lines
from reviewlake.session import measured_joins, written

JOB = [*dif.PR_KEYS, dif.REVISION]
FILE = [*JOB, "file_idx"]
MANIFEST = "go.mod"
LANGUAGE = "go"


def configured_jobs(jobs: DataFrame, sources: DataFrame, configs: DataFrame | None) -> DataFrame:
    """Jobs with their module's Go version and their configuration."""
    measured_joins(jobs.sparkSession)
    manifests = sources.where(F.col("path") == MANIFEST).select(
        "repo_full_name", F.col("ref").alias("head_sha"), go_version(F.col("content")).alias("go_version")
    )
    jobs = jobs.join(manifests, ["repo_full_name", "head_sha"], "left").withColumn(
        "go_version", F.coalesce("go_version", F.lit(""))
    )
    if configs is not None:
        return cfg.attach_config(jobs, configs)
    return jobs.withColumn("exclude_regex", F.lit(None).cast("string")).withColumn(
        "rule_flags", F.lit(None).cast("map<string,boolean>")
    )


def of_revision(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rows of the jobs' revisions; a table without a revision belongs to every revision of its pull request."""
    if dif.REVISION in rows.columns:
        return rows.join(jobs.select(*JOB), JOB, "left_semi")
    return rows.join(jobs.select(*JOB), list(dif.PR_KEYS))


def changed_sources(jobs: DataFrame, diffs: DataFrame, sources: DataFrame, stored: bool = False) -> DataFrame:
    """Changed Go files that are not excluded, with their content at the head: what both streams review."""
    files = dif.diff_files(diffs, stored=stored).where(F.col("language") == LANGUAGE).select(*FILE, "path")
    files = cfg.without_excluded(files.join(jobs, JOB))
    content = sources.select("repo_full_name", "path", F.col("ref").alias("head_sha"), "content")
    return files.join(content, ["repo_full_name", "path", "head_sha"])


def rule_findings(
    jobs: DataFrame,
    diffs: DataFrame,
    sources: DataFrame,
    rules: Sequence[RuleSpec] | None = None,
    only: Collection[str] | None = None,
) -> DataFrame:
    """Enabled findings of all rules on changed lines, numbered within the file.

    Diffs, their lines and the files are read several times, so they are written first.
    """
    diffs = written(of_revision(diffs, jobs), "diffs")
    info = written(dif.line_info(dif.diff_lines(diffs, stored=True)), "lines")
    files = changed_sources(jobs, diffs, sources, stored=True).select(*FILE, "path", "content", "go_version", "rule_flags")
    files = written(files, "files")
    changed = info.where("changed").groupBy(*FILE).agg(F.collect_list("line").alias("changed_lines"))
    scanned = scan(files.select(*FILE, "path", "content", "go_version"), rules, only, FILE, changed)
    found = gated(scanned, info, FILE, second_lines(only))
    found = cfg.only_enabled(found.join(files.select(*FILE, "path", "rule_flags"), FILE)).drop("rule_flags")
    in_file = Window.partitionBy(*FILE).orderBy("place", "ord", "rule", "message")
    return found.withColumn("ord", F.row_number().over(in_file).cast("bigint")).drop("place")


def model_stream(outcomes: DataFrame, jobs: DataFrame, diffs: DataFrame, sources: DataFrame) -> DataFrame:
    """Model findings placed in the diff, once per entry of the file in it.

    Only files count that the rules read, too: changed, not excluded, with content.
    """
    diffs = written(of_revision(diffs, jobs), "diffs")
    files = written(changed_sources(jobs, diffs, sources, stored=True).select(*FILE, "path"), "paths")
    positions = dif.line_positions(dif.diff_lines(diffs, stored=True)).join(files, FILE)
    entries = of_revision(outcomes, jobs).join(files, [*JOB, "path"])
    return mod.model_findings(entries, positions).withColumnRenamed("item_idx", "ord")


def reviews(
    jobs: DataFrame,
    diffs: DataFrame,
    sources: DataFrame,
    configs: DataFrame | None = None,
    responses: DataFrame | None = None,
    rules: Sequence[RuleSpec] | None = None,
) -> DataFrame:
    """One assembled review per pull request and revision with findings in either stream."""
    configured = configured_jobs(jobs, sources, configs)
    models = None
    if responses is not None:
        models = model_stream(mod.stage_outcomes(responses), configured, diffs, sources)
    return assembled(rule_findings(configured, diffs, sources, rules), models)


def assembled(known: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Reviews of the findings of the rules and, where there is one, of the model stream."""
    if models is not None:
        return rev.assemble_reviews(rev.merged_findings(known, models))
    alone = (
        known.withColumn("stream", F.lit(rev.RULE_STREAM))
        .withColumn("confidence", F.lit(None).cast("double"))
        .withColumn("suggested_fix", F.lit(None).cast("string"))
    )
    return rev.assemble_reviews(alone)
