"""Recorded model answers to findings: three stages chained per file.

All answers of a file meet in one aggregate keyed by the file, so the chain
costs one shuffle instead of a join per stage. The arrays it holds are the
items of single model answers.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.once import with_once
from reviewlake.functions.jsonio import envelope, envelope_ok, envelope_value, repeated_keys, zero_filled
from reviewlake.functions.text import severity_from_confidence, with_isolated_json
from reviewlake.schemas import DETECTOR_PAYLOAD, REVIEWER_PAYLOAD, SUGGESTER_PAYLOAD

FILE_KEYS = ("repo_full_name", "pr_number", "path")


def file_keys(df: DataFrame) -> list[str]:
    """What names one file of a review: its path, with the revision and the entry of the diff where known."""
    return [*FILE_KEYS, *(c for c in ("head_sha", "file_idx") if c in df.columns)]


# Stage names, attempts, fallback scoring and decisions.
DETECTOR, SUGGESTER, REVIEWER = "detector", "suggester", "reviewer"
REVIEWER_ATTEMPTS = 3
FALLBACK_CONFIDENCE, FALLBACK_DECISION = 0.75, "inline"
DROP, INLINE = "drop", "inline"
RULE_PREFIX = "llm-"


PAYLOADS = {DETECTOR: DETECTOR_PAYLOAD, SUGGESTER: SUGGESTER_PAYLOAD, REVIEWER: REVIEWER_PAYLOAD}


def decoded_responses(responses: DataFrame, stages: Collection[str] = tuple(PAYLOADS)) -> DataFrame:
    """Answers with the decoded payload of their own stage and an ok flag.

    ``stages`` are those that the answers can be of; a plan for fewer is smaller.
    """
    repeated_keys(responses.sparkSession)
    df = with_isolated_json(responses, "content", "__text_json")
    df = with_once(df, __json=F.col("__text_json")).drop("__text_json")
    payloads = {stage: schema for stage, schema in PAYLOADS.items() if stage in stages}
    answered = F.col("error").isNull()
    envelopes = {
        f"__{stage}": F.when((F.col("stage") == stage) & answered, envelope("__json", schema))
        for stage, schema in payloads.items()
    }
    df = with_once(df, **envelopes)
    ok = F.lit(False)
    for stage in payloads:
        ok = ok | envelope_ok(F.col(f"__{stage}"))
    df = df.withColumn("ok", ok)
    for stage, schema in payloads.items():
        value = zero_filled(envelope_value(F.col(f"__{stage}")), schema)
        items = value.getField(schema.fieldNames()[0])
        df = df.withColumn(f"{stage}_items", F.when(F.col("ok") & (F.col("stage") == stage), items))
    for stage in PAYLOADS.keys() - payloads.keys():
        df = df.withColumn(f"{stage}_items", F.lit(None).cast(PAYLOADS[stage].fields[0].dataType))
    return df.drop("__json", *[f"__{stage}" for stage in payloads])


def stage_outcomes(responses: DataFrame) -> DataFrame:
    """The outcomes of recorded answers, see :func:`outcomes_of`."""
    return outcomes_of(decoded_responses(responses))


def outcomes_of(df: DataFrame) -> DataFrame:
    """One row per file of decoded answers: candidates, items, reviewed, failed_stage, fallback.

    A file fails where a stage it needs has no answer, a call error, or (for
    the first two stages) no valid payload. An empty stage ends the file
    without failure.
    """
    keys = file_keys(df)

    def first_of(stage: str) -> Column:
        mine = F.when(F.col("stage") == stage, F.col("attempt"))
        answer = F.struct("ok", F.col(f"{stage}_items").alias("items"))
        return F.min_by(answer, mine)

    in_reach = (F.col("stage") == REVIEWER) & (F.col("attempt") <= REVIEWER_ATTEMPTS)
    decisive = in_reach & (F.col("ok") | F.col("error").isNotNull())
    files = df.groupBy(*keys).agg(
        first_of(DETECTOR).alias("d"),
        first_of(SUGGESTER).alias("s"),
        F.min_by(
            F.struct("ok", F.col("reviewer_items").alias("items")),
            F.when(decisive, F.col("attempt")),
        ).alias("r"),
        F.count_if(in_reach).alias("tries"),
    )
    files = files.where(F.col("d").isNotNull())

    promoted = F.transform(
        "s.items",
        lambda item: F.struct(
            item["category"].alias("category"),
            item["line"].alias("line"),
            item["message"].alias("message"),
            item["explanation"].alias("explanation"),
            item["suggested_fix"].alias("suggested_fix"),
            F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
            F.lit(FALLBACK_DECISION).alias("decision"),
        ),
    )
    has_candidates = F.coalesce(F.col("d.ok") & (F.size("d.items") > 0), F.lit(False))
    has_items = has_candidates & F.coalesce(F.col("s.ok") & (F.size("s.items") > 0), F.lit(False))
    exhausted = F.col("r").isNull() & (F.col("tries") > 0)
    failed = (
        F.when(~F.col("d.ok"), DETECTOR)
        .when(~has_candidates, None)
        .when(~F.coalesce("s.ok", F.lit(False)), SUGGESTER)
        .when(~has_items, None)
        .when(~exhausted & ~F.coalesce("r.ok", F.lit(False)), REVIEWER)
    )
    nothing = F.array().cast(REVIEWER_PAYLOAD["items"].dataType)
    return files.select(
        *keys,
        F.coalesce("d.items", F.array().cast(DETECTOR_PAYLOAD["candidates"].dataType)).alias(
            "candidates"
        ),
        F.when(has_candidates, F.coalesce("s.items", F.array().cast(SUGGESTER_PAYLOAD["items"].dataType)))
        .otherwise(F.array().cast(SUGGESTER_PAYLOAD["items"].dataType))
        .alias("items"),
        F.when(has_items & exhausted, promoted)
        .when(has_items, F.coalesce("r.items", nothing))
        .otherwise(nothing)
        .alias("reviewed"),
        failed.alias("failed_stage"),
        (has_items & exhausted).alias("fallback"),
    )


def _exploded(outcomes: DataFrame, column: str) -> DataFrame:
    keys = file_keys(outcomes)
    rows = outcomes.select(*keys, F.posexplode(column).alias("item_idx", "item"))
    return rows.select(*keys, "item_idx", "item.*")


def stage_candidates(outcomes: DataFrame) -> DataFrame:
    return _exploded(outcomes, "candidates")


def stage_items(outcomes: DataFrame) -> DataFrame:
    return _exploded(outcomes, "items")


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("failed_stage").isNotNull()).select(*file_keys(outcomes), "failed_stage")


def model_findings(outcomes: DataFrame, positions: DataFrame) -> DataFrame:
    """Surviving reviewed items with their place in the diff.

    ``positions`` has the file keys of the outcomes, line and diff_pos. An inline
    item without a position becomes a file-level one.
    """
    keys = file_keys(outcomes)
    items = _exploded(outcomes, "reviewed").where(F.col("decision") != DROP)
    placed = items.join(positions.select(*keys, "line", "diff_pos"), [*keys, "line"], "left")
    inline = F.col("decision") == INLINE
    zero = F.lit(0).cast("bigint")
    return placed.select(
        *keys,
        "item_idx",
        F.concat(F.lit(RULE_PREFIX), "category").alias("rule"),
        severity_from_confidence(F.col("confidence")).alias("severity"),
        "message",
        "line",
        F.when(inline, F.coalesce("diff_pos", zero)).otherwise(zero).alias("diff_pos"),
        "confidence",
        "suggested_fix",
    )
