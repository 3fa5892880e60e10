"""Repository configuration: lookup, path exclusion, rule switches, model choice.

Configuration is resolved once per job, so the per-file and per-finding steps
need no further join: they read the regex and the switch map that the job row
carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.globs import exclusion_regex
from reviewlake.session import measured_joins


def _first_wins(rules: Column) -> Column:
    """Array of (name, enabled) to a map where the first entry of a name decides."""
    fresh = F.filter(
        rules,
        lambda rule, at: F.array_position(
            F.transform(rules, lambda r: F.coalesce(r["name"], F.lit(""))),
            F.coalesce(rule["name"], F.lit("")),
        )
        == at + 1,
    )
    return F.map_from_entries(
        F.transform(
            fresh,
            lambda rule: F.struct(
                F.coalesce(rule["name"], F.lit("")).alias("key"),
                F.coalesce(rule["enabled"], F.lit(False)).alias("value"),
            ),
        )
    )


def effective_configs(configs: DataFrame) -> DataFrame:
    """One decoded configuration per (repo, revision).

    The preferred spelling hides the other one even when it is not valid; an
    invalid file then counts as no configuration.
    """
    body = F.struct("valid", "rules", "exclude_paths", "provider", "model")
    chosen = configs.groupBy("repo_full_name", "ref").agg(F.min_by(body, "priority").alias("c"))
    return chosen.where(F.col("c.valid")).select(
        "repo_full_name",
        "ref",
        _first_wins(F.coalesce(F.col("c.rules"), F.expr("array()"))).alias("rule_flags"),
        exclusion_regex(F.col("c.exclude_paths")).alias("exclude_regex"),
        F.coalesce("c.provider", F.lit("")).alias("provider"),
        F.coalesce("c.model", F.lit("")).alias("model"),
    )


def attach_config(jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """Jobs with rule_flags, exclude_regex, provider and model, null without one.

    The configuration comes from the base revision, or from the head revision
    where the base is empty.
    """
    measured_joins(jobs.sparkSession)
    lookup = effective_configs(configs).withColumnRenamed("ref", "config_sha")
    sha = F.when(F.coalesce("base_sha", F.lit("")) == "", F.col("head_sha")).otherwise(
        F.col("base_sha")
    )
    return jobs.withColumn("config_sha", sha).join(lookup, ["repo_full_name", "config_sha"], "left")


def without_excluded(files: DataFrame) -> DataFrame:
    """Drop files whose path matches a glob of their configuration."""
    hit = F.rlike("path", F.col("exclude_regex"))
    return files.where(F.col("exclude_regex").isNull() | ~hit)


def only_enabled(findings: DataFrame) -> DataFrame:
    """Keep findings whose rule is on; rules without an entry are on."""
    on = F.try_element_at("rule_flags", F.col("rule"))
    return findings.where(F.coalesce(on, F.lit(True)))


def model_choice(
    jobs: DataFrame, default_provider: str, default_model: str, known_providers: tuple[str, ...]
) -> DataFrame:
    """Provider and model per job after overrides.

    A provider override counts only when it names a known provider, in any
    letter case; a model override always counts.
    """
    wanted = F.lower(F.coalesce("provider", F.lit("")))
    provider = F.when(wanted.isin(*known_providers), wanted).otherwise(default_provider)
    model = F.coalesce(F.nullif(F.coalesce("model", F.lit("")), F.lit("")), F.lit(default_model))
    return jobs.withColumn("provider", provider).withColumn("model", model)
