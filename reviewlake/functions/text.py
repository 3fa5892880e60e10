"""Column expressions for strings, versions, severities and comment bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white space characters that trimming removes.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Severity names by ordinal.
SEVERITIES = ("info", "warning", "error")

# Confidence thresholds of the two upper severities.
ERROR_CONFIDENCE = 0.85
WARNING_CONFIDENCE = 0.7


def trim_space(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def leading_int(value: Column) -> Column:
    """Digits at the start of ``value`` as a number, 0 when there are none."""
    digits = F.regexp_extract(value, r"^\d*", 0)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def severity_name(ordinal: Column) -> Column:
    named = F.lit("unknown")
    for number, name in enumerate(SEVERITIES):
        named = F.when(ordinal == number, name).otherwise(named)
    return named


def severity_ordinal(name: Column) -> Column:
    number = F.lit(None).cast("int")
    for ordinal, label in enumerate(SEVERITIES):
        number = F.when(name == label, ordinal).otherwise(number)
    return number


def severity_from_confidence(confidence: Column) -> Column:
    return (
        F.when(confidence >= ERROR_CONFIDENCE, "error")
        .when(confidence >= WARNING_CONFIDENCE, "warning")
        .otherwise("info")
    )


def go_version(manifest: Column) -> Column:
    """Version named by the first ``go`` directive of a module manifest, or ''."""
    directive = r"(?mdU)^[^\S\n]*+go [^\S\n]*+(\S++)"
    return F.regexp_extract(F.coalesce(manifest, F.lit("")), directive, 1)


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Compare ``major.minor``; fewer than two parts never satisfies."""
    parts = F.split(F.regexp_replace(version, r"\.$", ""), r"\.")
    have_major = leading_int(F.get(parts, F.lit(0)))
    have_minor = leading_int(F.get(parts, F.lit(1)))
    newer = F.when(have_major != major, have_major > major).otherwise(have_minor >= minor)
    return F.coalesce((F.size(parts) >= 2) & newer, F.lit(False))


def strip_tag(message: Column) -> Column:
    """Drop a leading ``[tag]`` and trim; untagged messages stay as they are."""
    tag = r"^\[[^\]]*+\]"
    return F.when(message.rlike(tag), trim_space(F.regexp_replace(message, tag, ""))).otherwise(
        message
    )


def model_comment_body(message: Column, confidence: Column, fix: Column) -> Column:
    percent = (confidence * 100).cast("bigint").cast("string")
    body = F.concat(strip_tag(message), F.lit("\n\n*Confidence: "), percent, F.lit("%*"))
    block = F.concat(F.lit("\n\n**Suggested Fix:**\n```go\n"), fix, F.lit("\n```"))
    return F.when(fix != "", F.concat(body, block)).otherwise(body)


def file_level_note(path: Column, line: Column, body: Column) -> Column:
    return F.concat(F.lit("`"), path, F.lit("` line "), line.cast("string"), F.lit(": "), body)


def embedding_text(rule: Column, message: Column, fix: Column) -> Column:
    return F.concat(F.lit("["), rule, F.lit("] "), message, F.lit(". Fix: "), fix)


#: Longer than any text.
_WHOLE = (1 << 31) - 1


def with_isolated_json(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: the JSON object inside a raw model answer.

    A code fence is removed only when the answer starts with one; then the
    text from the first ``{`` to the last ``}`` is kept. Staged columns keep
    each step evaluated once per row. The end of a text is trimmed only where it has
    no such braces: that reads the whole text character by character.
    """
    text, mark = "__text", "```"
    df = df.withColumn(text, F.ltrim(F.coalesce(F.col(source), F.lit("")), F.lit(WHITE_SPACE)))
    opened = F.when(F.col(text).startswith(mark + "json"), F.substring(text, 8, _WHOLE)).otherwise(F.substring(text, 4, _WHOLE))
    df = df.withColumn("__opened", F.when(F.col(text).startswith(mark), opened))
    fenced = F.coalesce(F.col("__opened").contains(mark), F.lit(False))
    df = df.withColumn(text, F.when(fenced, F.substring_index("__opened", mark, 1)).otherwise(F.col(text)))
    df = df.withColumn("__object", F.regexp_extract(text, r"^[^{]*+(\{(?s:.*)\})", 1))
    found = F.when(F.col("__object") != "", F.col("__object")).otherwise(trim_space(F.col(text)))
    return df.withColumn(target, found).drop(text, "__opened", "__object")
