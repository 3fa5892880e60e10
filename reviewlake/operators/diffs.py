"""Unified diffs as tables: files, lines, changed lines and line positions.

A diff is cut into one chunk per file and one row per line; everything that
depends on earlier lines is a running window over one file's lines. The raw
text is shuffled once by pull request and revision, before it is exploded, and
every window and aggregate below reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.languages import language
from reviewlake.functions.text import leading_int
from reviewlake.session import spread

PR_KEYS = ("repo_full_name", "pr_number")
REVISION = "head_sha"


def revision_keys(df: DataFrame) -> list[str]:
    """What names one diff: the pull request, and its head revision where the table has it."""
    return [*PR_KEYS, REVISION] if REVISION in df.columns else list(PR_KEYS)


_FILE_HEADER = "diff --git "

#: Characters of diffs in one task, where their size is read first: some 13 bytes of its memory each.
TASK_CHARS = 16 << 20


def split_oversized(diffs: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Diffs within the size limit, and the others for quarantine."""
    size = F.octet_length("raw")
    return diffs.where(size <= max_bytes), diffs.where(size > max_bytes)


def _file_chunks(diffs: DataFrame, keys: Sequence[str], stored: bool) -> DataFrame:
    """One row per file entry: keys, file_idx, chunk; text before the first is dropped."""
    size = F.length("raw") if stored else None
    preamble = F.when(F.col("raw").startswith(_FILE_HEADER), 0).otherwise(1)
    chunks = (
        spread(diffs.select(*keys, "raw"), *keys, by=size, most=TASK_CHARS)
        .select(
            *keys,
            preamble.alias("__skip"),
            F.posexplode(F.split("raw", r"(?md)^(?=diff --git )", -1)).alias("__pos", "__chunk"),
        )
        .where(F.col("__chunk").startswith(_FILE_HEADER))
    )
    return chunks.select(
        *keys, (F.col("__pos") - F.col("__skip")).alias("file_idx"), F.col("__chunk").alias("chunk")
    )


def diff_rows(diffs: DataFrame, keys: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """One row per diff line: keys, file_idx, n, text, kind.

    ``stored`` says that the diffs are a table whose size can be read first, here and
    in the functions below: tasks are then cut by it.
    """
    keys = keys or revision_keys(diffs)
    lines = F.posexplode(F.split("chunk", "\n", -1)).alias("n", "text")
    rows = _file_chunks(diffs, keys, stored).select(*keys, "file_idx", lines)
    return rows.withColumn("kind", _line_kind(F.col("n"), F.col("text")))


def _header_rows(diffs: DataFrame, keys: Sequence[str], stored: bool) -> DataFrame:
    """The rows of ``diff_rows`` that name files; no other line is exploded."""
    headers = r"(?md)^(?:diff --git |---|\+\+\+|new file mode).*$"
    found = F.posexplode(F.regexp_extract_all("chunk", F.lit(headers), F.lit(0))).alias("n", "text")
    rows = _file_chunks(diffs, keys, stored).select(*keys, "file_idx", found)
    return rows.withColumn("kind", _line_kind(F.col("n"), F.col("text")))


def _line_kind(n: Column, text: Column) -> Column:
    return (
        F.when(n == 0, "file")
        .when(text.startswith("---"), "old")
        .when(text.startswith("+++"), "new")
        .when(text.startswith("new file mode"), "created")
        .when(text.startswith("@@ "), "hunk")
        .when(text == "\\ No newline at end of file", "marker")
        .otherwise("body")
    )


def _in_file_order(keys: Sequence[str]):
    return Window.partitionBy(*keys, "file_idx").orderBy("n")


def _hunk_ranges(text: Column) -> Column:
    """Start and count of both sides of a hunk header; zeros if malformed."""
    spans = F.split(
        F.regexp_replace(
            F.substring_index(F.substr(text, F.lit(4)), " @@", 1), r"(?U)^\s++|\s++$", ""
        ),
        r"(?U)\s++",
    )
    both = F.size(spans) == 2

    def side(index: int) -> tuple[Column, Column]:
        span = F.substr(F.get(spans, F.lit(index)), F.lit(2))
        comma = F.instr(span, ",")
        start = leading_int(F.substring_index(span, ",", 1))
        count = F.when(comma > 0, leading_int(F.regexp_replace(span, r"^[^,]*+,", ""))).otherwise(1)
        zero = F.lit(0).cast("bigint")
        return F.when(both, start).otherwise(zero), F.when(both, count).otherwise(zero)

    (old_start, old_lines), (new_start, new_lines) = side(0), side(1)
    return F.struct(
        old_start.alias("old_start"),
        old_lines.alias("old_lines"),
        new_start.alias("new_start"),
        new_lines.alias("new_lines"),
    )


def diff_lines(diffs: DataFrame, keys: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """Body lines with type, content, line numbers of both sides and position."""
    keys = keys or revision_keys(diffs)
    order = _in_file_order(keys)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    is_hunk = F.col("kind") == "hunk"
    first = F.substring("text", 1, 1)
    rows = diff_rows(diffs, keys, stored).where(F.col("kind").isin("hunk", "body"))
    rows = rows.withColumn("hunk_idx", F.count_if(is_hunk).over(so_far) - 1).where(
        (F.col("hunk_idx") >= 0) & (F.col("text") != "")
    )
    rows = rows.withColumn(
        "line_type",
        F.when(is_hunk, None)
        .when(first == "+", "added")
        .when(first == "-", "removed")
        .otherwise("context"),
    )
    on_old = F.col("line_type").isin("removed", "context")
    on_new = F.col("line_type").isin("added", "context")
    rows = rows.select(
        "*",
        F.row_number().over(order).cast("bigint").alias("diff_pos"),
        F.coalesce(F.count_if(on_old).over(before), F.lit(0)).alias("__old"),
        F.coalesce(F.count_if(on_new).over(before), F.lit(0)).alias("__new"),
    )
    header = F.when(
        is_hunk, F.struct(_hunk_ranges(F.col("text")).alias("range"), "__old", "__new")
    )
    rows = rows.withColumn("__hunk", F.last(header, ignorenulls=True).over(so_far)).where(~is_hunk)
    old_line = F.col("__hunk.range.old_start") + F.col("__old") - F.col("__hunk.__old")
    new_line = F.col("__hunk.range.new_start") + F.col("__new") - F.col("__hunk.__new")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        *keys,
        "file_idx",
        "n",
        F.col("hunk_idx").cast("int").alias("hunk_idx"),
        F.col("__hunk.range.old_start").alias("old_start"),
        F.col("__hunk.range.old_lines").alias("old_lines"),
        F.col("__hunk.range.new_start").alias("new_start"),
        F.col("__hunk.range.new_lines").alias("new_lines"),
        "line_type",
        F.expr("substring(text, 2)").alias("content"),
        F.when(on_old, old_line).otherwise(zero).alias("old_line"),
        F.when(on_new, new_line).otherwise(zero).alias("new_line"),
        "diff_pos",
    )


def diff_files(diffs: DataFrame, keys: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """One row per file entry: paths, language, new and deleted flags."""
    keys = keys or revision_keys(diffs)
    so_far = _in_file_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = F.regexp_replace("text", r"^(?:---|\+\+\+) ", "")
    exists = target != "/dev/null"
    rows = _header_rows(diffs, keys, stored).select(
        *keys,
        "file_idx",
        "n",
        "kind",
        F.when((F.col("kind") == "old") & exists, F.regexp_replace(target, "^a/", "")).alias("__old"),
        F.when((F.col("kind") == "new") & exists, F.regexp_replace(target, "^b/", "")).alias("__new"),
        ((F.col("kind") == "new") & ~exists).alias("__gone"),
    )
    # A deletion marker takes over the old path known by then, the first time
    # one is known; a real new path wins wherever it stands.
    rows = rows.withColumn("__old_now", F.last("__old", ignorenulls=True).over(so_far))
    taken = F.when(F.col("__gone") & (F.col("__old_now") != ""), F.col("__old_now"))
    files = rows.groupBy(*keys, "file_idx").agg(
        F.max_by("__new", F.when(F.col("__new").isNotNull(), F.col("n"))).alias("__path"),
        F.min_by(taken, F.when(taken.isNotNull(), F.col("n"))).alias("__taken"),
        F.max_by("__old", F.when(F.col("__old").isNotNull(), F.col("n"))).alias("__old"),
        F.bool_or(F.col("kind") == "created").alias("is_new"),
        F.bool_or("__gone").alias("is_delete"),
    )
    none = F.lit("")
    return files.select(
        *keys,
        "file_idx",
        F.coalesce(F.when(F.col("__path") != "", F.col("__path")), F.col("__taken"), none).alias("path"),
        F.coalesce("__old", none).alias("old_path"),
        F.coalesce(language(F.col("__path")), none).alias("language"),
        "is_new",
        "is_delete",
    )


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line_type") == "added")


def changed_lines(lines: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The set of new-file line numbers a diff adds."""
    keys = keys or revision_keys(lines)
    return (
        added_lines(lines)
        .where(F.col("new_line") > 0)
        .select(*keys, "file_idx", F.col("new_line").alias("line"))
        .distinct()
    )


def line_positions(lines: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Position of every new-file line; the last occurrence decides."""
    keys = keys or revision_keys(lines)
    return (
        lines.where(F.col("new_line") > 0)
        .groupBy(*keys, "file_idx", F.col("new_line").alias("line"))
        .agg(F.max("diff_pos").alias("diff_pos"))
    )


def line_info(lines: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Position and changed flag per new-file line, in one aggregate."""
    keys = keys or revision_keys(lines)
    return (
        lines.where(F.col("new_line") > 0)
        .groupBy(*keys, "file_idx", F.col("new_line").alias("line"))
        .agg(
            F.max("diff_pos").alias("diff_pos"),
            F.bool_or(F.col("line_type") == "added").alias("changed"),
        )
    )


def diff_summary(diffs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Hunks and added lines per file, counting files without any."""
    keys = keys or revision_keys(diffs)
    order = _in_file_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_hunk = F.col("kind") == "hunk"
    rows = diff_rows(diffs, keys).where(F.col("kind").isin("file", "hunk", "body"))
    rows = rows.withColumn("__hunks", F.count_if(is_hunk).over(order))
    added = (F.col("kind") == "body") & (F.col("__hunks") > 0) & F.col("text").startswith("+")
    return rows.groupBy(*keys, "file_idx").agg(
        F.count_if(is_hunk).alias("hunks"), F.count_if(added).alias("added")
    )
