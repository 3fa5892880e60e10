r"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together in another order.

A text is matched as a whole by ``(unit)*``. The regex library keeps every
repetition of a captured group, so ``match.ends(1)`` is the list of all unit ends:
its length is the number of units, and the two cut offsets are entries of it.
Only that number and the two offsets leave Python; draws, assembly and restoring
are column expressions.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, fresh

# The marks of the parts, the shares in percent and the seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SPM_PERCENT, SEED = 90, 20, "1"
#: One code point, line breaks too.
CODE_POINT = "(?s:.)"
#: Code points in one match: its captures take some 60 bytes each.
STRETCH = 1 << 18


def unit_ends(pattern: regex.Pattern, text: str, stretch: int = STRETCH) -> list[list[int]] | None:
    """Ends of all units, as one list a stretch of the text; None if the units do not cover it.

    A text of up to a stretch is one match. A longer one is matched stretch by
    stretch: a stretch goes on where the last whole unit but one of the stretch
    before it ended, because its last unit may go on behind the stretch.
    """
    if len(text) <= stretch:
        match = pattern.fullmatch(text)
        return None if match is None else [match.ends(1)]
    found, at, width = [], 0, stretch
    while at < len(text):
        end = min(len(text), at + width)
        match = pattern.match(text, at, end)
        ends = match.ends(1) if match else []
        if end < len(text):
            if len(ends) < 2:  # a unit longer than the stretch, or none that fits
                width *= 2
                continue
            ends.pop()
        elif not ends or ends[-1] != len(text):
            return None
        found.append(ends)
        at, width = ends[-1], stretch
    return found


def cuts(pattern: regex.Pattern, text: str, h1: int, h2: int) -> tuple[int | None, int | None, int | None]:
    """Number of units, and the code points before the first and before the second cut."""
    ends = unit_ends(pattern, text)
    if ends is None:
        return None, None, None
    n = sum(map(len, ends))

    def offset(units: int) -> int:
        if not units:
            return 0
        for part in ends:
            if units <= len(part):
                return part[units - 1]
            units -= len(part)
        raise AssertionError("more units than the text has")

    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, offset(first), offset(second)


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """The four numbers drawn for a row: the leading digits of a digest of seed and id (a null id is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    name: str = "fim",
    unit: str = CODE_POINT,
    seed: str = SEED,
    cut_percent: int = CUT_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The documents with a struct column ``name``: ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``n`` is the number of units of the whole text; ``unit`` is a regex without
    capturing groups. Form ``psm`` is prefix, suffix, middle, each behind its mark;
    ``spm`` suffix, prefix, middle; ``plain`` the text as it is, without part
    lengths: empty texts, texts that hold a mark, and the drawn rest. A text that its
    units do not cover is plain, with a null ``n``.

    A null text is empty. Rows are independent: repeated rows get equal results, rows
    of equal id the same draws, a null id draws like an empty one; empty tables give
    no rows; other columns pass through whatever their names, but a column called
    ``name`` itself is replaced. Texts of any length are cut whole, in memory of some
    60 bytes a code point of one stretch and 40 bytes a unit of one text.
    """
    bounded_batches(documents.sparkSession)
    pattern = regex.compile(f"({unit})*")

    @pandas_udf("n bigint, first bigint, second bigint")
    def cut(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        found = [cuts(pattern, t, a, b) for t, a, b in zip(texts, h1.tolist(), h2.tolist())]
        return pd.DataFrame(found, columns=["n", "first", "second"], index=texts.index, dtype="Int64")

    text_name, draw_name, cut_name = (fresh(documents, x) for x in ("whole", "draws", "cut"))
    text, draw, at = F.col(text_name), F.col(draw_name), F.col(cut_name)
    frame = documents.withColumn(text_name, F.coalesce(documents[text_col].cast("string"), F.lit("")))
    frame = frame.withColumn(draw_name, F.array(*draws(documents[id_col], seed)))
    frame = frame.withColumn(cut_name, cut(text, draw[0], draw[1]))

    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (draw[2] % 100 >= cut_percent) | at["n"].isNull()
    form = F.when(plain, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    first, second = at["first"].cast("int"), at["second"].cast("int")
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    output = (
        F.when(form == "plain", text)
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    result = F.struct(
        at["n"].alias("n"),
        form.alias("form"),
        F.when(~plain, at["first"]).alias("prefix_chars"),
        F.when(~plain, at["second"] - at["first"]).alias("middle_chars"),
        output.alias("output"),
    )
    return frame.withColumn(name, result).drop(text_name, draw_name, cut_name)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from.

    A text that holds a mark is plain, and no mark begins inside another, so the
    three marks of a cut output are the only ones in it.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    )
