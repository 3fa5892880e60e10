"""Mixing sources to target weights: temperature on token shares, then budgeted block permutations.

A source with share p of all tokens gets weight p**a / sum(p**a). The exponent a is
bisected so that the weights reach a target entropy, or as far towards equal weights
as a limit on repeating any source allows. The weights are then realised: every
source is passed through as often as its budget of tokens asks, each pass a new
permutation of blocks of documents, the last one cut where the budget is met.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import fresh, if_small, released, written

#: Share of the entropy of equal weights that the mix reaches, and passes over a source at most.
TARGET_ENTROPY, MAX_REPEATS = 0.98, 4.0
#: Tokens of a block, about.
BLOCK_TOKENS = 1 << 20
#: Exponents tried at once in a round of the search, and rounds.
TRIES, ROUNDS = 8, 10


@dataclass(frozen=True)
class Mix:
    """The exponent found, and what it gives: entropy over that of equal weights, passes over the most repeated source."""

    exponent: float
    entropy: float
    repeats: float


def tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def evaluate(shares: DataFrame, exponents: list[float], budget_ratio: float) -> list[Mix]:
    """What some exponents give, all in one aggregate over the sources (``share``, positive)."""
    p = F.col("share")
    columns = [F.count("*").alias("n")]
    for i, a in enumerate(exponents):
        w = F.pow(p, F.lit(a))
        columns += [F.sum(w).alias(f"s{i}"), F.sum(w * F.log(w)).alias(f"e{i}"), F.max(w / p).alias(f"r{i}")]
    row = shares.agg(*columns).first()
    out = []
    for i, a in enumerate(exponents):
        total = row[f"s{i}"]
        entropy = log(total) - row[f"e{i}"] / total
        out.append(Mix(a, entropy / log(row.n) if row.n > 1 else 1.0, budget_ratio * row[f"r{i}"] / total))
    return out


def temper(shares: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float = 1.0) -> Mix:
    """The largest exponent in [0, 1] that reaches the target entropy, or the smallest that
    keeps the repeats if that one would not.

    Entropy falls and repeats fall as the exponent grows, so both are found by
    cutting an interval: every round tries evenly spaced exponents in one Spark job
    and keeps the part where the answer changes. The driver sees only sums.
    """
    low, high, tried, last = 0.0, 1.0, [], 0
    for _ in range(ROUNDS):
        step = (high - low) / TRIES
        tried = evaluate(shares, [low + step * i for i in range(TRIES + 1)], budget_ratio)
        good = [m.entropy >= target_entropy or m.repeats > max_repeats for m in tried]
        last = max((i for i, g in enumerate(good) if g), default=-1)
        if last == TRIES:
            return tried[-1]
        if last < 0:
            return tried[0]
        low, high = tried[last].exponent, tried[last + 1].exponent
    return tried[last] if tried[last].repeats <= max_repeats else tried[last + 1]


def draw(seed: int, *columns: str | Column) -> Column:
    """A uniform 60-bit number from the columns, the same in every run and engine."""
    text = F.concat_ws("/", F.lit(str(seed)), *columns)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def plan_budgets(totals: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float, block_tokens: int) -> tuple[DataFrame, Mix | None]:
    """Token budget and number of blocks of every source (``s, total``), and the mix they come from."""
    every = totals.agg(F.sum("total")).first()[0]
    shares = totals.withColumn("share", F.col("total") / F.lit(float(every or 1)))
    mix = temper(shares, target_entropy, max_repeats, budget_ratio) if every else None
    weight = F.pow("share", F.lit(mix.exponent if mix else 1.0))
    whole = shares.agg(F.sum(weight)).first()[0] or 1.0
    plan = shares.select(
        "s",
        "total",
        F.round(F.lit(float(every or 0) * budget_ratio / whole) * weight).cast("bigint").alias("budget"),
        F.ceil(F.col("total") / block_tokens).cast("bigint").alias("blocks"),
    )
    return plan, mix


def before(*group: str, order: str) -> Column:
    """Tokens of the group's rows earlier in the order."""
    window = Window.partitionBy(*group).orderBy(order, "k").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("t").over(window), F.lit(0))


def mixed(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget_ratio: float = 1.0,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
) -> DataFrame:
    """The documents of the mix: all columns, then ``pass``, ``block`` and ``place``.

    The mix has ``budget_ratio`` times the tokens of the table, shared by the
    tempered weights. A source's documents are dealt to blocks of about
    ``block_tokens`` by hash, so a source of a third of all rows is many blocks.
    Every pass over a source has its own order of blocks (``block``, from 1) and of
    documents in a block (ascending ``place``). Whole passes take every document;
    the last one takes blocks in order until the budget is met, and of the block
    where that happens the documents that begin before it is: a source misses its
    budget by less than one document.

    A null source is a source of its own. Documents without tokens cost nothing and
    come once, in pass 0, block 0. Rows that repeat an id and a text are taken
    together. Empty tables give no rows. A new column whose name is taken gets ``_``.
    """
    names = [fresh(documents, c) for c in ("pass", "block", "place")]
    inner = {c: fresh(documents, f"mix_{c}") for c in ("s", "k")}
    source, text, key = documents[source_col].cast("string"), documents[text_col].cast("string"), documents[id_col].cast("string")
    rows = documents.withColumns({
        inner["s"]: F.coalesce(F.concat(F.lit("="), source), F.lit("none")),
        inner["k"]: F.concat_ws("/", F.coalesce(key, F.lit("")), F.xxhash64(text).cast("string")),
    })
    sized = rows.select(*(F.col(n).alias(c) for c, n in inner.items()), tokens(text).alias("t"))
    sized = written(sized.groupBy("s", "k").agg(F.sum("t").alias("t")).where("t > 0"), "mix-rows")
    totals = written(sized.groupBy("s").agg(F.sum("t").alias("total")), "mix-sources")
    plan, _ = plan_budgets(totals, target_entropy, max_repeats, budget_ratio, block_tokens)
    plan = written(plan, "mix-plan")

    def block_of(k: str) -> Column:
        return F.pmod(draw(seed, k), F.col("blocks"))

    dealt = sized.join(if_small(plan), "s").withColumn("b", block_of("k"))
    full = F.floor(F.col("budget") / F.col("total"))
    sums = dealt.groupBy("s", "b").agg(F.sum("t").alias("t"), F.first("budget").alias("budget"), F.first("total").alias("total"))
    passes = sums.select("s", "b", "t", F.col("b").alias("k"), full.alias("full"), (F.col("budget") - full * F.col("total")).alias("rest"), F.explode(F.sequence(F.lit(0), full)).alias("p"))
    ordered = passes.withColumn("turn", draw(seed, "p", "s", "b"))
    ordered = ordered.withColumns({
        "rank": F.row_number().over(Window.partitionBy("s", "p").orderBy("turn", "k")).cast("bigint"),
        "left": F.when(F.col("p") == F.col("full"), F.col("rest") - before("s", "p", order="turn")).otherwise(F.col("t")),
    }).where(F.col("left") > 0)
    ordered = written(ordered.select("s", "b", "p", "rank", "left", (F.col("left") < F.col("t")).alias("cut")), "mix-blocks")

    cut = ordered.where("cut").select("s", "b", "p", "left")
    inside = dealt.join(if_small(cut), ["s", "b"]).withColumn("turn", draw(seed, "p", "k"))
    inside = inside.withColumn("earlier", before("s", "b", order="turn")).where("earlier < left")
    chosen = written(inside.select(F.col("s").alias("cs"), F.col("k").alias("ck"), F.col("p").alias("cp")), "mix-cut")

    released(documents.sparkSession)
    tags = {c: fresh(rows, f"mix_{c}") for c in ("ps", "blocks", "os", "ob", "op", "rank", "cut", "cs", "ck", "cp")}

    def tagged(frame: DataFrame, **columns: str) -> DataFrame:
        return if_small(frame.select(*(F.col(old).alias(tags[new]) for new, old in columns.items())))

    same = F.col(inner["s"])
    spent = text.isNotNull() & text.rlike(r"\S")
    taken = (
        rows.join(tagged(plan, ps="s", blocks="blocks"), same == F.col(tags["ps"]), "left")
        .join(
            tagged(ordered, os="s", ob="b", op="p", rank="rank", cut="cut"),
            spent & (same == F.col(tags["os"])) & (F.pmod(draw(seed, inner["k"]), F.col(tags["blocks"])) == F.col(tags["ob"])),
            "left",
        )
        .join(
            tagged(chosen, cs="cs", ck="ck", cp="cp"),
            (same == F.col(tags["cs"])) & (F.col(inner["k"]) == F.col(tags["ck"])) & (F.col(tags["op"]) == F.col(tags["cp"])),
            "left",
        )
        .where(~F.coalesce(spent, F.lit(False)) | (F.col(tags["op"]).isNotNull() & (~F.col(tags["cut"]) | F.col(tags["ck"]).isNotNull())))
    )
    zero = F.lit(0).cast("bigint")
    new = (F.coalesce(tags["op"], zero), F.coalesce(tags["rank"], zero), F.when(F.col(tags["op"]).isNotNull(), draw(seed, tags["op"], inner["k"])).otherwise(zero))
    return taken.select(*documents.columns, *(c.alias(n) for c, n in zip(new, names)))
