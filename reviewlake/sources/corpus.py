"""Job tables derived from the test tables by fixed rules.

Nothing here is random: every derived value is a function of a source row, so
expected results can be stated over the source tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.crypto import hmac_sha256_hex
from reviewlake.session import spread
from reviewlake.sources.templates import GO_TEMPLATES

SECRET = b"corpus-secret"

EXTENSIONS = ("go", "py", "TS", "md", "yaml", "zzz")
HUNK_LINES = 10
HUNK_GAP = 5
DOCS_PER_PR = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# -- deliveries from events ---------------------------------------------------


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    k = F.col("event_id")
    owner = _text("org", F.col("user_id") % 5)
    name = _text("repo", F.col("user_id") % 20)
    payload = F.to_json(
        F.struct(
            F.element_at(
                F.array(F.lit("opened"), F.lit("synchronize"), F.lit("closed")), (k % 3 + 1).cast("int")
            ).alias("action"),
            k.alias("number"),
            F.struct(
                k.alias("number"),
                F.struct(_text("topic", k).alias("ref"), F.md5(_text("h", k)).alias("sha")).alias("head"),
                F.struct(F.lit("main").alias("ref"), F.md5(_text("b", k)).alias("sha")).alias("base"),
            ).alias("pull_request"),
            F.struct(
                F.concat(owner, F.lit("/"), name).alias("full_name"),
                F.struct(owner.alias("login")).alias("owner"),
                name.alias("name"),
            ).alias("repository"),
            F.struct(F.col("user_id").alias("id")).alias("installation"),
            F.struct(F.lit("ignored").alias("login")).alias("sender"),
        )
    )
    cut = F.when(k % 11 == 0, F.substr(payload, F.lit(1), F.length(payload) - 7)).otherwise(payload)
    signed = _text("sha256=", hmac_sha256_hex(SECRET, F.col("body")))
    return events.select(
        k.alias("delivery_id"),
        F.when(F.col("event_type") == "click", "ping")
        .when(F.col("event_type") == "error", "push")
        .otherwise("pull_request")
        .alias("event_type"),
        F.encode(cut, "UTF-8").alias("body"),
        F.col("ts").alias("received_at"),
    ).select(
        "delivery_id",
        "event_type",
        F.when(F.col("delivery_id") % 7 == 0, _text("sha256=", "0" * 64)).otherwise(signed).alias("signature"),
        "body",
        "received_at",
    )


def padded_deliveries(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The deliveries with bodies of exactly ``size`` bytes, and one byte more where the key is odd; signed anew."""
    k = F.col("delivery_id")
    filled = F.rpad(F.col("body").cast("string"), F.lit(size) + (k % 2).cast("int"), F.lit(" "))
    padded = deliveries(spark, sf_dir).withColumn("body", F.encode(filled, "UTF-8"))
    signed = _text("sha256=", hmac_sha256_hex(SECRET, F.col("body")))
    return padded.withColumn("signature", F.when(k % 7 == 0, F.col("signature")).otherwise(signed))


# -- diffs from documents -----------------------------------------------------


def _document_path() -> Column:
    d = F.col("doc_id")
    return _text("dir", d % 7, "/f", d, ".", _pick(EXTENSIONS, d % 6))


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests of four files each; one file per document.

    Line k of a document is added, removed or kept by its ordinal, with a new
    hunk after every tenth line and five untouched lines between hunks.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, d = _document_path(), F.col("doc_id")

    def added_before(k: Column) -> Column:
        return F.floor((k + 2) / 4).cast("bigint")

    def removed_before(k: Column) -> Column:
        return F.floor((k + 1) / 4).cast("bigint")

    docs = docs.select(
        "doc_id", path.alias("path"), F.filter(F.split("text", "\n", -1), lambda x: x != "").alias("lines")
    ).withColumn("n", F.size("lines"))

    def line(content: Column, index: Column) -> Column:
        k = (index + 1).cast("bigint")
        hunk = F.floor((k - 1) / HUNK_LINES).cast("bigint")
        last = F.least(k + HUNK_LINES, F.col("n") + 1)
        old = k - added_before(k) + HUNK_GAP * hunk
        new = k - removed_before(k) + HUNK_GAP * hunk
        old_count = (last - k) - (added_before(last) - added_before(k))
        new_count = (last - k) - (removed_before(last) - removed_before(k))
        header = _text("@@ -", old, ",", old_count, " +", new, ",", new_count, " @@ part\n")
        body = F.concat(
            F.when(k % 4 == 1, "+").when(k % 4 == 2, "-").otherwise(" "), F.lit("x"), content, F.lit("\n")
        )
        return F.when(k % HUNK_LINES == 1, F.concat(header, body)).otherwise(body)

    old_side = F.when(d % 9 == 0, "/dev/null").when(
        (d % 13 != 5) & (d % 17 == 3), _text("a/old/f", d)
    ).otherwise(_text("a/", F.col("path")))
    new_side = F.when((d % 9 != 0) & (d % 13 == 5), "/dev/null").otherwise(_text("b/", F.col("path")))
    mode = F.when(d % 9 == 0, "new file mode 100644\n").when(
        d % 13 == 5, "deleted file mode 100644\n"
    ).otherwise("index 11..22 100644\n")
    chunk = F.concat(
        _text("diff --git a/", F.col("path"), " b/", F.col("path"), "\n"),
        mode,
        _text("--- ", old_side, "\n+++ ", new_side, "\n"),
        F.array_join(F.transform("lines", line), ""),
    )
    files = docs.select(F.floor(d / DOCS_PER_PR).cast("bigint").alias("pr_number"), d, chunk.alias("chunk"))
    merged = files.groupBy("pr_number").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "chunk"))).alias("chunks")
    )
    return merged.select(
        _text("org/repo", F.col("pr_number") % 20).alias("repo_full_name"),
        "pr_number",
        F.array_join(F.transform("chunks", lambda c: c["chunk"]), "").alias("raw"),
    )


# -- Go pull requests from parts ----------------------------------------------


def go_path(key: Column) -> Column:
    return (
        F.when(key % 5 == 0, _text("cmd/p", key, "/main.go"))
        .when(key % 5 == 1, _text("pkg/p", key, ".go"))
        .when(key % 5 == 2, _text("pkg/p", key, "_test.go"))
        .when(key % 5 == 3, _text("internal/p", key, ".go"))
        .otherwise(_text("vendor/v/p", key, ".go"))
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    template = (F.floor(k / 5) % len(GO_TEMPLATES)).cast("int")
    body = F.element_at(F.array(*[F.lit(t.rstrip("\n")) for t in GO_TEMPLATES]), template + 1)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return parts.select(
        "*",
        _text("org", k % 5, "/mod", k % 20).alias("repo_full_name"),
        k.alias("pr_number"),
        go_path(k).alias("path"),
        F.md5(_text("h", k)).alias("head_sha"),
        F.when(k % 4 == 0, "").otherwise(F.md5(_text("b", k))).alias("base_sha"),
        F.concat(_text("// ", F.col("p_name"), " of ", F.col("p_brand"), "\n"), body).alias("content"),
    )


def go_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select(
        F.col("p_size").cast("bigint").alias("installation_id"),
        "repo_full_name",
        F.substring_index("repo_full_name", "/", 1).alias("owner"),
        F.substring_index("repo_full_name", "/", -1).alias("repo_name"),
        "pr_number",
        "head_sha",
        "base_sha",
    )


def go_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's lines, added where line + key is even and kept otherwise."""

    def line(content: Column, index: Column) -> Column:
        added = (index + 1 + F.col("pr_number")) % 2 == 0
        return F.concat(F.when(added, "+").otherwise(" "), content, F.lit("\n"))

    lines = F.split("content", "\n", -1)
    raw = F.concat(
        _text("diff --git a/", F.col("path"), " b/", F.col("path"), "\n"),
        _text("--- a/", F.col("path"), "\n+++ b/", F.col("path"), "\n"),
        _text("@@ -1,", F.size(lines), " +1,", F.size(lines), " @@\n"),
        F.array_join(F.transform(lines, line), ""),
    )
    return _parts(spark, sf_dir).select("repo_full_name", "pr_number", "head_sha", raw.alias("raw"))


def go_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File contents and module manifests at the head revisions."""
    manifest = _text("module example.org/m", F.col("pr_number"), "\n\ngo 1.", 15 + F.col("p_size") % 10, "\n")
    entries = F.array(
        F.struct(F.col("path").alias("path"), F.col("content").alias("content")),
        F.struct(F.lit("go.mod").alias("path"), manifest.alias("content")),
    )
    rows = _parts(spark, sf_dir).select(
        "repo_full_name", F.col("head_sha").alias("ref"), F.explode(entries).alias("f")
    )
    return rows.select("repo_full_name", "f.path", "ref", "f.content")


def go_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files of the part pull requests, by part size.

    size % 5: 0 none; 1 the preferred spelling; 2 only the other spelling;
    3 a broken preferred file in front of a good one; 4 both, preferred wins.
    """
    size = F.col("p_size") % 5

    def config(priority: int, valid: bool, off: str) -> Column:
        rules = F.array(
            F.struct(F.lit(off).alias("name"), F.lit(False).alias("enabled")),
            F.struct(F.lit(off).alias("name"), F.lit(True).alias("enabled")),
            F.struct(F.lit("naked-return").alias("name"), F.lit(True).alias("enabled")),
        )
        return F.struct(
            F.lit(priority).alias("priority"),
            F.lit(valid).alias("valid"),
            F.lit(1).cast("bigint").alias("version"),
            rules.alias("rules"),
            F.array(F.lit("vendor/**"), F.lit("cmd/[")).alias("exclude_paths"),
            F.when(F.col("p_size") % 2 == 0, "Alpha").when(F.col("p_size") % 3 == 0, "unheard-of").otherwise("").alias("provider"),
            F.when(F.col("p_size") % 4 == 1, "large").otherwise("").alias("model"),
        )

    entries = (
        F.when(size == 1, F.array(config(0, True, "panic-outside-main")))
        .when(size == 2, F.array(config(1, True, "os-exit-in-library")))
        .when(size == 3, F.array(config(0, False, "panic-outside-main"), config(1, True, "panic-outside-main")))
        .when(size == 4, F.array(config(1, True, "panic-outside-main"), config(0, True, "empty-error-catch")))
    )
    sha = F.when(F.col("base_sha") == "", F.col("head_sha")).otherwise(F.col("base_sha"))
    rows = _parts(spark, sf_dir).select("repo_full_name", sha.alias("ref"), F.explode(entries).alias("c"))
    return rows.select("repo_full_name", "ref", "c.*")


# -- revisions and model answers of the part pull requests ---------------------

#: Entries of a diff that neither stream may review: another language, and a file without content.
_UNREAD = ("tool/x.py", "gone/g.go")


# One sound statement, and balanced ones that are no Go, by key.
_STATEMENTS = (
    "x := a + -b", "x := := 1", "x := a + ;", "x := a * / b", "x := if a", "x = 1 2", "f(a, , b)", "x, y = *p, <-c",
    "return a.;", "a && || b", "defer go f()", "s[1 / ]", "var v = x.(T).f[1:]",
)


def odd_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library file for every part, with one statement of its key's kind ahead of a panic."""
    k = F.col("p_partkey")
    chosen = F.get(F.array(*[F.lit(x) for x in _STATEMENTS]), (k % len(_STATEMENTS)).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.lit("org/odd").alias("repo_full_name"),
        k.alias("pr_number"),
        F.lit(0).alias("file_idx"),
        _text("p", k, ".go").alias("path"),
        F.concat(F.lit("package p\n\nfunc f() {\n\t"), chosen, F.lit("\n\tpanic(1)\n}\n")).alias("content"),
        F.lit("").alias("go_version"),
    )


def second_revision(df: DataFrame, column: str) -> DataFrame:
    """The rows as they look after the pull requests were updated: another head, the same files."""
    return df.withColumn(column, F.md5(_text("again", F.col(column))))


def wider_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part diffs with two more entries each, and the own file a second time where key % 3 = 0."""

    def entry(path: str) -> str:
        return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,0 +1,1 @@\n+x\n"

    twice = F.when(F.col("pr_number") % 3 == 0, F.col("raw")).otherwise("")
    raw = F.concat("raw", F.lit("".join(map(entry, _UNREAD))), twice)
    return go_diffs(spark, sf_dir).withColumn("raw", raw)


def part_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored finding for every tenth part, so that only some repositories have any."""
    k = F.col("pr_number")
    rows = _parts(spark, sf_dir).where(k % 10 == 0)
    return rows.select(
        F.md5(_text("f", k)).alias("id"),
        F.substring_index("repo_full_name", "/", -1).alias("repo"),
        F.col("path").alias("file_path"),
        F.lit("llm-logic").alias("rule"),
        _text("finding ", k).alias("message"),
        F.array(k % 7 + 1, F.lit(1)).cast("array<float>").alias("embedding"),
        "pr_number",
        F.timestamp_seconds(k).alias("created_at"),
    )


def go_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving model finding for the own file and for each file that must not be reviewed."""
    item = '{"category": "logic", "line": 1, "message": "m", "confidence": 0.9, "decision": "summary"}'
    answers = F.array(*(
        F.struct(F.lit(stage).alias("stage"), F.lit(1).alias("attempt"), F.lit(f'{{"{name}": [{item}]}}').alias("content"))
        for stage, name in (("detector", "candidates"), ("suggester", "items"), ("reviewer", "items"))
    ))
    paths = F.explode(F.array(F.col("path"), *map(F.lit, _UNREAD))).alias("path")
    rows = _parts(spark, sf_dir).select("repo_full_name", "pr_number", "head_sha", paths)
    rows = rows.select("*", F.explode(answers).alias("a"))
    return rows.select("repo_full_name", "pr_number", "head_sha", "path", "a.*", F.lit(None).cast("string").alias("error"))


# -- model responses from orders ----------------------------------------------


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's file, in a fixed order within the file."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pr_number"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_discount",
        "l_returnflag",
    )
    return items.select(*_order_file(F.col("pr_number")), "*")


def _order_file(key: Column) -> list[Column]:
    return [
        _text("org/shop", key % 7).alias("repo_full_name"),
        _text("orders/o", key, ".go").alias("path"),
    ]


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all stages for every order that has line items.

    key % 5: 0 the first reviewer attempt is broken; 1 all three are broken;
    2 the detector call fails; else all is well, except that key % 35 = 3 has a
    failing reviewer call after a broken attempt. key % 3: the answer is bare,
    fenced, or inside other text.
    """
    fields = {
        "category": F.lower("l_returnflag"),
        "line": F.col("line"),
        "message": _text("[", F.lower("l_returnflag"), "] item ", F.col("l_partkey")),
        "explanation": _text("supplier ", F.col("l_suppkey")),
        "suggested_fix": F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(_text("fix(", F.col("l_partkey"), ")")),
        "confidence": F.col("l_discount") * 10,
        "decision": F.when(F.col("line") % 3 == 0, "drop").when(F.col("line") % 3 == 1, "inline").otherwise("summary"),
    }
    plain, fix = ("category", "line", "message"), ("explanation", "suggested_fix")
    shapes = {"found": plain, "fixed": (*plain, *fix), "scored": (*plain, *fix, "confidence", "decision")}

    # Every item is written as JSON by itself, ahead of the grouping: an item of an array would be worked out by interpretation.
    item = F.struct(
        "line", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", F.lower("l_returnflag").alias("category"),
        *[F.to_json(F.struct(*[fields[n].alias(n) for n in names])).alias(shape) for shape, names in shapes.items()],
    )
    files = (
        spread(order_items(spark, sf_dir), "pr_number")
        .groupBy("repo_full_name", "pr_number", "path")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    key = F.col("pr_number")

    def wrapped(name: str, shape: str) -> Column:
        json = F.concat(F.lit(f'{{"{name}":['), F.array_join(F.col("items")[shape], ","), F.lit("]}"))
        return (
            F.when(key % 3 == 0, json)
            .when(key % 3 == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```\n")))
            .otherwise(F.concat(F.lit("Here it is: "), json, F.lit(" - done")))
        )

    def answer(stage: str, attempt: int, content: Column, error: Column | None = None) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"),
            F.lit(attempt).alias("attempt"),
            content.alias("content"),
            (F.lit(None) if error is None else error).cast("string").alias("error"),
        )

    broken = F.lit('{"items": [{"line": "x"')
    review = wrapped("items", "scored")
    call_failed = key % 35 == 3
    answers = F.array(
        answer("detector", 1, F.when(key % 5 != 2, wrapped("candidates", "found")), F.when(key % 5 == 2, "timeout")),
        answer("suggester", 1, wrapped("items", "fixed")),
        answer("reviewer", 1, F.when((key % 5 < 2) | call_failed, broken).otherwise(review)),
        answer(
            "reviewer",
            2,
            F.when(key % 5 == 1, broken).when(~call_failed, review),
            F.when(call_failed, "timeout"),
        ),
        answer("reviewer", 3, F.when(key % 5 == 1, broken).otherwise(review)),
    )
    rows = files.select("repo_full_name", "pr_number", "path", F.explode(answers).alias("a"))
    return rows.select("repo_full_name", "pr_number", "path", "a.*")


def odd_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first answer for every order, right or wrong in a way that its key decides."""
    k = F.col("o_orderkey").cast("string")
    shapes = F.array(
        F.concat(F.lit('{"candidates":[{"category":"c","line":'), k, F.lit(',"message":"m"}]}')),
        F.concat(F.lit('{"candidates":[{"line":1,"message":'), k, F.lit("}]}")),
        F.concat(F.lit('{"Candidates":[{"LINE":'), k, F.lit('},{"line":2,"Message":"m"}]}')),
        F.lit('{"candidates":[]}],"end":"","_end":"end of the one value"} ,"x":[{}'),
        F.concat(F.lit('{"candidates":[{"line":'), k, F.lit(".5}]}")),
        F.concat(F.lit('{"candidates":[{"line":"'), k, F.lit('"}]}')),
        F.concat(F.lit('{"candidates":[{"line":1,"line":'), k, F.lit("}]}")),
        F.lit('{"candidates":null,"further":{"a":[1]}}'),
    )
    return table(spark, sf_dir, "orders").select(
        F.lit("org/orders").alias("repo_full_name"),
        F.col("o_orderkey").alias("pr_number"),
        F.lit("o.go").alias("path"),
        F.lit("detector").alias("stage"),
        F.lit(1).alias("attempt"),
        F.get(shapes, (F.col("o_orderkey") % 8).cast("int")).alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff positions of the even line numbers of every order's file."""
    lines = order_items(spark, sf_dir).where(F.col("line") % 2 == 0)
    return lines.select(
        "repo_full_name", "pr_number", "path", "line", (F.col("line") + 1).alias("diff_pos")
    ).distinct()


# -- history from embeddings --------------------------------------------------


def finding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past findings, one per vector, stored one second apart in id order."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.lpad(v.cast("string"), 9, "0").alias("id"),
        _text("repo", F.col("label")).alias("repo"),
        _text("pkg/f", v % 11, ".go").alias("file_path"),
        _text("llm-kind", v % 3).alias("rule"),
        _text("finding ", v).alias("message"),
        "embedding",
        v.alias("pr_number"),
        F.timestamp_seconds(F.lit(1700000000) + v).alias("created_at"),
    )


# -- paths from pages ---------------------------------------------------------


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths as file paths of one repository with a list of exclusions."""
    path = F.regexp_extract("url", r"^\w+://[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        F.lit("org/site").alias("repo_full_name"),
        F.col("page_id").alias("pr_number"),
        path.alias("path"),
    )
