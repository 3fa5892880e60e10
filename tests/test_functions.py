import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import jsonio
from reviewlake.functions import text as tx
from reviewlake.functions.crypto import hmac_sha256_hex
from reviewlake.functions.globs import any_glob_regex, glob_to_regex
from reviewlake.functions.jsonio import decode_envelope, envelope_ok, repeated_keys
from reviewlake.functions.languages import extension, language
from reviewlake.schemas import DETECTOR_PAYLOAD, REVIEWER_PAYLOAD


def values(spark, inputs, make, schema="i int, x string"):
    df = spark.createDataFrame(list(enumerate(inputs)), schema)
    rows = df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def isolated(answer):
    """The rule in a few lines: a fence only in front, then the outermost braces."""
    answer = answer.strip()
    if answer.startswith("```"):
        rest = answer[3:].removeprefix("json")
        if "```" in rest:
            answer = rest[: rest.index("```")].strip()
    first, last = answer.find("{"), answer.rfind("}")
    return answer[first : last + 1] if 0 <= first < last else answer


def glued(parts, n, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(parts, k=draw.randint(0, longest))) for _ in range(n)]


def test_isolated_json_follows_its_rule(spark):
    parts = ["{", "}", "```", "```json", "\n", " ", "k", '"v": 3', "[]", "é", "`"]
    inputs = glued(parts, 400, 9, 5)
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, raw string")
    rows = tx.with_isolated_json(df, "raw", "clean").orderBy("i").collect()
    assert [r.clean for r in rows] == [isolated(x) for x in inputs]


def test_go_version_is_the_first_directive(spark):
    inputs = glued(["go ", "go", "\t", " ", "\n", "\r\n", "1.7", "2.30.1", "require x\n", "//"], 400, 8, 6)

    def first(manifest):
        for line in manifest.split("\n"):
            line = line.strip()
            if line.startswith("go ") and line[3:].split():
                return line[3:].split()[0]
        return ""

    assert values(spark, inputs, tx.go_version) == [first(x) for x in inputs]


@pytest.mark.parametrize("wanted", [(0, 9), (1, 22), (3, 0)])
def test_version_at_least_compares_two_numbers(spark, wanted):
    inputs = glued(["0", "1", "2", "3", "9", "22", ".", "rc", "beta4"], 400, 5, 7)

    def number(part):
        return int(re.match(r"\d*", part)[0] or 0)

    def newer(version):
        parts = version.removesuffix(".").split(".")
        return len(parts) > 1 and (number(parts[0]), number(parts[1])) >= wanted

    assert values(spark, inputs, lambda x: tx.version_at_least(x, *wanted)) == [newer(x) for x in inputs]


@pytest.mark.parametrize(
    "text, ok",
    [
        ('{"candidates": []}', True),
        (' {"candidates": [{"line": 4}]} ', True),
        ('{"candidates": []}]}', False),
        ('{"candidates": []} ]} x}', False),
        ('{"candidates": []}], "_end": 1}', False),
        ('{"candidates": []}{"candidates": []}', False),
        ('{"candidates": [{"line": "4"}]}', False),
        ('{"candidates": [{"message": 5, "line": 1}]}', False),
        ('{"candidates": [{"line": 1.0}]}', False),
        ('{"candidates": [{"line": 12345678901234567890}]}', False),
        ('{"candidates": [7]}', False),
        ('{"candidates": {}}', False),
        ('{"Candidates": [{"LINE": 3, "line": null}, null]}', True),
        ('{"candidates": [{"line": 1, "line": 2}], "candidates": []}', True),
        ('{"candidates":[]}],"end":"x"} ,"x":[{}', False),
        ('{"candidates":[]}]},"_end":"end of the one value"} ,"x":[{}', False),
        ("", False),
        ("[]", False),
    ],
)
def test_decoding_takes_one_whole_value(spark, text, ok):
    repeated_keys(spark)
    df = spark.createDataFrame([(text,)], "x string").withColumn("e", decode_envelope(F.col("x"), DETECTOR_PAYLOAD))
    assert df.select(envelope_ok(F.col("e"))).first()[0] is ok


def test_severity_of_confidence(spark):
    cases = [(1.0, "error"), (0.85, "error"), (0.8499, "warning"), (0.7, "warning"), (0.69, "info"), (0.0, "info")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c double")
    got = [r[0] for r in df.select(tx.severity_from_confidence(F.col("c"))).collect()]
    assert got == [s for _, s in cases]
    names = spark.range(4).select(tx.severity_name(F.col("id"))).collect()
    assert [r[0] for r in names] == ["info", "warning", "error", "unknown"]


def test_tags_and_bodies(spark):
    cases = {"[a] text ": "text", "[a]text": "text", "[open text ": "[open text ", " plain ": " plain ", "[]": ""}
    assert values(spark, list(cases), tx.strip_tag) == list(cases.values())
    df = spark.createDataFrame([("[t] m", 0.29, "x()"), ("m", 1.0, "")], "m string, c double, f string")
    got = [r[0] for r in df.select(tx.model_comment_body(F.col("m"), F.col("c"), F.col("f"))).collect()]
    assert got == [
        "m\n\n*Confidence: 28%*\n\n**Suggested Fix:**\n```go\nx()\n```",
        "m\n\n*Confidence: 100%*",
    ]


def test_languages(spark):
    cases = {"a/b.go": "go", "a.JS": "javascript", "a/b.tsx": "typescript", "x.zzz": "", "a.b/c": "", "Makefile": "", ".yml": "yaml"}
    assert values(spark, list(cases), language) == list(cases.values())
    assert values(spark, ["a.b.c", "a.b/c", "x."], extension) == [".c", "", "."]


@pytest.mark.parametrize("size", [1, 64, 65, 200])
def test_keyed_digest(spark, size):
    secret = b"k" * size
    bodies = [b"", b"{}", bytes(range(256))]
    df = spark.createDataFrame([(bytearray(b),) for b in bodies], "b binary")
    got = [r[0] for r in df.select(hmac_sha256_hex(secret, F.col("b"))).collect()]
    assert got == [hmac.new(secret, b, hashlib.sha256).hexdigest() for b in bodies]


GLOBS = [
    ("*.go", "a.go", True),
    ("*.go", "d/a.go", False),
    ("**/*.go", "a.go", True),
    ("**/*.go", "d/e/a.go", True),
    ("vendor/**", "vendor/a/b", True),
    ("vendor/**", "vendor", True),
    ("vendor/**", "vendored/a", False),
    ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True),
    ("a/?.go", "a/x.go", True),
    ("a?b", "a/b", False),
    ("[a-c].go", "b.go", True),
    ("[!a-c].go", "b.go", False),
    ("[^a].go", "b.go", True),
    ("[z-a].go", "z.go", False),
    ("[z-aq].go", "q.go", True),
    ("[!z-a].go", "m.go", True),
    ("d[!z-a]e", "d/e", False),
    ("[z-a]*", "", False),
    ("{cmd,pkg}/*.go", "pkg/x.go", True),
    ("{a,b{c,d}}", "bd", True),
    ("\\*.go", "*.go", True),
    ("\\*.go", "a.go", False),
    ("a.go", "aXgo", False),
]


def test_globs(spark):
    rows = [(i, any_glob_regex([g]), p) for i, (g, p, _) in enumerate(GLOBS)]
    df = spark.createDataFrame(rows, "i int, r string, p string")
    got = [x[0] for x in df.orderBy("i").select(F.rlike("p", F.col("r"))).collect()]
    assert got == [want for _, _, want in GLOBS]
    assert [glob_to_regex(g) for g in ("[", "[]", "{a", "a\\", "[a-]")] == [None] * 5
    assert any_glob_regex([]) is None and any_glob_regex(["["]) is None
    assert re.search(any_glob_regex(["[", "b*"]).replace("\\z", "\\Z"), "bc")


def test_one_cast_and_field_by_field_agree(spark):
    repeated_keys(spark)
    item = '{"category":"c","line":%s,"message":"m","explanation":"e","suggested_fix":"f","confidence":%s,"decision":"d"}'
    plain = ["1|2", "1|0.5", "2|1e3", "null|null", "3|1e-300"]
    odd = ['"2"|1', "1.5|1", "12345678901234567890|1", 'true|1', '1|"x"']
    items = {t: item % tuple(t.split("|")) for t in plain + odd}
    more = ["null", "{}", "5", "[]", '{"LINE":3}', '{"line":4,"other":1}', '{"message":7}']
    lists = [[x] for x in items.values()] + [[items["1|2"], x] for x in [*items.values(), *more]] + [[]]
    texts = ['{"items":[' + ",".join(x) + "]}" for x in lists] + ['{"items":null}', "null", "{}", "[]", '{"Items":[' + items["1|2"] + "]}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrapped = F.try_parse_json("t")

    def filled(result):
        return F.when(result["ok"], jsonio.zero_filled(result["value"], REVIEWER_PAYLOAD))

    rows = df.select("t", filled(jsonio._decoded(wrapped, REVIEWER_PAYLOAD)).alias("a"), filled(jsonio._typed(wrapped, REVIEWER_PAYLOAD)).alias("b"))
    rows = rows.withColumn("fast", F.schema_of_variant(wrapped).rlike(f"^{jsonio._described(REVIEWER_PAYLOAD)}$")).collect()
    assert all(r.a == r.b for r in rows)
    fast = {r.t for r in rows if r.fast}
    assert {'{"items":[' + items[t] + "]}" for t in plain} <= fast and not {'{"items":[' + items[t] + "]}" for t in odd} & fast


def test_typed_parser_and_checks_agree(spark):
    repeated_keys(spark)
    item = '{"line":%s,"confidence":%s,"message":%s}'
    plain = [
        item % ("1", "0.7000000000000001", '"a"'), item % ("-3", "12", '"\\u00e9\\n\\"\\\\ \\/"'), item % ("null", "null", "null"),
        item % ("0", "0.25", '"\\ud83d\\ude00 é😀"'), item % ("-0", "0.0", '"\\ud800"'), '{"line":1,"line":2}', "{}", ' { "message" : "}]" ,\n"line"\t: 5 } ',
    ]
    odd = [
        item % x
        for x in [("01", "1", '""'), ("1.0", "1", '""'), ("1e2", "1", '""'), ('"1"', "1", '""'), ("123456789012345678901", "1", '""'),
                  ("1", "-0.0", '""'), ("1", "1e999", '""'), ("1", ".5", '""'), ("1", "1.", '""'), ("1", '"NaN"', '""'), ("1", "NaN", '""'),
                  ("1", "1", "5"), ("1", "1", '"\t"'), ("1", "1", '"\\x"'), ("1", "1", "'a'"), ("1", "1", "{}"), ("true", "1", '""')]
    ] + ['{"LINE":1}', '{"other":1}', '{"line":1,}', '{"line":1 "message":""}', "null", "5", "[]", '{"line":1}}', '{"line"}']
    texts = ['{"items":[' + ",".join(x) + "]}" for x in [[], plain, *([x] for x in plain + odd), *([plain[0], x] for x in odd)]]
    n_plain = 2 + len(plain)
    many = '{"items":[' + ",".join([plain[0]] * 5000 + [item % ("1", "1", '"' + "\\n x" * 100_000 + '"')]) + "]}"
    texts = [many, *texts[:n_plain], ' {"items":[]}\n', '{"items":[],"items":[{}]}', *texts[n_plain:]]
    n_plain += 3
    texts += ["", "{", "{}", '{"items":null}', '{"items":[{}],}', '{"items":[{},]}', '{"items":[,{}]}', '{"items":[{}]} x', '{"items":[{}]},{"items":[]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    schema = REVIEWER_PAYLOAD
    fast = F.col("t").rlike(rf"^\s*+{jsonio._plain(schema)}\s*+\z")
    rows = df.select("i", "t", fast.alias("fast"), decode_envelope(F.col("t"), schema).alias("a"), jsonio._checked(F.col("t"), schema).alias("b"))
    rows = rows.orderBy("i").collect()
    assert [r.i for r in rows if r.fast and r.i < n_plain] == [*range(n_plain)]
    for r in rows:
        assert bool(r.a and r.a.ok) == bool(r.b and r.b.ok), r.t[:200]
        assert not (r.a and r.a.ok) or r.a.value == r.b.value or repr(r.a.value) == repr(r.b.value), r.t[:200]
