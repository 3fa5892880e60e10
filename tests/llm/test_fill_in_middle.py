"""Fill-in-middle against plain slicing, exact restoring, and odd rows."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from reviewlake.llm import fim

SCHEMA = "doc_id bigint, text string, n int, form string, output string, whole string, draws int, cut int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "f", "o", "w", 2, 3) for i, t in pairs], SCHEMA)


def expected(doc_id, text):
    """The contract, by plain slicing."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def found(frame):
    out = fim.fill_in_middle(frame).withColumn("again", fim.restored(F.col("fim.output"), F.col("fim.form")))
    assert out.columns == [*frame.columns, "fim", "again"]
    return [(r.doc_id, r.text, tuple(r.fim), r.again) for r in out.collect()]


def test_outputs_equal_plain_slicing_and_restore(spark):
    draw = random.Random(11)
    texts = ["".join(draw.choices("aé\n\r <>PSM中😀́\x00 ", k=draw.randint(0, 40))) for _ in range(300)]
    for doc_id, text, got, again in found(rows(spark, enumerate(texts))):
        assert got == expected(doc_id, text)
        assert again == text


def test_odd_rows(spark):
    long = "line of text é\n" * 60_000
    pairs = [(1, None), (2, ""), (None, "some text"), (3, "x <S> y"), (4, "<P"), (5, long), (6, "same"), (6, "same"), (-9, "<" * 50)]
    got = found(rows(spark, pairs))
    assert len(got) == len(pairs)
    for doc_id, text, result, again in got:
        assert result == expected(doc_id, text)
        assert again == (text or "")
    assert found(rows(spark, [])) == []


def test_every_form_occurs_in_its_share(spark):
    forms = [r[2][1] for r in found(rows(spark, [(i, "some text") for i in range(4000)]))]
    assert 0.08 < forms.count("plain") / 4000 < 0.12
    assert 0.16 < forms.count("spm") / 4000 < 0.20


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\w+\s*", r"\X"])
def test_stretches_give_the_ends_of_one_match(unit):
    pattern = regex.compile(f"({unit})*")
    text = "some words é and\nmore " * 40 + "x" * 300 + " end"
    whole = fim.unit_ends(pattern, text)
    for stretch in (7, 64, 333):
        assert sum(fim.unit_ends(pattern, text, stretch), []) == whole[0]


def test_units_of_words_and_texts_they_do_not_cover(spark):
    frame = rows(spark, [(i, t) for i in range(20) for t in ("one two  three four five", "one, two")])
    for r in fim.fill_in_middle(frame, unit=r"\w+\s*").collect():
        if "," in r.text:
            assert (r.fim.n, r.fim.form, r.fim.output) == (None, "plain", r.text)
        else:
            assert r.fim.n == 5
            if r.fim.form != "plain":
                assert r.fim.prefix_chars in (0, 4, 9, 15, 20, 24)
