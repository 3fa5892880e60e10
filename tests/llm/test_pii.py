"""Personal data against the patterns as they are written, disclosing terms against plain counts."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.llm import pii
from reviewlake.llm.queries import op13_personal_data

SCHEMA = "doc_id bigint, text string, spans string, found int, term int, n int, `SPAN` string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, "x") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def plain_base(text):
    """The contract's patterns, applied as they stand."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(x) for x in m.group() if x.isdigit()]
        double = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and (double + sum(digits[::-2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(x.isdigit() for x in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(a, b, ("email", "ip", "card", "phone")[k]) for a, k, b in sorted(found)]


PARTS = st.sampled_from(
    ["a", "b.c", "@", ".", "-", "+", " ", "é", "1", "25", "256", "4111111111111111", "4111 1111-1111 1111", "12.34.56.78", "1.2.3", "(", ")", "+1 (555) 123-4567", "x@y.zz", "..", "0001", "\n", "%"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("text", ["a." * 200_000, "1" * 300_000, "1." * 200_000, "+1" * 200_000, "a" * 400_000 + "@", "@a" * 200_000, "+1" + " " * 300_000, "1-" * 200_000])
def test_long_runs_take_linear_time(text):
    assert pii.base_spans(text + " x@y.zz")[-1][2] == "email"


def test_disclosing_terms_equal_plain_counts(spark):
    draw = random.Random(13)
    common = ["the", "and", "with", "from", "Some", "words", "here", "of", "a"]
    owners = {"kim@x.example.com": ["Vermilion", "E4711"], "12.13.14.15": ["basement", "bas"], "+1 (555) 010-0000": ["hotline"]}
    texts = []
    for _ in range(200):
        words = draw.choices(common, k=draw.randint(0, 30))
        if draw.random() < 0.3:
            value, names = draw.choice(list(owners.items()))
            at = draw.randint(0, len(words))
            words[at:at] = [draw.choice(names), value, *draw.sample(names, draw.randint(0, len(names)))]
        if draw.random() < 0.4:
            words.append(draw.choice(["hotline", "vermin", "E9999", "based"]))
        texts.append(" ".join(words))
    texts += [None, "", texts[0], texts[1]]

    everywhere, holds, together, places, forms = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set), {}
    total = 0
    for text in filter(None, texts):
        total += 1
        base = plain_base(text)
        words = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+(?:['’-][^\W_]+)*", text) if len(m.group()) >= 3 and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        forms.update((w, pii.general_form(w)) for _, w in words)
        for term in {w for _, w in words} | {forms[w] for _, w in words} - {""}:
            everywhere[term] += 1
        own = set()
        for a, b, kind in base:
            c = (kind, re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower())
            near = [w for s, w in words if s < a][-8:] + [w for s, w in words if s >= b][:8]
            own.add((c, None))
            for w in near:
                for term in filter(None, (w, forms[w])):
                    own.add((c, term))
                    places[c, term].add(tuple(near))
        for c, term in own:
            (holds if term is None else together)[c if term is None else (c, term)] += 1

    def share(c, term):
        told = math.log2(total * together[c, term] / (holds[c] * everywhere[term]))
        return min(1.0, told / math.log2(total / holds[c]))

    expected = {}
    for (c, term), seen in places.items():
        if term in forms and len(seen) >= 3 and share(c, term) >= 0.9:
            form = forms[term]
            safe = bool(form) and share(c, form) < 0.9
            expected[term] = expected.get(term, True) and safe
    found = {r.term: r.action for r in pii.disclosing_terms(documents(spark, texts)).collect()}
    assert found == {pii.hashed(t): pii.GENERAL if safe else pii.REMOVE for t, safe in expected.items()}
    assert {"vermilion", "basement"} <= set(expected)
    assert set(found.values()) == {pii.GENERAL, pii.REMOVE}

    for block in (pii.BLOCK_TERMS, 1):
        for r in pii.find_personal(documents(spark, texts), "marks", block_terms=block).collect():
            text = r.text or ""
            base = plain_base(text)
            more = []
            for m in re.finditer(r"[^\W_]+(?:['’-][^\W_]+)*", text):
                if m.group().lower() in expected and not any(a < m.end() and m.start() < b for a, b, _ in base):
                    more.append((m.start(), m.end(), pii.GENERAL if expected[m.group().lower()] else pii.REMOVE))
            assert [(s.start, s.end, s.kind) for s in r.marks] == sorted(base + more)


def test_sanitised_text(spark):
    frame = documents(spark, ["ask Vermilion, kim@x.org or E47 at +1 (555) 010-0000 now", None, "nothing"])
    terms = spark.createDataFrame([(pii.hashed("vermilion"), pii.GENERAL), (pii.hashed("e47"), pii.GENERAL), (pii.hashed("now"), pii.REMOVE)], "term bigint, action string")
    found = pii.find_personal(frame, "spans", terms=terms)
    assert sorted(found.columns) == sorted(frame.columns)
    got = [r[0] for r in found.select(pii.sanitised(F.col("text"), F.col("spans"))).collect()]
    assert got == ["ask Ver*, [email] or E00 at [phone] -", None, "nothing"]


def test_odd_rows(spark, tmp_path):
    texts = [None, "", "a@b.cc", "a@b.cc", "no data", "é 😀 10.0.0.1", "x" * 100_000 + " a@b.cc " + "word " * 60_000]
    documents(spark, texts, [1, 2, 3, 3, None, 5, 6]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op13_personal_data(spark, str(tmp_path)).collect():
        text = {1: "", 2: "", 3: "a@b.cc", None: "no data", 5: texts[5], 6: texts[6]}[r.doc_id]
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_base(text))
        assert (r.base_sha256, r.spans) == (hashlib.sha256(base.encode()).hexdigest(), base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k) for k in pii.KINDS)
    assert pii.find_personal(documents(spark, [])).count() == 0


def test_passages_of_long_texts_are_counted_alike(spark, monkeypatch):
    monkeypatch.setattr(pii, "PASSAGE", 50)
    text = " ".join(f"word{i} kim@x.org term" for i in range(30))
    counted = {r.term: r.n for r in pii.term_passages(documents(spark, [text]).select("text")).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert counted[pii.hashed("term")] == len({m.start() // 50 for m in re.finditer("term", text)})
    rows = pii.evidence(documents(spark, [text]).select("text")).where("entity = term").collect()
    assert [r.n for r in rows] == [len({m.start() // 50 for m in re.finditer("kim", text)})]
