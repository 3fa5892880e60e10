"""Secrets, languages, toxicity, leaks and licences on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, dfa, langid, licenses, secrets, toxicity

DOCS = "doc_id bigint, text string, lang string, text_ string, found string"


def docs(spark, texts, lang="en"):
    """Documents with columns whose names the operators would like to use."""
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " \n\n ", "word", "word", "é" * 5000, "a b " * 20000]

# -- secrets -------------------------------------------------------------------

ASSIGN = re.compile(
    rb"""(?:[pP][aA][sS][sS][wW](?:[oO][rR][dD]|[dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
PIECES = [
    "token", "secretoken", "PassWord", "passwd", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "0123456789abcdef",
    "AKIA", "AKIAKIA", "QWERTY123456", "\n", "é", "漢", ".", "-", "ghp_", "x" * 40, "AIza", "-----BEGIN RSA PRIVATE KEY-----",
]


def by_regex(text):
    """The base contract with an ordinary regex engine."""
    data = text.encode()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", data) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", data) if len(m[0]) >= 24]
    point = lambda at: len(data[:at].decode())
    return [(("assign", "access", "hex")[k], point(a), point(b)) for a, k, b in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30), min_size=1, max_size=4))
def test_secret_spans_equal_a_regex_engine(parts):
    texts = ["".join(p) for p in parts]
    data = [t.encode() for t in texts]
    for text, raw, encoded in zip(texts, secrets.scan_texts(data, secrets.RULES), data):
        spans = secrets.kept_spans(encoded, raw, secrets.RULES)
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == by_regex(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_scan_in_lanes_equals_a_walk(data, lanes):
    search = secrets.automata(secrets.BASE)[0]
    state, walked = 0, []
    for byte in data:
        state = search.lists[0][state][search.lists[1][byte]]
        walked.append(state)
    assert dfa.scan(search, np.frombuffer(data, dtype=np.uint8), lanes).tolist() == walked


def test_secret_edges(spark):
    rows = secrets.find_secrets(docs(spark, [*EDGES, "Pwd; api_key: 'é' SECRET= abcdef1"])).orderBy("doc_id").collect()
    assert [len(r.spans) for r in rows] == [0] * len(EDGES) + [1]
    assert [tuple(s) for s in rows[-1].spans] == [("assign", 18, 33)]
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# -- languages -----------------------------------------------------------------


def code_length(text, training):
    """Prediction by partial matching, byte by byte."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in training:
        data = b"\0" * 4 + t
        for i in range(4, len(data)):
            for order in range(5):
                counts[data[i - order : i]][data[i]] += 1
    total, data = 0.0, b"\0" * 4 + text
    for i in range(4, len(data)):
        for order in range(4, -1, -1):
            seen = counts.get(data[i - order : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += math.log2((n + d) / seen[data[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    draw = random.Random(4)
    training = [["".join(draw.choices(letters, k=60)).encode() for _ in range(5)] for letters in ("abc ", "bcdé", "xyz")]
    counts = [np.unique(langid.joined(t)[0], return_counts=True) for t in training]
    trees = langid.Trees.fit(["a", "b", "c"], [(k, n.astype(float)) for k, n in counts])
    texts = [b"abcabc", b"", b"xyzzy \xff\x00", "é".encode() * 9, b"q"]
    got = trees.bits(texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx([code_length(text, t) for t in training], rel=1e-5, abs=1e-4)


def test_language_of_held_out_texts_and_edges(spark):
    draw = random.Random(2)
    words = {"aa": ["lo", "rem", "sit"], "bb": ["grü", "ßen", "zu"], "cc": ["kto", "dla", "nie"]}
    rows = [(i, " ".join(draw.choices(words[x], k=20)), x, "", "") for i, x in enumerate([*words] * 40)]
    learned = spark.createDataFrame(rows, DOCS)
    trees = langid.fit(learned)
    assert trees.languages == ["aa", "bb", "cc"]
    found = learned.select("doc_id", "lang", langid.language(trees, learned).alias("p")).collect()
    assert all(r.lang == r.p.lang_pred and 0 <= r.p.score <= 1 for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    edges = docs(spark, [*EDGES, "12 34 ?!"])
    got = edges.select("doc_id", langid.language(trees, edges).alias("p")).orderBy("doc_id").collect()
    assert [r.p.lang_pred == "und" for r in got] == [True, True, True, False, False, False, False, True]
    none = langid.fit(learned.withColumn("lang", F.lit(None).cast("string")))
    assert {r.p.lang_pred for r in edges.select(langid.language(none, edges).alias("p")).collect()} == {"und"}
    assert langid.fit(learned.limit(0)).languages == []


# -- toxicity ------------------------------------------------------------------


def test_clauses_weigh_more_than_words():
    score = toxicity.Scorer(toxicity.Model({}, {})).score
    plain, aimed = score("some idiot came"), score("you are an idiot")
    assert score("nothing here") < score("you are not an idiot") < plain < aimed
    assert score("he said that some idiot came") < plain
    assert score("kill the process") == score("nothing here") < score("i will kill you")
    assert score(None) == score("") == score("!!")
    assert 0 <= score("idiot " * 50000) <= 1


def test_composition_equals_one_transducer_after_another():
    moves, gains = toxicity.machine()
    draw = random.Random(9)
    for _ in range(200):
        clause, state, states = draw.choices(range(7), k=12), 0, [0] * len(toxicity.GRAMMAR)
        for kind in clause:
            symbol = (kind, 1.0)
            for k, part in enumerate(toxicity.GRAMMAR):
                states[k], symbol = part.step(states[k], symbol)
            assert gains[state][kind] == symbol[1]
            state = moves[state][kind]


def test_insults_are_learned_and_held_out_texts_scored(spark):
    draw = random.Random(8)
    filler = ["lorem", "ipsum", "dolor", "amet", "sit", "elit"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join(draw.choices(filler, k=30) + ["zorgling"] * 2 * toxic), "xx", "", ""))
        labels.append((i, None if i == 7 else int(toxic)))
    frame = spark.createDataFrame(rows, DOCS)
    labelled = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(toxicity.sample(frame, labelled))
    got = toxicity.score(frame, model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got)
    nothing = toxicity.learn(toxicity.sample(frame, labelled.limit(0)))
    edges = toxicity.score(docs(spark, EDGES), nothing).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert toxicity.score(frame.limit(0), nothing).count() == 0


# -- leaks ---------------------------------------------------------------------


def leaks(text, items, width=10):
    """Every window compared with every place."""
    words = decontaminate.words(text)
    hit, names = set(), set()
    for name, item in items:
        w = decontaminate.words(item)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    names |= {str(name)} - {"None"}
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_words, piece", [(2_000_000, 5000), (2, 5000), (30, 4)])
def test_leaks_equal_brute_force(spark, monkeypatch, block_words, piece):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    draw = random.Random(3)
    text = lambda n: "".join(draw.choices(["a", "B", "c", " ", " ", ", ", "Éé", "\n", "x9"], k=n))
    items = [(i, text(draw.choice([3, 12, 60]))) for i in range(9)] + [(9, None), (10, "..."), (9, "a a"), (None, "b"), (None, "c a B c x9 a c")]
    texts = [text(150) for _ in range(40)] + [None, "", "a" * 9000]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(docs(spark, texts), bench, block_words=block_words).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [leaks(t, items) for t in texts]
    for r, t in zip(got, texts):
        assert sum(len(decontaminate.words(t[s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontaminate.find_leaks(docs(spark, texts), bench.limit(0)).collect()} == {0}


# -- licences ------------------------------------------------------------------


def best_license(text):
    """Every unit against every template, without pruning."""
    text = (text or "").lower()
    found = {}
    for unit in {*text.split("\n"), *re.split(r"\n\s*\n", text), text}:
        grams = set(licenses.bigram_set(unit))
        for name, templates in licenses.TEMPLATES.items():
            for template in map(set, map(licenses.bigram_set, templates)):
                dice = 2 * len(grams & template) / (len(grams) + len(template))
                if dice >= licenses.THRESHOLD:
                    found[name] = max(dice, found.get(name, 0))
    best = max(found.items(), key=lambda x: (x[1], [-ord(c) for c in x[0]]), default=(None, 0.0))
    return (*best, sorted(found))


def test_licenses_equal_brute_force(spark):
    draw = random.Random(5)
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = []
    for _ in range(120):
        words = draw.choice(every).split(" ")
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = draw.choice(["x", "License", "", "the software"])
        texts.append(draw.choice(["", "Intro.\n", "Größe\n\n"]) + " ".join(words) + draw.choice(["", "\nend", "\n \nmit license"]))
    texts += EDGES
    got = licenses.find_licenses(docs(spark, texts)).orderBy("doc_id").collect()
    want = [best_license(t) for t in texts]
    assert [(r.license, round(r.dice, 12), r.licenses) for r in got] == [(n, round(d, 12), f) for n, d, f in want]
    assert licenses.find_licenses(docs(spark, [])).count() == 0


def test_spans_digest_is_of_the_listed_spans(spark):
    from reviewlake.llm.queries import op2_secret_scans

    row = op2_secret_scans(spark, "/root/testdata/sf0.01").where("n_hex + n_assign > 0").orderBy("doc_id").first()
    base = [s for s in row.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
    assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
