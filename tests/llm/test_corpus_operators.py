"""Similarity join, line dedup, neighbours, mixing, archives and the pipeline on small tables."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter
from itertools import combinations
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import ann, line_dedup, minhash, mixing, ngram_join, warc
from reviewlake.llm.common import released
from reviewlake.llm.components import connected_components
from reviewlake.session import written

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, root int, class_id string"


def docs(spark, texts, ids=None, sources=None):
    """Documents with columns whose names the operators would like to use."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t), "n", 1, "c") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def roots(n, links):
    """Plain union-find."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def words_of(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def grams(text, width=5):
    w = list(words_of(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def near_texts(seed, groups=6, size=7, words=60):
    """Texts with exact copies, near copies of differing distance, and texts on their own."""
    draw = random.Random(seed)
    new = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 7)))
    texts = []
    for _ in range(groups):
        base = [new() for _ in range(words)]
        for _ in range(size):
            edited = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                edited[draw.randrange(words)] = new()
            texts.append(" ".join(edited))
    return texts + [" ".join(new() for _ in range(words)) for _ in range(10)]


@pytest.mark.parametrize("weight", [150_000, 700])
def test_similarity_classes_equal_brute_force(spark, monkeypatch, weight):
    monkeypatch.setattr(minhash, "BLOCK_WEIGHT", weight)  # the small one cuts every component into blocks
    texts = near_texts(1) + [None, None, "", "?!", "one two", "One, TWO!", "x", "long word " * 3000, "Ü ü"]
    sets = [grams(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    degree = Counter(x for link in links for x in link)
    got = ngram_join.similarity_classes(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.class_id, r.n_links) for r in got] == [(c, degree[i]) for i, c in enumerate(roots(len(texts), links))]
    kept = ngram_join.one_of_each(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got})


def test_similarity_join_of_odd_rows(spark):
    same = "a b c d e f g h"
    frame = docs(spark, [same, same, same, "other words here " * 4, same], [5, 5, None, None, 3])
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.similarity_classes(frame).collect()}
    assert got == {(5, 3, 3), (None, 3, 3), (3, 3, 3), (None, None, 0)}
    kept = ngram_join.one_of_each(frame).collect()
    assert sorted((r.doc_id or -1, r.text[:5]) for r in kept) == [(-1, "other"), (3, "a b c")]
    twice = ngram_join.one_of_each(docs(spark, [same, same], [4, 4])).collect()
    assert [r.doc_id for r in twice] == [4]
    assert ngram_join.similarity_classes(docs(spark, [])).count() == 0
    assert ngram_join.one_of_each(docs(spark, [])).count() == 0


def test_repeated_rows_without_words_stay(spark):
    same = "a b c d e f g h"
    frame = docs(spark, [same, same, None, None, "", "", "?!", "?!", None, None], [4, 4, 5, 5, 6, 6, 7, 7, None, None])
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(frame).collect())
    assert kept == {(4, same): 1, (5, None): 2, (6, ""): 2, (7, "?!"): 2, (None, None): 2}


def test_a_large_group_of_near_copies_keeps_all_links(spark):
    draw = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(300):
        edited = list(base)
        edited[draw.randrange(40)] = f"z{i}"
        texts.append(" ".join(edited))
    sets = [grams(t) for t in texts]
    degree = Counter(x for a, b in combinations(range(300), 2) if jaccard(sets[a], sets[b]) >= 0.8 for x in (a, b))
    got = ngram_join.similarity_classes(docs(spark, texts)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: degree[i] for i in range(300)}


def test_banding_reaches_the_recall_it_is_chosen_for():
    banding = minhash.Banding.choose(0.8, 0.999, 128)
    assert 1 - (1 - 0.8**banding.rows) ** banding.bands >= 0.999 and banding.bands * banding.rows <= 128
    draw = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        common, own = draw.integers(0, 1 << 63, 80, dtype=np.uint64), draw.integers(0, 1 << 63, 20, dtype=np.uint64)
        keys = banding.keys(np.r_[common, own[:10], common, own[10:]], np.array([90, 90]))
        met += bool((keys[0] == keys[1]).any())
    assert met >= 298


def test_candidates_are_dealt_once_and_connect_all_that_share_a_key(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(400), draw.randrange(300)) for _ in range(500)] + [(1000 + i, 7) for i in range(9000)] + [(1000, 7), (None, 7), (5, None)]
    keys = spark.createDataFrame(rows, "node bigint, key bigint")
    links = minhash.candidates(keys)
    length = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        assert links._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") == 1
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", length)
    least = {}
    for node, key in rows:
        if None not in (node, key):
            least[key] = min(node, least.get(key, node))
    want = {(n, least[k]) for n, k in rows if None not in (n, k) and n != least[k]}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ordered_shingles_are_those_of_a_plain_sort():
    draw = np.random.default_rng(3)
    n = np.array([3, 1, 4])
    group_of = np.repeat(np.arange(3), n)
    owner = np.sort(draw.integers(0, 8, 400))
    hashes = draw.integers(0, 1 << 64, 30, dtype=np.uint64)[draw.integers(0, 30, 400)]
    want = sorted({(group_of[o], h, o) for o, h in zip(owner.tolist(), hashes.tolist())})
    for bits in (63, 1):  # packed in one number, and where they do not fit
        at, code = minhash.ordered(hashes, owner, group_of, bits)
        assert np.unique(hashes)[code].tolist() == [h for _, h, _ in want] and at.tolist() == [o for *_, o in want]
    assert [len(x) for x in minhash.ordered(hashes[:0], owner[:0], group_of)] == [0, 0]


def test_components_equal_union_find(spark):
    draw = random.Random(2)
    links = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 60)]
    edges = spark.createDataFrame([*links, *links[:9], (7, 7)], "a bigint, b bigint")
    want = roots(400, links)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert connected_components(edges.limit(0)).count() == 0


# -- lines ---------------------------------------------------------------------


def deduplicated(texts, chars=8):
    """All lines compared with all."""
    places, sets = [], []
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(line_dedup.WHITE).lower()
            if line:
                places.append((i, n))
                sets.append({line[k : k + chars] for k in range(max(1, len(line) - chars + 1))})
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    gone = {places[k] for k, root in enumerate(roots(len(sets), links)) if root != k}
    return [t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)]


@pytest.mark.parametrize("weight", [150_000, 700])
def test_line_dedup_equals_brute_force(spark, monkeypatch, weight):
    monkeypatch.setattr(minhash, "BLOCK_WEIGHT", weight)
    draw = random.Random(12)
    pool = near_texts(3, groups=5, size=8, words=25)
    texts = ["\n".join(draw.choices(["short", "", "  Short  ", *pool], k=draw.randint(1, 6))) for _ in range(60)]
    texts += [None, "", "\n\n", "ünïcode " * 9, "ÜNÏCODE " * 9, "z" * 60000, "y\n" * 400]
    texts += ["One paragraph.\n\nAnother one.\n \t\n", "One paragraph.\n\nAnother one.\n \t\n", "one paragraph.\t\n\r\n\u3000Another one.\r", "ab cd", "ab cd\r"]
    left = line_dedup.drop_repeated_lines(docs(spark, texts))
    assert left.columns == docs(spark, []).columns
    got = {r.doc_id: r.text for r in left.collect()}
    want = deduplicated(texts)
    assert [got[i] for i in range(len(texts))] == want
    full = {r.doc_id for r in line_dedup.drop_repeated_lines(docs(spark, texts), drop_empty=True).collect()}
    assert full == {i for i, (t, w) in enumerate(zip(texts, want)) if t == w or w.strip(line_dedup.WHITE)}


def test_near_lines_share_a_band_as_often_as_promised():
    banding = minhash.Banding.choose(line_dedup.THRESHOLD, line_dedup.RECALL, line_dedup.HASHES)
    assert 1 - (1 - 0.8**banding.rows) ** banding.bands >= 0.998
    draw = np.random.default_rng(4)
    met = 0
    for _ in range(1000):
        common, own = draw.integers(0, 1 << 63, 80, dtype=np.uint64), draw.integers(0, 1 << 63, 20, dtype=np.uint64)
        keys = banding.keys(np.r_[common, own[:10], common, own[10:]], np.array([90, 90]))
        met += bool((keys[0] == keys[1]).any())
    assert met >= 995


def test_line_dedup_of_odd_rows(spark):
    line = "this line is long enough to count"
    frame = docs(spark, [line, line, line, line + "\nmore"], [2, 2, None, 1])
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.drop_repeated_lines(frame).collect())
    assert got == [(-1, line), (1, "more"), (2, ""), (2, "")]
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


def test_short_lines_are_deduplicated_by_query_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from reviewlake.llm.queries import op8_line_dedup

    texts = ["Menu\nfirst text\n\n\r\nx", " menu \nread more now\n\n\r\nX", "menus\nread more now!", "y\nx", "x"]
    want = ["Menu\nfirst text\n\n\r\nx", "read more now\n\n\r", "menus", "y", ""]
    frame = docs(spark, texts)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(want)}
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame, "").collect()}
    assert left == {i: t for i, t in enumerate(want) if t}


# -- neighbours ----------------------------------------------------------------


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = [(-float((vectors[q] * v).sum()), i) for i, v in zip(ids, vectors) if i != ids[q]]
        out[ids[q]] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int, vec string, bucket int, score int")


def test_neighbours_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 100)
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 600)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    vectors = (centres[draw.integers(0, 12, 2000)] + 0.4 * draw.normal(size=(2000, 16))).astype("float32").astype(float)
    vectors *= draw.uniform(0.5, 2, (2000, 1)).astype("float32")
    vectors = vectors.astype("float32").astype(float)
    frame = embeddings(spark, [(i, v.tolist(), 1, "x", 2, 3) for i, v in enumerate(vectors)])
    got = {}
    for r in ann.nearest(frame, F.pmod("id", F.lit(20)) == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(range(2000), vectors, range(0, 2000, 20), 10)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / 10 for q, w in want.items()])
    assert recall >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 10
        assert all(s == pytest.approx(float((vectors[q] * vectors[i]).sum()), rel=1e-12) for i, s in found)


def test_neighbours_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 1.0]),
        (6, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (9, [0.5, 2.0]), (20, [1.0, 0.0]), *((30 + i, [2.0, 1.0]) for i in range(40)),
    ]
    frame = embeddings(spark, [(i, v, 1, "x", 2, 3) for i, v in rows])
    got = ann.nearest(frame, F.pmod("id", F.lit(20)) == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, 30 + i) for q in (0, 20) for i in range(5)] + [(40, 30 + i) for i in range(5)] + [(60, 30 + i) for i in range(5)]
    few = ann.nearest(frame.where("vec_id in (0, 8, 9)"), F.col("id") == 0, k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(9, 0.5), (8, -1.0)]
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(frame.where("vec_id = 1"), F.lit(True)).count() == 0


def test_repeated_rows_and_ids_take_no_places_of_neighbours(spark):
    same = [(100 + i, [2.0, 1.0]) for i in range(21)] * 21
    many = [(50, [3.0, 1.0 + j / 100]) for j in range(30)]
    far = [(200 + i, [1.0, i / 100]) for i in range(30)]
    frame = embeddings(spark, [(i, v, 1, "x", 2, 3) for i, v in [(0, [1.0, 0.0]), *same, *many, *far]])
    got = ann.nearest(frame, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(50, 3.0), *((100 + i, 2.0) for i in range(19))]


@pytest.mark.parametrize("rows", [1_000, 1_000_000, 10_000_000, 300_000_000])
def test_visits_hold_neighbours_of_tables_of_any_size(rows):
    draw = np.random.default_rng(8)
    hashing = ann.Hashing.choose(rows, 64, 1.0 + 1e-9)
    shares = []
    for _ in range(4):
        query, others = draw.normal(size=64), draw.normal(size=(500, 64))
        query /= np.linalg.norm(query)
        others -= np.outer(others @ query, query)
        near = 0.45 * query + (1 - 0.45**2) ** 0.5 * others / np.linalg.norm(others, axis=1, keepdims=True)
        shares.append(np.isin(hashing.places(near), hashing.visits(query, 0.45, ann.SUCCESS)).any(axis=1).mean())
    assert np.mean(shares) >= 0.96


# -- mixing --------------------------------------------------------------------


def test_exponent_meets_entropy_or_repetition(spark):
    counts = [1000, 100, 10, 3]
    shares = spark.createDataFrame([(f"s{i}", c / 1113) for i, c in enumerate(counts)], "s string, share double")
    p = np.array(counts) / 1113

    def gives(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum() / math.log(4), (w / p).max()

    free = mixing.temper(shares, 0.8, 1e9)
    assert free.entropy >= 0.8 and gives(free.exponent + 1e-6)[0] < 0.8
    bound = mixing.temper(shares, 0.999, 3.0)
    assert bound.repeats <= 3.0 and gives(bound.exponent - 1e-6)[1] > 3.0
    assert mixing.temper(shares, 0.0, 1e9).exponent == 1.0
    assert mixing.temper(shares, 2.0, 0.5).exponent == 1.0


def test_mix_meets_budgets_with_whole_permutations(spark):
    draw = random.Random(4)
    sources = ["big"] * 300 + ["mid"] * 60 + ["few"] * 12 + [None] * 5
    texts = [" ".join(["w"] * draw.randint(1, 30)) for _ in sources] + [None, " \n "]
    sources += ["big", "only empty"]
    frame = docs(spark, texts, sources=sources).withColumn("pass", F.lit("taken"))
    options = {"target_entropy": 0.9, "max_repeats": 3.0, "block_tokens": 200}
    got = mixing.mixed(frame, **options)
    assert got.columns == [*frame.columns, "pass_", "block", "place"]
    rows = got.collect()
    tokens = [len((t or "").split()) for t in texts]
    totals = Counter()
    for s, n in zip(sources, tokens):
        totals[s] += n
    plan, mix = mixing.plan_budgets(
        spark.createDataFrame([(str(s), n) for s, n in totals.items() if n], "s string, total bigint"), 0.9, 3.0, 1.0, 200
    )
    budgets = {r.s: r.budget for r in plan.collect()}
    p = {s: n / sum(tokens) for s, n in totals.items() if n}
    weight = {s: x**mix.exponent for s, x in p.items()}
    for s in p:
        assert budgets[str(s)] == round(sum(tokens) * weight[s] / sum(weight.values()))
        mine = [r for r in rows if r.source == s and tokens[r.doc_id]]
        taken = sum(tokens[r.doc_id] for r in mine)
        assert budgets[str(s)] <= taken < budgets[str(s)] + 30
        seen = Counter(r.doc_id for r in mine)
        full = budgets[str(s)] // totals[s]
        assert all(full <= seen[i] <= full + 1 for i, x in enumerate(sources) if x == s and tokens[i])
        for turn in {r.pass_ for r in mine}:
            blocks = {r.block for r in mine if r.pass_ == turn}
            assert blocks == set(range(1, len(blocks) + 1))
    assert Counter(r.doc_id for r in rows if not tokens[r.doc_id]) == {len(texts) - 2: 1, len(texts) - 1: 1}
    again = mixing.mixed(frame, **options).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark, [None, ""])).count() == 2


# -- archives ------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, file string, digest string"


def test_archive_round_trip(spark):
    pages = [
        (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "http://a/ü", "b" * 90000),
        (9007199254740993, "u", "b" * 90000), (7, "u", "once\r\n\r\nmore"), (None, "u", "<p>é</p>"), (None, "u", "nobody"), (None, "u", "nobody"), (7, "u", "once\r\n\r\nmore"),
    ]
    frame = spark.createDataFrame([(*p, "f", "d") for p in pages], PAGES)
    index = warc.write_archives(frame)
    assert index.count() == len(pages)
    for r in index.collect():
        with open(urlparse(r.file).path, "rb") as archive:
            archive.seek(r.offset)
            assert gzip.decompress(archive.read(r.length)).startswith(b"WARC/1.1\r\n")
    got = warc.read_records(index).collect()
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        refers = first if first is not None and page != first else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "response" if refers is None else "revisit", refers, data if refers is None else None))
    listed = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or (b"" if r.record_type == "response" else None)) for r in got]
    assert sorted(listed, key=str) == sorted(want, key=str)
    some = warc.read_records(index.where("page_id = 5")).collect()
    assert [bytes(r.payload) for r in some] == [b"b" * 90000]
    large = warc.read_records(warc.write_archives(frame, min_bytes=100), with_payload=False).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in large] == [(9007199254740993, 5)]
    assert warc.write_archives(frame.limit(0)).count() == 0


def test_ranges_are_coalesced():
    offsets, lengths = np.array([0, 10, 20, 200_000, 200_010]), np.array([10, 10, 10, 10, 10])
    assert warc.ranges(offsets, lengths) == [(0, 3), (3, 5)]
    assert warc.ranges(np.array([0, 9 << 20]), np.array([9 << 20, 5])) == [(0, 1), (1, 2)]


# -- pipeline ------------------------------------------------------------------


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(21)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 8)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(30)]
    leak = " ".join(word() for _ in range(15))
    near = texts[0].split()
    near[7], near[30] = "changed", "again"
    texts += [texts[1], None, "12 34", " ".join(near), "Leak: " + leak.title() + " " + word(), "?", "tiny one"]
    frame = docs(spark, texts, sources=[f"s{i % 3}" for i in range(len(texts))]).drop("node", "root", "class_id").withColumn("found", F.lit(1))
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = frame
    for _, stage in corpus_pipeline.STAGES:
        before, kept = kept, written(stage(spark, kept, str(tmp_path)), "stage")
        assert kept.columns[: len(before.columns)] == before.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {*range(30), 36} - ids == set() and not ids & {30, 31, 32, 34, 35}
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, str(tmp_path)), "stage")
    assert empty.count() == 0


def test_released_returns_freed_native_memory(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/statm") as pages:
            return int(pages.read().split()[1]) * 4096 >> 20

    page = bytes(1 << 16)
    held = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for deflater in held:
        deflater.setInput(page)
        deflater.deflate(bytearray(64))
    for i, deflater in enumerate(held):
        if i % 20:  # some stay in use between the freed ones
            deflater.end()
    jvm.System.gc()
    jvm.System.gc()
    freed = resident()
    released(spark)
    assert freed - resident() > 40
