"""The manifest and its proofs against a plain tree on the driver."""

import random
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import merkle
from reviewlake.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, kind int, tree int, leaf string, rank int"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, 2, "l", 3) for r in rows], SCHEMA)


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_levels(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def path(levels, at, presented, arity):
    siblings = []
    for level in levels[:-1]:
        begin = at // arity * arity
        run = list(range(begin, min(len(level), begin + arity)))
        siblings += [level[i] for i in run if i != at]
        presented = digest(*(presented if i == at else level[i] for i in run))
        at //= arity
    return siblings, presented


def expected(rows, arity=2):
    """Proof rows by the contract, one leaf at a time."""
    ordered = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(*r)))
    groups = [list(g) for _, g in groupby(ordered, key=lambda r: r[2])]
    trees = [tree_levels([leaf_of(*r) for r in g], arity) for g in groups]
    top = tree_levels([t[-1][0] for t in trees], arity)
    out = []
    for k, (group, levels) in enumerate(zip(groups, trees)):
        for i, row in enumerate(group):
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            shown = leaf_of(*row[:4], row[4] + 1) if tampered else leaf_of(*row)
            below, folded = path(levels, i, shown, arity)
            above, folded = path(top, k, folded, arity)
            out.append((row[0], leaf_of(*row), levels[-1][0], top[-1][0], digest(*below, *above), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def proved(frame, arity=2, stretch=merkle.STRETCH):
    chosen = F.coalesce(F.crc32(frame["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = merkle.dataset(frame, "doc_id", "lang", COLUMNS, {"n_chars": frame["n_chars"] + 1}, chosen)
    found = merkle.manifest(found.leaves.select("id", "kind", "leaf", "presented"), arity) if arity != 2 else found
    rows = merkle.proofs(found, stretch).collect()
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows), key=str)


def some_rows(seed, sizes):
    draw = random.Random(seed)
    rows = []
    for lang, n in sizes:
        for _ in range(n):
            text = draw.choice([None, "", "é" * draw.randint(0, 9), "some text 1:2", "-"])
            rows.append((draw.choice([None, draw.randint(-50, 400)]), text, lang, draw.choice([None, "s", ""]), draw.choice([None, 0, 7, 10])))
    draw.shuffle(rows)
    return rows + rows[:5]


@pytest.mark.parametrize("arity, block, stretch", [(2, 4096, 16384), (2, 4, 7), (3, 9, 5), (2, 16, 1)])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, arity, block, stretch):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = some_rows(arity, [(None, 3), ("", 1), ("de", 17), ("z", 64), ("en", 130), ("é", 2), ("fr", 33)])
    assert proved(documents(spark, rows), arity, stretch) == expected(rows, arity)


@pytest.mark.parametrize("sizes", [[], [("a", 1)], [("a", 2)], [("a", 1), ("b", 1)], [(None, 5)], [("a", 1), ("b", 1), ("c", 1)]])
def test_small_tables(spark, sizes):
    rows = some_rows(9, sizes)[: sum(n for _, n in sizes)]
    assert proved(documents(spark, rows), stretch=2) == expected(rows)


def test_the_query_proves_a_whole_table(spark, tmp_path):
    rows = some_rows(3, [("en", 40), ("de", 9)]) + [(700, "long " * 200_000, "en", "s", 1_000_000), (701, "x", "en", "s", (1 << 63) - 2)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("arity", [2, 3])
def test_the_missing_nodes_suffice_and_none_is_spare(arity):
    draw = random.Random(arity)
    for _ in range(40):
        n = draw.randint(1, 60)
        known = np.array(sorted(draw.sample(range(n), draw.randint(1, n))))
        sizes, levels = merkle.level_sizes(n, arity), tree_levels([str(i) for i in range(n)], arity)
        needed = merkle.missing(known, n, arity)

        def root(nodes):
            maps = [{} for _ in sizes]
            maps[0].update((int(i), str(i)) for i in known)
            for level, i in nodes:
                maps[level][i] = levels[level][i]
            merkle.derive(maps, sizes, arity)
            return maps[-1].get(0)

        assert root(needed) == levels[-1][0]
        for spare in needed:  # without any one of them the root cannot be derived
            try:
                assert root([x for x in needed if x != spare]) != levels[-1][0]
            except KeyError:
                pass


def test_siblings_are_the_proof(spark):
    rows = some_rows(5, [("en", 20), ("de", 3)])
    found = merkle.dataset(documents(spark, rows), "doc_id", "lang", COLUMNS)
    for r in merkle.proofs(found, 6, with_siblings=True).collect():
        assert digest(*r.siblings) == r.proof_sha256
        assert r.verified
