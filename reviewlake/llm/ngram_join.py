"""Similarity join of documents on word n-grams: MinHash banding, then exact Jaccard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, chunks, fresh, if_small, mix, pieces, written
from reviewlake.llm.components import connected_components
from reviewlake.llm.minhash import Banding, Shingler, blocks, candidates, verify, windows

WORDS = 5
THRESHOLD = 0.8
#: Pairs at the threshold that share a band, and hash functions allowed for it.
RECALL, HASHES = 0.99999, 256
#: Bytes of text hashed at a time.
CHUNK = 1 << 18
_BASE = 0xD6E8FEB86659FD93
_SEPARATES = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some lower-cased texts and the number of words of each.

    Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
    """
    data = np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)
    inside = ~_SEPARATES[data]
    edge = np.diff(np.r_[False, inside].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    position = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    factor = _word_powers(1 << int(position.max() + 1).bit_length())
    value = (mix(data.astype(np.uint64)) * factor[position]) * inside
    hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.r_[0, np.searchsorted(starts, bounds)])


def _word_powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingler(width: int = WORDS) -> Shingler:
    def shingle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
        return windows(hashes, counts, width)

    return shingle


def signed(documents: DataFrame, banding: Banding, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, node, weight, bands``: the text's hash, its number of shingles and its band keys (none without words)."""
    bounded_batches(documents.sparkSession)
    shingle = shingler(width)

    @pandas_udf("weight int, bands array<bigint>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        data = [t or "" for t in texts]
        weights, bands = np.zeros(len(data), dtype=np.int32), [[] for _ in data]
        for a, b in chunks([t.encode("utf-8", "surrogatepass") for t in data], CHUNK):
            hashes, counts = shingle(data[a:b])
            some = np.flatnonzero(counts)
            weights[a:b] = counts
            if len(some):
                for i, keys in zip(some, banding.keys(hashes, counts[some])):
                    bands[a + i] = keys
        return pd.DataFrame({"weight": weights, "bands": pd.Series(bands, dtype=object)})

    text = documents[text_col].cast("string")
    rows = documents.select(documents[id_col].alias("id"), F.xxhash64(text).alias("node"), sign(text).alias("signed"))
    return rows.select("id", "node", "signed.weight", "signed.bands")


def similarity_classes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """Per document: its id, ``node`` (hash of its text), ``class_id``, ``n_links``, ``first``.

    Texts are lower-cased and cut into words; a text's set holds its runs of
    ``width`` words (all its words, if fewer). ``n_links`` counts the other
    documents whose set has Jaccard similarity ``threshold`` or more; documents
    connected by links, directly or not, form a class, named by its smallest id.
    ``first`` marks the document that stands for the class: smallest id, then
    smallest text hash; rows that repeat both are marked alike.

    Null texts and texts without words have no links and a class of their own.
    Equal texts are one node however many copies there are, counted before any
    shuffle of texts. Null ids are never the smallest of a class that has an id.
    Empty tables give no rows; other columns are not read. Texts are known by a
    64-bit hash; no count of candidates or partners is capped.
    """
    banding = Banding.choose(threshold, recall, HASHES)
    rows = written(signed(documents, banding, width, id_col, text_col), "signed")
    known = rows.where("weight > 0")
    nodes = known.groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.max("weight").alias("weight"))
    keys = known.dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    found = written(connected_components(candidates(keys)), "candidates")

    members = written(blocks(nodes.join(found, "node")), "members")
    texts = documents.select(documents[id_col].alias("id"), documents[text_col].cast("string").alias("text"))
    chosen = members.select(F.col("node").alias("known"), "root", "block", "blocks", "copies", "least_id")
    one = texts.join(if_small(chosen), (F.xxhash64("text") == F.col("known")) & F.col("id").eqNullSafe(F.col("least_id")))
    if known.groupBy("id", "node").count().where("count > 1").limit(1).count():  # whole rows are repeated
        one = one.dropDuplicates(["known"])
    one = one.withColumnRenamed("known", "node")
    checked = written(verify(one, shingler(width), threshold), "checked")

    several = checked.where("blocks > 1").select(F.col("node").alias("a"), F.col("low").alias("b"))
    roots = checked.where("blocks = 1").select("node", F.col("low").alias("root")).union(connected_components(several))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    graded = (
        nodes.join(roots, "node", "left")
        .join(links, "node", "left")
        .select("node", "copies", "least_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    heads = graded.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("head"))
    graded = written(graded.join(heads, "root"), "classes")
    return rows.join(graded.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select(
        F.col("id").alias(id_col),
        "node",
        F.when(F.col("known").isNull(), F.col("id")).otherwise(F.col("head.least_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        (F.col("known").isNull() | (F.col("id").eqNullSafe(F.col("head.least_id")) & (F.col("node") == F.col("head.node")))).alias("first"),
        (F.col("known").isNull()).alias("alone"),
    )


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The documents without those that are similar to a kept one: one row of each class stays.

    The rows to go are few or are joined by id; texts of the rows that stay are not
    shuffled unless a table repeats whole rows of the same id and text.
    """
    classes = written(similarity_classes(documents, id_col, text_col, **options), "similar")
    gone = classes.where("not first").select(F.col(id_col).alias("gone_id"), F.col("node").alias("gone_node")).distinct()
    node = F.xxhash64(documents[text_col].cast("string"))
    gone_id, gone_node, mark = (fresh(documents, x) for x in ("gone_id", "gone_node", "text_hash"))
    gone = gone.toDF(gone_id, gone_node)
    kept = documents.withColumn(mark, node).join(
        if_small(gone), F.col(mark).eqNullSafe(F.col(gone_node)) & documents[id_col].eqNullSafe(F.col(gone_id)), "left_anti"
    )
    twice = classes.where("first and not alone").groupBy(id_col, "node").count().where("count > 1").select(id_col, "node")
    if twice.limit(1).count():  # only those lose copies: texts without words are classes of their own
        twice_id, twice_node = (fresh(documents, x) for x in ("twice_id", "twice_node"))
        marked = kept.join(
            if_small(twice.toDF(twice_id, twice_node)),
            F.col(mark).eqNullSafe(F.col(twice_node)) & kept[id_col].eqNullSafe(F.col(twice_id)),
            "left",
        )
        single = F.col(twice_node).isNull()
        kept = marked.where(single).union(marked.where(~single).dropDuplicates([id_col, mark]))
    return kept.select(documents.columns)
