"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import ann, decontaminate, fim, langid, licenses, line_dedup, merkle, mixing, ngram_join, pii, secrets, toxicity, warc
from reviewlake.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the labelled ones."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(toxicity.sample(documents, table(spark, sf_dir, "labels")))
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "clauses",
    )


def listed(spans: str) -> F.Column:
    """An array of spans as text."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digests of the spans found."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of similar documents of every document."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    documents = table(spark, sf_dir, "documents")
    found = documents.select("doc_id", langid.language(langid.fit(documents), documents).alias("found"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.bits_per_byte"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in every document."""
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "dice", F.array_join("licenses", ",").alias("licenses"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: lines before and after, and a digest of the text left."""
    documents = table(spark, sf_dir, "documents")

    def lines(text: str) -> F.Column:
        breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
        return F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(breaks + 1).cast("bigint")

    left = line_dedup.drop_repeated_lines(documents.select("doc_id", "text", lines("text").alias("n_lines")))
    return left.select("doc_id", "n_lines", lines("text").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tempered mix: every document's place in every pass over its source."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "pass", "block", "place")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read all records back by the index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and reordered for infilling: part lengths, digests of the output and of the text restored."""
    found = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest: digests, proof, and the verdict on a copy of which a seventh is tampered with."""
    documents = table(spark, sf_dir, "documents")
    chosen = F.coalesce(F.crc32(documents["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    found = merkle.dataset(
        documents,
        "doc_id",
        "lang",
        ["doc_id", "source", "lang", "n_chars", "text"],
        tampered={"n_chars": documents["n_chars"].cast("decimal(20,0)") + 1},
        where=chosen,
    )
    return merkle.proofs(found).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document and the terms that give it away: counts and digests of the spans."""
    found = pii.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = f"filter(spans, s -> s.kind in {pii.KINDS})"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scans": op2_secret_scans,
    "op3_ngram_join": op3_ngram_join,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_nearest": op7_nearest,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_personal_data": op13_personal_data,
}
