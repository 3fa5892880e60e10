"""Event deliveries: size, authenticity, routing, decoding, review jobs.

The same row-wise expressions serve batch tables and streams; no step needs a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.crypto import hmac_sha256_hex
from reviewlake.functions.once import with_once
from reviewlake.functions.jsonio import decode_envelope, envelope_ok, envelope_value, repeated_keys, zero_filled
from reviewlake.schemas import PULL_REQUEST_EVENT

# Limits and names of the delivery contract.
MAX_BODY_BYTES = 25 * 1024 * 1024
SIGNATURE_PREFIX = "sha256="
REVIEW_EVENT = "pull_request"
REVIEW_ACTIONS = ("opened", "synchronize")
STATUS_OK, STATUS_ACCEPTED = 200, 202
STATUS_BAD_REQUEST, STATUS_UNAUTHORIZED = 400, 401


def classify_deliveries(deliveries: DataFrame, secret: bytes, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Add ``status`` and the decoded ``event`` to every delivery; a body over ``max_bytes`` is neither hashed nor read."""
    repeated_keys(deliveries.sparkSession)
    expected = F.concat(F.lit(SIGNATURE_PREFIX), hmac_sha256_hex(secret, F.col("body")))
    small = F.octet_length("body") <= max_bytes
    authentic = F.coalesce(F.col("signature") == expected, F.lit(False))
    routed = F.coalesce(F.col("event_type") == REVIEW_EVENT, F.lit(False))

    # The gate keeps the decoder off rows an earlier test settles.
    df = with_once(
        deliveries,
        __gate=F.when(~small, "oversized")
        .when(~authentic, "forged")
        .when(~routed, "other")
        .otherwise("decode"),
    )
    body_text = F.col("body").cast("string")
    df = with_once(
        df,
        __envelope=F.when(F.col("__gate") == "decode", decode_envelope(body_text, PULL_REQUEST_EVENT)),
    )
    df = df.withColumn("__ok", envelope_ok(F.col("__envelope")))
    value = envelope_value(F.col("__envelope"))
    df = df.withColumn("event", F.when(F.col("__ok"), zero_filled(value, PULL_REQUEST_EVENT)))
    status = (
        F.when(F.col("__gate") == "oversized", STATUS_BAD_REQUEST)
        .when(F.col("__gate") == "forged", STATUS_UNAUTHORIZED)
        .when(F.col("__gate") == "other", STATUS_OK)
        .when(~F.col("__ok"), STATUS_BAD_REQUEST)
        .when(F.col("event.action").isin(*REVIEW_ACTIONS), STATUS_ACCEPTED)
        .otherwise(STATUS_OK)
    )
    return df.withColumn("status", status).drop("__gate", "__envelope", "__ok")


def delivery_status(deliveries: DataFrame, secret: bytes, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    return classify_deliveries(deliveries, secret, max_bytes).select("delivery_id", "status")


def review_jobs(deliveries: DataFrame, secret: bytes, *carry: str) -> DataFrame:
    """Jobs of the accepted deliveries; ``carry`` names delivery columns to keep."""
    accepted = classify_deliveries(deliveries, secret).where(F.col("status") == STATUS_ACCEPTED)
    return accepted.select(
        *carry,
        F.col("event.installation.id").alias("installation_id"),
        F.col("event.repository.full_name").alias("repo_full_name"),
        F.col("event.repository.owner.login").alias("owner"),
        F.col("event.repository.name").alias("repo_name"),
        F.col("event.number").alias("pr_number"),
        F.col("event.pull_request.head.sha").alias("head_sha"),
        F.col("event.pull_request.base.sha").alias("base_sha"),
    )
