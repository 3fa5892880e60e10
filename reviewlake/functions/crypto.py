"""Keyed message digests from built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256_hex(secret: bytes, body: Column) -> Column:
    """HMAC-SHA256 of a binary column under one secret, as lower-case hex."""
    key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, body), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)
