"""HMAC-SHA256 webhook signatures as native expressions.

HMAC(k, m) = H((k' ^ opad) || H((k' ^ ipad) || m)). The key is a constant,
so both padded keys are binary literals and the whole digest is two
``sha2`` calls on binary columns: no Python in the scan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(payload: Column, secret: str) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary (or string, as UTF-8) column."""
    ipad, opad = _pads(secret)
    body = payload.cast("binary")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), body), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def signature_header(payload: Column, secret: str) -> Column:
    """The ``sha256=<hex>`` header value."""
    return F.concat(F.lit("sha256="), hmac_sha256_hex(payload, secret))


def signature_ok(payload: Column, signature: Column, secret: str) -> Column:
    """header matches; an empty secret turns verification off."""
    if not secret:
        return F.lit(True)
    return F.coalesce(signature == signature_header(payload, secret), F.lit(False))
