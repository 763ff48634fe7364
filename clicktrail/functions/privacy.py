"""Keyed pseudonyms (F5): HMAC-SHA1 (RFC 2104) as a Spark expression, no Python at run time."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # SHA-1 block size in bytes


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """(key xor ipad, key xor opad); keys longer than a block are hashed first."""
    k = key.encode("utf-8")
    if len(k) > BLOCK:
        k = hashlib.sha1(k).digest()
    k = k.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha1(value: Column, key: str) -> Column:
    """Hex HMAC-SHA1 of the UTF-8 bytes of ``value`` under ``key``; NULL in, NULL out."""
    inner_pad, outer_pad = hmac_pads(key)
    inner = F.unhex(F.sha1(F.concat(F.unhex(F.lit(inner_pad.hex())), F.encode(value, "UTF-8"))))
    return F.sha1(F.concat(F.unhex(F.lit(outer_pad.hex())), inner))


def hmac_sha1_sql(value_sql: str, key: str) -> str:
    """The same construction in DuckDB SQL (for oracles)."""
    inner_pad, outer_pad = hmac_pads(key)
    inner = f"unhex(sha1(unhex('{inner_pad.hex()}') || encode({value_sql})))"
    return f"sha1(unhex('{outer_pad.hex()}') || {inner})"
