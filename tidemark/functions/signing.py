"""Signatures of query strings in plain expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of the message's UTF-8 bytes."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def canonical(params: Column) -> Column:
    """What is signed: all parameters of a map but `sig`, in order of name, as k=v joined by &."""
    entries = F.array_sort(F.map_entries(F.map_filter(params, lambda k, v: k != "sig")))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
