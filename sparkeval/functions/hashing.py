"""Digests as native expressions: framed hashes, HMAC-SHA256, derived seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def frame(*parts: Column) -> Column:
    """Each part (text or binary) behind its length as 8 big-endian bytes."""
    pieces = []
    for p in parts:
        b = p.cast("binary")
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b]
    return F.concat(*pieces)


def sha256_bytes(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _pad(seed8: bytes, fill: int) -> bytes:
    return bytes(b ^ fill for b in seed8.ljust(BLOCK, b"\0"))


def hmac_sha256(seed: int, message: Column) -> Column:
    """Hex HMAC-SHA256 of ``message`` under the seed as 8 big-endian bytes."""
    key = seed.to_bytes(8, "big")
    inner = sha256_bytes(F.concat(F.lit(_pad(key, 0x36)), F.encode(message, "UTF-8")))
    return F.sha2(F.concat(F.lit(_pad(key, 0x5C)), inner), 256)


def hmac_sha256_by(key16: Column, message: Column) -> Column:
    """The same with a key for each row, as 16 hex digits."""

    def pad(fill: int) -> Column:
        word = F.conv(key16, 16, -10).cast("long").bitwiseXOR(F.lit(int.from_bytes(bytes([fill] * 8), "big", signed=True)))
        return F.unhex(F.concat(F.lpad(F.hex(word), 16, "0"), F.lit(f"{fill:02X}" * (BLOCK - 8))))

    return F.sha2(F.concat(pad(0x5C), sha256_bytes(F.concat(pad(0x36), F.encode(message, "UTF-8")))), 256)


def hex_u64(hex16: Column) -> Column:
    """16 hex digits as decimal(20,0): the unsigned 64-bit value."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def task_seed(seed: int, key: Column, repetition: Column) -> Column:
    """The first 8 bytes of sha256(seed as 8 bytes, key, repetition as 4 bytes), unsigned."""
    data = F.concat(F.lit(seed.to_bytes(8, "big")), F.encode(key, "UTF-8"), F.unhex(F.lpad(F.hex(repetition.cast("long")), 8, "0")))
    return hex_u64(F.substring(F.sha2(data, 256), 1, 16))
