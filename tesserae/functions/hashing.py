"""Keyed hashing, byte packing and id derivation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def be(value: Column, width: int) -> Column:
    """Unsigned big-endian bytes of an integer column."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def prefixed(data: Column, width: int = 2) -> Column:
    """Length prefix plus the bytes, so that neighbouring fields cannot run together."""
    return F.concat(be(F.octet_length(data), width), data)


def netstrings(*texts: Column) -> Column:
    """``length:text`` for each text, joined; the length counts UTF-8 bytes."""
    parts = []
    for t in texts:
        t = t.cast("string")
        parts += [F.octet_length(t).cast("string"), F.lit(":"), t]
    return F.concat(*parts)


def hmac_hex(inner_pad: Column, outer_pad: Column, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex; the pads are the key already XORed with the HMAC constants."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def hash_fraction(hex_digest: Column) -> Column:
    """First 52 bits of a hex digest as a double in [0, 1); keeps the digest's order."""
    bits = F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(1 << 52))


def derive_seed(*parts: Column) -> Column:
    """60-bit sub-seed from joined parts (60 bits stay inside a signed bigint)."""
    digest = F.sha2(utf8(F.concat_ws("|", *[p.cast("string") for p in parts])), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(seed: Column, label: str) -> Column:
    """A uniform double in [0, 1) drawn from a seed under a label."""
    return hash_fraction(F.sha2(utf8(F.concat_ws("|", seed.cast("string"), F.lit(label))), 256))


def run_id(*parts: Column) -> Column:
    """16 hex digits identifying one configuration."""
    return F.substring(F.sha2(utf8(F.concat_ws("|", *[p.cast("string") for p in parts])), 256), 1, 16)


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)
