"""Checksums and 64-bit perceptual hashes read from whatever spelling the catalogue holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Checksums of the empty file.
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_SPACE = r"[\s\p{Z}\p{Cf}\p{Cc}]"


def phash64(c: Column) -> Column:
    """A perceptual hash in hex as a signed 64-bit number; null where it is zero, blank or unreadable.

    Upper or lower case, a 0x prefix, surrounding white space, separators and missing leading zeros are
    accepted; the bits are those of the unsigned number.
    """
    digits = F.regexp_extract(F.lower(F.regexp_replace(c, _SPACE + r"|[:_-]", "")), r"^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    value = F.conv(F.when(digits != "", digits), 16, -10).cast("bigint")
    return F.when(value != 0, value)


def checksum(c: Column, kind: str) -> Column:
    """An md5 or sha256 as bytes, from hex or base64, prefixed or not; null for a checksum of nothing."""
    size, empty = {"md5": (16, EMPTY_MD5), "sha256": (32, EMPTY_SHA256)}[kind]
    bare = F.regexp_replace(F.regexp_replace(c, _SPACE, ""), rf"(?i)^{kind}[:=-]", "")
    plain = F.lower(F.regexp_replace(F.regexp_replace(bare, r"(?i)^0x", ""), "[:-]", ""))
    base = F.rtrim(F.translate(bare, "-_", "+/"), F.lit("="))
    chars = -(-size * 8 // 6)
    padded = F.rpad(base, -(-size // 3) * 4, "=")
    hexed = F.when(plain.rlike(f"^[0-9a-f]{{{2 * size}}}$"), plain).when(
        base.rlike(rf"^[A-Za-z0-9+/]{{{chars}}}$"), F.lower(F.hex(F.try_to_binary(padded, F.lit("base64"))))
    )
    return F.when(~hexed.isin("0" * 2 * size, empty) & (F.length(hexed) == 2 * size), F.unhex(hexed))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def byte_chunk(value: Column, i: int) -> Column:
    """Byte ``i`` (0 the lowest) of a 64-bit number."""
    return F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))
