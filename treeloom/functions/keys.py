"""The 32-byte object key as column expressions.

One header byte (object type in the high nibble, bit 3 zero, size of the length field less one in the
low bits), the length in as few big-endian bytes as hold it, and as much of the digest as fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOB, FILE_NODE, DIR_LEAF, DIR_NODE, XATTR_SET = range(5)
# The types' names by number.
TYPE_NAMES = ("Blob", "FileNode", "DirLeaf", "DirNode", "XattrSet")


def digest(payload: Column) -> Column:
    """SHA-256 of a payload, the digest that SQL engines share; codec.blake3 has the other mode."""
    return F.unhex(F.sha2(payload.cast("binary"), 256))


def key(otype: Column | int, length: Column, digest_of: Column) -> Column:
    """The key of an object of a type, a logical length and the digest of its bytes."""
    otype = F.lit(otype) if isinstance(otype, int) else otype
    digits = F.hex(length.cast("long"))
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    size = (F.length(even) / 2).cast("int")
    header = F.lpad(F.hex((otype * 16 + size - 1).cast("long")), 2, "0")
    return F.concat(F.unhex(header), F.unhex(even), F.substring(digest_of, F.lit(1), F.lit(31) - size))


def text(k: Column) -> Column:
    """A key in lower-case hex."""
    return F.lower(F.hex(k))


def byte(k: Column, at: int) -> Column:
    """The byte at a place, from 1, as an integer."""
    return F.conv(F.hex(F.substring(k, at, 1)), 16, 10).cast("int")


def type_of(k: Column) -> Column:
    return F.shiftright(byte(k, 1), 4)


def length_size(k: Column) -> Column:
    return byte(k, 1).bitwiseAND(F.lit(7)) + 1


def length(k: Column) -> Column:
    """The logical length; null beyond a signed long."""
    digits = F.hex(F.substring(k, F.lit(2), length_size(k)))
    return F.conv(digits, 16, 10).try_cast("long")


def hash_of(k: Column) -> Column:
    return F.substring(k, F.lit(2) + length_size(k), F.lit(31) - length_size(k))


def type_name(t: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*[F.lit(x) for x in TYPE_NAMES]), F.when(t.between(0, 4), t + 1)), F.concat(F.lit("Type("), t.cast("string"), F.lit(")")))


def error(k: Column) -> Column:
    """The first rule that a key breaks, in this order; null if it is valid."""
    return (
        F.when(F.octet_length(k) != 32, "length")
        .when(byte(k, 1).bitwiseAND(F.lit(8)) != 0, "reserved bit")
        .when(type_of(k) > 4, "reserved type")
        .when((byte(k, 2) == 0) & (length_size(k) > 1), "non-canonical length")
    )
