"""Native column expressions over block and frame bytes; no Python runs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from colpack.functions.codec import OVERHEAD


def _reversed_hex(hexed: Column, n_bytes: int) -> Column:
    return F.concat(*(F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(n_bytes))))


def le_bytes(value: Column, n_bytes: int) -> Column:
    """A whole number as little-endian bytes, negative ones in two's complement."""
    hexed = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(_reversed_hex(F.substring(hexed, 17 - 2 * n_bytes, 2 * n_bytes), n_bytes))


def parse_le(data: Column, start: int, n_bytes: int) -> Column:
    """The unsigned little-endian number in n_bytes (at most 8) from byte start on, counted from 1."""
    return F.conv(_reversed_hex(F.hex(F.substring(data, start, n_bytes)), n_bytes), 16, -10).cast("bigint")


def is_block(data: Column) -> Column:
    return F.substring(data, 1, 4) == F.encode(F.lit("CPK1"), "utf-8")


def content_size(block: Column) -> Column:
    """Raw length of a block from its header, without decoding; null for other bytes."""
    return F.when(is_block(block) & (F.octet_length(block) >= 16), parse_le(block, 9, 8))


def dtype_of(block: Column) -> Column:
    """Number of the element type of a block, 0 for plain bytes."""
    return F.when(is_block(block) & (F.octet_length(block) >= 16), parse_le(block, 7, 1).cast("int"))


def compress_bound(data: Column) -> Column:
    return F.octet_length(data) + F.lit(OVERHEAD)


def int64_from_le(data: Column) -> Column:
    """Little-endian bytes as an array of bigint; a length that is no multiple of 8 gives null."""
    hexed = F.hex(data)
    n = F.octet_length(data)
    one = lambda i: F.conv(F.concat(*(F.substring(hexed, 16 * i + 2 * j + 1, F.lit(2)) for j in reversed(range(8)))), 16, -10).cast("bigint")
    none = F.array().cast("array<bigint>")
    return F.when(n == 0, none).when(n % 8 == 0, F.transform(F.sequence(F.lit(0), (n / 8).cast("int") - 1), one))


def reinterpret_i64_as_i32(values: Column) -> Column:
    """The int32 elements that the little-endian bytes of int64 elements hold: low half, then high half."""
    return F.flatten(F.transform(values, lambda x: F.array(F.shiftright(F.shiftleft(x, 32), 32).cast("int"), F.shiftright(x, 32).cast("int"))))
