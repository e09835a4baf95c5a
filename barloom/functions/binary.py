"""Little-endian packing and unpacking in Spark expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _swap(hexes: Column, size: int) -> Column:
    return F.concat(*[F.substring(hexes, 2 * k + 1, 2) for k in reversed(range(size))])


def le_word(block: Column, index: int, size: int = 4) -> Column:
    """The index-th little-endian word of a binary column, as long; words of 8 bytes are signed, shorter ones are not."""
    return F.conv(_swap(F.hex(F.substring(block, index * size + 1, size)), size), 16, -10).cast("long")


def le_hex_int(value: Column, size: int = 4) -> Column:
    """Hex of an integer, little-endian: of any long in 8 bytes, else of a non-negative one that the caller keeps below 2 ** (8 * size)."""
    return _swap(F.lpad(F.hex(value.cast("long")), 2 * size, "0"), size)
