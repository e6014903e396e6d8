"""Bit tables of a fixed largest size, built by an aggregation and tested inside
a row: a first filter before a join whose other side can be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest table, in 64-bit words (1 MiB); fuller tables only let more rows pass.
MOST_WORDS = 1 << 17


def table_size(members: int, bits_each: int = 64) -> int:
    """Words of a table for so many members, a power of two from 64 to MOST_WORDS."""
    size = 64
    while size * 64 < members * bits_each and size < MOST_WORDS:
        size *= 2
    return size


def build(hashes: DataFrame, col: str, size: int) -> Column:
    """A constant array<long> with two bits set for each hash in ``col``.

    At most ``size`` cells reach the driver, whatever the number of rows.
    """
    m = size * 64 - 1
    bit = F.explode(F.array(F.col(col).bitwiseAND(F.lit(m)), F.shiftrightunsigned(F.col(col), 32).bitwiseAND(F.lit(m))))
    cells = (
        hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    )
    table = [0] * size
    for r in cells.toLocalIterator():
        table[r["cell"]] = r["v"]
    return F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")


def has(table: Column, size: int, h: Column) -> Column:
    """Whether both bits of hash ``h`` are set."""
    m = size * 64 - 1

    def is_set(x: Column) -> Column:
        cell = F.get(table, F.shiftright(x, 6).cast("int"))
        return F.call_function("shiftrightunsigned", cell, x.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return is_set(h.bitwiseAND(F.lit(m))) & is_set(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(m)))
