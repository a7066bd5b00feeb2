"""Rarity levels: a pure function of id and level column, min(Geometric(1/2), 40)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level columns of a collection, and the largest level.
COLUMNS = 10
MOST = 40


def level(item: Column, j: int) -> Column:
    """1 + the leading zeros of 40 hashed bits."""
    digest = F.md5(F.concat(F.lit(f"L{j}:"), item.cast("string")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")
    return (F.lit(MOST + 1) - F.length(F.bin(bits))).cast("int")


def all_levels(item: Column) -> list[Column]:
    return [level(item, j).alias(f"level_{j}") for j in range(COLUMNS)]


def level_sql(item: str, j: int | str) -> str:
    """The same in DuckDB's SQL; j is a number or an expression."""
    return f"cast(41 - length(bin(cast('0x' || substr(md5(concat('L', {j}, ':', cast({item} as varchar))), 1, 10) as bigint))) as int)"
