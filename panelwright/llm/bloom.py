"""A blocked Bloom filter as a table, in DataFrame operations: a block of four 64-bit words, one bit of each for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: Keys a block is meant to hold: 256 bits for 16 keys.
BLOCK_KEYS = 16
WORDS = 4


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // BLOCK_KEYS))


def _place(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and its bit in each of the block's words."""
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({key}, 'bits'), {6 * i}) & 63 as int))")
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)), [bit(i) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column's values: block long, w0..w3 long; at most a row for each block."""
    block, bits = _place(key, blocks)
    marked = keys.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return marked.groupBy("block").agg(*[F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)])


def may_hold(rows: DataFrame, key: str, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """rows whose key the filter lets through: all that it holds, and a few others."""
    block, bits = _place(key, blocks)
    tried = rows.select("*", block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    passed = tried.join(small(filter_rows, blocks), "block").where(" AND ".join(f"(w{i} & b{i}) <> 0" for i in range(WORDS)))
    return passed.select(*rows.columns)
