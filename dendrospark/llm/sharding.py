"""Shards by a keyed permutation of row numbers.

Every row has a global number (rows sorted by id, then checksum and size). A Feistel network on the smallest even
number of bits that holds all numbers permutes them; numbers that fall outside the table walk on along their cycle until
they are inside. With ``p`` the permuted number, the shard is ``p mod shards`` and the slot ``p div shards``: both can be
computed for any row number alone, sizes differ by one row at most, and the same seed gives the same shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrospark.llm.common import with_row_key
from dendrospark.operators.ordering import global_rank
from dendrospark.session import cut

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> np.ndarray:
    steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(steps + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))


def half_bits(n: int) -> int:
    """Bits of one half of the smallest balanced block that holds 0 .. n-1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Image of each number in 0 .. n-1 under the permutation of 0 .. n-1 that ``seed`` names."""
    half = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return (left << half) | right

    out = once(np.asarray(numbers, dtype=np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while outside.size:  # fewer than four steps on average: the block is less than four times the table
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int, seed: int = 20240917) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, shard, slot`` for every row of ``docs`` (``doc_id``, ``text``).

    A null text counts as no bytes (size 16, checksum of nothing). Null ids sort first; repeated rows each get a number
    of their own; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = cut(with_row_key(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"))))
    n = narrow.count()
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_rid")]
    ranked = global_rank(narrow, order, "_rank").withColumn("row_number", F.col("_rank") - 1)

    @F.pandas_udf("bigint")
    def image(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    return ranked.withColumn("_p", image("row_number")).select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {int(shards)}").cast("bigint").alias("slot"))


def op2_shards(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39, counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")
