"""Ranks and running totals over a whole table, without a single-task window.

Rows are range partitioned and written once, so that partition numbers cannot
change under re-computation; each partition is numbered on its own and shifted
by what lies in the partitions before it (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.session import cut


def _partitioned(df: DataFrame, order: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _shifted(parts: DataFrame, local: DataFrame, total: Column, local_col: str, out: str) -> DataFrame:
    sizes = parts.groupBy("_part").agg(total.alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return local.join(F.broadcast(shift), "_part").withColumn(out, F.col(local_col) + F.col("_shift")).drop("_part", "_shift")


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row in the given total order."""
    parts = _partitioned(df, order)
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return _shifted(parts, local, F.count(F.lit(1)), "_local", out).withColumn(out, F.col(out).cast("bigint")).drop("_local")


def running_total(df: DataFrame, order: list[Column], value: str, out: str = "running") -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one; ``order`` must be unique."""
    parts = _partitioned(df, order)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _shifted(parts, parts.withColumn("_local", F.sum(value).over(upto)), F.sum(value), "_local", out).drop("_local")


def ntile(df: DataFrame, order: list[Column], k: int, out: str = "tile") -> DataFrame:
    """Equal-sized bins 1..k; the first n mod k bins hold one row more."""
    ranked = global_rank(df, order, "_rank")
    n = df.count()
    size, extra = divmod(n, k)
    edge = extra * (size + 1)
    tile = F.when(F.col("_rank") <= edge, F.floor((F.col("_rank") - 1) / F.lit(size + 1)) + 1).otherwise(
        extra + F.floor((F.col("_rank") - 1 - edge) / F.lit(max(size, 1))) + 1)
    return ranked.withColumn(out, tile.cast("int")).drop("_rank")


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact percentiles (linear between neighbours) under the given names.

    Found by running counts of distinct values, so the values are never gathered in one aggregate and ties are one row.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    counts = known.groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = cut(running_total(counts, [F.col("_v")], "_c", "_r"))
    n = ranked.agg(F.sum("_c")).first()[0] or 0
    wanted = {name: p * (n - 1) for name, p in shares.items()}

    def at(w: float) -> Column:
        low, part = int(w), w - int(w)
        holds = lambda place: (F.col("_r") >= place) & (F.col("_r") - F.col("_c") < place)
        first = F.max(F.when(holds(low + 1), F.col("_v")))
        second = F.coalesce(F.max(F.when(holds(low + 2), F.col("_v"))), first)
        return first + F.lit(part) * (second - first)

    return ranked.agg(*[at(w).alias(name) for name, w in wanted.items()])
