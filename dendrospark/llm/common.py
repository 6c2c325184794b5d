"""What the operators of this subpackage share: table access, words, row keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters (fixed by the data contract).
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def with_row_key(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A key for every row, also for repeated ones. Write the table before using the key twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def batches(rows: Iterable[pa.RecordBatch], columns: Sequence[str], most: int = 512):
    """Small slices of Arrow batches as lists of Python values, one list per column."""
    for batch in rows:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield part, [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
