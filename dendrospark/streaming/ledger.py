"""Running totals over ledger folders that are still being appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.operators.report import ledger_summary
from dendrospark.sources.readers import LEDGER_SCHEMA


def ledger_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New ledger files as they arrive."""
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path).filter(
        F.col("generation").isNotNull())


def summary_stream(spark: SparkSession, path: str) -> DataFrame:
    """The ledger summary, kept up to date; write it with output mode ``complete``."""
    return ledger_summary(ledger_stream(spark, path))
