"""Writers for graphs, reports, ledgers and split assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrospark.operators.metrics import METRIC_NAMES


def write_skeletons(path: str, nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> None:
    """Tables partitioned by brain, as ``read_skeletons`` expects them."""
    for name, df in (("nodes", nodes), ("edges", edges), ("meta", meta)):
        df.write.mode("overwrite").partitionBy("brain_id").parquet(f"{path}/{name}")


def write_results(per_neuron: DataFrame, root: str, brain_id: str, segmentation_id: str) -> None:
    names = {k: v for k, v in METRIC_NAMES.items() if k in per_neuron.columns and k != "split_accuracy"}
    per_neuron.select("neuron", *[F.col(k).alias(v) for k, v in names.items()]).write.mode("overwrite").csv(
        f"{root}/{brain_id}/{segmentation_id}/results.csv", header=True)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def write_text_report(lines: DataFrame, path: str) -> None:
    """Report lines in order; a report is a dozen lines, so one file."""
    lines.orderBy("pos").coalesce(1).select("line").write.mode("overwrite").text(path)


def append_ledger(rows: DataFrame, run_path: str) -> None:
    rows.write.mode("append").json(f"{run_path}/ledger.jsonl")


def write_split(parts: DataFrame, path: str, seed: int, fraction: float) -> None:
    parts.withColumns({"seed": F.lit(seed), "fraction": F.lit(fraction)}).write.mode("overwrite").parquet(path)
