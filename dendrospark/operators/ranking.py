"""Ranking of hypothesis records by how much they shifted belief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.functions.scalar import belief_label, direction
from dendrospark.operators.ordering import global_rank


def split_missing(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a readable surprisal, with ``score`` and ``priority``, and the dropped ones."""
    s = F.expr("try_cast(surprisal as double)")
    ranked = records.filter(s.isNotNull()).withColumn("score", s).withColumn(
        "priority", F.coalesce(F.expr("try_cast(posterior as double)"), F.lit(0.0)) * F.abs("score"))
    return ranked, records.filter(s.isNull())


def rank_order(mode: str = "surprise") -> list[Column]:
    """Score descending, then run, then id: whole-number ids first and by value."""
    if mode not in ("surprise", "posterior-surprise"):
        raise ValueError("mode is 'surprise' or 'posterior-surprise'")
    score = F.col("priority") if mode == "posterior-surprise" else F.abs("score")
    number = F.expr("try_cast(id as bigint)")
    return [score.desc(), F.col("run"), number.isNull(), F.coalesce(number, F.lit(0)), F.col("id")]


def rank_hypotheses(records: DataFrame, mode: str = "surprise", top: int | None = None) -> DataFrame:
    ranked, _ = split_missing(records)
    out = global_rank(ranked, rank_order(mode), "rank")
    return out if top is None else out.filter(F.col("rank") <= top)


def hypothesis_records(ranked: DataFrame) -> DataFrame:
    """Compact record of each ranked hypothesis."""
    def text(c):
        return F.coalesce(F.trim(c), F.lit("")).alias(c.split(".")[-1])

    return ranked.select(
        "rank", "run", "source_file", "id", F.coalesce("status", F.lit("")).alias("status"), F.round("score", 4).alias("surprisal"),
        F.round(F.abs("score"), 4).alias("surprise_magnitude"), F.round("priority", 4).alias("priority_score"),
        F.coalesce("isSurprising", F.abs("score") >= 0.3).alias("is_surprising"), F.round("prior", 4).alias("prior"),
        F.round("posterior", 4).alias("posterior"), belief_label(F.col("prior")).alias("belief_before"),
        belief_label(F.col("posterior")).alias("belief_after"), direction(F.col("prior"), F.col("posterior")).alias("direction"),
        text("hypothesis"), text("experimentPlan.objective"), text("analysis"), text("review"))


def rank_summary(records: DataFrame, top: int | None = None) -> DataFrame:
    """Counts of the ranking and the extremes of its scores."""
    s = F.abs(F.expr("try_cast(surprisal as double)"))
    out = records.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(s).alias("n_ranked"), F.count_if(s.isNull()).alias("n_dropped"),
        F.round(F.max(s), 4).alias("magnitude_max"), F.round(F.min(s), 4).alias("magnitude_min"),
        F.countDistinct("run").alias("n_files"))
    return out.withColumn("n_returned", F.col("n_ranked") if top is None else F.least(F.col("n_ranked"), F.lit(top)))
