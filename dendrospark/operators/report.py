"""Comparison across data sets, run ledgers and failure reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.operators.metrics import ERROR_METRICS, METRIC_NAMES, QUALITY_METRICS, weighted_mean

# Metrics that can be compared between brains of different size, and the verdict limit.
NORMALIZED = ["pct_split", "pct_omit", "pct_merged", "edge_accuracy", "normalized_erl"]
CONSISTENT_CV = 0.25


def dataset_means(results: DataFrame, metrics: Sequence[str], by: str = "brain_id") -> DataFrame:
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n_neurons"), *[F.avg(m).alias(m) for m in metrics])


def cross_dataset_cv(means: DataFrame, metrics: Sequence[str], by: str = "brain_id", normalized: Sequence[str] = tuple(NORMALIZED)) -> DataFrame:
    """Spread of the data set means per metric: mean, population deviation, extremes, variation, verdict."""
    long = means.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([by], list(metrics), "metric", "value")
    out = long.groupBy("metric").agg(
        F.avg("value").alias("mean_of_means"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.struct("value", by))[by].alias("lowest"), F.max(F.struct("value", by))[by].alias("highest"))
    cv = F.try_divide(F.col("std"), F.abs("mean_of_means"))
    return out.withColumns({"cv": cv, "scale_normalized": F.col("metric").isin(list(normalized))}).withColumn(
        "verdict", F.when(F.col("cv") < CONSISTENT_CV, "consistent").otherwise("diverges"))


def consistency_ends(cv: DataFrame) -> DataFrame:
    """Most and least consistent of the normalised metrics."""
    n = cv.filter(F.col("scale_normalized"))
    return n.agg(F.min("cv").alias("min_cv"), F.max("cv").alias("max_cv"), F.min(F.struct("cv", "metric"))["metric"].alias("most_consistent"),
                 F.max(F.struct("cv", "metric"))["metric"].alias("least_consistent"))


# --- ledger ---------------------------------------------------------------------------------------------------------


def ledger_summary(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Generations, accepted ones, best held-out value (undefined ones ignored) and totals."""
    held = F.when(~F.isnan("heldout_primary"), F.col("heldout_primary"))
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_generations"), F.count_if("accepted").alias("n_accepted"), F.max(held).alias("best_heldout"),
        F.sum("wall_seconds").alias("wall_seconds"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("human_interventions").alias("human_interventions"))


def run_facts(ledger: DataFrame, by: str = "run_id") -> DataFrame:
    """Baseline (the bar of the first generation), final value, net gain and cost per run."""
    held = F.when(~F.isnan("heldout_primary"), F.col("heldout_primary"))
    facts = ledger.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_generations"), F.count_if("accepted").alias("n_accepted"),
        F.min(F.struct("generation", "parent_heldout"))["parent_heldout"].alias("baseline_heldout"), F.max(held).alias("final_heldout"),
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("total_cost_usd"))
    return facts.withColumns({"brain_id": F.split(F.col(by).cast("string"), "_")[0],
                              "net_heldout_gain": F.col("final_heldout") - F.col("baseline_heldout")})


def accepted_generations(ledger: DataFrame, by: str = "run_id") -> DataFrame:
    return ledger.filter("accepted").select(by, "generation", "heldout_primary", "candidate_path")


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Value of the newest row per key (newest run per brain, last accepted generation)."""
    return df.groupBy(key).agg(F.max(F.struct(order, value)).alias("_m")).select(key, f"_m.{order}", f"_m.{value}")


# --- candidate reports ----------------------------------------------------------------------------------------------

DELTA = ["edge_accuracy", "pct_merged", "n_merges", "pct_split", "n_splits", "pct_omit"]


def per_neuron_delta(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Candidate minus baseline per neuron; the rows of the candidate decide."""
    b = baseline.select("neuron", *[F.col(m).alias(f"_{m}") for m in DELTA])
    return candidate.join(b, "neuron", "left").select(
        *[c for c in ("candidate_id",) if c in candidate.columns], "neuron", *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in DELTA])


def regressions(delta: DataFrame) -> DataFrame:
    return delta.filter(F.col("d_edge_accuracy") < 0)


def headline(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Weighted means of the report's four metrics before and after."""
    names = ["edge_accuracy", "pct_merged", "n_merges", "pct_split"]
    base = baseline.select("neuron", *[F.col(m).alias(f"base_{m}") for m in names])
    keys = [c for c in ("candidate_id",) if c in candidate.columns]
    both = [*names, *[f"base_{m}" for m in names]]
    return candidate.join(base, "neuron", "left").groupBy(*keys).agg(*[weighted_mean(m).alias(m) for m in both])


def targets_in_split(incidence: DataFrame, names: DataFrame, min_nodes: int = 50) -> DataFrame:
    """Merge labels with the count of involved neurons, overall and inside the reported part.

    A report lists a label when two or more of its neurons are inside; both
    counts are given, so that merges across the split do not go unseen.
    """
    inside = names.select("neuron").distinct().withColumn("_in", F.lit(1))
    return incidence.filter(F.col("n_nodes") > min_nodes).join(inside, "neuron", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_neurons"), F.count("_in").alias("n_inside"),
        F.sum(F.when(F.col("_in") == 1, F.col("n_nodes")).otherwise(0)).alias("n_nodes_inside")).filter(
        F.col("n_neurons") >= 2).withColumn("listed", F.col("n_inside") >= 2)


def failure_report(candidate: DataFrame, baseline: DataFrame, incidence: DataFrame, merges: DataFrame, edits: DataFrame,
                   names: DataFrame, min_nodes: int = 50, nodes: DataFrame | None = None, label: str = "raw_label") -> dict[str, DataFrame]:
    """The parts of a candidate's report as tables. With the true ``nodes`` also ``target_sites``: where each listed
    merge label lies on each neuron inside, with the node count."""
    from dendrospark.operators.edits import edit_histogram, render_edits
    from dendrospark.operators.metrics import target_neurons

    mine = candidate.join(names.select("neuron"), "neuron", "left_semi")
    delta = per_neuron_delta(mine, baseline)
    targets = targets_in_split(incidence, names, min_nodes).filter("listed")
    sites = {}
    if nodes is not None:
        sites["target_sites"] = target_neurons(nodes, label, min_nodes).join(targets.select("label"), "label", "left_semi").join(
            names.select("neuron").distinct(), "neuron", "left_semi")
    return sites | {
        "headline": headline(mine, baseline), "delta": delta, "regressions": regressions(delta),
        "targets": targets.orderBy(F.col("n_nodes_inside").desc(), "label"),
        "caused_merges": merges.filter("caused_by_edit").join(names.select("neuron"), "neuron", "left_semi"),
        "edit_kinds": edit_histogram(edits), "edits": render_edits(edits)}


def format_report(comparison: DataFrame) -> DataFrame:
    """Text lines of a before/after report, in order: ``pos, line``. ``comparison`` is a dozen rows."""
    order = F.create_map(*[F.lit(v) for i, m in enumerate(ERROR_METRICS + QUALITY_METRICS) for v in (METRIC_NAMES[m], i)])
    c = comparison.withColumn("_o", order[F.col("metric")])
    error = F.col("_o") < len(ERROR_METRICS)
    nan = F.lit(float("nan"))

    def num(name):
        return F.coalesce(F.col(name), nan)

    # fixed values: the two line formats of the report
    line = F.when(error, F.format_string("  %s: %.4f -> %.4f (reduction %.4f, corrected %.2f%%)", "metric", num("before"), num("after"),
                                         num("reduction"), num("corrected_pct"))).otherwise(
        F.format_string("  %s: %.4f -> %.4f (delta %.4f, relative %.2f%%)", "metric", num("before"), num("after"), num("delta"), num("relative_change_pct")))
    body = c.select((F.when(error, F.col("_o") + 3).otherwise(F.col("_o") + 5)).cast("int").alias("pos"), line.alias("line"))
    # fixed values: the headings of the report
    heads = [(0, "Proofreading Before/After Summary"), (1, ""), (2, "Error reductions"),
             (len(ERROR_METRICS) + 3, ""), (len(ERROR_METRICS) + 4, "Quality changes")]
    return body.unionByName(comparison.sparkSession.createDataFrame(heads, "pos int, line string")).orderBy("pos")
