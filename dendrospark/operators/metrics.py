"""Edge classes, error counts and accuracy metrics of labelled true skeletons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.operators.graph import connected_components
from dendrospark.operators.ordering import exact_percentiles
from dendrospark.operators.spatial import edges_in_patch, nodes_in_patch
from dendrospark.session import cut, side_by_side

# Metric columns and the names used in result files and reports.
METRIC_NAMES = {
    "run_length": "SWC Run Length",
    "edge_accuracy": "Edge Accuracy",
    "split_accuracy": "Split Accuracy",
    "erl": "ERL",
    "normalized_erl": "Normalized ERL",
    "n_splits": "# Splits",
    "n_merges": "# Merges",
    "pct_split": "% Split Edges",
    "pct_omit": "% Omit Edges",
    "pct_merged": "% Merged Edges",
    "split_rate": "Split Rate",
    "merge_rate": "Merge Rate",
}
# Which metrics are tracked, which count errors, which measure quality.
TRACKED = ["edge_accuracy", "split_accuracy", "erl", "normalized_erl", "n_splits", "n_merges", "pct_split", "pct_omit", "pct_merged"]
ERROR_METRICS = ["n_splits", "n_merges", "pct_split", "pct_omit", "pct_merged"]
QUALITY_METRICS = ["erl", "normalized_erl", "edge_accuracy", "split_rate", "merge_rate"]
COUNT_METRICS = ["n_splits", "n_merges"]


def edge_labels(edges: DataFrame, nodes: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Edges with the label of both ends."""
    for end in ("src", "dst"):
        side = nodes.select(*by, F.col("node_id").alias(end), F.col(label).alias(f"label_{end}"))
        edges = edges.join(side, [*by, end])
    return edges


def edge_class(omit_rule: str = "either", a: str = "label_src", b: str = "label_dst") -> Column:
    """``either``: omit when one end is background. ``both``: omit when both are, and background against a label is a split."""
    if omit_rule not in ("either", "both"):
        raise ValueError("omit_rule is 'either' or 'both'")
    zero_a, zero_b = F.col(a) == "0", F.col(b) == "0"
    omit = (zero_a | zero_b) if omit_rule == "either" else (zero_a & zero_b)
    return F.when(omit, "omit").when(F.col(a) != F.col(b), "split").otherwise("correct")


def classify_edges(edges: DataFrame, omit_rule: str = "either") -> DataFrame:
    return edges.withColumn("edge_class", edge_class(omit_rule))


def edge_class_counts(classified: DataFrame, keys: Sequence[str] = (), total_row: str | None = None) -> DataFrame:
    """Counts and percentages per class; ``total_row`` adds one row over everything under that name."""
    counts = [F.count_if(F.col("edge_class") == c).alias(c) for c in ("correct", "split", "omit")]
    grouped = classified.rollup(*keys) if total_row else classified.groupBy(*keys)
    out = grouped.agg(F.count(F.lit(1)).alias("n_edges"), *counts)
    if total_row:
        out = out.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(total_row)) for k in keys})
    return out.withColumns({f"pct_{c}": F.when(F.col("n_edges") > 0, F.lit(100.0) * F.col(c) / F.col("n_edges"))
                            for c in ("correct", "split", "omit")})


def label_neuron_counts(nodes: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Which label touches which neuron, and with how many nodes."""
    known = nodes.filter(F.col(label) != "0")
    return known.groupBy(*by, F.col(label).alias("label"), "neuron").agg(F.count(F.lit(1)).alias("n_nodes"))


def split_counts(incidence: DataFrame, neurons: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct labels minus one per neuron, never below zero."""
    per = incidence.groupBy(*by, "neuron").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n_splits"))
    if neurons is None:
        return per
    return neurons.join(per, [*by, "neuron"], "left").withColumn("n_splits", F.coalesce("n_splits", F.lit(0)))


def merge_segments(incidence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels on two or more neurons: a row per neuron with merges = neurons - 1, so that no label gathers its neurons."""
    spread = incidence.groupBy(*by, "label").agg((F.count(F.lit(1)) - 1).alias("n_merges")).filter(F.col("n_merges") >= 1)
    return incidence.select(*by, "label", "neuron").join(spread, [*by, "label"])


def supported(min_nodes: int, strict: bool = True) -> Column:
    return F.col("n_nodes") > min_nodes if strict else F.col("n_nodes") >= min_nodes


def merge_labels(incidence: DataFrame, min_nodes: int = 50, strict: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Labels that two or more neurons support with enough nodes each."""
    return incidence.filter(supported(min_nodes, strict)).groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n_neurons")).filter(F.col("n_neurons") >= 2)


def merged_edges(edges: DataFrame, merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges whose two ends carry the same merge label."""
    same = edges.filter((F.col("label_src") == F.col("label_dst")) & (F.col("label_src") != "0"))
    return same.join(merged.select(*by, F.col("label").alias("label_src")), [*by, "label_src"], "left_semi")


def merge_targets(nodes: DataFrame, label: str = "label", min_nodes: int = 50, max_sites: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Merge labels with the centroids of their neurons, all of them or the first ``max_sites``.

    One row per label: ``sites`` as structs, by node count descending. ``n_neurons`` and ``n_nodes`` count all
    neurons, also beyond the sites; ``target_neurons`` lists them as rows.
    """
    per = target_neurons(nodes, label, min_nodes, by)
    row = F.struct("place", "neuron", *[F.col(f"c{c}").alias(c) for c in "xyz"], "n_nodes")
    # ranked before they are gathered, so that a limit holds for what is gathered
    first = per if max_sites is None else per.filter(F.col("place") <= max_sites)
    listed = first.groupBy(*by, "label").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    total = per.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_neurons"), F.sum("n_nodes").alias("n_nodes"))
    return total.join(listed, [*by, "label"]).select(
        *by, "label", "n_neurons", "n_nodes", F.transform("_rows", lambda r: r.dropFields("place")).alias("sites"))


def target_neurons(nodes: DataFrame, label: str = "label", min_nodes: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Neurons of the merge labels: ``label, neuron, n_nodes, cx, cy, cz`` and ``place`` by node count descending."""
    known = nodes.filter(F.col(label) != "0")
    per = known.groupBy(*by, F.col(label).alias("label"), "neuron").agg(
        F.count(F.lit(1)).alias("n_nodes"), *[F.round(F.avg(c), 2).alias(f"c{c}") for c in "xyz"])
    per = cut(per.filter(supported(min_nodes)))
    shared = per.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    order = Window.partitionBy(*by, "label").orderBy(F.desc("n_nodes"), "neuron")
    return per.join(shared.drop("_n"), [*by, "label"]).withColumn("place", F.row_number().over(order))


def edge_accuracy() -> Column:
    return F.lit(100.0) - (F.col("pct_split") + F.col("pct_omit") + F.col("pct_merged"))


def with_derived(df: DataFrame) -> DataFrame:
    """Add split accuracy = 100 - % split edges, unless it is there already."""
    if "split_accuracy" in df.columns or "pct_split" not in df.columns:
        return df
    return df.withColumn("split_accuracy", F.lit(100.0) - F.col("pct_split"))


def error_rates(df: DataFrame) -> DataFrame:
    """Cable per split and per merge; NULL when there is none."""
    return df.withColumns({"split_rate": F.try_divide("run_length", "n_splits"), "merge_rate": F.try_divide("run_length", "n_merges")})


# --- run lengths ----------------------------------------------------------------------------------------------------


def error_free_runs(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes with ``run`` = component of the correct edges (both ends share one label, not background)."""
    correct = edges.filter((F.col("label_src") == F.col("label_dst")) & (F.col("label_src") != "0"))
    return connected_components(nodes, correct.select(*by, "src", "dst"), by, out="run")


def erl(edges: DataFrame, nodes: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Expected error-free run length per neuron: sum of squared run lengths over the run length.

    ``edges`` carry ``length`` and both labels. With ``merged`` given, runs under
    a merge label count as zero. This definition is ours, after the published
    flood-filling-networks measure.
    """
    runs = error_free_runs(nodes.select("node_id"), edges)
    correct = edges.filter((F.col("label_src") == F.col("label_dst")) & (F.col("label_src") != "0"))
    lengths = correct.join(runs.select(F.col("node_id").alias("src"), "run"), "src").groupBy(
        "neuron", "run", F.col("label_src").alias("label")).agg(F.sum("length").alias("run_um"))
    if merged is not None:
        lengths = lengths.join(merged.select("label"), "label", "left_anti")
    total = edges.groupBy("neuron").agg(F.sum("length").alias("run_length"))
    squared = lengths.groupBy("neuron").agg(F.sum(F.col("run_um") * F.col("run_um")).alias("_sq"))
    return total.join(squared, "neuron", "left").select(
        "neuron", "run_length", F.try_divide(F.coalesce("_sq", F.lit(0.0)), "run_length").alias("erl")).withColumn(
        "normalized_erl", F.try_divide("erl", "run_length"))


# --- means and summaries --------------------------------------------------------------------------------------------


def weighted_mean(value: str, weight: str = "run_length") -> Column:
    """Mean weighted by run length; NULL values leave both sums, zero weight gives NULL."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(known))


def metric_summary(per_neuron: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = tuple(TRACKED)) -> DataFrame:
    """Run-length-weighted mean of every tracked metric, in long form ``metric, value``."""
    wide = per_neuron.groupBy(*by).agg(*[weighted_mean(m).alias(m) for m in metrics])
    return wide.unpivot(list(by), list(metrics), "metric", "value")


def report_metrics(per_neuron: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Report aggregation: counts are summed, the other metrics weighted."""
    metrics = ERROR_METRICS + QUALITY_METRICS
    aggs = [(F.sum(m).cast("double") if m in COUNT_METRICS else weighted_mean(m)).alias(m) for m in metrics]
    return per_neuron.groupBy(*by).agg(*aggs).unpivot(list(by), metrics, "metric", "value")


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Join two long metric tables: delta, reduction and corrected % (errors only), relative change %."""
    b = before.select("metric", F.col("value").alias("before"))
    a = after.select("metric", F.col("value").alias("after"))
    error = F.col("metric").isin(ERROR_METRICS)
    drop = F.col("before") - F.col("after")
    names = F.create_map(*[F.lit(v) for kv in METRIC_NAMES.items() for v in kv])
    return b.join(a, "metric").select(
        names[F.col("metric")].alias("metric"), "before", "after", (F.col("after") - F.col("before")).alias("delta"),
        F.when(error, drop).alias("reduction"),
        F.when(error, F.try_divide(F.lit(100.0) * drop, F.col("before"))).alias("corrected_pct"),
        F.try_divide(F.lit(-100.0) * drop, F.col("before")).alias("relative_change_pct"))


def patch_metrics(nodes: DataFrame, edges: DataFrame, offset: Sequence[float], shape: Sequence[float], label: str = "label",
                  omit_rule: str = "both", min_nodes: int = 50) -> DataFrame:
    """Edge classes, merge labels and accuracy of what lies inside one box."""
    inside = nodes_in_patch(nodes, offset, shape)
    within = classify_edges(edge_labels(edges_in_patch(edges, nodes, offset, shape).select("src", "dst"), inside, label), omit_rule)
    merged = merge_labels(label_neuron_counts(inside, label), min_nodes)
    out = side_by_side(
        edge_class_counts(within), merged_edges(within, merged).agg(F.count(F.lit(1)).alias("merged")),
        merged.agg(F.count(F.lit(1)).alias("n_merges")), inside.agg(F.count(F.lit(1)).alias("n_nodes"))).withColumn(
        "pct_merged", F.when(F.col("n_edges") > 0, F.lit(100.0) * F.col("merged") / F.col("n_edges")))
    return out.withColumn("edge_accuracy", edge_accuracy())


def patch_metrics_lookup(nodes: DataFrame, per_neuron: DataFrame, offset: Sequence[float], shape: Sequence[float]) -> DataFrame:
    """Whole-brain rows of the neurons with a node inside the box, matched by neuron key."""
    present = nodes_in_patch(nodes, offset, shape).select("neuron").distinct()
    return per_neuron.join(present, "neuron", "left_semi")


def filter_neurons(per_neuron: DataFrame, names: DataFrame) -> DataFrame:
    """Restrict reported rows. Apply after scoring: merges need all neurons present."""
    return per_neuron.join(names.select("neuron"), "neuron", "left_semi")


def edge_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Confusion counts of two classifications of the same edges, agreement and Cohen's kappa.

    One row per (class_a, class_b) with the overall numbers repeated.
    """
    pairs = a.select("src", "dst", F.col("edge_class").alias("class_a")).join(
        b.select("src", "dst", F.col("edge_class").alias("class_b")), ["src", "dst"])
    cells = cut(pairs.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("n")))  # nine rows at most
    rows, cols, all_ = Window.partitionBy("class_a"), Window.partitionBy("class_b"), Window.partitionBy(F.lit(1))
    cells = cells.withColumns({"_total": F.sum("n").over(all_), "_row": F.sum("n").over(rows), "_col": F.sum("n").over(cols)})
    cells = cells.withColumns({
        "observed": F.sum(F.when(F.col("class_a") == F.col("class_b"), F.col("n")).otherwise(0)).over(all_) / F.col("_total")})
    # expected agreement: product of the marginals of each class seen on both sides
    marg_a = cells.select("class_a", "_row", "_total").distinct()
    marg_b = cells.select(F.col("class_b").alias("class_a"), "_col").distinct()
    expected = marg_a.join(marg_b, "class_a").agg(
        F.sum((F.col("_row") / F.col("_total")) * (F.col("_col") / F.col("_total")))).first()[0] or 0.0
    return cells.withColumn("expected", F.lit(expected)).select("class_a", "class_b", "n", "observed", "expected",
                      F.try_divide(F.col("observed") - F.col("expected"), F.lit(1.0) - F.col("expected")).alias("kappa"))


def label_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How far two labelings of the same nodes agree: labelled or not, and on the id where both label."""
    j = a.select("node_id", F.col("pred_label").alias("la")).join(b.select("node_id", F.col("pred_label").alias("lb")), "node_id")
    both = (F.col("la") != "0") & (F.col("lb") != "0")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("la") == "0") == (F.col("lb") == "0")).alias("n_presence_agrees"),
        F.count_if(both).alias("n_both"), F.count_if(both & (F.col("la") == F.col("lb"))).alias("n_id_agrees"))


def label_gap(left: DataFrame, right: DataFrame, label: str = "label") -> DataFrame:
    """Sizes of two label universes: common, only left, only right, share of left that is common."""
    l = left.select(label).distinct().withColumn("_l", F.lit(1))
    r = right.select(label).distinct().withColumn("_r", F.lit(1))
    return l.join(r, label, "full_outer").agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_common"),
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
    ).withColumn("overlap_pct", F.try_divide(F.lit(100.0) * F.col("n_common"), F.greatest("n_left", F.lit(1))))


def label_gap_lengths(edges: DataFrame, candidates: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Cable of the labels missing among ``candidates``: min, median, max and how many reach ``threshold``."""
    per = edges.join(candidates.select("label").distinct(), "label", "left_anti").groupBy("label").agg(
        F.sum("length").alias("um"))
    per = cut(per)
    ends = per.agg(F.count(F.lit(1)).alias("n_labels"), F.min("um").alias("min_um"), F.max("um").alias("max_um"),
                   F.count_if(F.col("um") >= threshold).alias("n_long"))
    middle = exact_percentiles(per, "um", {"median_um": 0.5})
    return side_by_side(ends, middle).select("n_labels", "min_um", "median_um", "max_um", "n_long")


def label_sets(candidate: DataFrame, scoring: DataFrame) -> DataFrame:
    """Every label with the side it is on: both, candidate or scoring."""
    c, s = candidate.select("label").distinct(), scoring.select("label").distinct()
    return (c.intersect(s).withColumn("side", F.lit("both"))
            .unionByName(c.exceptAll(s).withColumn("side", F.lit("candidate")))
            .unionByName(s.exceptAll(c).withColumn("side", F.lit("scoring"))))


def namespaces_disjoint(gt_ids: DataFrame, frag_ids: DataFrame) -> DataFrame:
    """Number of shared ids and whether there is none."""
    return gt_ids.intersect(frag_ids).agg(F.count(F.lit(1)).alias("n_shared")).withColumn("disjoint", F.col("n_shared") == 0)
