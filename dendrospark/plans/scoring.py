"""Scoring of many edit candidates against the true skeletons in one job.

What no candidate can change is computed once: labelled edges with their
lengths, edge counts per (neuron, label, label), label-neuron incidence and
error-free runs. A candidate touches some labels; only the neurons those labels
lie on are scored again, all others keep their baseline row. Merge edits rename
rows of the small aggregates, split edits re-read the nodes of the split labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.functions.scalar import BACKGROUND
from dendrospark.operators import edits as E
from dendrospark.operators import metrics as M
from dendrospark.operators.graph import component_roots, connected_components, length_of, with_ends
from dendrospark.session import cut, is_empty, merged

PER_NEURON = ["neuron", "run_length", "n_splits", "n_merges", "pct_split", "pct_omit", "pct_merged", "erl", "normalized_erl",
              "edge_accuracy", "split_accuracy", "split_rate", "merge_rate"]
CAND = ["candidate_id"]


@dataclass
class PreparedBrain:
    """State that holds for every candidate, kept in executor storage or the shared folder."""

    gt_node: DataFrame  # node_id, neuron, raw_label, x, y, z
    edges: DataFrame  # src, dst, neuron, length, label_src, label_dst, run_src, run_dst
    frag_node: DataFrame
    frag_edge: DataFrame
    pairs: DataFrame  # neuron, label_src, label_dst, n, um
    incidence: DataFrame  # label, neuron, n_nodes
    label_stats: DataFrame  # label, n_neurons, n_supported
    runs: DataFrame  # neuron, atom, label, um
    baseline: DataFrame  # PER_NEURON
    omit_rule: str
    min_nodes: int


def numbered(nodes: Sequence[DataFrame], by: Sequence[str], id_col: str = "node_id", most: int = 2**62) -> Callable[[str], Column] | None:
    """Ids of several brains as one number, in order of brain and id, for ``pooled``; None where the ids of ``nodes`` span too much for that.

    An id of no node becomes NULL and matches nothing, as before. Numbers are sorted and compared faster than structs.
    """
    every = reduce(DataFrame.unionByName, [n.select(*by, id_col) for n in nodes])
    if every.schema[id_col].dataType.typeName() not in ("long", "integer"):
        return None
    spans = every.groupBy(*by).agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi")).orderBy(*by).collect()  # a row per brain
    place, cases = 0, []
    for r in spans:
        if r["_lo"] is None:
            continue
        cases.append((r, place - r["_lo"]))
        place += r["_hi"] - r["_lo"] + 1
    if place > most or any(abs(shift) > most for _, shift in cases):
        return None

    def number(c: str) -> Column:
        out = F.lit(None).cast("bigint")
        for r, shift in cases:
            own = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(r[k])) for k in by]) & F.col(c).between(r["_lo"], r["_hi"])
            out = F.when(own, F.col(c) + F.lit(shift)).otherwise(out)
        return out

    return number


def pooled(df: DataFrame, by: Sequence[str], ids: Sequence[str] = (), labels: Sequence[str] = (), names: Sequence[str] = (),
           number: Callable[[str], Column] | None = None) -> DataFrame:
    """Tables of several brains as one: ids become numbers (``numbered``) or structs with the brain in front, labels (but background) and names get it as a prefix.

    What is then joined, united or compared by id, label or neuron stays inside its brain.
    """
    key = F.concat_ws("/", *by)
    out = {c: number(c) if number else F.struct(*by, F.col(c).alias("id")) for c in ids}
    out |= {c: F.when(F.col(c) == BACKGROUND, F.col(c)).otherwise(F.concat(key, F.lit("/"), c)) for c in labels}
    return df.withColumns(out | {c: F.concat(key, F.lit("/"), F.col(c).cast("string")) for c in names})


def prepare(gt_node: DataFrame, gt_edge: DataFrame, frag_node: DataFrame, frag_edge: DataFrame, label: str = "raw_label",
            omit_rule: str = "either", min_nodes: int = 50) -> PreparedBrain:
    nodes = gt_node.select("node_id", "neuron", F.col(label).alias("raw_label"), "x", "y", "z")
    edges = with_ends(gt_edge.select("src", "dst", "neuron"), nodes, ["x", "y", "z", "raw_label"])
    edges = cut(edges.select("src", "dst", "neuron", length_of().alias("length"), F.col("raw_label_src").alias("label_src"), F.col("raw_label_dst").alias("label_dst")))
    edges = cut(_with_runs(edges))
    pairs = cut(edges.groupBy("neuron", "label_src", "label_dst").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("um")))
    incidence = cut(M.label_neuron_counts(nodes, "raw_label"))
    stats = cut(_label_stats(incidence, [], min_nodes))
    runs = cut(_correct(edges).groupBy("neuron", F.col("run_src").alias("atom"), F.col("label_src").alias("label")).agg(
        F.sum("length").alias("um")))
    baseline = cut(_assemble(incidence, stats, pairs, runs, [], omit_rule))
    return PreparedBrain(nodes, edges, frag_node.select("node_id", "label", "x", "y", "z"), frag_edge.select("src", "dst"), pairs,
                         incidence, stats, runs, baseline, omit_rule, min_nodes)


def _with_runs(edges: DataFrame) -> DataFrame:
    """``run_src, run_dst``: the components of the correct edges that hold the two ends; a node outside of all is its own."""
    roots = component_roots(_correct(edges).select("src", "dst"))
    if roots is None:
        return edges.withColumns({"run_src": F.col("src"), "run_dst": F.col("dst")})
    roots = cut(roots)

    def looked_up(df: DataFrame, end: str) -> DataFrame:
        return df.join(merged(roots.select(F.col("v").alias(end), F.col("r").alias("_r"))), end, "left").withColumn(
            f"run_{end}", F.coalesce("_r", end)).drop("_r")

    correct = (F.col("label_src") == F.col("label_dst")) & (F.col("label_src") != "0")
    both = looked_up(edges.filter(correct), "src").withColumn("run_dst", F.col("run_src"))
    return both.unionByName(looked_up(looked_up(edges.filter(~correct), "src"), "dst"))


def _correct(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("label_src") == F.col("label_dst")) & (F.col("label_src") != "0"))


def _label_stats(incidence: DataFrame, by: Sequence[str], min_nodes: int) -> DataFrame:
    return incidence.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n_neurons"), F.count_if(M.supported(min_nodes)).alias("n_supported"))


def _assemble(incidence: DataFrame, stats: DataFrame, pairs: DataFrame, runs: DataFrame, by: list[str], omit_rule: str) -> DataFrame:
    """Per-neuron metrics from relabelled aggregates (one row per neuron label / label pair / run)."""
    key = [*by, "neuron"]
    spread = stats.filter(F.col("n_supported") >= 2).select(*by, F.col("label").alias("_m"), F.lit(True).alias("_merged"))
    counts = pairs.withColumn("_m", F.when(F.col("label_src") == F.col("label_dst"), F.col("label_src"))).join(
        merged(spread), ["_m", *by], "left").withColumn("edge_class", M.edge_class(omit_rule)).groupBy(*key).agg(
        F.sum("n").alias("n_edges"), F.sum("um").alias("run_length"),
        F.sum(F.when(F.col("edge_class") == "split", F.col("n")).otherwise(0)).alias("_split"),
        F.sum(F.when(F.col("edge_class") == "omit", F.col("n")).otherwise(0)).alias("_omit"),
        F.sum(F.when(F.col("_merged"), F.col("n")).otherwise(0)).alias("_merge"))
    labels = incidence.join(merged(stats.select(*by, "label", "n_neurons")), ["label", *by]).groupBy(*key).agg(
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n_splits"), F.count_if(F.col("n_neurons") >= 2).alias("n_merges"))
    squares = runs.join(merged(spread.withColumnRenamed("_m", "label")), ["label", *by], "left_anti").groupBy(*key).agg(
        F.sum(F.col("um") * F.col("um")).alias("_sq"))
    out = counts.join(merged(labels), ["neuron", *by], "left").join(merged(squares), ["neuron", *by], "left")
    out = out.withColumns({
        **{f"pct_{c}": F.when(F.col("n_edges") > 0, F.lit(100.0) * F.col(f"_{s}") / F.col("n_edges"))
           for c, s in (("split", "split"), ("omit", "omit"), ("merged", "merge"))},
        "n_splits": F.coalesce("n_splits", F.lit(0)), "n_merges": F.coalesce("n_merges", F.lit(0)),
        "erl": F.try_divide(F.coalesce("_sq", F.lit(0.0)), "run_length")})
    out = out.withColumns({"normalized_erl": F.try_divide("erl", "run_length"), "edge_accuracy": M.edge_accuracy()})
    return M.error_rates(M.with_derived(out)).select(*by, *PER_NEURON)


def score_labels(nodes: DataFrame, edges: DataFrame, label: str, omit_rule: str = "either", min_nodes: int = 50) -> DataFrame:
    """Per-neuron metrics of one labelling. ``edges`` carry ``neuron`` and ``length``."""
    e = cut(M.edge_labels(edges.select("src", "dst", "neuron", "length"), nodes, label))
    run = M.error_free_runs(nodes.select("node_id"), e).select(F.col("node_id").alias("src"), F.col("run").alias("atom"))
    pairs = e.groupBy("neuron", "label_src", "label_dst").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("um"))
    incidence = M.label_neuron_counts(nodes, label)
    runs = _correct(e).join(run, "src").groupBy("neuron", "atom", F.col("label_src").alias("label")).agg(F.sum("length").alias("um"))
    return _assemble(incidence, _label_stats(incidence, [], min_nodes), pairs, runs, [], omit_rule)


def score(brain: PreparedBrain, edits: DataFrame, candidates: Sequence[str], max_class_size: int | None = None) -> DataFrame:
    """``candidate_id`` plus the per-neuron metrics, for every candidate named, with or without edits."""
    edits = cut(E.normalize_edits(edits))
    classes = cut(E.merge_classes(edits, max_class_size))
    sides = E.split_sides(brain.gt_node, brain.frag_node, brain.frag_edge, edits)
    split = sides.select(*CAND, "label").distinct()
    any_split, any_class = not is_empty(sides), not is_empty(classes)

    touched = cut(classes.select(*CAND, "label").union(split).distinct())
    affected = cut(brain.incidence.join(merged(touched), "label").select(*CAND, "neuron").distinct())

    incidence, touched_stats = _edited_incidence(brain, touched, affected, classes, sides, split, any_split)
    base_stats = brain.label_stats.join(merged(incidence.filter(~F.col("touched")).select(*CAND, "label").distinct()), "label").select(
        *CAND, "label", "n_neurons", "n_supported")
    stats = cut(touched_stats.unionByName(base_stats))

    pairs = brain.pairs.join(merged(affected), "neuron")
    atoms = brain.runs.join(merged(affected), "neuron")
    links = None  # edges that two classes of labels make correct
    if any_class:
        links = _linked(_rename(_between_labels(brain.edges).join(
            merged(classes.select(*CAND, F.col("label").alias("label_src"))), "label_src"), classes))
    if any_split:
        pairs, atoms, links = _with_split(brain, pairs, atoms, links, classes, sides, split)
    if links is None:  # without classes no run meets another
        runs = atoms.withColumnRenamed("atom", "run")
    else:
        pairs = _rename(pairs, classes)
        atoms = atoms.join(merged(classes), ["label", *CAND], "left").withColumn("label", F.coalesce("class", "label")).drop("class")
        runs = _joined_runs(cut(atoms), cut(links))

    rescored = _assemble(incidence, stats, pairs, runs, CAND, brain.omit_rule)
    names = F.explode(F.array(*[F.lit(c) for c in candidates])).alias("candidate_id")
    unchanged = brain.baseline.select(names, *PER_NEURON).join(merged(affected), ["neuron", *CAND], "left_anti")
    return rescored.unionByName(unchanged)


def _joined_runs(atoms: DataFrame, links: DataFrame) -> DataFrame:
    """Error-free runs from the runs before the edits and the edges that now join them."""
    vertices = atoms.select(*CAND, F.col("atom").alias("node_id")).distinct()
    group = cut(connected_components(
        vertices.union(links.select(*CAND, F.explode(F.array("src", "dst")))).distinct(), links, CAND, out="run"))
    # a run may consist of links alone, where both ends had no correct edge before
    cable = atoms.select(*CAND, "neuron", "atom", "label", "um").unionByName(
        links.select(*CAND, "neuron", F.col("src").alias("atom"), "label", F.col("length").alias("um")))
    return cable.join(merged(group.withColumnRenamed("node_id", "atom")), ["atom", *CAND]).groupBy(*CAND, "neuron", "run", "label").agg(
        F.sum("um").alias("um"))


def _between_labels(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("label_src") != F.col("label_dst")) & (F.col("label_src") != "0") & (F.col("label_dst") != "0"))


def _rename(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for end in ("label_src", "label_dst"):
        to = classes.select(*CAND, F.col("label").alias(end), "class")
        pairs = pairs.join(merged(to), [end, *CAND], "left").withColumn(end, F.coalesce("class", end)).drop("class")
    return pairs


def _linked(edges: DataFrame) -> DataFrame:
    """Edges that join two runs now that both ends have one label."""
    return edges.filter(F.col("label_src") == F.col("label_dst")).select(
        *CAND, "neuron", F.col("label_src").alias("label"), F.col("run_src").alias("src"), F.col("run_dst").alias("dst"), "length")


def _edited_incidence(brain, touched, affected, classes, sides, split, any_split):
    """Label-neuron counts after the edits, for the affected neurons, and the spread of the touched labels.

    All neurons of a touched label are affected, so its spread is complete here.
    """
    inc = brain.incidence.join(merged(affected), "neuron").join(
        merged(touched.withColumn("touched", F.lit(True))), ["label", *CAND], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    inc = inc.select(*CAND, "neuron", "label", "n_nodes", "touched")
    if any_split:
        pieces = sides.join(merged(brain.gt_node.select("node_id", "neuron")), "node_id").groupBy(
            *CAND, "neuron", E.pseudo().alias("label")).agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("touched", F.lit(True))
        inc = inc.join(merged(split), ["label", *CAND], "left_anti").unionByName(pieces)
    inc = inc.join(merged(classes), ["label", *CAND], "left").groupBy(
        *CAND, "neuron", F.coalesce("class", "label").alias("label"), "touched").agg(F.sum("n_nodes").alias("n_nodes"))
    inc = cut(inc)
    return inc, _label_stats(inc.filter("touched"), CAND, brain.min_nodes)


def _with_split(brain, pairs, atoms, links, classes, sides, split):
    """Replace what lies under split labels by counts from their edges."""
    for end in ("label_src", "label_dst"):
        pairs = pairs.join(merged(split.withColumnRenamed("label", end)), [end, *CAND], "left_anti")
    atoms = atoms.join(merged(split), ["label", *CAND], "left_anti")
    # edges with an end under a split label, with the new label of both ends; every node of a split label has a side
    new = {end: merged(sides.select(*CAND, F.col("node_id").alias(end), E.pseudo().alias(f"_new_{end}"))) for end in ("src", "dst")}
    at_src = brain.edges.join(new["src"], "src").join(new["dst"], ["dst", *CAND], "left")
    at_dst = brain.edges.join(new["dst"], "dst").join(merged(split.withColumnRenamed("label", "label_src")), ["label_src", *CAND], "left_anti")
    edges = at_src.unionByName(at_dst, allowMissingColumns=True)
    edges = cut(edges.withColumns({f"label_{end}": F.coalesce(f"_new_{end}", f"label_{end}") for end in new}).drop("_new_src", "_new_dst"))
    counted = edges.groupBy(*CAND, "neuron", "label_src", "label_dst").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("um"))
    pairs = pairs.unionByName(counted)
    # pieces: components inside one pseudo-label
    inner = _correct(edges)
    piece = cut(connected_components(sides.select(*CAND, "node_id"), inner.select(*CAND, "src", "dst"), CAND, out="atom"))
    new_atoms = inner.join(merged(piece.withColumnRenamed("node_id", "src")), ["src", *CAND]).groupBy(
        *CAND, "neuron", "atom", F.col("label_src").alias("label")).agg(F.sum("length").alias("um"))
    atoms = atoms.unionByName(new_atoms)
    if links is None:
        return pairs, atoms, None
    # a link joins two atoms whose labels fall into one class
    across = _between_labels(edges)
    for end in ("src", "dst"):
        across = across.join(merged(piece.withColumnsRenamed({"node_id": end, "atom": f"_{end}"})), [end, *CAND], "left").withColumn(
            f"run_{end}", F.coalesce(f"_{end}", f"run_{end}")).drop(f"_{end}")
    return pairs, atoms, links.unionByName(_linked(_rename(across, classes)))


def split_ceiling(brain: PreparedBrain, min_nodes: int = 50) -> DataFrame:
    """Tracked metrics if every merge label were cut perfectly: ``metric, baseline, perfect, delta``.

    Here a label counts from ``min_nodes`` on (inclusive), one less than in the metric itself.
    """
    merged = M.merge_labels(brain.incidence, min_nodes, strict=False).select(F.col("label").alias("raw_label"), F.lit(True).alias("_m"))
    nodes = brain.gt_node.join(merged, "raw_label", "left").withColumn(
        "perfect", F.when(F.col("_m"), F.concat_ws("#", "raw_label", "neuron")).otherwise(F.col("raw_label")))
    perfect = score_labels(nodes, brain.edges, "perfect", brain.omit_rule, brain.min_nodes)
    a = M.metric_summary(brain.baseline).withColumnRenamed("value", "baseline")
    b = M.metric_summary(perfect).withColumnRenamed("value", "perfect")
    return a.join(b, "metric").withColumn("delta", F.col("perfect") - F.col("baseline"))


def merge_count(pieces: DataFrame, incidence: DataFrame) -> DataFrame:
    """Fragment pieces per candidate and label that lies on two or more neurons."""
    spread = incidence.groupBy(*CAND, "label").agg(F.count(F.lit(1)).alias("n_neurons")).filter(F.col("n_neurons") >= 2)
    return pieces.select(*CAND, "label", "piece").distinct().join(spread, [*CAND, "label"]).groupBy(*CAND, "label").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.first("n_neurons").alias("n_neurons"))


def attribute_merges(incidence: DataFrame, classes: DataFrame) -> DataFrame:
    """Each (label, neuron) of a merge with the size of the class that caused it.

    ``caused_by_edit`` when the class fuses two or more labels, pseudo-labels included.
    """
    size = classes.groupBy(*CAND, F.col("class").alias("label")).agg(F.count(F.lit(1)).alias("n_fused"))
    spread = incidence.groupBy(*CAND, "label").agg(F.count(F.lit(1)).alias("n_neurons")).filter(F.col("n_neurons") >= 2)
    return incidence.join(spread, [*CAND, "label"]).join(size, [*CAND, "label"], "left").withColumns({
        "n_fused": F.coalesce("n_fused", F.lit(1)), "caused_by_edit": F.coalesce("n_fused", F.lit(1)) >= 2})


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
