"""Repair policies, the train / held-out split, the acceptance gate and the tournament.

A policy is a function ``(sites, context) -> edits``. ``sites`` is the stream of
split and merge sites, numbered in order by ``site_seq``; the result has the
columns of an edit table without ``candidate_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.functions.scalar import dot, radius_ratio
from dendrospark.operators import edits as E
from dendrospark.operators import sites as SI
from dendrospark.operators import voxel as V
from dendrospark.operators.graph import XYZ, degrees, edge_length, mean_tangent, reach, symmetric, tip_tangent
from dendrospark.operators.greedy import edit_budget, label_cap
from dendrospark.operators.metrics import weighted_mean, TRACKED
from dendrospark.operators.ordering import exact_percentiles, global_rank, ntile
from dendrospark.session import cut, merged


@dataclass
class Context:
    """What a policy may look at: geometry and image, never the truth."""

    frag_node: DataFrame
    frag_edge: DataFrame
    voxels: DataFrame | None = None  # z, y, x, value, and by
    anisotropy: tuple[float, float, float] = (1.0, 1.0, 1.0)
    by: Sequence[str] = ()  # columns that tell brains apart, in all tables and in the sites


Policy = Callable[[DataFrame, Context], DataFrame]


def number_sites(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stream order as ``site_seq``: split sites by gap, then merge sites by the shorter arm.

    A stream of one kind is numbered from 1 in the same order (``joined_stream``).
    """
    has = set(stream.columns)
    order = [F.col("gap_um").asc_nulls_last()] * ("gap_um" in has) + [F.least("cable_a_um", "cable_b_um").desc()] * ("cable_a_um" in has)
    ids = [F.coalesce(*[c for c in pair if c in has]) for pair in (("node_a", "cut_node"), ("node_b", "seed_b_node"))]
    return global_rank(stream, [F.col("kind").desc(), *order, *ids, *[F.col(c) for c in by]], "site_seq")


def joined_stream(split: DataFrame, merge: DataFrame) -> DataFrame:
    """The whole stream from its two kinds, each numbered on its own: merge sites follow the split sites."""
    after = merge.withColumn("site_seq", F.col("site_seq") + F.lit(split.count()))
    return split.unionByName(after, allowMissingColumns=True)


def _split_sites(sites: DataFrame, max_gap: float) -> DataFrame:
    return sites.filter((F.col("kind") == "split") & (F.col("gap_um") <= max_gap) & (F.col("label_a") != F.col("label_b")))


def as_merge_edits(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sites.select(*by, F.col("site_seq").alias("edit_seq"), F.lit(E.MERGE).alias("kind"), "label_a", "label_b",
                        F.lit(None).cast("string").alias("label"), F.lit(None).cast(E.SEED_TYPE).alias("seeds"))


def as_split_edits(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def seed(tag):
        return F.struct(F.lit(tag).alias("suffix"), *[F.col(f"seed_{tag}_{c}").cast("double").alias(c) for c in XYZ],
                        F.col(f"seed_{tag}_node").alias("node"))

    return sites.select(*by, F.col("site_seq").alias("edit_seq"), F.lit(E.SPLIT).alias("kind"), F.lit(None).cast("string").alias("label_a"),
                        F.lit(None).cast("string").alias("label_b"), "label", F.array(seed("a"), seed("b")).cast(E.SEED_TYPE).alias("seeds"))


def _site_tangents(sites: DataFrame, ctx: Context, radius: float, inward: bool) -> DataFrame:
    """Sites with the neighbourhood tangent at both ends as ``ta*``, ``tb*``."""
    ends = sites.select(*ctx.by, F.explode(F.array("node_a", "node_b")).alias("node_id")).distinct()
    sym = cut(symmetric(edge_length(ctx.frag_edge.select(*ctx.by, "src", "dst"), ctx.frag_node, ctx.by), ctx.by, carry=["length"]))
    tangent = cut(mean_tangent(ctx.frag_node, reach(ends, sym, radius, ctx.by), inward, ctx.by))
    return _attach_tangents(sites, tangent, ctx.by)


def _attach_tangents(sites: DataFrame, tangent: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    for tag in ("a", "b"):
        sites = sites.join(tangent.select(*by, F.col("node_id").alias(f"node_{tag}"), *[F.col(f"t{c}").alias(f"t{tag}{c}") for c in XYZ]),
                           [*by, f"node_{tag}"], "left")
    return sites


def _clipped_angle(cosine: Column) -> Column:
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def _site_radii(sites: DataFrame, ctx: Context) -> DataFrame:
    for tag in ("a", "b"):
        sites = sites.join(ctx.frag_node.select(*ctx.by, F.col("node_id").alias(f"node_{tag}"), F.col("radius").cast("double").alias(f"radius_{tag}")),
                           [*ctx.by, f"node_{tag}"], "left")
    return sites


# --- policies -------------------------------------------------------------------------------------------------------


def policy_noop(sites: DataFrame, ctx: Context) -> DataFrame:
    """No edits."""
    return as_merge_edits(sites.filter(F.lit(False)), ctx.by)


def policy_tangent(sites: DataFrame, ctx: Context, max_gap: float = 4.0, radius: float = 12.0, max_angle: float = 35.0) -> DataFrame:
    """Small gap and outward tangents that point at each other."""
    s = _site_tangents(cut(_split_sites(sites, max_gap)), ctx, radius, inward=False)
    return as_merge_edits(s.filter(_clipped_angle(-dot("ta", "tb")) <= max_angle), ctx.by)


def policy_merge_cut(sites: DataFrame, ctx: Context, min_arm: float = 12.0, max_angle: float = 130.0, min_ratio: float = 1.5,
                     min_degree: int = 4, max_valley: float = 0.7) -> DataFrame:
    """Split a label only on strong evidence of two neurites, confirmed by an intensity valley when there is an image."""
    m = sites.filter((F.col("kind") == "merge") & (F.col("cable_a_um") >= min_arm) & (F.col("cable_b_um") >= min_arm))
    two = (F.col("radius_ratio") >= min_ratio) | (F.col("branch_degree") >= min_degree)
    m = m.filter((F.col("detector") == "component") | ((F.col("angle_deg") <= max_angle) & two))
    if ctx.voxels is not None:
        seeds = m.select(
            F.col("site_seq").alias("site"), *ctx.by, *[F.col(f"seed_a_{c}").alias(f"a{c}") for c in XYZ],
            *[F.col(f"seed_b_{c}").alias(f"b{c}") for c in XYZ])
        valley = V.merge_cut_evidence(seeds, ctx.voxels, ctx.anisotropy, by=ctx.by).filter(
            (F.col("valley_ratio") <= max_valley) & F.col("valley_pos").between(0.25, 0.75))
        m = m.join(merged(valley.select(F.col("site").alias("site_seq"))), "site_seq", "left_semi")
    return as_split_edits(m, ctx.by)


def policy_multisignal(sites: DataFrame, ctx: Context, near: float = 3.0, far: float = 6.0, max_angle: float = 50.0,
                       max_ratio: float = 2.2, dim_share: float = 0.45, max_edits: int | None = None) -> DataFrame:
    """Gap, tangents, calibre and image together; longer gaps need the image or a tighter angle."""
    s = _site_radii(_site_tangents(cut(_split_sites(sites, far)), ctx, 6.0, inward=True), ctx)
    off = F.lit(180.0) - _clipped_angle(dot("ta", "tb"))
    ratio = radius_ratio(F.col("radius_a"), F.col("radius_b"))
    s = s.withColumn("_off", off).filter((F.col("_off") <= max_angle) & (ratio.isNull() | (ratio <= max_ratio)))
    if ctx.voxels is not None:
        ends = s.select(F.col("site_seq").alias("site"), *ctx.by, *[F.col(f"a{c}") for c in XYZ], *[F.col(f"b{c}") for c in XYZ])
        light = V.gap_connectivity(ends, ctx.voxels, ctx.anisotropy, by=ctx.by)
        bright, dim = F.greatest("mean_a", "mean_b"), F.least("mean_a", "mean_b")
        known = F.col("mean_a").isNotNull() & F.col("mean_b").isNotNull()
        light = light.select(F.col("site").alias("site_seq"), F.when(known, (bright > 0) & (dim >= dim_share * bright)).alias("_img"))
        s = s.join(light, "site_seq", "left")
    else:
        s = s.withColumn("_img", F.lit(None).cast("boolean"))
    short = (F.col("gap_um") <= near) & F.coalesce("_img", F.lit(True))
    long = (F.col("gap_um") > near) & F.coalesce("_img", F.col("_off") <= max_angle * 0.6)
    picked = s.filter(short | long)
    if max_edits is not None:  # a report limit, in stream order
        picked = global_rank(picked, [F.col("site_seq")], "_place").filter(F.col("_place") <= max_edits).drop("_place")
    return as_merge_edits(picked, ctx.by)


def policy_mutual(sites: DataFrame, ctx: Context, max_gap: float = 3.0, max_ratio: float = 2.0) -> DataFrame:
    """Tips that are each other's nearest tip within a tiny gap, of similar calibre.

    Reciprocity is tested on the raw tip pairs; the site stream keeps only one
    direction per label pair.
    """
    pairs = SI.tip_pairs(ctx.frag_node, ctx.frag_edge, max_gap, tip_to_shaft=False, by=ctx.by)
    ratio = radius_ratio(F.col("radius_a"), F.col("radius_b"))
    pairs = _site_radii(pairs, ctx).filter(ratio.isNull() | (ratio <= max_ratio))
    mutual = SI.mutual_nearest(pairs, ctx.by).select(*ctx.by, F.least("label_a", "label_b").alias("_lo"), F.greatest("label_a", "label_b").alias("_hi")).distinct()
    keyed = _split_sites(sites, max_gap).withColumns({"_lo": F.least("label_a", "label_b"), "_hi": F.greatest("label_a", "label_b")})
    return as_merge_edits(keyed.join(mutual, [*ctx.by, "_lo", "_hi"], "left_semi"), ctx.by)


def policy_small_gap(sites: DataFrame, ctx: Context, max_gap: float = 3.0, max_degree: int = 2) -> DataFrame:
    """Small gaps onto a tip or shaft, at most one per label, first come first served."""
    s = _split_sites(sites, max_gap).filter(F.col("degree_b") <= max_degree).withColumn("edge_id", F.col("site_seq"))
    return as_merge_edits(label_cap(s, [F.col("site_seq")], by=ctx.by), ctx.by)


def confidence(gap: Column, degree_b: Column, cosine: Column, max_gap: float) -> Column:
    """0.30 gap + 0.40 terminal + 0.30 direction; direction counts for tip to tip only."""
    # fixed values: weights and scores of the three parts
    c_gap = F.greatest(F.lit(0.0), 1.0 - gap / F.lit(max_gap))
    c_term = F.when(degree_b.isNull(), 0.5).when(degree_b == 1, 1.0).when(degree_b == 2, 0.4).otherwise(0.0)
    c_dir = F.when((degree_b == 1) & cosine.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 - cosine) / 2.0))).otherwise(0.5)
    return 0.30 * c_gap + 0.40 * c_term + 0.30 * c_dir


def policy_budget(sites: DataFrame, ctx: Context, max_gap: float = 4.0, budget: int = 1, min_confidence: float = 0.55) -> DataFrame:
    """The few most confident reattachments, one per label."""
    tangent = tip_tangent(ctx.frag_node, ctx.frag_edge.select(*ctx.by, "src", "dst"), ctx.by)
    s = _attach_tangents(_split_sites(sites, max_gap), tangent, ctx.by)
    s = s.withColumns({"confidence": F.round(confidence(F.col("gap_um"), F.col("degree_b"), dot("ta", "tb"), max_gap), 9),
                       "edge_id": F.col("site_seq")}).filter(F.col("confidence") >= min_confidence)
    return as_merge_edits(edit_budget(s, "confidence", budget, by=ctx.by), ctx.by)


# --- split, gate, tournament ----------------------------------------------------------------------------------------


def neuron_split(names: DataFrame, fraction: float = 0.33, seed: int = 0) -> DataFrame:
    """``neuron, part``: whole neurons held out, max(1, round(n * fraction)) of them by seeded hash order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("neuron").cast("string")))
    ranked = global_rank(names.select("neuron").distinct().withColumn("_h", key), [F.col("_h"), F.col("neuron")], "_r")
    n = max(1, round(ranked.count() * fraction))  # half to even
    return ranked.select("neuron", F.when(F.col("_r") <= n, "heldout").otherwise("train").alias("part"))


def gate(candidate: DataFrame, parent: DataFrame, eps: float = 0.0, split_tol: float = 0.05) -> DataFrame:
    """Accept or reject each candidate against the parent metrics, with the reason.

    ``candidate``: candidate_id, edge_accuracy, pct_merged, n_merges, pct_split,
    has_split. ``parent``: one row of the same metrics per candidate_id. An
    undefined accuracy rejects.
    """
    names = ["edge_accuracy", "pct_merged", "n_merges", "pct_split"]
    j = candidate.join(parent.select("candidate_id", *[F.col(c).alias(f"parent_{c}") for c in names]), "candidate_id")

    def num(c, digits):
        return F.format_string(f"%.{digits}f", F.col(c))

    better = F.coalesce(F.col("edge_accuracy") > F.col("parent_edge_accuracy") + F.lit(eps), F.lit(False))

    def told(code, metric):
        return F.concat_ws(" ", F.lit(code), num(f"parent_{metric}", 3), num(metric, 3))

    # a code, the parent's value and the candidate's value of the metric that decided
    reason = (
        F.when(~better, told("accuracy-not-better", "edge_accuracy"))
        .when(~F.col("has_split"), told("accuracy-better", "edge_accuracy"))
        .when(F.col("pct_merged") > F.col("parent_pct_merged") + 1e-9, told("merged-share-up", "pct_merged"))
        .when(F.col("n_merges") > F.col("parent_n_merges") + 1e-9, told("merges-up", "n_merges"))
        .when(F.col("pct_split") > F.col("parent_pct_split") + F.lit(split_tol), told("split-share-up", "pct_split"))
        .otherwise(told("repaired", "edge_accuracy")))
    accepted = better & (~F.col("has_split") | (
        F.coalesce(F.col("pct_merged") <= F.col("parent_pct_merged") + 1e-9, F.lit(True))
        & F.coalesce(F.col("n_merges") <= F.col("parent_n_merges") + 1e-9, F.lit(True))
        & F.coalesce(F.col("pct_split") <= F.col("parent_pct_split") + F.lit(split_tol), F.lit(True))))
    return j.withColumns({"accepted": accepted, "reason": reason})


def gate_lineage(generations: DataFrame, eps: float = 0.0, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Accepted flags in generation order, each compared with the last accepted one before it.

    ``generations``: run_id, generation, heldout, baseline. Sequential by nature;
    a run has as many rows as generations, and runs are folded side by side.
    """
    rows = generations.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("generation", "heldout"))).alias("_g"), F.first("baseline").alias("_base"))
    state = F.struct(F.col("_base").cast("double").alias("parent"), F.array().cast("array<struct<generation:bigint,heldout:double,parent:double,accepted:boolean>>").alias("out"))

    def fold(acc, row):
        good = F.coalesce(row["heldout"] > acc["parent"] + F.lit(eps), F.lit(False))
        item = F.struct(row["generation"].cast("bigint").alias("generation"), row["heldout"].cast("double").alias("heldout"),
                        acc["parent"].alias("parent"), good.alias("accepted"))
        return F.struct(F.when(good, row["heldout"]).otherwise(acc["parent"]).cast("double").alias("parent"),
                        F.array_append(acc["out"], item).alias("out"))

    return rows.select(*by, F.explode(F.aggregate("_g", state, fold)["out"]).alias("_o")).select(*by, "_o.*")


def propose(policies: Mapping[str, Policy], sites: DataFrame, ctx: Context) -> DataFrame:
    """Edits of all policies in one table, ``candidate_id`` = policy name."""
    from dendrospark.plans.scoring import union_all

    return union_all([p(sites, ctx).withColumn("candidate_id", F.lit(name)) for name, p in policies.items()]).select(*ctx.by, *E.EDIT_SCHEMA.fieldNames())


def tournament(brain, policies: Mapping[str, Policy], sites: DataFrame, ctx: Context, parts: DataFrame, eps: float = 0.0,
               split_tol: float = 0.05, max_class_size: int | None = None) -> DataFrame:
    """Propose, score on all neurons, weigh per part, gate on the held-out part: one row per policy."""
    from dendrospark.plans.scoring import score

    sites = cut(sites)
    edits = cut(propose(policies, sites, ctx))
    scored = score(brain, edits, list(policies), max_class_size)
    every = cut(scored.unionByName(brain.baseline.withColumn("candidate_id", F.lit("_none")).select(*scored.columns)))
    means = every.join(parts, "neuron").groupBy("candidate_id", "part").agg(*[weighted_mean(m).alias(m) for m in TRACKED])
    held = cut(means).filter(F.col("part") == "heldout").drop("part")
    train = means.filter(F.col("part") == "train").select("candidate_id", F.col("edge_accuracy").alias("train_edge_accuracy"))
    kinds = edits.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_edits"), F.max(F.col("kind") == E.SPLIT).alias("has_split"))
    cand = held.filter(F.col("candidate_id") != "_none").join(train, "candidate_id").join(kinds, "candidate_id", "left").withColumns({
        "n_edits": F.coalesce("n_edits", F.lit(0)), "has_split": F.coalesce("has_split", F.lit(False))})
    names = F.explode(F.array(*[F.lit(n) for n in policies])).alias("candidate_id")
    parent = held.filter(F.col("candidate_id") == "_none").drop("candidate_id").select(names, "*")
    return gate(cand, parent, eps, split_tol)


# --- proposal models ------------------------------------------------------------------------------------------------


def leaf_density(tips: DataFrame, cell_um: float = 20.0) -> DataFrame:
    """Leaves in the block of 3 x 3 x 3 cells around each leaf (our definition of local density): counts, no pairs."""
    cells = {f"_d{c}": F.floor(F.col(c) / F.lit(cell_um)) for c in XYZ}
    keyed = tips.withColumns(cells)
    counts = keyed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    around = counts
    for c in cells:
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    total = around.groupBy(*cells).agg(F.sum("_n").alias("density"))
    return keyed.join(total, list(cells)).select("node_id", "density")


def proposal_features(props: DataFrame, ctx: Context) -> DataFrame:
    """Degree, radii, length, leaf-to-leaf flag, local leaf density and directions of each proposal."""
    nodes = ctx.frag_node
    edges = ctx.frag_edge.select("src", "dst")
    p = _site_radii(props, ctx)
    p = _attach_tangents(p, cut(tip_tangent(nodes, edges)))
    tips = degrees(nodes, edges).filter(F.col("degree") == 1).select("node_id", *XYZ)
    density = cut(leaf_density(tips))
    p = p.join(density.withColumnsRenamed({"node_id": "node_a", "density": "density_a"}), "node_a", "left")
    return p.select(
        "node_a", "node_b", "label_a", "label_b", "degree_b", F.sqrt("d2").alias("length"), "radius_a", "radius_b",
        radius_ratio(F.col("radius_a"), F.col("radius_b")).alias("radius_ratio"),
        (F.col("degree_b") == 1).cast("int").alias("leaf_to_leaf"), F.coalesce("density_a", F.lit(0)).alias("density"),
        F.coalesce(-dot("ta", "tb"), F.lit(0.0)).alias("alignment"))


FEATURES = ["degree_b", "length", "radius_ratio", "leaf_to_leaf", "density", "alignment"]


def fit_proposals(features: DataFrame, label: str = "target", model: str = "logistic", seed: int = 0):
    """Fit a logistic regression or random forest on labelled proposals; returns (model, scored rows)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = features.fillna(1.0, ["radius_ratio"])
    learner = (LogisticRegression(featuresCol="features", labelCol=label, maxIter=50, regParam=0.01) if model == "logistic"
               else RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, seed=seed))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), learner]).fit(known.filter(F.col(label).isNotNull()))
    scored = fitted.transform(known).withColumn("score", vector_to_array("probability")[1])
    return fitted, scored.drop("features", "rawPrediction", "probability")


def adaptive_threshold(df: DataFrame, distance: str, low: float, high: float, p_low: float = 0.1, p_high: float = 0.9) -> DataFrame:
    """Threshold that goes linearly from ``low`` to ``high`` between two percentiles of the distance."""
    q = exact_percentiles(df, distance, {"q0": p_low, "q1": p_high}).first()
    span = (q.q1 - q.q0) if q.q0 is not None else 0.0
    share = (F.col(distance) - F.lit(q.q0)) / F.lit(span) if span > 0 else F.lit(0.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return df.withColumn("threshold", F.lit(low) + share * (high - low))


def decile_rates(df: DataFrame, feature: str, positive: str, tie: str, bins: int = 10) -> DataFrame:
    """Positive rate per equal-sized bin of a feature."""
    t = ntile(df, [F.col(feature), F.col(tie)], bins, "bin")
    return t.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(feature).alias("low"), F.max(feature).alias("high"),
                                F.avg(F.col(positive).cast("double")).alias("rate"))
