"""Operators over two brains with the same node ids and coordinates: nothing may leak from one into the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import graph as G
from dendrospark.operators import greedy as GR
from dendrospark.operators import metrics as M
from dendrospark.operators import policy as P
from dendrospark.operators import sites as SI
from dendrospark.operators import spatial as SP
from dendrospark.operators import walk as W
from dendrospark.plans import scoring as SC
from dendrospark.plans.catalog import ORACLES, query
from dendrospark.plans.derived import Brains, by_brain, with_tables
from dendrospark.plans.metric_queries import MIN_NODES, merge_edits, round_per_neuron, split_edits
from dendrospark.plans.site_queries import _ROUNDED, ALL_SQL, rounded_sites
from dendrospark.session import cut

BY = ["brain"]


def per_brain(name: str, of: str | None = None, sql: str | None = None):
    """Register a query whose SQL is that of query ``of``, once for each brain."""
    made = query(name, by_brain(sql or ORACLES[of]))
    return lambda fn: made(lambda t: fn(Brains(t)))


def _edges(b):
    return b.frag_edge.select(*BY, "src", "dst")


def _sym(b):
    return G.symmetric(G.edge_length(_edges(b), b.frag_node, BY), BY, carry=["length"])


def _of_degree(b, condition):
    return G.degrees(b.frag_node, b.frag_edge, BY).filter(condition)


@per_brain("g1_components_by_brain", "g1_connected_components")
def _(b):
    return G.connected_components(b.frag_node.select(*BY, "node_id"), _edges(b), BY)


@per_brain("g2_arms_by_brain", "g2_branch_arms")
def _(b):
    a = W.walk_arms(b.frag_node, _edges(b), _of_degree(b, F.col("degree") >= 3), 24.0, 8.0, by=BY)
    return a.select(*BY, "node_id", "arm", "end_node", F.round("cable", 6).alias("cable"), "seed_node")


@per_brain("g3_reach_by_brain", "g3_reach")
def _(b):
    tips = _of_degree(b, F.col("degree") == 1).select(*BY, "node_id")
    return G.reach(tips, _sym(b), 12.0, BY).select(*BY, "start", "node_id", F.round("dist", 6).alias("dist"))


@per_brain("p13_tip_tangent_by_brain", "p13_tip_tangent")
def _(b):
    return G.tip_tangent(b.frag_node, b.frag_edge, BY).select(*BY, "node_id", *[F.round(f"t{c}", 6).alias(f"t{c}") for c in "xyz"])


@per_brain("p14_mean_tangent_by_brain", "p14_mean_tangent")
def _(b):
    tips = _of_degree(b, F.col("degree") == 1).select(*BY, "node_id")
    tan = G.mean_tangent(b.frag_node, G.reach(tips, _sym(b), 12.0, BY), by=BY)
    return tan.select(*BY, "node_id", *[F.round(f"t{c}", 6).alias(f"t{c}") for c in "xyz"])


@per_brain("p23_radius_variance_by_brain", "p23_radius_variance")
def _(b):
    starts = _of_degree(b, F.col("degree") >= 3).select(*BY, "node_id")
    v = G.radius_variance(b.frag_node, G.reach(starts, _sym(b), 12.0, BY), BY)
    return v.select(*BY, "node_id", F.round("radius_variance", 6).alias("radius_variance"), "n_nodes")


@per_brain("r1_drop_short_by_brain", "r1_drop_short")
def _(b):
    nodes, _edge = G.drop_short(b.frag_node.select(*BY, "node_id", "x", "y", "z"), _edges(b), 40.0, BY)
    return nodes.select(*BY, "node_id", "component")


@per_brain("j3_nearest_label_by_brain", "j3_nearest_label")
def _(b):
    return SP.nearest_label(b.gt_node, b.frag_node, 5.0, BY).select(*BY, "node_id", "pred_label")


@per_brain("j1_split_sites_by_brain", "j1_split_sites")
def _(b):
    s = SI.split_sites(b.frag_node, b.frag_edge, 15.0, max_sites=None, by=BY)
    return s.select(*BY, "label_a", "label_b", "node_a", "node_b", "d2")


@per_brain("j14_mutual_nearest_by_brain", "j14_mutual_nearest_tips")
def _(b):
    pairs = SI.tip_pairs(b.frag_node, b.frag_edge, 15.0, tip_to_shaft=False, by=BY)
    return SI.mutual_nearest(pairs, BY).select(*BY, "node_a", "node_b", "d2")


@per_brain("g5_suppress_by_brain", "g5_suppress_necks")
def _(b):
    s = SI.merge_sites_bridge(b.kink_node, b.kink_edge.select(*BY, "src", "dst"), separation=1e-6, by=BY)
    points = s.select(*BY, F.col("cut_node").alias("node_id"), F.round("angle_deg", 6).alias("a"), *[F.col(f"cut_{c}").alias(c) for c in "xyz"])
    return GR.suppress(points, [F.col("a")], 20.0, by=BY).select(*BY, "node_id")


@per_brain("g7_branch_sites_by_brain", "g7_merge_sites_branch")
def _(b):
    return rounded_sites(SI.merge_sites_branch(b.frag_node, _edges(b), by=BY), *BY)


@per_brain("g8_bridge_sites_by_brain", "g8_merge_sites_bridge")
def _(b):
    return rounded_sites(SI.merge_sites_bridge(b.kink_node, b.kink_edge.select(*BY, "src", "dst"), by=BY), *BY)


@per_brain("g9_component_sites_by_brain", "g9_merge_sites_component")
def _(b):
    return rounded_sites(SI.merge_sites_component(b.frag_node, _edges(b), by=BY), *BY)


@per_brain("merge_sites_by_brain", sql=with_tables("frag_deg", recursive=True, extra=ALL_SQL, body=f"{_ROUNDED} from found"))
def _(b):
    return rounded_sites(SI.merge_sites(b.frag_node, _edges(b), by=BY), *BY)


@per_brain("a6_targets_by_brain", "a6_target_neurons")
def _(b):
    return M.target_neurons(b.gt_node, "raw_label", MIN_NODES, BY).select(*BY, "label", "neuron", "n_nodes", "place", "cx", "cy", "cz")


def _sites(b, kind):
    """Sites of one kind of both brains, numbered once."""
    if not hasattr(b.one, f"_brain_{kind}_sites"):
        setattr(b.one, f"_brain_{kind}_sites", cut(P.number_sites(SI.sites_of_kind(kind, b.frag_node, b.frag_edge, 15.0, BY), BY)))
    return getattr(b.one, f"_brain_{kind}_sites")


def _context(b):
    return P.Context(b.frag_node, _edges(b), by=BY)


@per_brain("d3_tangent_by_brain", "d3_policy_tangent")
def _(b):
    return P.policy_tangent(_sites(b, "split"), _context(b), max_gap=12.0).select(*BY, "label_a", "label_b")


@per_brain("d4_merge_cut_by_brain", "d4_policy_merge_cut")
def _(b):
    e = P.policy_merge_cut(_sites(b, "merge"), _context(b))
    return e.select(*BY, "label", F.col("seeds")[0]["node"].alias("seed_a_node"), F.col("seeds")[1]["node"].alias("seed_b_node"))


@per_brain("d5_multisignal_by_brain", "d5_policy_multisignal")
def _(b):
    return P.policy_multisignal(_sites(b, "split"), _context(b), near=6.0, far=12.0).select(*BY, "label_a", "label_b")


@per_brain("d6_mutual_by_brain", "d6_policy_mutual")
def _(b):
    return P.policy_mutual(_sites(b, "split"), _context(b), max_gap=10.0).select(*BY, "label_a", "label_b")


@per_brain("d7_small_gap_by_brain", "d7_policy_small_gap")
def _(b):
    return P.policy_small_gap(_sites(b, "split"), _context(b), max_gap=8.0).select(*BY, "label_a", "label_b")


@per_brain("d8_budget_by_brain", "d8_policy_budget")
def _(b):
    return P.policy_budget(_sites(b, "split"), _context(b), max_gap=15.0, budget=25).select(*BY, "label_a", "label_b")


def _prepared(b):
    number = SC.numbered([b.gt_node, b.frag_node], BY)
    edge = lambda df: SC.pooled(df, BY, ids=["src", "dst"], names=[c for c in ("neuron",) if c in df.columns], number=number)
    return SC.prepare(
        SC.pooled(b.gt_node, BY, ids=["node_id"], labels=["raw_label"], names=["neuron"], number=number), edge(b.gt_edge),
        SC.pooled(b.frag_node, BY, ids=["node_id"], labels=["label"], names=["neuron"], number=number), edge(b.frag_edge.select(*BY, "src", "dst")), min_nodes=MIN_NODES)


def _pooled_brain(b):
    if not hasattr(b.one, "_pooled"):
        b.one._pooled = _prepared(b)
    return b.one._pooled


def _told_apart(scored):
    """Results per brain from the pooled names."""
    return scored.withColumns({"brain": F.substring_index("neuron", "/", 1), "neuron": F.substring_index("neuron", "/", -1).cast("bigint")})


@per_brain("a16_score_merges_by_brain", "a16_score_merge_candidates")
def _(b):
    edits = merge_edits(b.one).withColumn("brain", F.lit("a")).unionByName(merge_edits(b.two).withColumn("brain", F.lit("b")))
    edits = SC.pooled(edits, BY, labels=["label_a", "label_b"]).drop("brain")
    return round_per_neuron(_told_apart(SC.score(_pooled_brain(b), edits, ["within", "across"])), "brain", "candidate_id")


@query("a16_score_splits_by_brain", by_brain(ORACLES["a16_score_split_candidate"]).replace("when run = 2 and neuron % 2 = 1", "when run = 1 and neuron % 2 = 1"))
def _(t):
    # the split edits are made for the first labelling, so it stands under both names here
    b = Brains(t)
    b.two = t
    twin = lambda df: df.withColumn("brain", F.lit("a")).unionByName(df.withColumn("brain", F.lit("b")))
    brain = _prepared(b)
    edits = SC.pooled(twin(split_edits(t)), BY, labels=["label"]).drop("brain")
    return round_per_neuron(_told_apart(SC.score(brain, edits, ["split"])), "brain", "candidate_id")
