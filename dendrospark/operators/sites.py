"""Candidate repair sites from fragment geometry alone.

A split site is a tip close to a node of another label. A merge site is a place
where one label may hold two neurites: a branch, a kinked neck, or two pieces
that are not connected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.functions.scalar import BACKGROUND, angle_deg, radius_ratio
from dendrospark.operators.graph import XYZ, connected_components, degrees, labelled, length_of, symmetric, with_ends
from dendrospark.operators.greedy import suppress
from dendrospark.operators.ordering import global_rank
from dendrospark.operators.spatial import HOT_ROWS, as_build, nearest, within_distance
from dendrospark.operators.walk import Steps, arm_ends, arm_seeds, chain_tables, first_edges
from dendrospark.session import cut, merged

MERGE_SITE_COLUMNS = [
    "label", "cut_node", "cut_x", "cut_y", "cut_z", "seed_a_node", "seed_b_node",
    "seed_a_x", "seed_a_y", "seed_a_z", "seed_b_x", "seed_b_y", "seed_b_z",
    "branch_degree", "angle_deg", "radius_ratio", "cable_a_um", "cable_b_um", "detector",
]


def known_nodes(frag_node: DataFrame, frag_edge: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The nodes with their degrees, written once for several detectors."""
    cols = [c for c in ("label", *XYZ, "radius") if c in frag_node.columns]
    return cut(degrees(frag_node.select(*by, "node_id", *cols), frag_edge, by))


# --- split sites ----------------------------------------------------------------------------------------------------


def tip_pairs(frag_node: DataFrame, frag_edge: DataFrame, max_gap: float = 15.0, tip_to_shaft: bool = True,
              by: Sequence[str] = (), hot_rows: int = HOT_ROWS, known: DataFrame | None = None) -> DataFrame:
    """Every (tip, node of another label) pair within ``max_gap``.

    ``by, node_a, label_a, ax.., node_b, label_b, degree_b, bx.., d2``. Coincident
    nodes of one label count once, with their smallest id. ``known`` are the nodes with their degrees, if at hand.
    """
    known = labelled(known_nodes(frag_node, frag_edge, by) if known is None else known)  # read four times below

    def side(df, tag):
        first = df.groupBy(*by, "label", *XYZ).agg(F.min(F.struct("node_id", "degree")).alias("_n"))
        return first.select(*by, F.col("_n.node_id").alias(f"node_{tag}"), F.col("label").alias(f"label_{tag}"),
                            F.col("_n.degree").alias(f"degree_{tag}"), *[F.col(c).alias(f"{tag}{c}") for c in XYZ])

    tips = known.filter(F.col("degree") == 1)
    partners = side(known if tip_to_shaft else tips, "b")
    return within_distance(
        side(tips, "a").drop("degree_a"), partners, max_gap, by=by, probe_xyz=("ax", "ay", "az"),
        build_xyz=("bx", "by", "bz"), condition=F.col("label_a") != F.col("label_b"), hot_rows=hot_rows)


def closest_per_label_pair(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The closest pair of every unordered label pair; ties by node ids."""
    best = pairs.groupBy(*by, F.least("label_a", "label_b").alias("_l"), F.greatest("label_a", "label_b").alias("_h")).agg(
        F.min(F.struct("d2", "node_a", "node_b", "label_a", "label_b", "degree_b", "ax", "ay", "az", "bx", "by", "bz"))
        .alias("_s"))
    return best.select(*by, "_s.*").withColumn("gap_um", F.sqrt("d2"))


def split_sites(frag_node: DataFrame, frag_edge: DataFrame, max_gap: float = 15.0, max_sites: int | None = None,
                tip_to_shaft: bool = True, by: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
    """Candidate split sites, closest gaps first, all of them, or at most ``max_sites`` per ``by`` (a report limit), smallest gap first."""
    sites = closest_per_label_pair(tip_pairs(frag_node, frag_edge, max_gap, tip_to_shaft, by, known=known), by)
    if max_sites is None:
        return sites
    order = [F.col("gap_um"), F.col("node_a"), F.col("node_b")]
    return _first_per(sites, order, max_sites, by)


def _first_per(sites: DataFrame, order: list, most: int, by: Sequence[str]) -> DataFrame:
    """The first ``most`` rows of each ``by``; of all when there is none."""
    ranked = (sites.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by
              else global_rank(sites, order, "_place"))
    return ranked.filter(F.col("_place") <= most).drop("_place")


def mutual_nearest(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tip pairs that are each other's nearest partner.

    Built on the raw pairs: the per-label-pair choice keeps one direction only,
    so reciprocity cannot be tested after it.
    """
    first = pairs.groupBy(*by, "node_a").agg(F.min(F.struct("d2", "node_b", "label_a", "label_b")).alias("_n")).select(
        *by, "node_a", "_n.*")
    back = first.select(*by, F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"))
    return first.join(merged(back), [*by, "node_a", "node_b"]).filter(F.col("node_a") < F.col("node_b"))


def proposals(pairs: DataFrame, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """At most ``k`` partners per leaf, one per other label, nearest first."""
    one_each = pairs.groupBy(*by, "node_a", "label_b").agg(
        F.min(F.struct("d2", "node_b", "label_a", "degree_b")).alias("_n")).select(*by, "node_a", "label_b", "_n.*")
    order = Window.partitionBy(*by, "node_a").orderBy("d2", "node_b")
    return one_each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def label_proposals(props: DataFrame, node_to_neuron: DataFrame, by: Sequence[str] = (), frag_node: DataFrame | None = None,
                    gt_node: DataFrame | None = None, max_projection: float = 8.0) -> DataFrame:
    """Truth of each proposal: accept, reject or unknown by the neurons of its two ends.

    With the nodes of both graphs given, an accepted proposal must also lie along its neuron: ``projection_p90``, the 90th percentile
    of the distances from the proposal's points to that neuron, has to be less than ``max_projection``; it is rejected otherwise.
    """
    for end in ("node_a", "node_b"):
        props = props.join(node_to_neuron.select(*by, F.col("node_id").alias(end), F.col("neuron").alias(f"neuron_{end}")),
                           [*by, end], "left")
    same = F.col("neuron_node_a") == F.col("neuron_node_b")
    props = props.withColumn("truth", F.when(same, "accept").when(~same, "reject").otherwise("unknown"))
    if frag_node is None or gt_node is None:
        return props
    props = cut(props)
    one = props.filter(F.col("truth") == "accept").select(*by, "node_a", "node_b", F.col("neuron_node_a").alias("neuron"))
    far = proposal_projection(one, frag_node, gt_node, by=by).drop("neuron")
    props = props.join(far, [*by, "node_a", "node_b"], "left")
    aside = (F.col("truth") == "accept") & (F.col("projection_p90") >= max_projection)
    return props.withColumn("truth", F.when(aside, "reject").otherwise(F.col("truth")))


def proposal_projection(props: DataFrame, frag_node: DataFrame, gt_node: DataFrame, spacing: float = 1.0, share: float = 0.9,
                        by: Sequence[str] = (), start: float = 8.0) -> DataFrame:
    """``by, node_a, node_b, neuron, projection_p90`` for proposals ``node_a, node_b, neuron``.

    Points lie at most ``spacing`` apart on the straight line between the ends, both included; each is measured to the nearest node
    of the neuron, however far. A proposal is no longer than its search radius, so it has few points.
    """
    line = props.select(*by, "node_a", "node_b", "neuron")
    for node in ("node_a", "node_b"):
        line = _place(line, frag_node, node, node, by)
    axes = [(F.col(f"node_a_{c}").cast("double"), F.col(f"node_b_{c}").cast("double")) for c in XYZ]
    length = F.sqrt(sum(((b - a) * (b - a) for a, b in axes), F.lit(0.0)))
    line = line.withColumn("_steps", F.greatest(F.lit(1), F.ceil(length / spacing).cast("int")))
    line = line.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    points = line.select(*by, "neuron", F.struct("node_a", "node_b", "_i").alias("_point"),
                         *[(a + (b - a) * F.col("_i") / F.col("_steps")).alias(c) for c, (a, b) in zip(XYZ, axes)])
    build = as_build(gt_node.select(*by, "node_id", *XYZ, F.col("neuron")), by=[*by, "neuron"])
    # the nodes of one neuron are few in a cell, and points many: wide cells repeat fewer points
    hit = nearest(points, build, probe_id="_point", build_id="b_id", radius=start, by=[*by, "neuron"], bounded=False, side=8.0 * start)
    return hit.groupBy(*by, "neuron", "_point.node_a", "_point.node_b").agg(
        F.percentile(F.sqrt("d2"), F.lit(share)).alias("projection_p90"))


# --- merge sites ----------------------------------------------------------------------------------------------------


def _place(sites: DataFrame, frag_node: DataFrame, node: str, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    at = frag_node.select(*by, F.col("node_id").alias(node), *[F.col(c).alias(f"{prefix}_{c}") for c in XYZ])
    return sites.join(merged(at), [*by, node])


def _two_sides(ends: DataFrame, order: list, by: Sequence[str] = ()) -> DataFrame:
    """The first two arms in order of each cut in one row, with the places of their ends."""
    first = ends.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "node_id").orderBy(*order))).filter(F.col("_rank") <= 2)

    def pick(rank, col):
        return F.max(F.when(F.col("_rank") == rank, F.col(col)))

    aggs = [pick(rank, col).alias(f"{col}_{tag}") for tag, rank in (("a", 1), ("b", 2))
            for col in ("arm", *[f"end_{c}" for c in XYZ], "cable", "mean_radius")]
    return first.groupBy(*by, "node_id").agg(*aggs).filter(F.col("cable_b").isNotNull())


def _with_angle(sides: DataFrame, cuts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Places of the cuts, and the angle between the two sides there."""
    s = sides.join(merged(cuts.select(*by, "node_id", "label", "degree", *[F.col(c).alias(f"cut_{c}") for c in XYZ])), [*by, "node_id"])
    s = s.withColumns({f"_{t}{c}": (F.col(f"end_{c}_{t}") - F.col(f"cut_{c}")).cast("double") for t in "ab" for c in XYZ})
    return s.withColumns({
        "angle_deg": angle_deg("_a", "_b"),
        "radius_ratio": radius_ratio(F.col("mean_radius_a"), F.col("mean_radius_b")),
    }).withColumnsRenamed({"cable_a": "cable_a_um", "cable_b": "cable_b_um", "degree": "branch_degree"})


def _with_seeds(sites: DataFrame, arms: DataFrame, tables: Steps, seed_depth: float, by: Sequence[str] = ()) -> DataFrame:
    """Seeds of both sides: only the arms of sites are walked once more."""
    chosen = sites.select(*by, "node_id", F.explode(F.array("arm_a", "arm_b")).alias("arm")).distinct()
    seeds = cut(arm_seeds(arms.join(merged(chosen), [*by, "node_id", "arm"], "left_semi"), tables, seed_depth, by))
    for t in "ab":
        side = seeds.select(*by, "node_id", F.col("arm").alias(f"arm_{t}"), F.col("seed_node").alias(f"seed_{t}_node"),
                            *[F.col(f"seed_{c}").alias(f"seed_{t}_{c}") for c in XYZ])
        sites = sites.join(merged(side), [*by, "node_id", f"arm_{t}"])
    return sites.withColumnRenamed("node_id", "cut_node")


def _arm_sites(frag_node: DataFrame, frag_edge: DataFrame, branch: bool, bridge: bool, min_arm: float, seed_depth: float, max_angle: float = 120.0,
               separation: float = 20.0, by: Sequence[str] = (), chains: tuple[DataFrame, Steps] | None = None,
               known: DataFrame | None = None) -> DataFrame:
    """Branches and necks between two long arms. The arms of both are walked together: a walk reads the tables of steps whole, however few its starts."""
    known = known_nodes(frag_node, frag_edge, by) if known is None else known
    directed, tables = chains or chain_tables(frag_node, frag_edge, 3.0 * seed_depth, by, known)
    at_branch, at_neck = F.col("degree") >= 3, F.col("degree") == 2
    wanted = at_branch if not bridge else at_neck if not branch else F.col("degree") >= 2
    out = labelled(directed.withColumnRenamed("ulabel", "label")).filter(wanted)
    arms = first_edges(out, at_branch, by, keep=["degree"])  # an arm of a neck begins at the neighbour
    # the longest arms of a branch, where rounding keeps arms of equal length in neighbour order; a neck has two
    order = [F.when(at_branch, F.round("cable", 6)).desc(), F.col("arm")]
    sides = _two_sides(arm_ends(arms, tables, 3.0 * seed_depth, by), order, by).filter((F.col("cable_a") >= min_arm) & (F.col("cable_b") >= min_arm))
    neck = F.col("branch_degree") == 2
    sites = cut(_with_angle(sides, known, by).filter(~neck | (F.col("angle_deg") <= max_angle)))
    if bridge:  # sharpest first
        points = sites.filter(neck).select(*by, "node_id", F.round("angle_deg", 6).alias("_a"), *[F.col(f"cut_{c}").alias(c) for c in XYZ])
        kept = suppress(points, [F.col("_a")], separation, by=by).select(*by, "node_id")
        sites = cut(sites.filter(~neck).unionByName(sites.filter(neck).join(merged(kept), [*by, "node_id"], "left_semi").select(*sites.columns)))
    sites = _with_seeds(sites, arms, tables, seed_depth, by)
    return sites.withColumn("detector", F.when(neck, "bridge").otherwise("branch")).select(*by, *MERGE_SITE_COLUMNS)


def merge_sites_branch(frag_node: DataFrame, frag_edge: DataFrame, min_arm: float = 10.0, seed_depth: float = 8.0,
                       by: Sequence[str] = (), chains: tuple[DataFrame, Steps] | None = None,
                       known: DataFrame | None = None) -> DataFrame:
    """Nodes of degree 3 or more whose two longest arms both reach ``min_arm``."""
    return _arm_sites(frag_node, frag_edge, True, False, min_arm, seed_depth, by=by, chains=chains, known=known)


def merge_sites_bridge(frag_node: DataFrame, frag_edge: DataFrame, min_arm: float = 10.0, seed_depth: float = 8.0,
                       max_angle: float = 120.0, separation: float = 20.0, by: Sequence[str] = (),
                       chains: tuple[DataFrame, Steps] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Kinked necks: degree 2, both sides long, angle at most ``max_angle``; sharpest first within ``separation``."""
    return _arm_sites(frag_node, frag_edge, False, True, min_arm, seed_depth, max_angle, separation, by, chains, known)


def component_sizes(frag_node: DataFrame, frag_edge: DataFrame, by: Sequence[str] = (), directed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled nodes with their component inside the label, and cable and mean radius per component. ``directed`` are the ``directed_edges``, if at hand."""
    nodes = labelled(frag_node).select(*by, "node_id", "label", *XYZ, "radius")
    if directed is None:
        ends = with_ends(frag_edge.select(*by, "src", "dst"), nodes, [*XYZ, "label"], by)
        inside = cut(ends.filter(F.col("label_src") == F.col("label_dst")).select(*by, "src", "dst", length_of().alias("length")))
    else:  # one direction of each edge
        one = directed.filter((F.col("e") % 2 == 0) & (F.col("ulabel") == F.col("vlabel")) & (F.col("ulabel") != BACKGROUND))
        inside = one.select(*by, F.col("u").alias("src"), F.col("v").alias("dst"), "length")
    marked = cut(connected_components(nodes, inside, by))
    cable = inside.select(*by, "src", "length").join(merged(marked.select(*by, F.col("node_id").alias("src"), "component")), [*by, "src"]).groupBy(
        *by, "component").agg(F.sum("length").alias("cable"))
    r = F.col("radius").cast("double")
    sized = marked.groupBy(*by, "label", "component").agg(
        F.avg(F.when(r > 0, r)).alias("mean_radius"), F.count(F.lit(1)).alias("n_nodes")).join(
        merged(cable), [*by, "component"], "left").withColumn("cable", F.coalesce("cable", F.lit(0.0)))
    return marked, cut(sized)


def closest_component_pair(marked: DataFrame, sized: DataFrame, start: float = 20.0, by: Sequence[str] = ()) -> DataFrame:
    """Per label: the largest component against each other one, at their closest node pair.

    Looks from the smaller components to the largest with a growing radius, so
    no pair of far nodes is ever formed.
    """
    scope = [*by, "label"]
    top = sized.groupBy(*scope).agg(
        F.max(F.struct(F.round("cable", 6).alias("c"), (-F.col("component")).alias("neg"))).alias("_t"),
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    big = top.select(*scope, (-F.col("_t.neg")).alias("component_a"))
    ranked = sized.join(merged(big), scope)
    ranked = ranked.select(*by, "component", "component_a")
    taken = cut(marked.select(*scope, "node_id", *XYZ, "component").join(merged(ranked), [*by, "component"]))
    probe = taken.filter(F.col("component") != F.col("component_a"))
    build = taken.filter(F.col("component") == F.col("component_a"))
    hit = nearest(probe, as_build(build, by=scope), probe_id="node_id", build_id="b_id", radius=start, by=scope,
                  bounded=False)
    pairs = hit.join(merged(probe.select(*by, "node_id", "component")), [*by, "node_id"]).groupBy(*scope, "component").agg(
        F.min(F.struct("d2", F.col("node_id").alias("node_b"), F.col("b_id").alias("node_a"))).alias("_p"))
    return pairs.select(*scope, F.col("component").alias("component_b"), "_p.node_a", "_p.node_b", "_p.d2").join(merged(big), scope)


def merge_sites_component(frag_node: DataFrame, frag_edge: DataFrame, min_arm: float = 10.0, by: Sequence[str] = (),
                          directed: DataFrame | None = None) -> DataFrame:
    """One label over two or more unconnected pieces of at least ``min_arm`` cable."""
    marked, sized = component_sizes(frag_node, frag_edge, by, directed)
    sized = sized.filter(F.col("cable") >= min_arm)
    pairs = closest_component_pair(marked, sized, by=by)

    def info(tag):
        return sized.select(*by, F.col("component").alias(f"component_{tag}"), F.col("cable").alias(f"cable_{tag}_um"),
                            F.col("mean_radius").alias(f"_r{tag}"))

    s = pairs.join(merged(info("a")), [*by, "component_a"]).join(merged(info("b")), [*by, "component_b"])
    s = s.withColumnsRenamed({"node_a": "seed_a_node", "node_b": "seed_b_node"})
    s = _place(_place(s, frag_node, "seed_a_node", "seed_a", by), frag_node, "seed_b_node", "seed_b", by)
    return s.withColumns({
        **{f"cut_{c}": (F.col(f"seed_a_{c}") + F.col(f"seed_b_{c}")) / 2.0 for c in XYZ},
        "cut_node": F.col("seed_a_node"),
        "branch_degree": F.lit(0).cast("bigint"),
        "angle_deg": F.lit(None).cast("double"),
        "radius_ratio": radius_ratio(F.col("_ra"), F.col("_rb")),
        "detector": F.lit("component"),
    }).select(*by, *MERGE_SITE_COLUMNS)


def cap_sites(sites: DataFrame, max_per_label: int | None = None, max_sites: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The strongest sites of each label, then the strongest of each ``by`` (of all without it), by the shorter arm; no limit unless given."""
    strength = F.round(F.least("cable_a_um", "cable_b_um"), 6)
    order = [strength.desc(), F.col("cut_node"), F.col("seed_b_node"), F.col("detector")]
    if max_per_label is not None:
        sites = _first_per(sites, order, max_per_label, [*by, "label"])
    return sites if max_sites is None else _first_per(sites, order, max_sites, by)


def merge_sites(frag_node: DataFrame, frag_edge: DataFrame, min_arm: float = 10.0, seed_depth: float = 8.0,
                max_per_label: int | None = None, max_sites: int | None = None, by: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
    """All three detectors; limits per label and overall (of each ``by``) only if given."""
    known = known_nodes(frag_node, frag_edge, by) if known is None else known
    chains = chain_tables(frag_node, frag_edge, 3.0 * seed_depth, by, known)
    found = _arm_sites(frag_node, frag_edge, True, True, min_arm, seed_depth, by=by, chains=chains, known=known)
    found = found.unionByName(merge_sites_component(frag_node, frag_edge, min_arm, by, chains[0]))
    return cap_sites(found, max_per_label, max_sites, by)


def all_sites(frag_node: DataFrame, frag_edge: DataFrame, max_gap: float = 15.0, by: Sequence[str] = ()) -> DataFrame:
    """The stream of all split and merge sites, without limits; both kinds share the nodes with their degrees."""
    known = known_nodes(frag_node, frag_edge, by)
    return site_stream(*[sites_of_kind(kind, frag_node, frag_edge, max_gap, by, known) for kind in ("split", "merge")])


def sites_of_kind(kind: str, frag_node: DataFrame, frag_edge: DataFrame, max_gap: float = 15.0, by: Sequence[str] = (),
                  known: DataFrame | None = None) -> DataFrame:
    """All split sites, or all merge sites of the three detectors: the part of the stream that a policy on one kind looks at."""
    if kind == "split":
        return split_sites(frag_node, frag_edge, max_gap, by=by, known=known).withColumn("kind", F.lit(kind))
    return merge_sites(frag_node, frag_edge, by=by, known=known).withColumn("kind", F.lit(kind))


def site_stream(split: DataFrame, merge: DataFrame) -> DataFrame:
    """Both kinds in one table, tagged ``kind``."""
    return split.withColumn("kind", F.lit("split")).unionByName(
        merge.withColumn("kind", F.lit("merge")), allowMissingColumns=True)


def site_counts(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return stream.groupBy(*by, "kind", F.coalesce("detector", F.lit("")).alias("detector")).agg(F.count(F.lit(1)).alias("n"))


# --- severing -------------------------------------------------------------------------------------------------------


def sharp_edges(nodes: DataFrame, edges: DataFrame, max_angle: float = 30.0) -> DataFrame:
    """Edges at branch nodes that leave within ``max_angle`` of an edge to a smaller neighbour id.

    Unit directions of one node are compared on a cell grid, so a hub with very
    many edges does not compare all of them with each other.
    """
    hubs = degrees(nodes, edges).filter(F.col("degree") >= 3).select(F.col("node_id").alias("hub"), *[F.col(c).alias(f"h{c}") for c in XYZ])
    sym = symmetric(edges).select(F.col("src").alias("hub"), F.col("dst").alias("nbr"))
    out = sym.join(hubs, "hub").join(nodes.select(F.col("node_id").alias("nbr"), *XYZ), "nbr")
    d2 = sum(((F.col(c) - F.col(f"h{c}")) * (F.col(c) - F.col(f"h{c}")) for c in XYZ), F.lit(0))
    unit = out.filter(d2 > 0).select("hub", "nbr", *[((F.col(c) - F.col(f"h{c}")) / F.sqrt(d2)).alias(c) for c in XYZ])
    other = unit.select("hub", F.col("nbr").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    chord = 2.0 * math.sin(math.radians(max_angle) / 2.0)
    close = within_distance(unit, other, chord, by=["hub"], condition=F.col("other") < F.col("nbr"), inclusive=False)
    return close.select(F.least("hub", "nbr").alias("_lo"), F.greatest("hub", "nbr").alias("_hi")).distinct()


def thin_necks(nodes: DataFrame, edges: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Edges at degree-2 nodes whose radius is below ``ratio`` times the mean of their neighbours' radii."""
    sym = symmetric(edges)
    r = nodes.select(F.col("node_id").alias("dst"), F.col("radius").cast("double").alias("_nr"))
    mean = sym.join(r, "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("_nr").alias("_mean"))
    necks = degrees(nodes, edges).filter(F.col("degree") == 2).join(mean, "node_id").filter(F.col("radius") < F.lit(ratio) * F.col("_mean"))
    return sym.join(necks.select(F.col("node_id").alias("src")), "src").select(
        F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")).distinct()


def sever(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Edges without the flagged ones; degrees, tips and proposals follow from running their operators again."""
    keyed = edges.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")})
    return keyed.join(flagged, ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")
