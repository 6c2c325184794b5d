"""Node and edge tables: degrees, lengths, components, reach, pruning, resampling.

Edges are stored once per undirected edge. Operators that need both directions
build the symmetric view themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.operators.ordering import global_rank
from dendrospark.session import cut, is_empty, merged, side_by_side

XYZ = ("x", "y", "z")


def symmetric(edges: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge as ``src, dst``."""
    return edges.select(*by, *carry, F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )).alias("_e")).select(*by, "_e.src", "_e.dst", *carry)


def degrees(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes with ``degree`` (0 for isolated nodes)."""
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node_id"))
    counted = ends.groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.join(merged(counted), [*by, "node_id"], "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def node_class(degree: Column) -> Column:
    return (F.when(degree >= 3, "branch").when(degree == 2, "shaft").when(degree == 1, "tip").otherwise("isolated"))


def labelled(df: DataFrame, label: str = "label", background: str = "0") -> DataFrame:
    return df.filter(F.col(label).isNotNull() & (F.col(label) != background))


def label_universe(nodes: DataFrame, label: str = "label") -> DataFrame:
    return labelled(nodes, label).select(label).distinct().orderBy(label)


def with_ends(edges: DataFrame, nodes: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Edges with ``<col>_src`` and ``<col>_dst`` taken from the node table."""
    for end in ("src", "dst"):
        side = nodes.select(*by, F.col("node_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols])
        edges = _by_id(edges, side, end, by)
    return edges


def _by_id(df: DataFrame, side: DataFrame, col: str, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """``df`` with ``side`` merged in on ``by`` and ``col``. The id comes first: rows are sorted by the leading bytes of the first key, and ``by`` has few values."""
    out = df.join(merged(side), [col, *by], how)
    first = [*by, col]
    return out.select(*first, *[c for c in out.columns if c not in first])


def length_of(a: str = "src", b: str = "dst") -> Column:
    d2 = sum(((F.col(f"{c}_{a}") - F.col(f"{c}_{b}")) * (F.col(f"{c}_{a}") - F.col(f"{c}_{b}")) for c in XYZ), F.lit(0))
    return F.sqrt(d2)


def edge_length(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges with their Euclidean ``length``."""
    drop = [f"{c}_{e}" for c in XYZ for e in ("src", "dst")]
    return with_ends(edges, nodes, XYZ, by).withColumn("length", length_of()).drop(*drop)


def edge_midpoints(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    wide = with_ends(edges, nodes, XYZ, by)
    return wide.select(*edges.columns, *[((F.col(f"{c}_src") + F.col(f"{c}_dst")) / 2.0).alias(f"mid_{c}") for c in XYZ])


# --- components -----------------------------------------------------------------------------------------------------


def component_map(edges: DataFrame, by: Sequence[str] = ()) -> list[DataFrame]:
    """Contraction steps ``(by, v, r)``, to be applied one after the other.

    Each round hooks every vertex on its smallest neighbour, doubles the pointers
    three times and contracts the edges, so long chains shrink eightfold per
    round. No component is ever gathered: the work is joins on vertex ids and
    ``min`` aggregates with map-side combine.
    """
    by = list(by)
    work = cut(edges.filter(F.col("src") != F.col("dst")).select(
        *by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))
    steps: list[DataFrame] = []
    while not is_empty(work):
        hop = work.groupBy(*by, F.col("b").alias("v")).agg(F.min("a").alias("r"))
        for _ in range(3):
            onward = hop.select(*by, F.col("v").alias("r"), F.col("r").alias("_rr"))
            hop = _by_id(hop, onward, "r", by, "left").select(*by, "v", F.coalesce("_rr", "r").alias("r"))
        hop = cut(hop)
        steps.append(hop)
        moved = _follow(_follow(work, hop, by, "a"), hop, by, "b")
        # a pointer that does not end in a root yet stays in the graph as an edge
        tree = hop.select(*by, F.col("r").alias("a")).distinct().withColumn("b", F.col("a"))
        tree = _follow(tree, hop, by, "b").filter(F.col("a") != F.col("b"))
        work = moved.select(*by, "a", "b").unionByName(tree.select(*by, "a", "b")).filter(F.col("a") != F.col("b"))
        work = cut(work.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return steps


def _follow(df: DataFrame, hop: DataFrame, by: list[str], col: str) -> DataFrame:
    step = hop.select(*by, F.col("v").alias(col), F.col("r").alias("_to"))
    return _by_id(df, step, col, by, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")


def connected_components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), id_col: str = "node_id",
                         out: str = "component") -> DataFrame:
    """Nodes with ``component`` = smallest node id of their connected component."""
    result = nodes.withColumn(out, F.col(id_col))
    whole = component_roots(edges, by)
    return result if whole is None else _follow(result, whole, list(by), out)


def component_roots(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame | None:
    """``by, v, r``: the smallest node id of the component of ``v``, for all nodes of edges that are not the smallest themselves; None without edges."""
    by = list(by)
    steps = component_map(edges, by)
    if not steps:
        return None
    # the narrow steps are put together from the last, so that the nodes are joined once
    whole = steps[-1]
    for hop in reversed(steps[:-1]):  # a vertex that pointed to no root comes again in a later step
        later = _by_id(whole, hop.select(*by, "v"), "v", by, "left_anti").select(*by, "v", "r")
        whole = _follow(hop, whole, by, "r").select(*by, "v", "r").unionByName(later)
    return whole


# --- reach and tangents ---------------------------------------------------------------------------------------------


def reach(starts: DataFrame, sym: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Nodes within path length ``radius`` of each start: ``start, node_id, dist``.

    ``sym`` is the symmetric edge view with ``length``. The frontier carries only
    improved distances, and the loop ends when none is left, at the latest after
    radius / shortest edge rounds.
    """
    by = list(by)
    step = sym.select(*by, F.col("src").alias("node_id"), F.col("dst").alias("_next"), "length")
    seen = cut(starts.select(*by, F.col("node_id").alias("start"), "node_id", F.lit(0.0).alias("dist")).distinct())
    frontier = seen
    while True:
        onward = frontier.join(merged(step), [*by, "node_id"]).select(
            *by, "start", F.col("_next").alias("node_id"), (F.col("dist") + F.col("length")).alias("_new"))
        onward = onward.filter(F.col("_new") <= radius).groupBy(*by, "start", "node_id").agg(F.min("_new").alias("_new"))
        better = onward.join(merged(seen), [*by, "start", "node_id"], "left").filter(
            F.col("dist").isNull() | (F.col("_new") < F.col("dist")))
        frontier = cut(better.select(*by, "start", "node_id", F.col("_new").alias("dist")))
        if is_empty(frontier):
            return seen
        seen = cut(seen.unionByName(frontier).groupBy(*by, "start", "node_id").agg(F.min("dist").alias("dist")))


def _normalised(prefix: str, eps: float = 1e-9) -> dict[str, Column]:
    norm = F.sqrt(sum((F.col(f"{prefix}{c}") * F.col(f"{prefix}{c}") for c in XYZ), F.lit(0.0)))
    return {f"t{c}": F.when(norm > eps, F.col(f"{prefix}{c}") / norm) for c in XYZ}


def tip_tangent(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unit vector from the only neighbour to each tip (NULL when they coincide)."""
    tips = degrees(nodes, edges, by).filter(F.col("degree") == 1).select(*by, "node_id", *XYZ)
    near = symmetric(edges, by).select(*by, F.col("src").alias("node_id"), F.col("dst").alias("_n"))
    other = nodes.select(*by, F.col("node_id").alias("_n"), *[F.col(c).alias(f"_n{c}") for c in XYZ])
    diff = tips.join(merged(near), [*by, "node_id"]).join(merged(other), [*by, "_n"]).withColumns({f"_d{c}": F.col(c) - F.col(f"_n{c}") for c in XYZ})
    return diff.withColumns(_normalised("_d")).select(*by, "node_id", *[f"t{c}" for c in XYZ])


def mean_tangent(nodes: DataFrame, reached: DataFrame, inward: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the unit displacements from a start to the nodes in its reach, re-normalised.

    The mean points into the fragment; ``inward=False`` turns it outward.
    """
    at = nodes.select(*by, "node_id", *XYZ)
    start = at.select(*by, F.col("node_id").alias("start"), *[F.col(c).alias(f"_s{c}") for c in XYZ])
    unit = reached.filter(F.col("start") != F.col("node_id")).join(merged(at), [*by, "node_id"]).join(merged(start), [*by, "start"]).withColumns(
        {f"_d{c}": F.col(c) - F.col(f"_s{c}") for c in XYZ}).withColumns(_normalised("_d"))
    total = unit.groupBy(*by, "start").agg(*[F.sum(f"t{c}").alias(f"_m{c}") for c in XYZ])
    sign = 1.0 if inward else -1.0
    return total.withColumns(_normalised("_m")).select(
        *by, F.col("start").alias("node_id"), *[(F.col(f"t{c}") * sign).alias(f"t{c}") for c in XYZ])


def radius_variance(nodes: DataFrame, reached: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Population variance of the positive radii in the reach of each start."""
    r = nodes.select(*by, "node_id", F.when(F.col("radius") > 0, F.col("radius").cast("double")).alias("_r"))
    return reached.join(r, [*by, "node_id"]).groupBy(*by, F.col("start").alias("node_id")).agg(
        F.var_pop("_r").alias("radius_variance"), F.count("_r").alias("n_nodes"))


# --- lengths, filters -----------------------------------------------------------------------------------------------


def run_length(edges_with_length: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges_with_length.groupBy(*keys).agg(F.sum("length").alias("run_length"), F.count(F.lit(1)).alias("n_edges"))


def drop_short(nodes: DataFrame, edges: DataFrame, min_um: float, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keep the components whose cable reaches ``min_um``."""
    marked = cut(connected_components(nodes, edges, by))
    comp = marked.select(*by, F.col("node_id").alias("src"), "component")
    lengths = edge_length(edges, nodes, by).join(comp, [*by, "src"])
    long_enough = lengths.groupBy(*by, "component").agg(F.sum("length").alias("_l")).filter(F.col("_l") >= min_um)
    kept = marked.join(long_enough.select(*by, "component"), [*by, "component"], "left_semi")
    return kept, edges.join(kept.select(*by, F.col("node_id").alias("src")), [*by, "src"], "left_semi")


def sample_node(nodes: DataFrame, seed: int = 0, id_col: str = "node_id") -> DataFrame:
    """One node chosen by the smallest seeded hash: a draw that does not depend on partitioning."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    return nodes.withColumn("draw", key).orderBy("draw").limit(1)


def dense_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Map the ids of ``col`` to 1..n in id order.

    Ranks are computed per range bucket of the distinct ids and shifted by the
    size of the buckets before, so no task sees all ids.
    """
    return df.join(global_rank(df.select(col).distinct(), [F.col(col)], out), col)


def graph_summary(nodes: DataFrame, edges: DataFrame, segment: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Nodes, edges, connected components and distinct segment ids."""
    by = list(by)
    marked = connected_components(nodes, edges, by)
    n = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("component").alias("n_components"),
        F.countDistinct(F.substring_index(F.col(segment).cast("string"), ".", 1)).alias("n_segments"))
    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"))
    if by:
        return n.join(e, by, "left").fillna(0, ["n_edges"])
    return side_by_side(n, e)
