"""Walks along unbranched chains, by doubling instead of step by step.

A directed edge u->v goes on to v->w exactly when v has one other neighbour.
Tables of 1, 2, 4, ... steps answer "walk until the cable reaches L" in
log2(steps) joins, whatever the node spacing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.operators.graph import XYZ, degrees, length_of, with_ends
from dendrospark.session import cut, is_empty, merged


def directed_edges(nodes: DataFrame, edges: DataFrame, stops: DataFrame | None = None, by: Sequence[str] = (),
                   known: DataFrame | None = None) -> DataFrame:
    """``e, u, v, length, degree, through, passes, usum, ucnt, rsum, rcnt``: both directions of every edge, with the places
    (``ux.., vx..``) and labels of both ends, if there are any.

    ``e`` is a number over all brains; the two directions of an edge are 2k and 2k + 1, so that tables of steps need no other key.
    ``degree`` is that of u. ``passes`` tells whether a walk may go on beyond v (degree 2 and not a stop), ``through`` the same of u;
    ``rsum, rcnt`` are v's positive radius and 1, or zeros, ``usum, ucnt`` those of u. ``known`` are the nodes with their degrees, if at hand.
    """
    known = degrees(nodes, edges, by) if known is None else known
    passes = F.col("degree") == 2
    if stops is not None:
        known = known.join(merged(stops.select(*by, "node_id", F.lit(True).alias("_stop")).distinct()), ["node_id", *by], "left")
        passes = passes & F.col("_stop").isNull()
    radius = F.col("radius").cast("double") if "radius" in nodes.columns else F.lit(0.0)
    label = ["label"] if "label" in nodes.columns else []
    at = known.select(
        *by, "node_id", "degree", passes.alias("passes"), F.when(radius > 0, radius).otherwise(0.0).alias("sum"),
        F.when(radius > 0, 1).otherwise(0).cast("bigint").alias("cnt"), *XYZ, *label)
    ends = with_ends(edges.select(*by, "src", "dst"), at, ["degree", "passes", "sum", "cnt", *XYZ, *label], by)
    ends = ends.select("*", length_of().alias("length"), (F.monotonically_increasing_id() * 2).alias("_k"))

    def way(u: str, v: str, i: int):
        return F.struct(
            (F.col("_k") + i).alias("e"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(f"degree_{u}").alias("degree"),
            F.col(f"passes_{u}").alias("through"), F.col(f"passes_{v}").alias("passes"), F.col(f"sum_{u}").alias("usum"),
            F.col(f"cnt_{u}").alias("ucnt"), F.col(f"sum_{v}").alias("rsum"), F.col(f"cnt_{v}").alias("rcnt"),
            *[F.col(f"{c}_{n}").alias(f"{t}{c}") for t, n in (("u", u), ("v", v)) for c in [*XYZ, *label]])

    both = ends.select(*by, "length", F.explode(F.array(way("src", "dst", 0), way("dst", "src", 1))).alias("_e"))
    return cut(both.select(*by, "length", "_e.*"))


def single_steps(directed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One step on: ``e -> ne`` with the cable and radius it adds.

    A node that a walk passes has two edges out; the way back along one of them goes on along the other.
    """
    cols = ["v", "e", "length", "rsum", "rcnt"]
    two = directed.filter("through").groupBy(*by, "u").agg(
        *[f(c).alias(f"{c}{i}") for i, f in ((0, F.first), (1, F.last)) for c in cols]).filter(F.col("v0") != F.col("v1"))

    def turn(i: int, o: int):
        return F.struct(F.col(f"e{i}").bitwiseXOR(F.lit(1)).alias("e"), F.col(f"e{o}").alias("ne"), F.col(f"length{o}").alias("c"),
                        F.col(f"rsum{o}").alias("rs"), F.col(f"rcnt{o}").alias("rc"))

    return two.select(F.explode(F.array(turn(0, 1), turn(1, 0))).alias("_s")).select("_s.*")


@dataclass
class Steps:
    """Ways on from the directed edges: ``first`` holds one and two steps (``ne, c, rs, rc`` and ``ne2, ..``), ``more`` 2, 4, 8, ... steps."""

    edges: DataFrame
    first: DataFrame
    more: list[DataFrame]


def step_tables(directed: DataFrame, limit: float, by: Sequence[str] = ()) -> Steps:
    """Tables of 2^k steps, as long as some of them stay below ``limit``."""
    one = cut(single_steps(directed, by))
    after = one.select(F.col("e").alias("ne"), F.col("ne").alias("ne2"), F.col("c").alias("c2"), F.col("rs").alias("rs2"), F.col("rc").alias("rc2"))
    first = cut(one.join(merged(after), "ne", "left").select(*one.columns, "ne2", "c2", "rs2", "rc2"))
    last = first.filter(F.col("ne2").isNotNull() & (F.col("c") + F.col("c2") < limit)).select(
        "e", F.col("ne2").alias("ne"), (F.col("c") + F.col("c2")).alias("c"), (F.col("rs") + F.col("rs2")).alias("rs"),
        (F.col("rc") + F.col("rc2")).alias("rc"))
    more: list[DataFrame] = []
    for _ in range(40):
        if is_empty(last):
            return Steps(directed, first, more)
        more.append(last)
        second = last.select(F.col("e").alias("ne"), F.col("ne").alias("_ne"), F.col("c").alias("_c"), F.col("rs").alias("_rs"), F.col("rc").alias("_rc"))
        last = cut(last.join(merged(second), "ne").select(
            "e", F.col("_ne").alias("ne"), (F.col("c") + F.col("_c")).alias("c"), (F.col("rs") + F.col("_rs")).alias("rs"),
            (F.col("rc") + F.col("_rc")).alias("rc")).filter(F.col("c") < limit))
    raise ValueError("chains do not end: edges of no length form a cycle")


def walk_until(starts: DataFrame, steps: Steps, limit: float) -> DataFrame:
    """Advance ``e, cable, rsum, rcnt``: step while the cable is below ``limit`` and the chain goes on."""
    keep = [c for c in starts.columns if c not in ("e", "cable", "rsum", "rcnt")]
    state = starts
    for table in reversed(steps.more):
        go = F.col("ne").isNotNull() & (F.col("cable") + F.col("c") < limit)
        state = state.join(merged(table.filter(F.col("c") < limit)), "e", "left").select(
            *keep, F.when(go, F.col("ne")).otherwise(F.col("e")).alias("e"),
            *[F.when(go, F.col(x) + F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("cable", "c"), ("rsum", "rs"), ("rcnt", "rc"))])
    # what is left are one step that stays below the limit, and the one that reaches it
    go = F.col("ne").isNotNull() & (F.col("cable") < limit)
    on = go & F.col("ne2").isNotNull() & (F.col("cable") + F.col("c") < limit)
    return state.join(merged(steps.first), "e", "left").select(
        *keep, F.when(on, F.col("ne2")).when(go, F.col("ne")).otherwise(F.col("e")).alias("e"),
        *[F.when(on, F.col(x) + F.col(y) + F.col(f"{y}2")).when(go, F.col(x) + F.col(y)).otherwise(F.col(x)).alias(x)
          for x, y in (("cable", "c"), ("rsum", "rs"), ("rcnt", "rc"))])


def chain_tables(nodes: DataFrame, edges: DataFrame, max_um: float, by: Sequence[str] = (), known: DataFrame | None = None) -> tuple[DataFrame, Steps]:
    """Directed edges and their step tables up to ``max_um``, for several calls of ``walk_arms`` over one graph."""
    directed = directed_edges(nodes, edges, by=by, known=known)
    return directed, step_tables(directed, max_um, by)


def walk_arms(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_um: float, seed_um: float, from_neighbour: bool = False,
              by: Sequence[str] = (), chains: tuple[DataFrame, Steps] | None = None) -> DataFrame:
    """Arms out of ``starts`` (``node_id``), one row per start and neighbour.

    ``from_neighbour=False``: the arm begins at the start, the first edge counts
    and so does the radius of the start. ``True``: it begins at the neighbour.
    The limit is tested before each step, so the cable may overshoot. Returns
    ``node_id, arm, end_node, cable, seed_node, mean_radius``. ``chains`` are the ``chain_tables`` of this graph and
    ``max_um``, if at hand.
    """
    by = list(by)
    directed, tables = chains or chain_tables(nodes, edges, max_um, by)
    arms = cut(start_arms(nodes, directed, starts, from_neighbour, by))
    ends = arm_ends(arms, tables, max_um, by).drop(*[f"end_{c}" for c in XYZ])
    return ends.join(merged(arm_seeds(arms, tables, seed_um, by).drop(*[f"seed_{c}" for c in XYZ])), [*by, "node_id", "arm"])


def start_arms(nodes: DataFrame, directed: DataFrame, starts: DataFrame, from_neighbour: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The first edge of every arm out of ``starts`` (some of ``nodes``), as ``walk_until`` takes it."""
    out = directed.join(merged(starts.select(*by, F.col("node_id").alias("u"))), [*by, "u"], "left_semi")
    return first_edges(out, F.lit(not from_neighbour), by)


def first_edges(directed: DataFrame, own: Column, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Directed edges as starts of walks; where ``own``, the edge itself and the radius of its start count."""
    return directed.select(
        *by, F.col("u").alias("node_id"), F.col("v").alias("arm"), *keep, "e", F.when(own, F.col("length")).otherwise(0.0).alias("cable"),
        F.when(own, F.col("rsum") + F.col("usum")).otherwise(F.col("rsum")).alias("rsum"),
        F.when(own, F.col("rcnt") + F.col("ucnt")).otherwise(F.col("rcnt")).alias("rcnt"))


def _arrived(walked: DataFrame, steps: Steps, tag: str) -> DataFrame:
    """The last node of each walk and its place."""
    at = steps.edges.select("e", F.col("v").alias(f"{tag}_node"), *[F.col(f"v{c}").alias(f"{tag}_{c}") for c in XYZ])
    return walked.join(merged(at), "e").drop("e")


def arm_ends(arms: DataFrame, tables: Steps, max_um: float, by: Sequence[str] = ()) -> DataFrame:
    """Ends of the arms as ``end_node, end_x, end_y, end_z``, with ``cable`` and ``mean_radius``."""
    ends = walk_until(arms, tables, max_um)
    return _arrived(ends, tables, "end").withColumn("mean_radius", F.when(F.col("rcnt") > 0, F.col("rsum") / F.col("rcnt"))).drop("rsum", "rcnt")


def arm_seeds(arms: DataFrame, tables: Steps, seed_um: float, by: Sequence[str] = ()) -> DataFrame:
    """The node reached after ``seed_um`` as ``seed_node, seed_x, seed_y, seed_z``."""
    return _arrived(walk_until(arms, tables, seed_um).select(*by, "node_id", "arm", "e"), tables, "seed")


def chain_ends(directed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every directed edge u->v the first node beyond which the walk cannot go: ``u, v, end, last, cable, hops``
    (``last`` is the node before ``end``).

    ``cable`` is measured from u. Edges of closed rings without a stop have no
    end and are left out.
    """
    step = single_steps(directed, by).select("e", "ne", "c")
    state = cut(directed.select("e", "passes").join(merged(step), "e", "left").select(
        "e", F.coalesce("ne", "e").alias("ne"), F.coalesce("c", F.lit(0.0)).alias("c"),
        F.col("ne").isNotNull().cast("bigint").alias("n"), (~F.col("passes")).alias("done")))
    open_before = None
    while True:
        onward = state.select(F.col("e").alias("ne"), F.col("ne").alias("_ne"), F.col("c").alias("_c"), F.col("n").alias("_n"), F.col("done").alias("_done"))
        moved = state.filter(~F.col("done")).join(merged(onward), "ne").select(
            "e", F.col("_ne").alias("ne"), (F.col("c") + F.col("_c")).alias("c"), (F.col("n") + F.col("_n")).alias("n"), F.col("_done").alias("done"))
        state = cut(state.filter("done").unionByName(moved))
        still_open = state.filter(~F.col("done")).count()
        if still_open == 0 or (still_open == open_before and _only_rings(state)):
            break
        open_before = still_open
    ends = state.filter("done").select("e", "ne", "c", "n").join(merged(directed.select(*by, "e", "u", "v", "length")), "e")
    last = directed.select(F.col("e").alias("ne"), F.col("v").alias("end"), F.col("u").alias("last"))
    return ends.join(merged(last), "ne").select(*by, "u", "v", "end", "last", (F.col("length") + F.col("c")).alias("cable"), (F.col("n") + 1).alias("hops"))


def _only_rings(state: DataFrame) -> bool:
    """True when the open walks have gone round at least once: more steps than there are edges."""
    row = state.filter(~F.col("done")).agg(F.min("n"), F.count(F.lit(1))).first()
    return row[0] > row[1]


# --- chains between junctions ---------------------------------------------------------------------------------------


def chains(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the graph at tips and branches.

    Returns the chains (``start, first, end, last, cable``; an end is a tip or a
    branch) and their edges with the position of both ends along the chain
    (``start, first, a, b, pos_a, pos_b`` with pos_a < pos_b for real lengths).
    Closed rings without a junction belong to no chain.
    """
    directed = directed_edges(nodes, edges)
    ends = cut(chain_ends(directed))
    passing = directed.filter("passes").select(F.col("v").alias("u")).distinct()
    out = ends.join(passing, "u", "left_anti")
    table = cut(out.filter(F.struct("u", "v") <= F.struct("end", "last")).select(
        F.col("u").alias("start"), F.col("v").alias("first"), "end", "last", "cable"))
    # a directed edge v->u that ends in (start, first) lies on that chain; its cable is the position of v
    toward = ends.select(F.col("u").alias("b"), F.col("v").alias("a"), F.col("end").alias("start"), F.col("last").alias("first"),
                         F.col("cable").alias("pos_b"))
    on = toward.join(table.select("start", "first"), ["start", "first"])
    length = directed.select(F.col("u").alias("b"), F.col("v").alias("a"), "length")
    members = on.join(length, ["a", "b"]).select("start", "first", "a", "b", (F.col("pos_b") - F.col("length")).alias("pos_a"), "pos_b")
    return table, members


def resample(nodes: DataFrame, edges: DataFrame, spacing: float) -> DataFrame:
    """Points at even steps of about ``spacing`` along every chain: ``start, first, k, pos, x, y, z``.

    k = 0 and the last k are the junctions themselves; consecutive k are the new
    edges. Each old edge makes the points that fall on it, so a long chain is
    never gathered.
    """
    table, members = chains(nodes, edges)
    steps = table.select("start", "first", F.greatest(F.lit(1), F.round(F.col("cable") / F.lit(spacing)).cast("bigint")).alias("n"), "cable")
    at = members.join(steps, ["start", "first"])
    for end in ("a", "b"):
        at = at.join(nodes.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in XYZ]), end)
    step = F.col("cable") / F.col("n")
    # rounding keeps a point that falls on a node from being made twice
    low = F.ceil(F.round(F.col("pos_a") / step, 6))
    high = F.when(F.round(F.col("pos_b") - F.col("cable"), 6) >= 0, F.col("n")).otherwise(F.ceil(F.round(F.col("pos_b") / step, 6)) - 1)
    points = at.filter(low <= high).withColumn("k", F.explode(F.sequence(low, high))).withColumn("pos", F.col("k") * step)
    share = F.when(F.col("pos_b") > F.col("pos_a"), (F.col("pos") - F.col("pos_a")) / (F.col("pos_b") - F.col("pos_a"))).otherwise(0.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return points.select("start", "first", "k", "pos", *[
        (F.col(f"{c}_a") + share * (F.col(f"{c}_b") - F.col(f"{c}_a"))).alias(c) for c in XYZ])


def prune_tips(nodes: DataFrame, edges: DataFrame, depth: float) -> DataFrame:
    """Nodes left after cutting off the terminal branches shorter than ``depth``; the branch node stays."""
    deg = degrees(nodes, edges).select("node_id", "degree")
    table, members = chains(nodes, edges)
    t = table
    for end in ("start", "end"):
        t = t.join(deg.withColumnsRenamed({"node_id": end, "degree": f"_{end}"}), end)
    tip_to_branch = ((F.col("_start") == 1) & (F.col("_end") >= 3)) | ((F.col("_end") == 1) & (F.col("_start") >= 3))
    short = t.filter(tip_to_branch & (F.col("cable") < depth)).select(
        "start", "first", F.when(F.col("_start") >= 3, F.col("start")).otherwise(F.col("end")).alias("_keep"))
    gone = members.join(short, ["start", "first"]).select("_keep", F.explode(F.array("a", "b")).alias("node_id")).filter(
        F.col("node_id") != F.col("_keep")).select("node_id").distinct()
    return nodes.join(gone, "node_id", "left_anti")


def tortuosity(nodes: DataFrame, edges: DataFrame, piece_um: float = 50.0) -> DataFrame:
    """Path over chord per piece of about ``piece_um`` along each chain; an edge belongs to the piece it starts in."""
    _, members = chains(nodes, edges)
    at = members.withColumn("piece", F.floor(F.round(F.col("pos_a"), 6) / F.lit(piece_um)))
    span = at.groupBy("start", "first", "piece").agg(
        F.sum(F.col("pos_b") - F.col("pos_a")).alias("path"), F.min(F.struct("pos_a", F.col("a").alias("n"))).alias("_lo"),
        F.max(F.struct("pos_b", F.col("b").alias("n"))).alias("_hi"))
    out = span
    for tag in ("lo", "hi"):
        out = out.join(nodes.select(F.col("node_id").alias(f"_{tag}n"), *[F.col(c).alias(f"{c}_{tag}") for c in XYZ]),
                       F.col(f"_{tag}.n") == F.col(f"_{tag}n"))
    d2 = sum(((F.col(f"{c}_lo") - F.col(f"{c}_hi")) * (F.col(f"{c}_lo") - F.col(f"{c}_hi")) for c in XYZ), F.lit(0))
    return out.select("start", "first", "piece", "path", F.sqrt(d2).alias("chord")).withColumn(
        "tortuosity", F.try_divide("path", "chord"))
