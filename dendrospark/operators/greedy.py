"""Greedy choices made in rounds that give the same answer as one pass in order.

Each rule needs a total order, so an id always breaks ties. The best remaining
item is kept in every round, so the loops end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.operators.graph import component_map
from dendrospark.operators.ordering import global_rank
from dendrospark.session import cut, is_empty, merged

_CELL = ("_gx", "_gy", "_gz")
_BLOCK = ("_kx", "_ky", "_kz")  # four cells a side


def _settled(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranks that are kept, of items that wait for nothing (kept), for one better item ``_up``, or are ``_open`` (not decided yet).

    An item that waits for one other is kept if and only if that one is not. So along a chain of such items every second one is kept,
    and pointer doubling with the parity of the way decides a chain of any length in logarithmically many steps.
    """
    key = [*by, "_rank"]
    free = state.filter(~F.col("_open") & F.col("_up").isNull()).select(*key)
    wait = state.filter(~F.col("_open") & F.col("_up").isNotNull()).select(*key, "_up", F.lit(True).alias("_odd"))
    if is_empty(wait.join(merged(wait.select(*by, F.col("_rank").alias("_up"))), [*by, "_up"], "left_semi")):
        return free  # no chains: whoever waits for a kept item goes
    while True:
        on = wait.select(*by, F.col("_rank").alias("_up"), F.col("_up").alias("_next"), F.col("_odd").alias("_odd_next"))
        wait = cut(wait.join(merged(on), [*by, "_up"], "left").select(
            *key, F.coalesce("_next", "_up").alias("_up"), (F.col("_odd") != F.coalesce("_odd_next", F.lit(False))).alias("_odd"),
            F.col("_next").isNotNull().alias("_moved")))
        if is_empty(wait.filter("_moved")):
            break
    even = wait.filter(~F.col("_odd")).join(merged(free.withColumnRenamed("_rank", "_up")), [*by, "_up"], "left_semi")
    return free.unionByName(even.select(*key))


def suppress(points: DataFrame, order: Sequence[Column], separation: float, id_col: str = "node_id", by: Sequence[str] = ()) -> DataFrame:
    """Best-first suppression: keep a point unless a kept, better one is closer than ``separation``.

    Cells are so small that two points of one cell always conflict. A round looks at the best live point of each cell and the rank of
    the second: a leader waits for the better leaders it conflicts with, and is left open where a cell in reach holds more than one better
    point. Chains of leaders that wait for one other are decided at once; the live points near kept ones go. So a crowded place costs
    one aggregate, never its pairs.
    """
    by, size = list(by), separation / math.sqrt(3.0)
    cell = [*by, *_CELL]
    live = points.withColumns({
        **{c: F.floor(F.col(v) / F.lit(size)) for c, v in zip(_CELL, ("x", "y", "z"))},
        "_rank": F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_col).alias("oid")),
    })
    live = cut(live)
    kept: DataFrame | None = None

    def near(ax, ay, az):
        dx, dy, dz = F.col("x") - F.col(ax), F.col("y") - F.col(ay), F.col("z") - F.col(az)
        return dx * dx + dy * dy + dz * dz < separation * separation

    while True:
        best = live.groupBy(*cell).agg(F.min(F.struct("_rank", "x", "y", "z")).alias("_best"))
        second = live.join(merged(best), cell).filter(F.col("_rank") > F.col("_best._rank")).groupBy(*cell).agg(F.min("_rank").alias("_second"))
        leaders = cut(best.join(merged(second), cell, "left").select(*cell, "_best.*", "_second"))
        mine = _in_reach(leaders, [*by, F.col("_rank").alias("_mine"), *[F.col(c).alias(f"_m{c}") for c in ("x", "y", "z")],
                                   *[F.col(c).alias(f"_m{c}") for c in _CELL]])
        reached = [F.abs(F.col(c) - F.col(f"_m{c}")) <= 2 for c in _CELL]
        better = _in_blocks(leaders).join(mine, [*by, *_BLOCK]).filter(
            (F.col("_rank") < F.col("_mine")) & reached[0] & reached[1] & reached[2])
        unclear = F.coalesce(F.col("_second") < F.col("_mine"), F.lit(False))
        waits = better.filter(unclear | near("_mx", "_my", "_mz")).groupBy(*by, F.col("_mine").alias("_rank")).agg(
            F.min("_rank").alias("_up"), ((F.count(F.lit(1)) > 1) | F.bool_or(unclear)).alias("_open"))
        state = cut(leaders.select(*by, "_rank").join(merged(waits), [*by, "_rank"], "left").withColumn("_open", F.coalesce("_open", F.lit(False))))
        winners = cut(live.join(merged(_settled(state, by)), [*by, "_rank"], "left_semi"))
        kept = winners if kept is None else kept.unionByName(winners)
        centre = _in_reach(winners, [*by, *[F.col(c).alias(f"_w{c}") for c in ("x", "y", "z")]])
        gone = _in_blocks(live).join(centre, [*by, *_BLOCK]).filter(near("_wx", "_wy", "_wz")).select(*by, id_col).distinct()
        live = cut(live.join(merged(gone), [*by, id_col], "left_anti"))
        if is_empty(live):
            return kept.drop(*_CELL, "_rank")


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.floor(F.col(c) / 4) for k, c in zip(_BLOCK, _CELL)})


def _in_reach(df: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """Repeat each row for the eight blocks of cells a ball of radius ``separation`` can touch.

    The planner does not see that rows multiply, so they are never broadcast.
    """
    for k, c in zip(_BLOCK, _CELL):
        df = df.withColumn(k, F.explode(F.sequence(F.floor((F.col(c) - 2) / 4), F.floor((F.col(c) + 2) / 4))))
    return merged(df.select(*keep, *_BLOCK))


def greedy_matching(edges: DataFrame, order: Sequence[Column], a: str = "a", b: str = "b", id_col: str = "edge_id",
                    by: Sequence[str] = ()) -> DataFrame:
    """Exclusive choice: best first, each endpoint used at most once.

    A round keeps the edges that are the best live edge at both ends, and decides at once the chains of edges that wait for one better
    edge each. As a matching under weights this reaches at least half of the optimum.
    """
    by = list(by)
    live = cut(edges.withColumn("_rank", F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_col).alias("oid"))))
    kept: DataFrame | None = None

    def at_ends(df: DataFrame, per_end: DataFrame, col: str, how: str) -> DataFrame:
        for end in (a, b):
            df = df.join(merged(per_end.withColumnsRenamed({"_end": end, col: f"{col}_{end}"})), [*by, end], how)
        return df

    while True:
        best = live.select(*by, "_rank", F.explode(F.array(a, b)).alias("_end")).groupBy(*by, "_end").agg(F.min("_rank").alias("_best"))
        ends = at_ends(live.select(*by, "_rank", a, b), best, "_best", "inner")
        worse = ends.select(*by, "_rank", F.explode(F.array(*[
            F.struct(F.col(end).alias("end"), F.col(f"_best_{end}").alias("best")) for end in (a, b)])).alias("_e")).filter(
            F.col("_rank") > F.col("_e.best"))
        second = worse.groupBy(*by, F.col("_e.end").alias("_end")).agg(F.min("_rank").alias("_second"))
        up = [F.when(F.col("_rank") > F.col(f"_best_{end}"), F.col(f"_best_{end}")) for end in (a, b)]
        third = [F.coalesce(F.col("_rank") > F.col(f"_second_{end}"), F.lit(False)) for end in (a, b)]
        state = cut(at_ends(ends, second, "_second", "left").select(
            *by, "_rank", F.coalesce(*up).alias("_up"), (third[0] | third[1] | F.coalesce(up[0] != up[1], F.lit(False))).alias("_open")))
        chosen = cut(live.join(merged(_settled(state, by)), [*by, "_rank"], "left_semi").select(*live.columns))
        kept = chosen if kept is None else kept.unionByName(chosen)
        used = chosen.select(*by, F.explode(F.array(a, b)).alias("_end")).distinct()
        live = cut(
            live.join(merged(used.withColumnRenamed("_end", a)), [*by, a], "left_anti")
            .join(merged(used.withColumnRenamed("_end", b)), [*by, b], "left_anti"))
        if is_empty(live):
            return kept.drop("_rank")


def edit_budget(edits: DataFrame, confidence: str, budget: int, id_col: str = "edge_id", a: str = "label_a",
                b: str = "label_b", by: Sequence[str] = ()) -> DataFrame:
    """The ``budget`` most confident edits (of each ``by``), at most one per label."""
    chosen = greedy_matching(edits, [-F.col(confidence)], a, b, id_col, by)
    return _best_few(chosen, [F.col(confidence).desc(), F.col(id_col)], budget, by)


def _best_few(rows: DataFrame, order: Sequence[Column], k: int, by: Sequence[str]) -> DataFrame:
    """The first ``k`` rows of each ``by``, or of all."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= k).drop("_place")


def label_cap(edits: DataFrame, stream_order: Sequence[Column], id_col: str = "edge_id", a: str = "label_a",
              b: str = "label_b", by: Sequence[str] = ()) -> DataFrame:
    """First come, first served in stream order, at most one edit per label on either side."""
    return greedy_matching(edits, stream_order, a, b, id_col, by)


def pick_spread(points: DataFrame, order: Sequence[Column], k: int, separation: float, id_col: str = "node_id",
                by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` points in order (of each ``by``) that keep ``separation`` from those picked before.

    Only better points decide whether a point is picked. So suppression looks at the best points, more of them each time,
    until ``k`` are picked or all points have been looked at.
    """
    by, rank = list(by), [*order, F.col(id_col)]
    ranked = global_rank(points, [*[F.col(c) for c in by], *rank], "_place")
    if by:
        first = ranked.groupBy(*by).agg(F.min("_place").alias("_first"))
        ranked = ranked.join(first, by).withColumn("_place", F.col("_place") - F.col("_first") + 1).drop("_first")
    ranked = cut(ranked)
    total, most = ranked.groupBy(*by).agg(F.max("_place").alias("_all")), 64 * k
    while True:
        picked = cut(suppress(ranked.filter(F.col("_place") <= most).drop("_place"), order, separation, id_col, by))
        found = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("_found"))
        both = total.join(found, by) if by else total.crossJoin(found)
        if is_empty(both.filter((F.col("_all") > most) & (F.col("_found") < k))):
            return _best_few(picked, rank, k, by)
        most *= 16


def spanning_forest(edges: DataFrame, order: Sequence[Column], a: str = "a", b: str = "b", id_col: str = "edge_id") -> DataFrame:
    """Edges that a best-first pass would accept because they close no cycle.

    Each round every component takes its best outgoing edge and the components
    grow together, so the number of rounds is logarithmic.
    """
    live = cut(edges.withColumn("_rank", F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_col).alias("oid"))).withColumns(
        {"_ca": F.col(a), "_cb": F.col(b)}).filter(F.col(a) != F.col(b)))
    kept: DataFrame | None = None
    while True:
        best = live.select("_rank", F.explode(F.array("_ca", "_cb")).alias("_c")).groupBy("_c").agg(
            F.min("_rank").alias("_rank")).select("_rank").distinct()
        chosen = cut(live.join(best, "_rank", "left_semi"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        grown = live.join(best, "_rank", "left_anti")
        for hop in component_map(chosen.select(F.col("_ca").alias("src"), F.col("_cb").alias("dst"))):
            for end in ("_ca", "_cb"):
                to = hop.select(F.col("v").alias(end), F.col("r").alias("_to"))
                grown = grown.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        live = cut(grown.select(*live.columns).filter(F.col("_ca") != F.col("_cb")))
        if is_empty(live):
            return kept.drop("_rank", "_ca", "_cb")


def progressive_accept(proposals: DataFrame, a: str = "a", b: str = "b", score: str = "score", id_col: str = "edge_id",
                       top: float = 0.95, low: float = 0.75, step: float = 0.05, drop_below: float = 0.3) -> DataFrame:
    """Lower the threshold in steps and accept the proposals that close no cycle.

    Proposals below ``drop_below`` are never considered. Those between it and
    ``low`` stay out as well: ``low`` is the last threshold.
    """
    considered = proposals.filter((F.col(score) >= drop_below) & (F.col(score) >= low))
    # how many thresholds must pass before the proposal is on the table
    level = F.greatest(F.lit(0), F.ceil(F.round((F.lit(top) - F.col(score)) / F.lit(step), 9))).cast("int")
    considered = considered.withColumn("level", level)
    return spanning_forest(considered, [F.col("level"), -F.col(score)], a, b, id_col)


def cycle_edges(proposals: DataFrame, order: Sequence[Column], a: str = "a", b: str = "b", id_col: str = "edge_id") -> DataFrame:
    """All proposals with ``forms_cycle``: those a best-first pass would refuse."""
    forest = spanning_forest(proposals, order, a, b, id_col).select(id_col, F.lit(False).alias("_in"))
    return proposals.join(forest, id_col, "left").withColumn("forms_cycle", F.coalesce("_in", F.lit(True))).drop("_in")
