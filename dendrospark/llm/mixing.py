"""Interleaving of sources to target weights by proportionate fairness, in DataFrame functions; only the plan is made on the driver.

With whole weights ``w`` and their total ``W``, block ``k`` of a source is released at ``floor(k W / w)`` and due at
``ceil((k + 1) W / w)``; in every slot the released block with the earliest deadline goes out. All deadlines are met, so at every moment
each source is less than one block away from its target itself: nothing is rounded to slots of a period. When a source has run out, the
others start anew in the proportion of their weights. Sources of weight 0 (no target) wait until all others have run out and then take
turns evenly; no row is dropped. The rule is sequential, so the plan is one pass over blocks, not rows, written in bounded pieces.

A caller that names a ``period`` gets the plan of that many slots, repeated: there every source has one slot at least and weights are
rounded to the rest of the period.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from heapq import heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrospark.llm.common import table, with_row_key
from dendrospark.operators.ordering import global_rank
from dendrospark.session import cut

BLOCK, SEED = 16, "mix-1"
PIECE = 250_000  #: slots of the plan that the driver holds at a time
NO_SOURCE = "\x02"  #: stands for a null source


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))


def weights(sizes: dict[str, int], targets: dict[str, float] | None) -> dict[str, int]:
    """Whole weights of the sources in exactly the proportion of their targets; without any the square root of the size, to 1e-6."""
    if targets is None:
        return {s: round(math.sqrt(n) * 1_000_000) for s, n in sizes.items()}
    exact = {s: Fraction(str(w)) for s, w in targets.items()}
    scale = math.lcm(*[w.denominator for w in exact.values()])
    return {s: int(exact.get(s, 0) * scale) for s in sizes}


def schedule(sizes: list[tuple[str, int, int]], block: int) -> Iterator[tuple[str, int, int, int, int, int]]:
    """``source, block, slot, release, due, start`` of all blocks in order, from ``source, rows, weight`` of each source.

    ``start`` counts the rows before the block. Waiting blocks lie in one heap by release, released ones in another by deadline.
    """
    left = {s: [0, n, w] for s, n, w in sizes if n > 0}  # blocks given out, rows left, weight
    slot = start = 0
    while left:
        weight = {s: w for s, (_, _, w) in left.items() if w > 0} or dict.fromkeys(left, 1)
        total, begin, given = sum(weight.values()), slot, {s: left[s][0] for s in weight}
        waiting, ready, spent = [(0, s) for s in sorted(weight)], [], False
        while not spent:
            while waiting and waiting[0][0] <= slot - begin:
                release, s = heappop(waiting)
                k = left[s][0] - given[s]
                heappush(ready, (-(-(k + 1) * total // weight[s]), s, release))
            due, s, release = heappop(ready)
            state = left[s]
            yield s, state[0], slot, begin + release, begin + due, start
            taken = min(block, state[1])
            state[0], state[1], slot, start = state[0] + 1, state[1] - taken, slot + 1, start + taken
            if state[1]:
                heappush(waiting, ((state[0] - given[s]) * total // weight[s], s))
            else:
                del left[s]
                spent = True


def _written(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """The schedule as a table. Pieces are written one by one, so the driver never holds more than one."""
    schema = "_source string, block long, slot long, release long, due long, _start long"
    pieces = [spark.createDataFrame([], schema)]
    while piece := list(islice(rows, PIECE)):
        pieces.append(cut(spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in zip(*piece)], names=["_source", "block", "slot", "release", "due", "_start"]), schema)))
    return reduce(DataFrame.unionByName, pieces)


def quotas(sizes: DataFrame, period: int, targets: dict[str, float] | None = None) -> DataFrame:
    """``_source, q``: slots of a period that a caller named. ``sizes``: ``_source, n``."""
    if targets is None:
        weight = F.round(F.sqrt(F.col("n").cast("double")) * 1_000_000).cast("bigint")
    else:
        pairs = [F.lit(x) for s, w in targets.items() for x in (s, int(round(w * 1_000_000)))]
        weight = F.coalesce((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>"))[F.col("_source")].cast("bigint"), F.lit(0).cast("bigint"))
    known = sizes.withColumn("w", weight)
    # one row per source: few rows in one window
    everything = Window.partitionBy(F.lit(0))
    known = known.withColumn("total", F.sum("w").over(everything)).withColumn("spare", F.lit(period) - F.count(F.lit(1)).over(everything))
    share = known.withColumn("base", F.expr("case when total = 0 then 0 else spare * w div total end")) \
        .withColumn("rest", F.expr("case when total = 0 then 0 else spare * w % total end"))
    left = share.withColumn("left", F.col("spare") - F.sum("base").over(everything)) \
        .withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "_source")))
    count = F.count(F.lit(1)).over(everything)
    # with no weight at all everything is left over: deal it out evenly
    extra = F.expr("left div _count + case when place <= left % _count then 1 else 0 end")
    return left.withColumn("_count", count).select("_source", (F.lit(1) + F.col("base") + extra).cast("bigint").alias("q"))


def plan(quota: DataFrame, period: int) -> DataFrame:
    """``_source, q, k, slot, release, due``: the slots of one period, earliest deadline first among the released blocks."""
    one = quota.agg(F.sort_array(F.collect_list(F.struct("_source", "q"))).alias("s"))
    release = lambda k, q: F.floor(k * period / q)
    due = lambda k, q: F.ceil((k + 1) * period / q)

    def step(state, t):
        offers = F.transform("s", lambda s, i: F.when(
            (F.get(state["next"], i) < s["q"]) & (release(F.get(state["next"], i), s["q"]) <= t),
            F.struct(due(F.get(state["next"], i), s["q"]).alias("due"), i.alias("i"), F.get(state["next"], i).alias("k"))))
        return F.element_at(F.transform(F.array(F.array_min(offers)), lambda best: F.struct(
            F.transform(state["next"], lambda c, i: c + F.when(i == best["i"], F.lit(1)).otherwise(F.lit(0)).cast("bigint")).alias("next"),
            F.concat(state["out"], F.array(F.struct(best["i"].alias("i"), best["k"].alias("k")))).alias("out"))), 1)

    start = F.struct(F.transform("s", lambda s: F.lit(0).cast("bigint")).alias("next"), F.array().cast("array<struct<i:int,k:bigint>>").alias("out"))
    slots = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda a: a["out"])
    rows = one.filter(F.size("s") > 0).select("s", F.posexplode(slots).alias("slot", "x"))
    return rows.select(F.get("s", F.col("x.i")).alias("g"), F.col("x.k").alias("k"), F.col("slot").cast("bigint").alias("slot")).select(
        "g._source", "g.q", "k", "slot", release(F.col("k"), F.col("g.q")).cast("bigint").alias("release"), due(F.col("k"), F.col("g.q")).cast("bigint").alias("due"))


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, seed: str = SEED,
          keep_row: bool = False) -> DataFrame:
    """``doc_id, source, block, slot, release, due, position`` for every row of ``docs`` (``doc_id, source``).

    Within a source rows come in the order of a seeded hash of their id, ``block`` rows to a block. ``position`` counts from 0 without
    gaps. A named period is at least four times the number of sources. Null sources are a source of their own, null ids sort first,
    repeated rows each get a place, an empty table gives an empty result.
    """
    rows = docs if keep_row else with_row_key(docs)
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    narrow = cut(rows.select("doc_id", "source", "_rid", _source().alias("_source"), shuffled.alias("_hash")))
    sizes = cut(narrow.groupBy("_source").agg(F.count(F.lit(1)).alias("n")))
    ranked = cut(global_rank(narrow, [F.col("_source"), F.col("_hash"), F.col("doc_id"), F.col("_rid")], "_rank"))
    first = ranked.groupBy("_source").agg(F.min("_rank").alias("_first"))
    placed = (ranked.join(first, "_source").withColumn("_at", F.col("_rank") - F.col("_first"))
              .withColumn("block", F.expr(f"_at div {int(block)}")).withColumn("_in", F.col("_at") % block))
    if period is None:
        # one row per source
        n = {r["_source"]: r["n"] for r in sizes.collect()}
        known = [(s, n[s], w) for s, w in weights(n, targets).items()]
        out = placed.join(_written(docs.sparkSession, schedule(known, block)), ["_source", "block"]).withColumn("position", F.col("_start") + F.col("_in"))
    else:
        out = _by_period(placed, sizes, max(period, 4 * sizes.count()), targets)
    return out.select("doc_id", "source", *(["_rid"] if keep_row else []), "block", "slot", "release", "due", "position")


def _by_period(placed: DataFrame, sizes: DataFrame, period: int, targets: dict[str, float] | None) -> DataFrame:
    slots = cut(plan(quotas(sizes, period, targets), period))
    turns = (placed.join(slots.select("_source", "q").distinct(), "_source")
             .withColumn("_turn", F.expr("block div q")).withColumn("k", F.col("block") % F.col("q")))
    # the plan has one row per slot of the period, bounded by its length
    found = turns.join(F.broadcast(slots.drop("q")), ["_source", "k"])
    shift = F.col("_turn") * period
    timed = found.select("doc_id", "source", "_rid", "block", "_in", *[(F.col(c) + shift).alias(c) for c in ("slot", "release", "due")])
    return global_rank(timed, [F.col("slot"), F.col("_in")], "_pos").withColumn("position", F.col("_pos") - 1)


def in_mixed_order(docs: DataFrame, targets: dict[str, float] | None = None, place_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, sorted by their place in the mix (range partitions, each sorted); with the place itself if named."""
    kept = F.struct(*[c for c in docs.columns if c != place_col])
    rows = cut(with_row_key(docs.select("doc_id", "source", kept.alias("_payload"))))
    place = mixed(rows, targets, keep_row=True).select("_rid", F.col("position").alias("_position"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.join(place, "_rid").repartitionByRange(n, "_position").sortWithinPartitions("_position").select(
        "_payload.*", *([] if place_col is None else [F.col("_position").alias(place_col)])))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents interleaved so that sources appear by the square root of their size."""
    return mixed(table(spark, sf_dir, "documents"))
