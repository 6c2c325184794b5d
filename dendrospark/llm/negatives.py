"""Hard negatives from candidate blocks along a Hilbert curve, chosen by zone maps.

Candidates are ordered by label and by the Hilbert key of a few main directions, and written as Parquet blocks of at most ``BLOCK`` rows of one
label. A block's zone map has the least and greatest value of every dimension. Interval arithmetic bounds the inner products of an anchor with all
rows of a block, so a block is read for an anchor only if its interval meets what the anchor still wants:

* positives: the anchor's own block, its neighbourhood on the curve, gives a first threshold; then every block of its label whose bound reaches it;
* negatives: each positive sets a window of scores; the block of another label with the highest bound gives first findings, which raise
  the windows' lower ends; then every block of another label whose interval meets a window.

Nothing that could be an answer is skipped, so results are exact. Anchors meet zone maps in parts, chunk by chunk, and blocks are read for parts of
anchors. Only the curve is fitted on a bounded sample (``SAMPLE`` rows at most); it decides the order, not the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.llm.common import batches, table, with_row_key
from dendrospark.llm.packing import hilbert_keys
from dendrospark.operators.ordering import global_rank
from dendrospark.session import cut

BLOCK = 1024  #: rows in a block
ANCHORS, ZONES = 1024, 512  #: anchors and zone maps that meet in one task
SAMPLE, AXES, BITS = 10_000, 6, 8
EMPTY = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Not null, all components finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part, labels moved on where the id is divisible by 7."""
    known = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return known.select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.cast("bigint").alias("label"),
                        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint")).alias("q"))


def fit_curve(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Main directions of the sample, and the inner borders of equal shares along each."""
    centred = sample - sample.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:AXES]
    return axes, np.quantile(sample @ axes.T, np.arange(1, 1 << BITS) / (1 << BITS), axis=0)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors; an error where one leaves 64 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    out = a.astype(object) @ b.T.astype(object)
    if any(abs(int(v)) >= _LONG for v in out.flat):
        raise OverflowError("an inner product does not fit in 64 bits")
    return out.astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``; rounded outward."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    low, high = low.T.astype(float), high.T.astype(float)
    least, most = up @ low + down @ high, up @ high + down @ low
    slack = 1e-12 * (up @ np.abs(high) + up @ np.abs(low) - down @ np.abs(low) - down @ np.abs(high)) + 1
    return least - slack, most + slack


def matrix(data: pa.Table, name: str, dims: int) -> np.ndarray:
    return data.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def best(score: np.ndarray, ids: np.ndarray, pick: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``pick`` with the highest scores, ties to the smaller id."""
    if len(pick) > k:
        pick = pick[score[pick] >= np.partition(score[pick], len(pick) - k)[len(pick) - k]]
    return pick[np.lexsort((ids[pick], -score[pick]))[:k]]


def _blocks(rows: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Candidates with their ``block`` (of one label), written along the curve, and zone maps ``label, block, n, low, high``."""
    sample = rows.select("q").orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(SAMPLE).collect()
    axes, borders = fit_curve(np.array([r["q"] for r in sample], float))

    def place(parts):
        for part, (qs,) in batches(parts, ["q"], 4096):
            if part.num_rows:
                along = np.array(qs, float) @ axes.T
                cells = np.stack([np.searchsorted(borders[:, i], along[:, i]) for i in range(len(axes))], axis=1).astype(np.int64)
                yield part.append_column("_key", pa.array(hilbert_keys(cells, BITS)))

    keyed = with_row_key(rows).mapInArrow(place, "vec_id long, label long, q array<long>, _rid long, _key long")
    ranked = cut(global_rank(keyed, [F.col("label"), F.col("_key"), F.col("vec_id"), F.col("_rid")], "_rank"))
    first = ranked.groupBy("label").agg(F.min("_rank").alias("_first"))
    blocks = cut(ranked.join(first, "label").withColumn("block", F.expr(f"(_rank - _first) div {BLOCK}")).drop("_rank", "_first", "_key"))
    each = lambda f, name: [f(F.col("q")[i]).alias(f"_{name}{i}") for i in range(dims)]
    zones = blocks.groupBy("label", "block").agg(F.count(F.lit(1)).alias("n"), *each(F.min, "low"), *each(F.max, "high"))
    zones = zones.select("label", "block", "n", *[F.array(*[F.col(f"_{s}{i}") for i in range(dims)]).alias(s) for s in ("low", "high")])
    return blocks, cut(zones)


def _chosen(asks: DataFrame, zones: DataFrame, dims: int, same: bool, highest: bool = False) -> DataFrame:
    """``_rid, z_label, block``: the blocks of the anchor's label (or of all others) whose interval meets one of its windows
    (``from_``, ``to_``); with ``highest`` only the one with the highest bound."""
    chunks, parts = max(1, -(-zones.count() // ZONES)), max(1, -(-asks.count() // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("_rid", "label", "q", "from_", "to_", F.pmod(F.xxhash64("_rid"), F.lit(parts)).cast("int").alias("part"), every(chunks).alias("chunk"))
    right = zones.select(F.col("label").alias("z_label"), "block", "low", "high", F.pmod(F.xxhash64("label", "block"), F.lit(chunks)).cast("int").alias("chunk"), every(parts).alias("part"))

    def meet(a: pa.Table, z: pa.Table) -> pa.Table:
        rid, label, block, bound = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if a.num_rows and z.num_rows:
            least, most = bounds(matrix(a, "q", dims), matrix(z, "low", dims), matrix(z, "high", dims))
            z_label, z_block = z.column("z_label").to_numpy(), z.column("block").to_numpy()
            mine = (a.column("label").to_numpy()[:, None] == z_label) == same
            for i, (own, starts, ends) in enumerate(zip(a.column("_rid").to_pylist(), a.column("from_").to_pylist(), a.column("to_").to_pylist())):
                hit = np.zeros(len(z_block), bool)
                for lo, hi in zip(starts, ends):
                    hit |= (most[i] >= lo) & (least[i] <= hi)
                hit = np.flatnonzero(hit & mine[i])
                if highest and len(hit):
                    hit = hit[[most[i][hit].argmax()]]
                rid.append(np.full(len(hit), own)), label.append(z_label[hit]), block.append(z_block[hit]), bound.append(most[i][hit])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in (rid, label, block, bound)], names=["_rid", "z_label", "block", "bound"])

    found = left.groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInArrow(meet, "_rid long, z_label long, block long, bound double")
    if highest:
        found = found.withColumn("_first", F.row_number().over(Window.partitionBy("_rid").orderBy(F.desc("bound"), "z_label", "block"))).filter("_first = 1")
    return cut(found.select("_rid", "z_label", "block"))


def _read(pairs: DataFrame, asks: DataFrame, blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """``_rid, w, vec_id, score``: per anchor, window and block the ``k`` best rows of the block inside the window; never the anchor's own id."""
    sized = pairs.groupBy("z_label", "block").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("_parts"))
    keys = ["z_label", "block", "part"]
    left = pairs.join(sized, ["z_label", "block"]).join(asks.select("_rid", "anchor_id", "q", "from_", "to_"), "_rid").select("_rid", "z_label", "block", F.pmod(F.xxhash64("_rid"), F.col("_parts")).cast("int").alias("part"), "anchor_id", "q", "from_", "to_")
    right = blocks.withColumnRenamed("label", "z_label").join(sized, ["z_label", "block"]).select(
        "z_label", "block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "vec_id", "q")

    def compare(a: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        if a.num_rows and rows.num_rows:
            scores, ids = inner(matrix(a, "q", dims), matrix(rows, "q", dims)), rows.column("vec_id").to_numpy()
            for i, (rid, own, starts, ends) in enumerate(zip(*[a.column(c).to_pylist() for c in ("_rid", "anchor_id", "from_", "to_")])):
                for w, (lo, hi) in enumerate(zip(starts, ends)):
                    pick = best(scores[i], ids, np.flatnonzero((scores[i] >= lo) & (scores[i] <= hi) & (ids != own)), k)
                    for column, values in zip(out, (np.full(len(pick), rid), np.full(len(pick), w), ids[pick], scores[i][pick])):
                        column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["_rid", "w", "vec_id", "score"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "_rid long, w long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each anchor and window, with their ``rank``."""
    order = Window.partitionBy("_rid", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows of ``vectors`` (``vec_id, embedding, label``) whose id is divisible by ``every``. Each has its ``positives`` best other
    rows of its label, and for each of them the ``negatives`` best rows of other labels with a score of ``low`` to ``high`` percent of the
    positive's. Rows without id, label or vector, or with a null or non-finite component, take no part, nor do vectors that have not the usual length.
    Rows with the anchor's id are never its candidates; repeated rows are anchors and candidates each. Without anchors or partners the
    result is empty. Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    sizes = rows.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return spark.createDataFrame([], EMPTY)
    dims = sizes[0]["d"]
    blocks, zones = _blocks(rows.filter(F.size("q") == dims), dims)
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    anchors = cut(blocks.filter(F.col("vec_id") % every == 0).select("_rid", F.col("vec_id").alias("anchor_id"), "label", "block", "q"))
    open_ = anchors.withColumns({"from_": longs(-_LONG), "to_": longs(_LONG - 1)})
    # the anchor's own block gives its threshold
    own = open_.select("_rid", F.col("label").alias("z_label"), "block")
    seen = _first(_read(own, open_, blocks, dims, positives), positives).filter(F.col("rank") == positives).select("_rid", F.col("score").alias("_least"))
    asks = cut(open_.join(seen, "_rid", "left").withColumn("from_", F.array(F.coalesce("_least", F.lit(-_LONG).cast("long")))).drop("_least"))
    chosen = cut(_first(_read(_chosen(asks, zones, dims, True), asks, blocks, dims, positives), positives).select(
        "_rid", F.col("rank").alias("_place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # each positive sets a window; an anchor has few positives
    window = F.struct("_place", F.ceil(F.expr("cast(positive_score as decimal(20,0)) * %d / 100" % low)).cast("long").alias("from_"),
                      F.floor(F.expr("cast(positive_score as decimal(20,0)) * %d / 100" % high)).cast("long").alias("to_"))
    wanted = chosen.groupBy("_rid").agg(F.sort_array(F.collect_list(window)).alias("_w"))
    asks = cut(anchors.join(wanted, "_rid").select("_rid", "anchor_id", "label", "q", F.col("_w.from_").alias("from_"), F.col("_w.to_").alias("to_")))
    seen = _first(_read(_chosen(asks, zones, dims, False, highest=True), asks, blocks, dims, negatives), negatives).filter(F.col("rank") == negatives)
    least = seen.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_least"))
    raised = F.transform("from_", lambda lo, i: F.greatest(lo, F.coalesce(F.col("_least")[i.cast("long")], lo)))
    asks = cut(asks.join(least, "_rid", "left").withColumn("from_", raised).drop("_least"))
    found = _first(_read(_chosen(asks, zones, dims, False), asks, blocks, dims, negatives), negatives)
    named = chosen.join(anchors.select("_rid", "anchor_id"), "_rid").withColumn("w", F.col("_place").cast("long") - 1)
    return found.join(named, ["_rid", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth embedding."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
   list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
   from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 scored as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as score
   from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 positives as (select anchor_id, own, vec_id as positive_id, score as positive_score from scored where label = own
   qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, s.vec_id) as int) as rank, s.vec_id as negative_id,
  cast(positive_score as bigint) as positive_score, cast(score as bigint) as negative_score
from positives join scored s using (anchor_id) where s.label <> s.own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, s.vec_id) <= 3
"""
