"""Nearest neighbours by an inverted index whose lists are scanned with adaptive numbers of dimensions.

Vectors are rotated at random, which spreads a distance evenly over the dimensions, and kept in column blocks. While the
blocks of a probed list are added up, the distance so far estimates the whole; a candidate goes as soon as a test says that it cannot be
among the best ``k`` any more. What remains has its exact distance.

The index (rotation, centroids) is fitted on a bounded sample; every vector is indexed. Lists are scanned in chunks of at most about
``CHUNK`` vectors by blocks of at most about ``QUERIES`` queries, so a crowded list (one vector repeated in a third of all rows) is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.llm.common import batches, table
from dendrospark.session import cut

SAMPLE = 20_000  #: vectors the index is fitted on, at most
PER_LIST, MOST_LISTS = 400, 1024
CHUNK, QUERIES = 4096, 1024
BLOCK = 8  #: dimensions in a column block
EPSILON = 2.1  #: strictness of the test; larger values abandon later
SEED = 11


def usable(vector: Column) -> Column:
    """Not null or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def fit(sample: np.ndarray, lists: int, seed: int = SEED, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Random rotation, and centroids of ``lists`` cells of the rotated sample."""
    draw = np.random.default_rng(seed)
    rotation = np.linalg.qr(draw.standard_normal((sample.shape[1], sample.shape[1])))[0]
    points = np.unique(sample @ rotation, axis=0)
    centres = points[draw.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        cell = nearest_lists(points, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        size = np.bincount(cell, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return rotation, centres


def nearest_lists(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of every point, nearest first."""
    d2 = (centres * centres).sum(axis=1) - 2.0 * points @ centres.T
    return np.argsort(d2, axis=1, kind="stable")[:, :n]


def scan(query: np.ndarray, rows: np.ndarray, k: int, epsilon: float = EPSILON) -> np.ndarray:
    """Indices of rows that may be among the ``k`` nearest of ``query``; both rotated.

    The bound is the ``k``-th distance of a first few rows, all dimensions. The rest is scanned block by block. After ``d`` of ``D``
    dimensions the estimate ``partial D / d`` lies above ``bound (1 + epsilon / sqrt d)^2`` only by a rare chance if the row is near.
    """
    n, dims = rows.shape
    first = min(n, 4 * k)
    if n <= first:
        return np.arange(n)
    head = ((rows[:first] - query) ** 2).sum(axis=1)
    bound = np.partition(head, k - 1)[k - 1]
    alive = np.arange(first, n)
    partial = np.zeros(len(alive))
    for at in range(0, dims, BLOCK):
        part = rows[alive, at: at + BLOCK] - query[at: at + BLOCK]
        partial = partial + (part * part).sum(axis=1)
        done = min(dims, at + BLOCK)
        limit = bound * (done / dims) * (1.0 + epsilon / np.sqrt(done)) ** 2 if done < dims else bound * (1 + 1e-9)
        near = partial <= limit
        alive, partial = alive[near], partial[near]
        if not len(alive):
            break
    return np.concatenate([np.arange(first), alive])


def search(vectors: DataFrame, is_query: Column, k: int = 10, probe_share: float = 0.75, least_probes: int = 8) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for every query row, ties to the smaller id.

    ``vectors``: ``vec_id, embedding``; ``is_query`` is a condition on them. Rows without id, null vectors, zero vectors and vectors with
    null or non-finite components take no part, nor do vectors whose length is not the usual one. Lists are probed nearest first until
    they number three quarters (eight at least; without clusters the nearest rows are spread over many lists) and hold more than ``k`` rows. Repeated ids are rows of their own, but no neighbours of
    one another. Without usable vectors the result is empty.
    """
    known = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("is_query"))
    sizes = known.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], empty)
    dims, total = sizes[0]["d"], sizes[0]["n"]
    known = known.filter(F.size("v") == dims)
    sample = known.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    rotation, centres = fit(np.array([r["v"] for r in sample]), max(1, min(MOST_LISTS, total // PER_LIST)))

    def assign(rows):
        for part, (vs,) in batches(rows, ["v"], 4096):
            if part.num_rows:
                own = nearest_lists(np.array(vs) @ rotation, centres, 1)[:, 0]
                yield part.append_column("list", pa.array(own.astype(np.int32)))

    index = cut(known.mapInArrow(assign, "vec_id long, v array<double>, is_query boolean, list int"))
    # one number per list, bounded by MOST_LISTS
    size = {r["list"]: (r["n"], r["q"]) for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).collect()}
    held = np.array([size.get(i, (0, 0))[0] for i in range(len(centres))])
    probes = max(least_probes, int(np.ceil(probe_share * len(centres))))

    def probe(rows):
        for part, (ids, vs) in batches(rows, ["vec_id", "v"], 1024):
            if not part.num_rows:
                continue
            order = nearest_lists(np.array(vs) @ rotation, centres, len(centres))
            enough = np.cumsum(held[order], axis=1) > k
            n = np.maximum(np.minimum(probes, len(centres)), np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(centres)))
            row = np.repeat(np.arange(len(ids)), n)
            lists = np.concatenate([o[:m] for o, m in zip(order, n)])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[row]), part.column(part.schema.get_field_index("v")).take(pa.array(row)), pa.array(lists.astype(np.int32))],
                                             names=["query_id", "v", "list"])

    asked = cut(index.filter("is_query").select("vec_id", "v").mapInArrow(probe, "query_id long, v array<double>, list int"))
    asked_of = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {i: (-(-int(held[i]) // CHUNK), -(-n // QUERIES)) for i, n in asked_of.items() if held[i]}
    if not parts:
        return vectors.sparkSession.createDataFrame([], empty)
    layout = F.broadcast(vectors.sparkSession.createDataFrame([(i, c, q) for i, (c, q) in parts.items()], "list int, chunks int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(layout, "list").select("list", every("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "v")
    right = index.join(layout, "list").select("list", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), every("blocks").alias("block"), "vec_id", "v")

    def matrix(data: pa.Table) -> np.ndarray:
        return data.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q, x = matrix(queries), matrix(rows)
            turned, asked_turned = x @ rotation, q @ rotation
            ids, asked_ids = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            for i, own in enumerate(asked_ids):
                others = np.flatnonzero(ids != own)
                pick = others[scan(asked_turned[i], turned[others] if len(others) < len(ids) else turned, k)] if len(others) else others
                score = np.sqrt(((x[pick] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[pick], score))[:k]
                out[0].append(np.full(len(best), own)), out[1].append(ids[pick][best]), out[2].append(score[best])
        whole = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.Table.from_arrays([pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)), pa.array(whole[2].astype(float))], names=["query_id", "vec_id", "score"])

    keys = ["list", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth embedding."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
