"""Near-duplicate documents: SetSketch bands find candidates, the joint likelihood thins them out, full sets decide.

Documents with the same words are one class first (an aggregate, so thousands of copies cost no pairs). Class representatives
that share a band key are candidates. Small buckets give their pairs directly. A large bucket is compared with one member
only, its pivot: the member that lies in the largest buckets, hence near the centre of its group. That loses no link:

* Write ``D(x)`` for the elements in which ``x`` and the pivot ``p`` differ. Similarity at least ``t`` means
  ``|x ^ y| <= c (|x| + |y|)`` with ``c = (1 - t) / (1 + t)``, and ``|x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|``.
* If ``D(x)`` and ``D(y)`` share nothing and ``x, y`` are linked, both are linked with ``p``, so the pair adds nothing.
* Otherwise they share an element of their differences. These are few and mostly rare, so pairs of one linked and one other member
  come from a prefix join on them: with ``|D(y)| <= |D(x)|`` the overlap is at least
  ``|D(y)| - c (|x| + |y|) / 2`` and at least ``|D(x)| - c (|x| + |y|)``, so it meets a prefix of both in one fixed order.
  Added elements come first, for they are the rare ones.
* Members that are not linked with the pivot may be a family of their own, with the same differences from it. They get a pivot among
  themselves in the next round, and so on as long as a bucket's pivot finds a family (``FAMILIES`` of the members left). What is left then has no
  large family; its pairs come from the prefix join on differences from the bucket's first pivot, which is the most central.

So a family costs a comparison with its pivot for each member, and pairs only where members made the same changes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.llm.common import batches, table, with_row_key
from dendrospark.llm.sketch import M, WordHashes, band_keys, likely_jaccard, plain_words, registers, shingles
from dendrospark.operators.graph import connected_components
from dendrospark.session import cut, is_empty

SMALL_BUCKET = 6  #: up to so many members a bucket lists its pairs (15 at most); the result is the same for every value
FAMILIES = 0.1  #: share of the members left in a bucket that a further pivot must be linked with to count as a family


def sketches(docs: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``n_shingles``, class key ``_h1, _h2`` (128 bits of the word sequence), sketch and packed words (null without words)."""
    columns = list(dict.fromkeys(["doc_id", *keep, "text"]))
    carried = [c for c in columns if c != "text" or c in keep]
    schema = T.StructType([*[docs.schema[c] for c in carried], T.StructField("n_shingles", T.LongType()),
                           T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType()),
                           T.StructField("_sketch", T.BinaryType()), T.StructField("_packed", T.BinaryType())])

    def make(rows):
        known, pack = WordHashes(), zstandard.ZstdCompressor(level=1)
        for part, (texts,) in batches(rows, ["text"]):
            n, h1, h2, regs, packed = [], [], [], [], []
            for text in texts:
                words = plain_words(text)
                own = shingles(words, width, known)
                n.append(len(own))
                if not words:
                    h1.append(None), h2.append(None), regs.append(None), packed.append(None)
                    continue
                joined = b" ".join(words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64)
                h1.append(int(digest[0])), h2.append(int(digest[1]))
                regs.append(registers(own).tobytes())
                packed.append(pack.compress(joined))
            arrays = [part.column(part.schema.get_field_index(c)) for c in carried]
            arrays += [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.select(*columns).mapInArrow(make, schema)


def _bands(reps: DataFrame, rows: int) -> DataFrame:
    """``_key, _cid``: one row per band."""

    def make(parts):
        for part, (cids, sketches_) in batches(parts, ["_cid", "_sketch"]):
            keys = [band_keys(np.frombuffer(s, np.uint16), rows).view(np.int64) for s in sketches_]
            width = M // rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), pa.array(np.repeat(np.array(cids, np.int64), width))], names=["_key", "_cid"])

    return reps.select("_cid", "_sketch").mapInArrow(make, "_key long, _cid long")


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose likely similarity is not clearly below the threshold (six standard errors)."""
    least = threshold - 6.0 * math.sqrt(threshold * (1.0 - threshold) / M)
    for side in ("u", "v"):
        pairs = pairs.join(reps.select(F.col("_cid").alias(side), F.col("_sketch").alias(f"s_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)

    def thin(rows):
        for part, (su, sv, nu, nv) in batches(rows, ["s_u", "s_v", "n_u", "n_v"]):
            if part.num_rows:
                a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, M) for x in (su, sv))
                likely = likely_jaccard(a, b, np.array(nu, float), np.array(nv, float))
                yield part.filter(pa.array(likely >= least)).select(["u", "v"])

    return pairs.select("u", "v", "s_u", "s_v", "n_u", "n_v").mapInArrow(thin, "u long, v long")


def _with_words(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(reps.select(F.col("_cid").alias(side), F.col("_packed").alias(f"w_{side}")), side)
    return pairs.select("u", "v", "w_u", "w_v")


def _pair_sets(rows, width):
    """Full sets of the two sides of each pair. The last set of each side is kept: pivots come in runs."""
    known, unpack = WordHashes(), zstandard.ZstdDecompressor()
    last = {0: (None, None), 1: (None, None)}

    def of(side, cid, packed):
        if last[side][0] != cid:
            last[side] = (cid, shingles(unpack.decompress(packed).split(b" "), width, known))
        return last[side][1]

    for _, (us, vs, wus, wvs) in batches(rows, ["u", "v", "w_u", "w_v"], 256):
        yield [(u, v, of(0, u, wu), of(1, v, wv)) for u, v, wu, wv in zip(us, vs, wus, wvs)]


def _linked(common: int, n_u: int, n_v: int, percent: int) -> bool:
    return 100 * common >= percent * (n_u + n_v - common)


def _verified(pairs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def check(rows):
        for sets in _pair_sets(rows, width):
            kept = [(u, v) for u, v, a, b in sets if _linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return _with_words(pairs, reps).mapInArrow(check, "u long, v long")


def _stars(star_pairs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """``p, x, linked``, elements ``n``, of the difference ``d``, of these added ``a``, and the prefixes of the difference, as the smaller and as the larger side of a pair."""
    t = percent / 100.0
    c = (1.0 - t) / (1.0 + t)

    def compare(rows):
        for sets in _pair_sets(rows, width):
            out = [[], [], [], [], [], [], [], []]
            for p, x, a, b in sets:
                common = np.intersect1d(a, b, assume_unique=True)
                linked = _linked(len(common), len(a), len(b), percent)
                added = np.setdiff1d(b, common, assume_unique=True)
                gone = np.setdiff1d(a, common, assume_unique=True)
                diff = np.concatenate([added, gone]).view(np.int64)
                d, h = len(diff), c * len(b) * (1.0 + 1.0 / t) + 1e-9  # h bounds c (|x| + |y|): a linked y has at most |x| / t elements
                # as the smaller side; the other one is unlinked if this one is linked, hence differs by more than its own bound
                other = max(d, math.floor(c * (t * len(b) + len(a)))) if linked else d
                small = max(1, math.ceil((other + d - h) / 2.0 - 1e-9))
                large = max(1, math.ceil(d - h - 1e-9))
                for column, value in zip(out, (p, x, linked, len(b), d, len(added), diff[: max(0, d - small + 1)], diff[: max(0, d - large + 1)])):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(out, types)], names=["p", "x", "linked", "n", "d", "a", "small", "large"])

    return _with_words(star_pairs, reps).mapInArrow(compare, "p long, x long, linked boolean, n long, d long, a long, small array<long>, large array<long>")


def _side_pairs(stars: DataFrame, percent: int, mixed: bool) -> DataFrame:
    """Pairs of one star that may be linked through a shared element of their differences: one linked with the pivot and one not
    (``mixed``), or neither.

    A linked pair is met at the first element it shares, from where both differences still hold the overlap it needs.
    """
    c = (100.0 - percent) / (100.0 + percent)
    open_ = stars.filter(~F.col("linked")).select("p").distinct()  # a star whose members are all linked has no such pair
    rows = stars.join(open_, "p", "left_semi")
    side = lambda array, tag: rows.select(
        "p", *[F.col(k).alias(f"{k}_{tag}") for k in ("x", "linked", "n", "d", "a")], F.posexplode(array).alias(f"i_{tag}", "e"))
    y, z = side("small", "y"), side("large", "z")
    col = F.col
    need = (col("d_y") + col("d_z") - c * (col("n_y") + col("n_z"))) / 2.0 - 1e-6
    gone = F.least(col("d_y") - F.greatest("i_y", "a_y"), col("d_z") - F.greatest("i_z", "a_z"))
    fresh = F.greatest(F.least(col("a_y") - col("i_y"), col("a_z") - col("i_z")), F.lit(0))
    met = y.join(z, (y["p"] == z["p"]) & (y["e"] == z["e"]) & (col("linked_y") != col("linked_z") if mixed else ~col("linked_y") & ~col("linked_z")) & (gone + fresh >= need)
                 & ((col("d_y") < col("d_z")) | ((col("d_y") == col("d_z")) & (col("x_y") < col("x_z")))))
    return met.select(F.least("x_y", "x_z").alias("u"), F.greatest("x_y", "x_z").alias("v")).distinct()


def links(reps: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """``u, v``: verified links that connect exactly what all links connect. ``reps``: ``_cid, n_shingles, _sketch, _packed``."""
    bands = _bands(reps, rows)
    sizes = bands.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    met = cut(bands.join(sizes, "_key"))
    needed = cut(reps.join(met.select("_cid").distinct(), "_cid", "left_semi"))
    weight = met.groupBy("_cid").agg(F.sum("_size").alias("_weight"))
    direct = [_all_pairs(met.filter(F.col("_size") <= SMALL_BUCKET))]
    open_ = cut(met.filter(F.col("_size") > SMALL_BUCKET).select("_key", "_cid").join(weight, "_cid"))
    linked: list[DataFrame] = []
    closed: list[DataFrame] = []  # members left in buckets without a further family, with the bucket's first pivot
    first = None
    while not is_empty(open_):
        # the heaviest member lies in the largest buckets, hence near the centre of the largest family
        pivot = open_.groupBy("_key").agg(F.max(F.struct("_weight", -F.col("_cid"))).alias("_top")).select("_key", (-F.col("_top")["col2"]).alias("u"))
        around = cut(open_.join(pivot, "_key"))
        stars = cut(_stars(around.filter("_cid != u").select("u", F.col("_cid").alias("v")).distinct(), needed, width, percent))
        marks = stars.select(F.col("p").alias("u"), F.col("x").alias("_cid"), "linked")
        marked = cut(around.join(marks, ["u", "_cid"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))))
        if first is None:
            first = stars
            marked, good = marked.withColumn("_p", F.col("u")), stars
        else:
            found = marked.groupBy("_key").agg((F.count_if("linked") >= FAMILIES * (F.count(F.lit(1)) - 1)).alias("_family"))
            marked = cut(marked.join(found, "_key"))
            closed.append(marked.filter("not _family").select(F.col("_p").alias("p"), F.col("_cid").alias("x")))
            marked = marked.filter("_family").drop("_family")
            good = stars.join(marked.select(F.col("u").alias("p"), F.col("_cid").alias("x")).distinct(), ["p", "x"], "left_semi")
        direct.append(_side_pairs(good, percent, mixed=True))
        linked.append(good.filter("linked").select(F.col("p").alias("u"), F.col("x").alias("v")))
        rest = marked.filter("not linked and _cid != u").select("_key", "_cid", "_weight", "_p")
        rest = cut(rest.join(rest.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")), "_key"))
        direct.append(_all_pairs(rest.filter((F.col("_size") > 1) & (F.col("_size") <= SMALL_BUCKET))))
        open_ = rest.filter(F.col("_size") > SMALL_BUCKET).drop("_size")
    if closed:
        left = reduce(DataFrame.unionByName, closed).distinct()
        direct.append(_side_pairs(first.join(left, ["p", "x"], "left_semi"), percent, mixed=False))
    pairs = cut(_likely(reduce(DataFrame.unionByName, direct).distinct(), needed, percent / 100.0))
    return reduce(DataFrame.unionByName, linked, _verified(pairs, needed, width, percent))


def _all_pairs(members: DataFrame) -> DataFrame:
    """``u, v``: the pairs of each small bucket."""
    few = members.groupBy("_key").agg(F.sort_array(F.collect_list("_cid")).alias("_all"))
    return few.select(F.posexplode("_all").alias("_at", "u"), "_all").select("u", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_shingles``, ``component_id``, ``kept``, ``leads`` for every row of ``docs``.

    Two documents are linked when their shingle sets have a Jaccard similarity of at least ``percent`` hundredths. ``component_id`` is
    the smallest id reachable over links. Null and blank texts have no shingles and stand alone. Rows with the same id are
    judged alike; a row without id links others but is kept only if its component has no id at all. ``leads`` holds for exactly one row of each
    component, one with the smallest id, also among repeated rows and rows without id; rows without shingles each lead themselves. Empty tables give empty results.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50 and not above 100")
    all_rows = cut(with_row_key(sketches(docs, width, keep)))
    worded = all_rows.filter("_h1 is not null")
    classes = cut(worded.groupBy("_h1", "_h2").agg(F.min("_rid").alias("_cid"), F.min("doc_id").alias("_first"),
                                                       F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("_lead")))
    reps = worded.withColumnRenamed("_rid", "_cid").select("_cid", "n_shingles", "_sketch", "_packed").join(classes.select("_cid"), "_cid", "left_semi")
    edges = cut(links(reps, width, percent, rows).select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct())
    joined = cut(connected_components(classes, edges, id_col="_cid", out="_comp"))
    least = joined.groupBy("_comp").agg(F.min("_first").alias("component_id"), F.min("_lead").alias("_lead"))
    found = joined.join(least.select("_comp", "component_id", F.col("_lead._rid").alias("_leader")), "_comp").select("_h1", "_h2", "component_id", "_leader")
    return (all_rows.drop("_sketch", "_packed").join(found, ["_h1", "_h2"], "left")
            .withColumn("component_id", F.coalesce("component_id", F.col("doc_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .withColumn("leads", F.coalesce(F.col("_rid") == F.col("_leader"), F.lit(True))).drop("_h1", "_h2", "_rid", "_leader"))


def op4_near_dups(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
