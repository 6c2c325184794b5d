"""Sparse voxels (``z, y, x`` integers, z-y-x order) in place of dense volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.session import cut, merged

ZYX = ("z", "y", "x")
#: voxels of one task that are repeated over offsets, and the side of the blocks in which neighbours come to one task
TASK_VOXELS, BLOCK_SIDE = 100_000, 32


def rasterize_edges(edges: DataFrame, shape: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """Voxels on the straight line of each edge (``src_z .. dst_x``, local), clipped to the box.

    As many steps as the longest axis difference; interpolated and rounded.
    """
    e = edges.withColumns({f"_{end}{c}": F.round(F.col(f"{end}_{c}")).cast("bigint") for end in ("src", "dst") for c in ZYX})
    steps = F.greatest(*[F.abs(F.col(f"_dst{c}") - F.col(f"_src{c}")) for c in ZYX])
    e = e.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    share = F.when(F.col("_n") > 0, F.col("_i") / F.col("_n")).otherwise(0.0)

    def at(c: str, size: int) -> Column:
        v = F.round(F.col(f"_src{c}") + share * (F.col(f"_dst{c}") - F.col(f"_src{c}")))
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), v.cast("bigint"))).alias(c)

    return e.select(*carry, *[at(c, s) for c, s in zip(ZYX, shape)]).distinct()


def _offsets(df: DataFrame, radius: int, inside: Column, shape: Sequence[int], keep: Sequence[Column | str]) -> DataFrame:
    """Each voxel repeated over the offsets that satisfy ``inside`` and stay in the box: a fixed number per voxel."""
    for c in ZYX:
        df = df.withColumn(f"_o{c}", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    df = df.filter(inside)
    moved = df.select(*keep, *[(F.col(c) + F.col(f"_o{c}")).alias(c) for c in ZYX])
    for c, s in zip(ZYX, shape):
        moved = moved.filter((F.col(c) >= 0) & (F.col(c) < s))
    return moved


def _in_blocks(voxels: DataFrame) -> DataFrame:
    """Voxels dealt out by blocks of space, in as many parts as they need: what grows together is united before the shuffle."""
    voxels = cut(voxels)
    return voxels.repartition(voxels.count() // TASK_VOXELS + 1, *[F.floor(F.col(c) / BLOCK_SIDE) for c in ZYX])


def dilate(voxels: DataFrame, radius: int, shape: Sequence[int]) -> DataFrame:
    """All voxels within ``radius`` city-block steps."""
    near = F.abs("_oz") + F.abs("_oy") + F.abs("_ox") <= radius
    return _offsets(_in_blocks(voxels.select(*ZYX)), radius, near, shape, []).distinct()


def dilate_labels(voxels: DataFrame, radius: int, shape: Sequence[int], label: str = "label") -> DataFrame:
    """Nearest label within Euclidean ``radius``; ties to the lowest label."""
    d2 = F.col("_oz") * F.col("_oz") + F.col("_oy") * F.col("_oy") + F.col("_ox") * F.col("_ox")
    grown = _offsets(_in_blocks(voxels.select(*ZYX, label)), radius, d2 <= radius * radius, shape, [d2.alias("_d2"), label])
    return grown.groupBy(*ZYX).agg(F.min(F.struct("_d2", label)).alias("_b")).select(*ZYX, F.col(f"_b.{label}").alias(label))


def read_labels_at(nodes: DataFrame, voxels: DataFrame, shape: Sequence[int], label: str = "label") -> DataFrame:
    """Label of the voxel each node falls in (``local_z, local_y, local_x`` rounded and clipped), else background."""
    key = {c: F.greatest(F.lit(0), F.least(F.lit(s - 1), F.round(F.col(f"local_{c}")).cast("bigint"))) for c, s in zip(ZYX, shape)}
    at = nodes.withColumns({f"_v{c}": k for c, k in key.items()})
    vox = voxels.select(*[F.col(c).cast("bigint").alias(f"_v{c}") for c in ZYX], F.col(label).cast("string").alias("_l"))
    return at.join(vox, [f"_v{c}" for c in ZYX], "left").withColumn("pred_label", F.coalesce("_l", F.lit("0"))).drop(
        "_l", *[f"_v{c}" for c in ZYX])


def mask_iou(a: DataFrame, b: DataFrame, shape: Sequence[int] | None = None) -> DataFrame:
    """Sizes, intersection, union, IoU and coverage of two voxel sets."""
    j = a.select(*ZYX).distinct().withColumn("_a", F.lit(1)).join(b.select(*ZYX).distinct().withColumn("_b", F.lit(1)), list(ZYX), "full_outer")
    out = j.agg(F.count("_a").alias("n_true"), F.count("_b").alias("n_approx"),
                F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_common"), F.count(F.lit(1)).alias("n_union"))
    out = out.withColumn("iou", F.try_divide(F.col("n_common").cast("double"), F.col("n_union")))
    if shape is not None:
        total = 1
        for s in shape:
            total *= s
        out = out.withColumn("coverage_pct", F.lit(100.0) * F.col("n_true") / F.lit(total))
    return out


def mip(voxels: DataFrame, axis: str, value: str = "value") -> DataFrame:
    """Largest value along one axis."""
    rest = [c for c in ZYX if c != axis]
    return voxels.groupBy(*rest).agg(F.max(value).alias(value))


def _patch_values(centres: DataFrame, keys: Sequence[str], voxels: DataFrame, shape: Sequence[int],
                  by: Sequence[str] = ()) -> DataFrame:
    """Voxels inside the box of ``shape`` around each centre (``cz, cy, cx``): a cell join, then the exact box.

    A patch starts at centre - size // 2.
    """
    cells = [*by, *[f"_k{c}" for c in ZYX]]
    low = {c: F.col(f"c{c}") - F.lit(s // 2) for c, s in zip(ZYX, shape)}
    # distinct centres first: neighbouring samples often share their patch
    centre = [*by, *[f"c{c}" for c in ZYX]]
    p = centres.select(*keys, *centre)
    q = p.select(*centre).distinct()
    for k, c, s in zip(cells[len(by):], ZYX, shape):
        q = q.withColumn(k, F.explode(F.sequence(F.floor(low[c] / F.lit(s)), F.floor((low[c] + F.lit(s - 1)) / F.lit(s)))))
    v = voxels.withColumns({k: F.floor(F.col(c) / F.lit(s)) for k, c, s in zip(cells[len(by):], ZYX, shape)})
    # centres and voxels both grow with the tables
    hit = q.join(merged(v), cells)
    for c, s in zip(ZYX, shape):
        hit = hit.filter((F.col(c) >= low[c]) & (F.col(c) < low[c] + F.lit(s)))
    # rounded, so that equal samples stay equal after interpolation
    stats = hit.groupBy(*centre).agg(
        F.avg("value").alias("mean"), F.max("value").cast("double").alias("max"), F.round(F.percentile("value", F.lit(0.9)), 9).alias("p90"))
    return p.join(merged(stats), centre, "left")


def _voxel_of(prefix: str, anisotropy: Sequence[float]) -> dict[str, Column]:
    ax, ay, az = anisotropy
    return {f"c{c}": F.round(F.col(f"{prefix}{c}") / F.lit(float(s))).cast("bigint") for c, s in (("z", az), ("y", ay), ("x", ax))}


def gap_connectivity(pairs: DataFrame, voxels: DataFrame, anisotropy: Sequence[float] = (1.0, 1.0, 1.0),
                     shape: Sequence[int] = (16, 16, 16), by: Sequence[str] = ()) -> DataFrame:
    """Mean, maximum and 90th percentile of the intensities around both ends of a gap; NULL where there is no voxel.

    ``pairs``: site, ax, ay, az, bx, by, bz in microns. ``voxels`` lists the voxels that exist.
    Columns ``by`` tell the images of several brains apart, in both tables; ``site`` is unique over all.
    """
    def side(tag):
        ends = pairs.select("site", *by, *[c.alias(n) for n, c in _voxel_of(tag, anisotropy).items()])
        return _patch_values(ends, ["site"], voxels, shape, by).select(
            "site", F.col("mean").alias(f"mean_{tag}"), F.col("max").alias(f"max_{tag}"), F.col("p90").alias(f"p90_{tag}"))

    return side("a").join(side("b"), "site")


def merge_cut_evidence(sites: DataFrame, voxels: DataFrame, anisotropy: Sequence[float] = (1.0, 1.0, 1.0), n_samples: int = 9,
                       shape: Sequence[int] = (16, 16, 16), by: Sequence[str] = ()) -> DataFrame:
    """Intensity profile along the chord between two seeds: is there a valley?

    Each sample is the 90th percentile of a small patch. The lowest interior
    value is the valley; its position looks at all samples, ends included. Sites
    with a sample outside the known voxels give NULLs.
    """
    last = max(n_samples - 1, 1)
    v = sites
    for tag in ("a", "b"):
        v = v.withColumns({f"_{tag}{n}": c for n, c in _voxel_of(tag, anisotropy).items()})
    v = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    share = F.col("i") / F.lit(float(last))
    # Python's round: half to even
    centre = {f"c{c}": F.bround(F.col(f"_ac{c}") + share * (F.col(f"_bc{c}") - F.col(f"_ac{c}"))).cast("bigint") for c in ZYX}
    samples = _patch_values(v.select("site", "i", *by, *[c.alias(n) for n, c in centre.items()]), ["site", "i"], voxels, shape, by)
    # n_samples rows per site
    prof = samples.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("i", "p90"))).alias("_s")).withColumn(
        "profile", F.transform("_s", lambda s: s["p90"]))
    whole = ~F.exists("profile", lambda p: p.isNull())
    interior = F.slice("profile", 2, n_samples - 2) if n_samples > 2 else F.col("profile")
    ends = (F.col("profile")[0] + F.col("profile")[n_samples - 1]) / 2.0
    valley = F.array_min(interior)
    return prof.select(
        "site", F.when(whole, F.col("profile")).alias("profile"), F.when(whole, ends).alias("endpoint_mean"),
        F.when(whole, valley).alias("valley"), F.when(whole & (ends > 0), valley / ends).alias("valley_ratio"),
        F.when(whole, (F.array_position("profile", F.array_min("profile")) - 1) / F.lit(float(last))).alias("valley_pos"))
