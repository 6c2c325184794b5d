"""Sparse voxel operators on the rasterised fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import graph as G
from dendrospark.operators import sites as SI
from dendrospark.operators import voxel as V
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables

# no patch is meant: z is 0 to 3 in these graphs, y and x only must not fall below zero
SHAPE = (4, 1 << 40, 1 << 40)

_LINE = """
  select distinct label, greatest(0, cast(round(az + (i / n) * (bz - az)) as bigint)) as z, cast(round(ay + (i / n) * (by_ - ay)) as bigint) as y,
    greatest(0, cast(round(ax + (i / n) * (bx - ax)) as bigint)) as x
  from (select *, unnest(range(0, steps + 1))::double as i, greatest(steps, 1)::double as n from (
    select {label} as label, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, greatest(abs(a.x-b.x), abs(a.y-b.y), abs(a.z-b.z)) as steps
    from {edge} e join {node} a on a.node_id = e.src join {node} b on b.node_id = e.dst) q) p"""
FRAG_VOX = _LINE.format(label="e.label", edge="frag_edge", node="frag_node")
GT_VOX = _LINE.format(label="0", edge="gt_edge", node="gt_node")
LIGHT = "select z, y, x, cast((z * 31 + y * 7 + x * 3) % 50 as double) as value from gt_vox"


def _local(edges, nodes, carry=()):
    w = G.with_ends(edges.select("src", "dst", *carry), nodes, ["x", "y", "z"])
    return w.select(*carry, *[F.col(f"{c}_{e}").alias(f"{e}_{c}") for c in "zyx" for e in ("src", "dst")])


def frag_voxels(t):
    return V.rasterize_edges(_local(t.frag_edge, t.frag_node, ["label"]), SHAPE, ["label"])


def light(t):
    v = V.rasterize_edges(_local(t.gt_edge, t.gt_node), SHAPE)
    return v.withColumn("value", ((F.col("z") * 31 + F.col("y") * 7 + F.col("x") * 3) % 50).cast("double"))


@query("p19_rasterize_edges", with_tables("frag_edge", extra={"vox": FRAG_VOX}, body="select label, z, y, x from vox"))
def _(t):
    return frag_voxels(t)


@query("r4_dilate", with_tables("frag_edge", extra={"vox": FRAG_VOX}, body="""
  select distinct z + dz as z, y + dy as y, x + dx as x from (select distinct z, y, x from vox) v, range(-2, 3) a(dz), range(-2, 3) b(dy), range(-2, 3) c(dx)
  where abs(dz) + abs(dy) + abs(dx) <= 2 and z + dz between 0 and 3 and y + dy >= 0 and x + dx >= 0"""))
def _(t):
    return V.dilate(frag_voxels(t), 2, SHAPE)


_GROWN = """
  select z, y, x, min_by(label, d2 * 100000000 + label::bigint) as label from (
    select z + dz as z, y + dy as y, x + dx as x, label, dz*dz + dy*dy + dx*dx as d2 from vox v, range(-2, 3) a(dz), range(-2, 3) b(dy), range(-2, 3) c(dx)
    where dz*dz + dy*dy + dx*dx <= 4) g where z between 0 and 3 and y >= 0 and x >= 0 group by z, y, x"""


def grown(t):
    # the lowest label by value: labels of the fixture are numbers
    v = frag_voxels(t).withColumn("label", F.col("label").cast("bigint"))
    return V.dilate_labels(v, 2, SHAPE)


@query("r5_dilate_labels", with_tables("frag_edge", extra={"vox": FRAG_VOX, "grown": _GROWN}, body="select z, y, x, label::bigint as label from grown"))
def _(t):
    return grown(t)


@query("r6_read_labels_at", with_tables("frag_edge", extra={"vox": FRAG_VOX, "grown": _GROWN}, body="""
  select g.node_id, coalesce(v.label, '0') as pred_label from gt_node g left join grown v on v.z = g.z and v.y = g.y and v.x = g.x"""))
def _(t):
    nodes = t.gt_node.select("node_id", *[F.col(c).alias(f"local_{c}") for c in "zyx"])
    return V.read_labels_at(nodes, grown(t), SHAPE).select("node_id", "pred_label")


@query("a30_mask_iou", with_tables("frag_edge", extra={"vox": FRAG_VOX, "gt_vox": GT_VOX,
    "a": "select distinct z, y, x from gt_vox", "b": "select distinct z, y, x from vox"}, body="""
  select (select count(*) from a) as n_true, (select count(*) from b) as n_approx, (select count(*) from (select * from a intersect select * from b) q) as n_common,
    (select count(*) from (select * from a union select * from b) q) as n_union,
    round((select count(*) from (select * from a intersect select * from b) q) / (select count(*) from (select * from a union select * from b) q)::double, 9) as iou"""))
def _(t):
    return V.mask_iou(light(t), frag_voxels(t)).withColumn("iou", F.round("iou", 9))


@query("a33_mip", with_tables("gt_edge", extra={"gt_vox": GT_VOX, "light": LIGHT}, body="select y, x, max(value) as value from light group by y, x"))
def _(t):
    return V.mip(light(t), "z")


_PATCH = """
  select p.site, avg(l.value) as mean, max(l.value) as max, round(quantile_cont(l.value, 0.9), 9) as p90 from {pts} p join light l
    on l.z >= p.cz - 2 and l.z < p.cz + 2 and l.y >= p.cy - 8 and l.y < p.cy + 8 and l.x >= p.cx - 8 and l.x < p.cx + 8 group by p.site"""


@query("a31_gap_connectivity", with_tables("split_site", "gt_edge", extra={"gt_vox": GT_VOX, "light": LIGHT,
    "pa": "select node_a || '-' || node_b as site, az as cz, ay as cy, ax as cx from split_site", "pb": """select node_a || '-' || node_b as site, bz as cz, "by" as cy, bx as cx from split_site""",
    "a": _PATCH.format(pts="pa"), "b": _PATCH.format(pts="pb")}, body="""
  select a.site, round(a.mean, 6) as mean_a, a.max as max_a, round(a.p90, 6) as p90_a, round(b.mean, 6) as mean_b, b.max as max_b, round(b.p90, 6) as p90_b
  from a join b on a.site = b.site"""))
def _(t):
    s = SI.split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None)
    pairs = s.select(F.concat_ws("-", "node_a", "node_b").alias("site"), "ax", "ay", "az", "bx", "by", "bz")
    g = V.gap_connectivity(pairs, light(t), shape=(4, 16, 16))
    return g.select("site", F.round("mean_a", 6).alias("mean_a"), "max_a", F.round("p90_a", 6).alias("p90_a"),
                    F.round("mean_b", 6).alias("mean_b"), "max_b", F.round("p90_b", 6).alias("p90_b"))


@query("a32_merge_cut_evidence", with_tables("split_site", "gt_edge", extra={"gt_vox": GT_VOX, "light": LIGHT,
    "smp": """select node_a || '-' || node_b as pair, i, node_a || '-' || node_b || '-' || i as site, cast(round_even(az + (i / 8.0::double) * (bz - az), 0) as bigint) as cz,
      cast(round_even(ay + (i / 8.0::double) * ("by" - ay), 0) as bigint) as cy, cast(round_even(ax + (i / 8.0::double) * (bx - ax), 0) as bigint) as cx
      from split_site, range(0, 9) r(i)""",
    "v": _PATCH.format(pts="smp"), "prof": "select pair, i, p90 from smp left join v using (site)"}, body="""
  select pair as site, round((min(p90) filter (i = 0) + min(p90) filter (i = 8)) / 2, 6) as endpoint_mean, round(min(p90) filter (i between 1 and 7), 6) as valley,
    round(min(p90) filter (i between 1 and 7) / ((min(p90) filter (i = 0) + min(p90) filter (i = 8)) / 2), 6) as valley_ratio, min_by(i, p90 * 1000 + i) / 8.0::double as valley_pos
  from prof group by pair having count(p90) = 9"""))
def _(t):
    s = SI.split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None)
    sites = s.select(F.concat_ws("-", "node_a", "node_b").alias("site"), "ax", "ay", "az", "bx", "by", "bz")
    e = V.merge_cut_evidence(sites, light(t), shape=(4, 16, 16)).filter(F.col("profile").isNotNull())
    return e.select("site", *[F.round(c, 6).alias(c) for c in ("endpoint_mean", "valley", "valley_ratio")], "valley_pos")
