"""Distance joins, nearest neighbours and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import metrics as M
from dendrospark.operators import sites as SI
from dendrospark.operators import spatial as SP
from dendrospark.operators.ordering import exact_percentiles
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables
from dendrospark.session import cut, merged, side_by_side

OFFSET, SHAPE = (20, 800, 0), (200, 2400, 4)

_D2 = "(g.x-f.x)*(g.x-f.x) + (g.y-f.y)*(g.y-f.y) + (g.z-f.z)*(g.z-f.z)"
NEAR_SQL = f"""
  select g.node_id, min_by(f.label, ({_D2}) * 100000000 + f.node_id) as near_label
  from gt_node g join frag_node f on f.x between g.x - 5 and g.x + 5 and f.y between g.y - 5 and g.y + 5
    and f.z between g.z - 5 and g.z + 5 where {_D2} <= 25 group by g.node_id"""
PRED_SQL = """
  select g.node_id, g.neuron, g.raw_label, coalesce(near_label, '0') as pred_label from gt_node g left join near using (node_id)"""
PRED_EDGE_SQL = """
  select e.src, e.dst, e.neuron, a.pred_label as label_src, b.pred_label as label_dst from gt_edge e
    join pred a on e.src = a.node_id join pred b on e.dst = b.node_id"""
PRED = {"near": NEAR_SQL, "pred": PRED_SQL}


@query("flagship_edge_classes_per_neuron", with_tables("gt_edge", "frag_node", extra={**PRED, "pe": PRED_EDGE_SQL}, body="""
  select cast(neuron as varchar) as neuron, count(*) filter (c = 'correct') as correct, count(*) filter (c = 'split') as split,
    count(*) filter (c = 'omit') as omit from (
      select neuron, case when label_src = '0' or label_dst = '0' then 'omit' when label_src <> label_dst then 'split'
        else 'correct' end as c from pe) x group by neuron"""))
def _(t):
    gt = SP.nearest_label(t.gt_node, t.frag_node, 5.0)
    edges = M.classify_edges(M.edge_labels(t.gt_edge, gt, "pred_label"))
    counts = M.edge_class_counts(edges, ["neuron"])
    return counts.select(F.col("neuron").cast("string").alias("neuron"), "correct", "split", "omit")


@query("j1_split_sites", with_tables("split_site", body="select label_a, label_b, node_a, node_b, d2 from split_site"))
def _(t):
    s = SI.split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None)
    return s.select("label_a", "label_b", "node_a", "node_b", "d2")


@query("j1_split_sites_capped", with_tables("split_site", body="""
  select label_a, label_b, node_a, node_b, round(gap_um, 6) as gap_um from split_site order by split_site.gap_um, node_a, node_b limit 100"""))
def _(t):
    s = SI.split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=100)
    return s.select("label_a", "label_b", "node_a", "node_b", F.round("gap_um", 6).alias("gap_um"))


@query("j2_tip_to_tip_sites", with_tables("tip_pair", body="""
  select label_a, label_b, node_a, node_b, d2 from (
    select *, row_number() over (partition by least(label_a, label_b), greatest(label_a, label_b)
                                 order by d2, node_a, node_b) as rn from tip_pair where degree_b = 1) where rn = 1"""))
def _(t):
    s = SI.split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None, tip_to_shaft=False)
    return s.select("label_a", "label_b", "node_a", "node_b", "d2")


@query("w1_closest_per_label_pair", with_tables("tip_pair", body="""
  select least(label_a, label_b) as low, greatest(label_a, label_b) as high, min(d2) as d2, count(*) as n_pairs
  from tip_pair group by all"""))
def _(t):
    pairs = SI.tip_pairs(t.frag_node, t.frag_edge, 15.0)
    return pairs.groupBy(F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high")).agg(
        F.min("d2").alias("d2"), F.count(F.lit(1)).alias("n_pairs"))


@query("j3_nearest_label", with_tables("gt_edge", "frag_node", extra=PRED, body="select node_id, pred_label from pred"))
def _(t):
    return SP.nearest_label(t.gt_node, t.frag_node, 5.0).select("node_id", "pred_label")


@query("j4_nearest_distance", with_tables("frag_node", body="""
  select g.node_id, min((g.x-f.x)*(g.x-f.x) + (g.y-f.y)*(g.y-f.y) + (g.z-f.z)*(g.z-f.z)) as d2
  from gt_node g join frag_node f on f.y between g.y - 200 and g.y + 200 group by g.node_id"""))
def _(t):
    return SP.nearest_distance(t.gt_node, t.frag_node, 5.0).select("node_id", "d2")


@query("j4_nearest_distance_far", with_tables("frag_node", body="""
  select g.node_id, min((g.x+100000-f.x)*(g.x+100000-f.x) + (g.y-f.y)*(g.y-f.y) + (g.z-f.z)*(g.z-f.z)) as d2
  from gt_node g join frag_node f on true group by g.node_id"""))
def _(t):
    """True nodes in a frame of their own, far from every fragment."""
    moved = t.gt_node.withColumn("x", F.col("x") + 100_000)
    return SP.nearest_distance(moved, t.frag_node, 5.0).select("node_id", "d2")


@query("j4_distance_summary", with_tables("frag_node", body="""
  select round(max(d), 6) as max_d, round(median(d), 6) as median_d, count(*) as n from (
    select sqrt(min((g.x-f.x)*(g.x-f.x) + (g.y-f.y)*(g.y-f.y) + (g.z-f.z)*(g.z-f.z))) as d
    from gt_node g join frag_node f on f.y between g.y - 200 and g.y + 200 group by g.node_id) q"""))
def _(t):
    d = SP.nearest_distance(t.gt_node, t.frag_node, 5.0)
    top = d.agg(F.round(F.max("distance"), 6).alias("max_d"), F.count(F.lit(1)).alias("n"))
    return side_by_side(top, exact_percentiles(d, "distance", {"median_d": 0.5}).select(F.round("median_d", 6).alias("median_d")))


@query("j5_edge_labels", with_tables("gt_edge", "frag_node", extra={**PRED, "pe": PRED_EDGE_SQL}, body="""
  select src, dst, label_src, label_dst from pe"""))
def _(t):
    gt = SP.nearest_label(t.gt_node, t.frag_node, 5.0)
    return M.edge_labels(t.gt_edge, gt, "pred_label").select("src", "dst", "label_src", "label_dst")


@query("j14_mutual_nearest_tips", with_tables("tip_pair", extra={"first": """
  select node_a, node_b, d2 from (select *, row_number() over (partition by node_a order by d2, node_b) as rn
    from tip_pair where degree_b = 1) where rn = 1"""}, body="""
  select a.node_a, a.node_b, a.d2 from first a join first b on a.node_a = b.node_b and a.node_b = b.node_a
  where a.node_a < a.node_b"""))
def _(t):
    pairs = SI.tip_pairs(t.frag_node, t.frag_edge, 15.0, tip_to_shaft=False)
    return SI.mutual_nearest(pairs).select("node_a", "node_b", "d2")


_PROPOSAL = """
  select node_a, node_b, label_a, label_b, degree_b, d2, row_number() over (partition by node_a order by d2, node_b) as rank from (
    select *, row_number() over (partition by node_a, label_b order by d2, node_b) as rn from tip_pair) where rn = 1"""


@query("j15_proposals", with_tables("tip_pair", extra={"prop": _PROPOSAL}, body="""
  select node_a, node_b, label_b, d2, rank from prop where rank <= 2"""))
def _(t):
    return SI.proposals(SI.tip_pairs(t.frag_node, t.frag_edge, 15.0), k=2).select("node_a", "node_b", "label_b", "d2", "rank")


_TRUTH = {"prop": _PROPOSAL, "rev": """
    select node_id, neuron from (select f.node_id, g.neuron, row_number() over (partition by f.node_id
      order by (g.x-f.x)*(g.x-f.x) + (g.y-f.y)*(g.y-f.y) + (g.z-f.z)*(g.z-f.z), g.node_id) as rn
      from frag_node f join gt_node g on g.x between f.x - 1 and f.x + 1 and g.y = f.y and g.z = f.z) q where rn = 1""",
    "ends": """
    select p.node_a, p.node_b, a.neuron as na, b.neuron as nb from prop p left join rev a on p.node_a = a.node_id
      left join rev b on p.node_b = b.node_id where rank <= 3""",
    "line": """
    select e.node_a, e.node_b, na, a.x as ax, a.y as ay, a.z as az, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz,
      greatest(1, cast(ceil(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z))) as integer)) as steps
    from ends e join frag_node a on a.node_id = e.node_a join frag_node b on b.node_id = e.node_b where na = nb""",
    "dots": """
    select node_a, node_b, na, i, ax + dx * i / steps as x, ay + dy * i / steps as y, az + dz * i / steps as z
    from (select *, unnest(range(0, steps + 1)) as i from line) q""",
    "far": """
    select node_a, node_b, quantile_cont(d, 0.9) as p90 from (
      select p.node_a, p.node_b, p.i, sqrt(min((g.x-p.x)*(g.x-p.x) + (g.y-p.y)*(g.y-p.y) + (g.z-p.z)*(g.z-p.z))) as d
      from dots p join gt_node g on g.neuron = p.na group by p.node_a, p.node_b, p.i) q group by node_a, node_b"""}


def _proposal_truth(t, **limit):
    # reverse labels: the neuron of the true node nearest to each fragment node at an end of a proposal
    truth = t.gt_node.select("node_id", "x", "y", "z", F.col("neuron").alias("n_gt"))
    props = cut(SI.proposals(SI.tip_pairs(t.frag_node, t.frag_edge, 15.0), k=3))
    ends = props.select(F.explode(F.array("node_a", "node_b")).alias("node_id")).distinct()
    rev = SP.nearest(t.frag_node.join(merged(ends), "node_id", "left_semi"), SP.as_build(truth, keep={"n_gt": "neuron"}), probe_id="node_id",
                     build_id="b_id", radius=1.0, carry=["neuron"])
    return SI.label_proposals(props, rev.select("node_id", "neuron"), frag_node=t.frag_node, gt_node=t.gt_node, **limit)


@query("j16_proposal_truth", with_tables("tip_pair", extra=_TRUTH, body="""
  select truth, count(*) as n, round(max(p90), 6) as max_p90 from (select case when na = nb and p90 >= 8 then 'reject' when na = nb then 'accept'
    when na <> nb then 'reject' else 'unknown' end as truth, p90 from ends left join far using (node_a, node_b)) q group by truth"""))
def _(t):
    return _proposal_truth(t).groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("projection_p90"), 6).alias("max_p90"))


@query("j16_proposal_truth_strict", with_tables("tip_pair", extra=_TRUTH, body="""
  select node_a, node_b, round(p90, 6) as p90, case when na = nb and p90 >= 2.3 then 'reject' when na = nb then 'accept'
    when na <> nb then 'reject' else 'unknown' end as truth from ends left join far using (node_a, node_b)"""))
def _(t):
    return _proposal_truth(t, max_projection=2.3).select("node_a", "node_b", F.round("projection_p90", 6).alias("p90"), "truth")


@query("p9_nodes_in_patch", with_tables("gt_node", body="""
  select node_id, x - 20 as local_x, y - 800 as local_y, z as local_z from gt_node
  where x >= 20 and x < 220 and y >= 800 and y < 3200 and z >= 0 and z < 4"""))
def _(t):
    return SP.nodes_in_patch(t.gt_node, OFFSET, SHAPE).select("node_id", "local_x", "local_y", "local_z")


@query("p10_edges_in_patch", with_tables("gt_edge", extra={"box": """
    select * from gt_node where x >= 20 and x < 220 and y >= 800 and y < 3200 and z >= 0 and z < 4"""}, body="""
  select e.src, e.dst, e.neuron, a.x - 20 as src_x, b.x - 20 as dst_x from gt_edge e join box a on e.src = a.node_id
    join box b on e.dst = b.node_id"""))
def _(t):
    return SP.edges_in_patch(t.gt_edge, t.gt_node, OFFSET, SHAPE).select("src", "dst", "neuron", "src_x", "dst_x")


@query("p11_nodes_in_patches", with_tables("gt_node", extra={"patch": """
    select node_id as patch_id, x - 32 as ox, y - 64 as oy, z - 2 as oz from gt_node where ord = 30"""}, body="""
  select patch_id, count(*) as n, count(distinct neuron) as neurons, sum(n.x - ox)::bigint as sum_local_x from gt_node n join patch p
    on n.x >= ox and n.x < ox + 64 and n.y >= oy and n.y < oy + 128 and n.z >= oz and n.z < oz + 4 group by patch_id"""))
def _(t):
    patches = t.gt_node.filter(F.col("ord") == 30).select(
        F.col("node_id").alias("patch_id"), (F.col("x") - 32).alias("ox"), (F.col("y") - 64).alias("oy"), (F.col("z") - 2).alias("oz"))
    inside = SP.nodes_in_patches(t.gt_node, patches, (64, 128, 4))
    return inside.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("neuron").alias("neurons"),
                                          F.sum("local_x").alias("sum_local_x"))
