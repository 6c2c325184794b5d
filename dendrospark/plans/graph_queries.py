"""Projections, node features, components, walks and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.functions import scalar as S
from dendrospark.operators import graph as G
from dendrospark.operators import walk as W
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables

# anisotropy of the data set (x, y, z), in microns per voxel
ANISOTROPY = (0.748, 0.748, 1.0)


@query("p1_to_voxel", with_tables("gt_node", body="""
  select node_id, cast(round(z / 1.0::double) as integer) as vz, cast(round(y / 0.748::double) as integer) as vy,
    cast(round(x / 0.748::double) as integer) as vx from gt_node"""))
def _(t):
    v = S.to_voxel(ANISOTROPY)
    return t.gt_node.select("node_id", *[c.alias(n) for n, c in v.items()])


@query("p2_segment_id", with_tables("frag_node", body="""
  select segment, count(*) as n from (
    select split_part(label || '.' || cast(node_id % 3 as varchar), '.', 1) as segment from frag_node) s group by segment"""))
def _(t):
    swc = F.concat_ws(".", "label", (F.col("node_id") % 3).cast("string"))
    return t.frag_node.select(S.segment_id(swc).alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("p3_neuron_keys", """
  select c_custkey, list_extract(string_split(name, '-'), -1) as annotator, c_nationkey || ':' || name as neuron_key
  from (select *, 'N' || c_custkey || '-' || c_nationkey || '-' || lower(substr(c_mktsegment, 1, 2)) as name
        from customer) c""")
def _(t):
    c = t.raw("customer").withColumn("name", F.concat(
        F.lit("N"), "c_custkey", F.lit("-"), "c_nationkey", F.lit("-"), F.lower(F.substring("c_mktsegment", 1, 2))))
    return c.select("c_custkey", S.annotator("name").alias("annotator"),
                    S.neuron_key("c_nationkey", "name").alias("neuron_key"))


@query("p4_labelled", with_tables("gt_node", body="""
  select neuron, count(*) as n from gt_node where raw_label <> '0' group by neuron"""))
def _(t):
    return G.labelled(t.gt_node, "raw_label").groupBy("neuron").agg(F.count(F.lit(1)).alias("n"))


@query("p5_label_universe", with_tables("gt_node", body="""
  select distinct raw_label from gt_node where raw_label <> '0'"""))
def _(t):
    return G.label_universe(t.gt_node, "raw_label")


@query("p6_degree", with_tables("frag_deg", body="select node_id, degree from frag_deg"))
def _(t):
    return G.degrees(t.frag_node, t.frag_edge).select("node_id", "degree")


@query("p7_node_class", with_tables("frag_deg", body="""
  select label, count(*) filter (degree >= 3) as branches, count(*) filter (degree = 2) as shafts,
    count(*) filter (degree = 1) as tips, count(*) filter (degree = 0) as isolated from frag_deg group by label"""))
def _(t):
    c = G.degrees(t.frag_node, t.frag_edge).withColumn("k", G.node_class(F.col("degree")))
    return c.groupBy("label").agg(
        F.count_if(F.col("k") == "branch").alias("branches"), F.count_if(F.col("k") == "shaft").alias("shafts"),
        F.count_if(F.col("k") == "tip").alias("tips"), F.count_if(F.col("k") == "isolated").alias("isolated"))


@query("p8_edge_length", with_tables("frag_len", body="select src, dst, round(length, 9) as length from frag_len"))
def _(t):
    return G.edge_length(t.frag_edge.select("src", "dst"), t.frag_node).select("src", "dst", F.round("length", 9).alias("length"))


@query("p12_edge_midpoints", with_tables("gt_le", body="""
  select e.src, e.dst, (a.x + b.x) / 2.0::double as mid_x, (a.y + b.y) / 2.0::double as mid_y,
    (a.z + b.z) / 2.0::double as mid_z
  from gt_le e join gt_node a on e.src = a.node_id join gt_node b on e.dst = b.node_id
  where e.label_src <> e.label_dst and e.label_src <> '0' and e.label_dst <> '0'"""))
def _(t):
    split = t.gt_labelled_edge.filter(
        (F.col("label_src") != F.col("label_dst")) & (F.col("label_src") != "0") & (F.col("label_dst") != "0"))
    return G.edge_midpoints(split.select("src", "dst"), t.gt_node)


_TANGENT = """
  select d.node_id, (d.x - n.x) / nullif(l, 0) as tx, (d.y - n.y) / nullif(l, 0) as ty, (d.z - n.z) / nullif(l, 0) as tz
  from (select * from frag_deg where degree = 1) d join frag_sym s on s.u = d.node_id join frag_node n on n.node_id = s.v,
    lateral (select sqrt((d.x-n.x)*(d.x-n.x) + (d.y-n.y)*(d.y-n.y) + (d.z-n.z)*(d.z-n.z)) as l)"""


@query("p13_tip_tangent", with_tables("frag_deg", extra={"tan": _TANGENT}, body="""
  select node_id, round(tx, 6) as tx, round(ty, 6) as ty, round(tz, 6) as tz from tan"""))
def _(t):
    tan = G.tip_tangent(t.frag_node, t.frag_edge)
    return tan.select("node_id", *[F.round(f"t{c}", 6).alias(f"t{c}") for c in "xyz"])


_TIPS = "(select node_id from frag_deg where degree = 1)"
# fragments of the fixture are trees: the walk that never turns back is the shortest path
_REACH = """
  select node_id as start, node_id, cast(-1 as bigint) as prev, 0.0::double as dist from {starts} s0
  union all
  select r.start, e.v, r.node_id, r.dist + e.length from reach r join frag_sym e on e.u = r.node_id
  where e.v <> r.prev and r.dist + e.length <= {radius}"""


def _tips(t):
    return G.degrees(t.frag_node, t.frag_edge).filter(F.col("degree") == 1).select("node_id")


def _sym(t):
    return G.symmetric(G.edge_length(t.frag_edge.select("src", "dst"), t.frag_node), carry=["length"])


@query("g3_reach", with_tables("frag_deg", recursive=True, extra={"reach": _REACH.format(starts=_TIPS, radius=12)}, body="""
  select start, node_id, round(dist, 6) as dist from reach"""))
def _(t):
    return G.reach(_tips(t), _sym(t), 12.0).select("start", "node_id", F.round("dist", 6).alias("dist"))


_MEAN = """
  select start, sum(dx / l) as mx, sum(dy / l) as my, sum(dz / l) as mz from (
    select r.start, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz,
      nullif(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)), 0) as l
    from reach r join frag_node a on a.node_id = r.start join frag_node b on b.node_id = r.node_id
    where r.start <> r.node_id) u group by start"""


@query("p14_mean_tangent", with_tables("frag_deg", recursive=True, extra={
    "reach": _REACH.format(starts=_TIPS, radius=12), "mean": _MEAN}, body="""
  select start as node_id, round(-mx / n, 6) as tx, round(-my / n, 6) as ty, round(-mz / n, 6) as tz
  from mean, lateral (select nullif(sqrt(mx*mx + my*my + mz*mz), 0) as n)"""))
def _(t):
    tan = G.mean_tangent(t.frag_node, G.reach(_tips(t), _sym(t), 12.0))
    return tan.select("node_id", *[F.round(f"t{c}", 6).alias(f"t{c}") for c in "xyz"])


@query("p15_angle_between_edges", with_tables("frag_len", body="""
  select src, dst, round(degrees(acos(greatest(-1, least(1, (ax*qx + ay*qy + az*qz) / (la * lb))))), 4) as angle from (
    select e.src, e.dst, (a.x - b.x)::double as ax, (a.y - b.y)::double as ay, (a.z - b.z)::double as az, 1.0 as qx, 0.0 as qy, 0.0 as qz,
      sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as la, 1.0 as lb
    from frag_edge e join frag_node a on e.src = a.node_id join frag_node b on e.dst = b.node_id) v where la > 0"""))
def _(t):
    e = G.with_ends(t.frag_edge.select("src", "dst"), t.frag_node, ["x", "y", "z"]).select(
        "src", "dst", *[(F.col(f"{c}_src") - F.col(f"{c}_dst")).cast("double").alias(f"a{c}") for c in "xyz"],
        F.lit(1.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(0.0).alias("bz"))
    return e.filter(S.norm("a") > 0).select("src", "dst", F.round(S.angle_deg("a", "b"), 4).alias("angle"))


@query("p16_radius_ratio", with_tables("frag_edge", body="""
  select e.src, e.dst, case when a.r > 0 and b.r > 0 then round(greatest(a.r, b.r) / least(a.r, b.r)::double, 6) end as ratio
  from frag_edge e join (select node_id, radius - 1 as r from frag_node) a on e.src = a.node_id
    join (select node_id, radius - 1 as r from frag_node) b on e.dst = b.node_id"""))
def _(t):
    n = t.frag_node.select("node_id", (F.col("radius") - 1).cast("double").alias("r"))
    e = G.with_ends(t.frag_edge.select("src", "dst"), n, ["r"])
    return e.select("src", "dst", F.round(S.radius_ratio(F.col("r_src"), F.col("r_dst")), 6).alias("ratio"))


@query("p18_sample_node", with_tables("gt_node", body="""
  select node_id, draw from (select node_id, md5('7|' || cast(node_id as varchar)) as draw from gt_node) s
  order by draw limit 1"""))
def _(t):
    return G.sample_node(t.gt_node.select("node_id"), seed=7)


@query("p20_dense_codes", with_tables("frag_node", body="""
  select node_id, cast(dense_rank() over (order by label) as bigint) as code from frag_node"""))
def _(t):
    return G.dense_codes(t.frag_node.select("node_id", "label"), "label").select("node_id", "code")


@query("p23_radius_variance", with_tables("frag_deg", recursive=True, extra={
    "reach": _REACH.format(starts="(select node_id from frag_deg where degree >= 3)", radius=12)}, body="""
  select r.start as node_id, round(var_pop(n.radius), 6) as radius_variance, count(*) as n_nodes
  from reach r join frag_node n using (node_id) group by r.start"""))
def _(t):
    starts = G.degrees(t.frag_node, t.frag_edge).filter(F.col("degree") >= 3).select("node_id")
    v = G.radius_variance(t.frag_node, G.reach(starts, _sym(t), 12.0))
    return v.select("node_id", F.round("radius_variance", 6).alias("radius_variance"), "n_nodes")


COMP_SQL = """
  select node_id, node_id as root from frag_node
  union
  select e.v, c.root from comp c join frag_sym e on e.u = c.node_id where c.root < e.v"""


@query("g1_connected_components", with_tables("frag_sym", recursive=True, extra={"comp": COMP_SQL}, body="""
  select node_id, min(root) as component from comp group by node_id"""))
def _(t):
    return G.connected_components(t.frag_node.select("node_id"), t.frag_edge.select("src", "dst"))


# arms walked node by node; n counts the steps
ARM_SQL = """
  select s.u as start, s.v as arm, s.u as prev, s.v as cur, {first} as cable, 1 as n from frag_sym s join frag_deg d on d.node_id = s.u and {which}
  union all
  select a.start, a.arm, a.cur, e.v, a.cable + e.length, a.n + 1 from arms a join frag_deg d on d.node_id = a.cur and d.degree = 2
    join frag_sym e on e.u = a.cur and e.v <> a.prev where a.cable < {limit}"""


@query("g2_branch_arms", with_tables("frag_deg", recursive=True, extra={
    "arms": ARM_SQL.format(first="s.length", which="d.degree >= 3", limit=24)}, body="""
  select start as node_id, arm, max_by(cur, n) as end_node, round(max(cable), 6) as cable,
    coalesce(min_by(cur, n) filter (cable >= 8), max_by(cur, n)) as seed_node from arms group by start, arm"""))
def _(t):
    starts = G.degrees(t.frag_node, t.frag_edge).filter(F.col("degree") >= 3)
    a = W.walk_arms(t.frag_node, t.frag_edge.select("src", "dst"), starts, 24.0, 8.0)
    return a.select("node_id", "arm", "end_node", F.round("cable", 6).alias("cable"), "seed_node")


@query("g2_neck_sides", with_tables("frag_deg", recursive=True, extra={
    "arms": ARM_SQL.format(first="0.0::double", which="d.degree = 2", limit=24)}, body="""
  select start as node_id, arm, max_by(cur, n) as end_node, round(max(cable), 6) as cable,
    coalesce(min_by(cur, n) filter (cable >= 8), max_by(cur, n)) as seed_node from arms group by start, arm"""))
def _(t):
    starts = G.degrees(t.frag_node, t.frag_edge).filter(F.col("degree") == 2)
    a = W.walk_arms(t.frag_node, t.frag_edge.select("src", "dst"), starts, 24.0, 8.0, from_neighbour=True)
    return a.select("node_id", "arm", "end_node", F.round("cable", 6).alias("cable"), "seed_node")


@query("r1_drop_short", with_tables("frag_sym", recursive=True, extra={"comp": COMP_SQL, "top": """
    select node_id, min(root) as component from comp group by node_id"""}, body="""
  select node_id, component from top where component in (
    select component from frag_len e join top on e.src = top.node_id group by component having sum(length) >= 40)"""))
def _(t):
    nodes, _edges = G.drop_short(t.frag_node.select("node_id", "x", "y", "z"), t.frag_edge.select("src", "dst"), 40.0)
    return nodes.select("node_id", "component")


@query("a22_graph_summary", with_tables("frag_sym", recursive=True, extra={"comp": COMP_SQL, "top": """
    select node_id, min(root) as component from comp group by node_id"""}, body="""
  select (select count(*) from frag_node) as n_nodes, (select count(distinct component) from top) as n_components,
    (select count(distinct label) from frag_node) as n_segments, (select count(*) from frag_edge) as n_edges"""))
def _(t):
    return G.graph_summary(t.frag_node, t.frag_edge.select("src", "dst"))


# one chain seen from its smaller end: walk from every junction edge to the next junction
_CHAIN = {
    "walk": """select s.u as start, s.v as first, s.u as prev, s.v as cur, s.length as cable, 1 as n from frag_sym s
        join frag_deg d on d.node_id = s.u and d.degree <> 2
      union all
      select w.start, w.first, w.cur, e.v, w.cable + e.length, w.n + 1 from walk w join frag_deg d on d.node_id = w.cur and d.degree = 2
        join frag_sym e on e.u = w.cur and e.v <> w.prev""",
    "walked": """select start, first, max_by(cur, n) as "end", max_by(prev, n) as last, max(cable) as cable from walk group by start, first""",
    "chain": """select * from walked where start < "end" or (start = "end" and first <= last)""",
    "member": """select w.start, w.first, w.prev as a, w.cur as b, w.cable - e.length as pos_a, w.cable as pos_b, c.cable
      from walk w join chain c using (start, first) join frag_sym e on e.u = w.prev and e.v = w.cur""",
}


@query("r2_chains", with_tables("frag_deg", recursive=True, extra=_CHAIN, body="""
  select start, first, "end", last, round(cable, 6) as cable from chain"""))
def _(t):
    table, _members = W.chains(t.frag_node, t.frag_edge.select("src", "dst"))
    return table.select("start", "first", "end", "last", F.round("cable", 6).alias("cable"))


@query("r2_resample", with_tables("frag_deg", recursive=True, extra={**_CHAIN, "m": """
    select *, greatest(1, cast(round(cable / 7.0::double) as bigint)) as n from member""", "pts": """
    select m.*, unnest(range(cast(ceil(round(pos_a / (cable / n), 6)) as bigint),
      case when round(pos_b - cable, 6) >= 0 then n + 1 else cast(ceil(round(pos_b / (cable / n), 6)) as bigint) end)) as k from m"""}, body="""
  select start, first, k, round(a.x + s * (b.x - a.x), 4) as x, round(a.y + s * (b.y - a.y), 4) as y, round(a.z + s * (b.z - a.z), 4) as z
  from (select *, greatest(0, least(1, (k * (cable / n) - pos_a) / (pos_b - pos_a))) as s from pts) p
    join frag_node a on a.node_id = p.a join frag_node b on b.node_id = p.b"""))
def _(t):
    r = W.resample(t.frag_node, t.frag_edge.select("src", "dst"), 7.0)
    return r.select("start", "first", "k", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("r3_prune_tips", with_tables("frag_deg", recursive=True, extra={**_CHAIN, "short": """
    select c.start, c.first, case when ds.degree >= 3 then c.start else c."end" end as keep from chain c
    join frag_deg ds on ds.node_id = c.start join frag_deg de on de.node_id = c."end"
    where c.cable < 12 and ((ds.degree = 1 and de.degree >= 3) or (de.degree = 1 and ds.degree >= 3))"""}, body="""
  select node_id from frag_node where node_id not in (
    select unnest([a, b]) as node_id from member join short using (start, first))
  or node_id in (select keep from short)"""))
def _(t):
    return W.prune_tips(t.frag_node, t.frag_edge.select("src", "dst"), 12.0).select("node_id")


@query("x10_tortuosity", with_tables("frag_deg", recursive=True, extra={**_CHAIN, "span": """
    select start, first, floor(round(pos_a, 6) / 50) as piece, sum(pos_b - pos_a) as path, min_by(a, pos_a) as lo, max_by(b, pos_b) as hi
    from member group by all"""}, body="""
  select start, first, cast(piece as bigint) as piece, round(path, 5) as path,
    round(path / nullif(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 0), 5) as tortuosity
  from span join frag_node a on a.node_id = lo join frag_node b on b.node_id = hi"""))
def _(t):
    r = W.tortuosity(t.frag_node, t.frag_edge.select("src", "dst"), 50.0)
    return r.select("start", "first", "piece", F.round("path", 5).alias("path"), F.round("tortuosity", 5).alias("tortuosity"))
