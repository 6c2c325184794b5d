"""Merge-site detectors, greedy rounds and the site stream."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dendrospark.operators import graph as G
from dendrospark.operators import greedy as GR
from dendrospark.operators import sites as SI
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables
from dendrospark.plans.graph_queries import ARM_SQL, COMP_SQL

_ARM_ENDS = """
  select start, arm, max(cable) as cable, max_by(cur, n) as end_node,
    coalesce(min_by(cur, n) filter (cable >= 8), max_by(cur, n)) as seed_node, sum(r.radius) as rsum, count(*) as rcnt
  from arms a join frag_node r on r.node_id = a.cur group by start, arm"""
_ANGLE = """degrees(acos(greatest(-1, least(1, ((ea.x-c.x)*(eb.x-c.x) + (ea.y-c.y)*(eb.y-c.y) + (ea.z-c.z)*(eb.z-c.z))
    / nullif(sqrt((ea.x-c.x)*(ea.x-c.x) + (ea.y-c.y)*(ea.y-c.y) + (ea.z-c.z)*(ea.z-c.z)) *
      sqrt((eb.x-c.x)*(eb.x-c.x) + (eb.y-c.y)*(eb.y-c.y) + (eb.z-c.z)*(eb.z-c.z)), 0)))))"""
_SITE_COLS = ["label", "cut_node", "seed_a_node", "seed_b_node", "branch_degree", "detector"]

BRANCH_SQL = {
    "arms": ARM_SQL.format(first="s.length", which="d.degree >= 3", limit=24), "ends": _ARM_ENDS,
    "ranked": "select *, row_number() over (partition by start order by round(cable, 6) desc, arm) as rn from ends",
    "branch_site": f"""
      select c.label, a.start as cut_node, a.seed_node as seed_a_node, b.seed_node as seed_b_node, c.degree as branch_degree,
        {_ANGLE} as angle_deg, greatest((a.rsum + c.radius) / (a.rcnt + 1), (b.rsum + c.radius) / (b.rcnt + 1))
          / least((a.rsum + c.radius) / (a.rcnt + 1), (b.rsum + c.radius) / (b.rcnt + 1)) as radius_ratio,
        a.cable as cable_a_um, b.cable as cable_b_um, 'branch' as detector
      from ranked a join ranked b on a.start = b.start and a.rn = 1 and b.rn = 2 join frag_deg c on c.node_id = a.start
        join frag_node ea on ea.node_id = a.end_node join frag_node eb on eb.node_id = b.end_node where b.cable >= 10""",
}


def rounded_sites(df, *keys):
    return df.select(*keys, *_SITE_COLS, F.round("angle_deg", 4).alias("angle_deg"), F.round("radius_ratio", 6).alias("radius_ratio"),
                     F.round("cable_a_um", 6).alias("cable_a_um"), F.round("cable_b_um", 6).alias("cable_b_um"))


_ROUNDED = """select label, cut_node, seed_a_node, seed_b_node, branch_degree, detector, round(angle_deg, 4) as angle_deg,
  round(radius_ratio, 6) as radius_ratio, round(cable_a_um, 6) as cable_a_um, round(cable_b_um, 6) as cable_b_um"""


@query("g7_merge_sites_branch", with_tables("frag_deg", recursive=True, extra=BRANCH_SQL, body=f"{_ROUNDED} from branch_site"))
def _(t):
    return rounded_sites(SI.merge_sites_branch(t.frag_node, t.frag_edge.select("src", "dst")))


# kinks of the V-shaped fixture are suppressed only by kinks of the same user, whose order is a plain chain,
# so the sequential pass is a recursion along the ranked candidates
_KINK = {
    "kink_sym": """
      select src as u, dst as v, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as length
      from kink_edge e join kink_node a on e.src = a.node_id join kink_node b on e.dst = b.node_id
      union all select dst, src, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))
      from kink_edge e join kink_node a on e.src = a.node_id join kink_node b on e.dst = b.node_id""",
    "kink_deg": """select n.*, coalesce(d.degree, 0) as degree from kink_node n left join
      (select u as node_id, count(*) as degree from kink_sym group by u) d using (node_id)""",
    "arms": ARM_SQL.format(first="0.0::double", which="d.degree = 2", limit=24).replace("frag_", "kink_"),
    "ends": _ARM_ENDS.replace("frag_", "kink_"),
    "ranked": "select *, row_number() over (partition by start order by arm) as rn from ends",
    "neck": f"""
      select c.label, a.start as cut_node, a.seed_node as seed_a_node, b.seed_node as seed_b_node, c.degree as branch_degree,
        {_ANGLE} as angle_deg, greatest(a.rsum / a.rcnt, b.rsum / b.rcnt) / least(a.rsum / a.rcnt, b.rsum / b.rcnt) as radius_ratio,
        a.cable as cable_a_um, b.cable as cable_b_um, 'bridge' as detector, c.x as cx, c.y as cy, c.z as cz
      from ranked a join ranked b on a.start = b.start and a.rn = 1 and b.rn = 2 join kink_deg c on c.node_id = a.start
        join kink_node ea on ea.node_id = a.end_node join kink_node eb on eb.node_id = b.end_node
      where a.cable >= 10 and b.cable >= 10""",
    "cand": "select *, row_number() over (order by round(angle_deg, 6), cut_node) as ord from neck where angle_deg <= 120",
    "conflict": """select a.ord as better, b.ord as worse from cand a join cand b on a.ord < b.ord
      and (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz) < 400""",
    "pass": """
      select cast(0 as bigint) as i, cast([] as bigint[]) as kept
      union all
      select i + 1, case when exists (select 1 from conflict c where c.worse = i + 1 and list_contains(kept, c.better)) then kept
        else list_append(kept, i + 1) end from pass where i < (select count(*) from cand)""",
    "bridge_site": "select c.* from cand c, (select unnest(kept) as k from (select kept from pass order by i desc limit 1)) q where c.ord = k",
}


@query("g8_merge_sites_bridge", with_tables("kink_edge", recursive=True, extra=_KINK, body=f"{_ROUNDED} from bridge_site"))
def _(t):
    return rounded_sites(SI.merge_sites_bridge(t.kink_node, t.kink_edge.select("src", "dst")))


COMPONENT_SQL = {
    "comp": COMP_SQL, "top": "select node_id, min(root) as component from comp group by node_id",
    "cable": "select component, sum(length) as cable from frag_len e join top on e.src = top.node_id group by component",
    "sized": """select n.label, t.component, coalesce(any_value(c.cable), 0) as cable, avg(n.radius) as mean_radius
      from top t join frag_node n using (node_id) left join cable c on c.component = t.component group by n.label, t.component
      having coalesce(any_value(c.cable), 0) >= 10""",
    "ranked_comp": """select *, row_number() over (partition by label order by round(cable, 6) desc, component) as rn,
      count(*) over (partition by label) as n from sized""",
    "contact": """
      select a.label, a.component as component_a, b.component as component_b, na.node_id as node_a, nb.node_id as node_b,
        a.cable as cable_a_um, b.cable as cable_b_um, a.mean_radius as ra, b.mean_radius as rb,
        (na.x-nb.x)*(na.x-nb.x) + (na.y-nb.y)*(na.y-nb.y) + (na.z-nb.z)*(na.z-nb.z) as d2
      from ranked_comp a join ranked_comp b on a.label = b.label and a.rn = 1 and b.rn > 1
        join top ta on ta.component = a.component join top tb on tb.component = b.component
        join frag_node na on na.node_id = ta.node_id join frag_node nb on nb.node_id = tb.node_id""",
    "component_site": """
      select label, node_a as cut_node, node_a as seed_a_node, node_b as seed_b_node, 0 as branch_degree, null::double as angle_deg,
        greatest(ra, rb) / least(ra, rb) as radius_ratio, cable_a_um, cable_b_um, 'component' as detector, component_b, d2
      from (select *, row_number() over (partition by component_b order by d2, node_b, node_a) as rn from contact) where rn = 1""",
}


@query("g9_merge_sites_component", with_tables("frag_sym", recursive=True, extra=COMPONENT_SQL, body=f"{_ROUNDED} from component_site"))
def _(t):
    return rounded_sites(SI.merge_sites_component(t.frag_node, t.frag_edge.select("src", "dst")))


@query("j6_closest_component_pair", with_tables("frag_sym", recursive=True, extra=COMPONENT_SQL, body="""
  select label, component_b, seed_a_node as node_a, seed_b_node as node_b, d2 from component_site"""))
def _(t):
    marked, sized = SI.component_sizes(t.frag_node, t.frag_edge.select("src", "dst"))
    pairs = SI.closest_component_pair(marked, sized.filter(F.col("cable") >= 10.0))
    return pairs.select("label", "component_b", "node_a", "node_b", "d2")


# --- all three detectors --------------------------------------------------------------------------------------------

# the bridge tables on the fragment graph, under names of their own
_BRIDGE_SQL = {
    (f"neck_{k}" if k in ("arms", "ends", "ranked") else k): re.sub(r"\b(arms|ends|ranked)\b", r"neck_\1", sql.replace("kink_", "frag_"))
    for k, sql in _KINK.items() if k not in ("kink_sym", "kink_deg")}
ALL_SQL = {**BRANCH_SQL, **COMPONENT_SQL, **_BRIDGE_SQL, "found": " union all ".join(
    f"""select label, cut_node, seed_a_node, seed_b_node, branch_degree, angle_deg, radius_ratio, cable_a_um, cable_b_um, detector
  from {site}""" for site in ("branch_site", "component_site", "bridge_site"))}


def _all_sites(t):
    return SI.merge_sites(t.frag_node, t.frag_edge.select("src", "dst"))


def _all_stream(t):
    return SI.all_sites(t.frag_node, t.frag_edge, 15.0)


@query("w2_cap_sites", with_tables("frag_deg", recursive=True, extra={**ALL_SQL, "per_label": """
    select *, row_number() over (partition by label order by round(least(cable_a_um, cable_b_um), 6) desc, cut_node, seed_b_node, detector) as rn
    from found"""}, body=f"""
  {_ROUNDED} from (select * from per_label where rn <= 2
    order by round(least(cable_a_um, cable_b_um), 6) desc, cut_node, seed_b_node, detector limit 50)"""))
def _(t):
    return rounded_sites(SI.cap_sites(_all_sites(t), max_per_label=2, max_sites=50))


@query("u1_site_stream", with_tables("frag_deg", "split_site", recursive=True, extra=ALL_SQL, body="""
  select 'merge' as kind, label as key, cut_node as node, detector from found
  union all select 'split', label_a, node_a, null from split_site"""))
def _(t):
    return _all_stream(t).select("kind", F.coalesce("label", "label_a").alias("key"), F.coalesce("cut_node", "node_a").alias("node"), "detector")


@query("a34_site_counts", with_tables("frag_deg", "split_site", recursive=True, extra=ALL_SQL, body="""
  select 'merge' as kind, detector, count(*) as n from found group by detector
  union all select 'split', '', count(*) from split_site"""))
def _(t):
    return SI.site_counts(_all_stream(t))


@query("g5_suppress_necks", with_tables("kink_edge", recursive=True, extra=_KINK, body="select cut_node as node_id from bridge_site"))
def _(t):
    # all necks found with no separation, then suppressed on their own
    s = SI.merge_sites_bridge(t.kink_node, t.kink_edge.select("src", "dst"), separation=1e-6)
    points = s.select(F.col("cut_node").alias("node_id"), F.round("angle_deg", 6).alias("a"),
                      F.col("cut_x").alias("x"), F.col("cut_y").alias("y"), F.col("cut_z").alias("z"))
    return GR.suppress(points, [F.col("a")], 20.0).select("node_id")


# best first: an edge is taken when no earlier taken edge uses one of its ends
_BEST_FIRST = """
  select cast(0 as bigint) as i, cast([] as varchar[]) as used, cast([] as bigint[]) as kept
  union all
  select g.i + 1, case when list_contains(used, o.label_a) or list_contains(used, o.label_b) then used else list_concat(used, [o.label_a, o.label_b]) end,
    case when list_contains(used, o.label_a) or list_contains(used, o.label_b) then kept else list_append(kept, o.i) end
  from taken g join ordered o on o.i = g.i + 1"""
_TAKEN = "i in (select unnest(kept) from (select kept from taken order by i desc limit 1) q)"


@query("g6_greedy_matching", with_tables("split_site", recursive=True, extra={
    "ordered": "select *, row_number() over (order by d2, node_a || '-' || node_b) as i from split_site", "taken": _BEST_FIRST}, body=f"""
  select label_a, label_b, node_a, node_b, d2 from ordered where {_TAKEN}"""))
def _(t):
    s = SI.split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None).withColumn("edge_id", F.concat_ws("-", "node_a", "node_b"))
    return GR.greedy_matching(s, [F.col("d2")], "label_a", "label_b").select("label_a", "label_b", "node_a", "node_b", "d2")


@query("w7_pick_spread", with_tables("gt_le", recursive=True, extra={
    "mid": """select row_number() over (order by e.src) as ord, e.src as node_id, (a.x + b.x) / 2.0::double as x, (a.y + b.y) / 2.0::double as y, (a.z + b.z) / 2.0::double as z
      from gt_le e join gt_node a on a.node_id = e.src join gt_node b on b.node_id = e.dst
      where e.label_src <> e.label_dst and e.label_src <> '0' and e.label_dst <> '0'""",
    "conflict": """select a.ord as better, b.ord as worse from mid a join mid b on a.ord < b.ord and abs(a.x - b.x) < 60 and
      (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < 3600""",
    "pass": """
      select cast(0 as bigint) as i, cast([] as bigint[]) as kept
      union all
      select i + 1, case when exists (select 1 from conflict c where c.worse = i + 1 and list_contains(kept, c.better)) then kept
        else list_append(kept, i + 1) end from pass where i < (select count(*) from mid) and len(kept) < 20"""}, body="""
  select node_id, x, y, z from mid where ord in (select unnest(kept) from (select kept from pass order by i desc limit 1) q)"""))
def _(t):
    split = t.gt_labelled_edge.filter(
        (F.col("label_src") != F.col("label_dst")) & (F.col("label_src") != "0") & (F.col("label_dst") != "0"))
    mids = G.edge_midpoints(split.select("src", "dst"), t.gt_node).select(
        F.col("src").alias("node_id"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("mid_z").alias("z"))
    return GR.pick_spread(mids, [F.col("node_id")], 20, 60.0).select("node_id", "x", "y", "z")


def _proposals(t):
    p = SI.proposals(SI.tip_pairs(t.frag_node, t.frag_edge, 15.0), k=3)
    return p.select(F.concat_ws("-", "node_a", "node_b").alias("edge_id"), F.col("label_a").alias("a"),
                    F.col("label_b").alias("b"), (F.lit(1.0) - F.col("d2") / 450.0).alias("score"))


# one pass in order of level and score; place i of cls holds the component of the i-th label, named by its smallest place
@query("g10_progressive_accept", with_tables("tip_pair", recursive=True, extra={
    "prop": """select node_a || '-' || node_b as edge_id, label_a as a, label_b as b, 1 - d2 / 450.0::double as score
      from (select *, row_number() over (partition by node_a order by d2, node_b) as rank from (
        select *, row_number() over (partition by node_a, label_b order by d2, node_b) as rn from tip_pair) where rn = 1) where rank <= 3""",
    "levelled": """select *, cast(greatest(0, ceil(round((0.95::double - score) / 0.05::double, 9))) as integer) as level
      from prop where score >= 0.75 and a <> b""",
    "ordered": "select *, row_number() over (order by level, score desc, edge_id) as i from levelled",
    "lab": "select label, row_number() over (order by label) as k from (select a as label from ordered union select b from ordered) q",
    "step": "select o.i, x.k as ka, y.k as kb from ordered o join lab x on x.label = o.a join lab y on y.label = o.b",
    "fold": """select cast(0 as bigint) as i, (select list(k order by k) from lab) as cls, cast([] as bigint[]) as kept
      union all
      select s.i, list_transform(cls, lambda c: case when c = greatest(cls[ka], cls[kb]) then least(cls[ka], cls[kb]) else c end),
        case when cls[ka] = cls[kb] then kept else list_append(kept, s.i) end
      from fold f join step s on s.i = f.i + 1"""}, body="""
  select edge_id, a, b, round(score, 6) as score, level from ordered
  where i in (select unnest(kept) from (select kept from fold order by i desc limit 1) q)"""))
def _(t):
    """Proposals accepted as the threshold falls, unless they close a cycle."""
    return GR.progressive_accept(_proposals(t)).select("edge_id", "a", "b", F.round("score", 6).alias("score"), "level")


@query("g11_cycle_edges", with_tables("tip_pair", recursive=True, extra={
    "prop": """select label_a, label_b from (select *, row_number() over (partition by node_a order by d2, node_b) as rank from (
      select *, row_number() over (partition by node_a, label_b order by d2, node_b) as rn from tip_pair) where rn = 1) where rank <= 3""",
    "link": "select label_a as u, label_b as v from prop union select label_b, label_a from prop",
    "grow": """select u as node, u as root from link union select l.v, g.root from grow g join link l on l.u = g.node where g.root < l.v""",
    "lab": "select node, min(root) as root from grow group by node"}, body="""
  select (select count(*) from prop) as n_proposals,
    (select count(*) from prop) - ((select count(*) from lab) - (select count(distinct root) from lab)) as n_cycle_edges"""))
def _(t):
    marked = GR.cycle_edges(_proposals(t), [-F.col("score")])
    return marked.agg(F.count(F.lit(1)).alias("n_proposals"), F.count_if("forms_cycle").alias("n_cycle_edges"))


@query("g13_contested_matching", with_tables("tip_pair", recursive=True, extra={
    "prop": """select * from (select *, row_number() over (partition by node_a order by d2, node_b) as rank from (
      select *, row_number() over (partition by node_a, label_b order by d2, node_b) as rn from tip_pair) where rn = 1) where rank <= 3""",
    "ordered": "select *, row_number() over (order by d2, node_a || '-' || node_b) as i from prop", "taken": _BEST_FIRST}, body=f"""
  select node_a || '-' || node_b as edge_id, label_a as a, label_b as b, round(1 - d2 / 450.0::double, 6) as score from ordered where {_TAKEN}"""))
def _(t):
    """Locally dominant matching: at least half of the best total weight."""
    return GR.greedy_matching(_proposals(t), [-F.col("score")]).select("edge_id", "a", "b", F.round("score", 6).alias("score"))


_SHARP = """
  select distinct least(s.u, s.v) as lo, greatest(s.u, s.v) as hi from frag_sym s join frag_deg d on d.node_id = s.u and d.degree >= 3
    join frag_sym o on o.u = s.u and o.v < s.v join frag_node h on h.node_id = s.u join frag_node a on a.node_id = s.v join frag_node b on b.node_id = o.v
  where s.length > 0 and o.length > 0 and
    ((a.x-h.x)*(b.x-h.x) + (a.y-h.y)*(b.y-h.y) + (a.z-h.z)*(b.z-h.z)) / (s.length * o.length) > cos(radians(30))"""


@query("g12_sever_sharp_branches", with_tables("frag_deg", extra={"sharp": _SHARP, "kept": """
    select e.src, e.dst from frag_edge e where not exists (select 1 from sharp where lo = least(e.src, e.dst) and hi = greatest(e.src, e.dst))"""}, body="""
  select n.node_id, count(k.src) as degree from frag_node n left join kept k on k.src = n.node_id or k.dst = n.node_id group by n.node_id"""))
def _(t):
    e = t.frag_edge.select("src", "dst")
    kept = SI.sever(e, SI.sharp_edges(t.frag_node, e, 30.0))
    return G.degrees(t.frag_node, kept).select("node_id", "degree")


@query("g12_sever_thin_necks", with_tables("frag_deg", extra={"thin": """
    select d.node_id from frag_deg d join frag_sym s on s.u = d.node_id join frag_node n on n.node_id = s.v where d.degree = 2
    group by d.node_id, d.radius having d.radius < 0.5 * avg(n.radius)"""}, body="""
  select src, dst from frag_edge where src not in (select node_id from thin) and dst not in (select node_id from thin)"""))
def _(t):
    e = t.frag_edge.select("src", "dst")
    return SI.sever(e, SI.thin_necks(t.frag_node, e, 0.5))
