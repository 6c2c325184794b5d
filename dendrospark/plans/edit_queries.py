"""Label edits: kinds, suffixes, classes, partitions and their application."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dendrospark.operators import edits as E
from dendrospark.operators import graph as G
from dendrospark.operators.ordering import global_rank
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables
from dendrospark.plans.metric_queries import MERGED_NODES, SIDE_SQL, merge_edits, split_edits

# a mixed edit list made from the split sites: pairs without a kind, typed pairs, flags
_MIXED = """
  select 'c' || node_a % 3 as candidate_id, node_a as edit_seq, case node_a % 4 when 0 then null when 1 then 'merge_labels'
    when 2 then 'flag_review' else 'reject_candidate' end as kind, label_a, label_b from split_site"""


def mixed_edits(t):
    from dendrospark.operators.sites import split_sites

    s = split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None)
    kind = (F.when(F.col("node_a") % 4 == 1, E.MERGE).when(F.col("node_a") % 4 == 2, E.FLAG).when(F.col("node_a") % 4 == 3, E.REJECT))
    return s.select(F.concat(F.lit("c"), (F.col("node_a") % 3).cast("string")).alias("candidate_id"), F.col("node_a").alias("edit_seq"),
                    kind.alias("kind"), "label_a", "label_b", F.lit(None).cast("string").alias("label"),
                    F.lit(None).cast(E.SEED_TYPE).alias("seeds"))


@query("e1_normalize_edits", with_tables("split_site", extra={"mixed": _MIXED}, body="""
  select candidate_id, edit_seq, coalesce(kind, 'merge_labels') as kind, label_a, label_b from mixed"""))
def _(t):
    return E.normalize_edits(mixed_edits(t)).select("candidate_id", "edit_seq", "kind", "label_a", "label_b")


@query("e9_inert_edits", with_tables("split_site", extra={"mixed": _MIXED}, body="""
  select candidate_id, count(*) as n_edits, count(*) filter (coalesce(kind, 'merge_labels') = 'merge_labels') as n_effective
  from mixed group by candidate_id"""))
def _(t):
    e = E.normalize_edits(mixed_edits(t))
    return e.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_edits"),
                                         F.count_if(F.col("kind").isin(E.MERGE, E.SPLIT)).alias("n_effective"))


# no suffix wanted, so they go a..z, aa, ab, ...
@query("e2_assign_suffixes", with_tables("frag_node", body="""
  select neuron as label, rn - 1 as seed_idx, case when rn <= 26 then '' else chr(cast(96 + (rn - 1) // 26 as integer)) end || chr(cast(97 + (rn - 1) % 26 as integer)) as suffix
  from (select neuron, row_number() over (partition by neuron order by ord) as rn from frag_node) q"""))
def _(t):
    n = t.frag_node.withColumn("rn", F.row_number().over(Window.partitionBy("neuron").orderBy("ord")))
    seed = F.struct(F.lit(None).cast("string").alias("suffix"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("node_id").alias("node"))
    edits = n.select(F.lit("c").alias("candidate_id"), F.col("ord").alias("edit_seq"), F.lit(E.SPLIT).alias("kind"),
                     F.col("neuron").alias("label"), F.array(seed).cast(E.SEED_TYPE).alias("seeds"))
    return E.split_seeds(edits).select("label", "seed_idx", "suffix")


# every edit of every node wants a and b: the first gets them, later ones the next free names in order
@query("e2_suffix_collisions", with_tables("frag_node", body="""
  select neuron as label, i as seed_idx, case when i < 26 then chr(cast(97 + i as integer))
    when i < 702 then chr(cast(96 + i // 26 as integer)) || chr(cast(97 + i % 26 as integer))
    else chr(cast(97 + (i - 702) // 676 as integer)) || chr(cast(97 + (i - 702) // 26 % 26 as integer)) || chr(cast(97 + (i - 702) % 26 as integer)) end as suffix
  from (select neuron, unnest(range(2 * count(*))) as i from frag_node group by neuron) q"""))
def _(t):
    """Every node of every label as an edit that wants a and b, past z too."""
    def seed(suffix):
        return F.struct(F.lit(suffix).alias("suffix"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("node_id").alias("node"))

    edits = t.frag_node.select(F.lit("c").alias("candidate_id"), F.col("ord").alias("edit_seq"), F.lit(E.SPLIT).alias("kind"),
                               F.col("neuron").alias("label"), F.array(seed("a"), seed("b")).cast(E.SEED_TYPE).alias("seeds"))
    return E.split_seeds(edits).select("label", "seed_idx", "suffix")


_CLS = {k: MERGED_NODES[k] for k in ("cand", "near", "grow0", "cls")}


@query("e3_merge_classes", with_tables("gt_node", recursive=True, extra=_CLS, body="select candidate_id, label, class from cls"))
def _(t):
    return E.merge_classes(merge_edits(t))


# one pass over the edits in order; place i of cls holds the class of the i-th label, named by its smallest place
@query("e4_capped_classes", with_tables("split_site", recursive=True, extra={
    "ordered": """select label_a, label_b, row_number() over (
        order by lpad(cast(d2 as varchar), 6, '0') || '-' || node_a || '-' || node_b) as i
      from split_site where label_a <> '0' and label_b <> '0'""",
    "lab": "select label, row_number() over (order by label) as k from (select label_a as label from ordered union select label_b from ordered) q",
    "step": """select o.i, a.k as ka, b.k as kb from ordered o join lab a on a.label = o.label_a join lab b on b.label = o.label_b""",
    "fold": """select cast(0 as bigint) as i, (select list(k order by k) from lab) as cls
      union all
      select s.i, case when cls[ka] <> cls[kb] and len(list_filter(cls, lambda c: c = cls[ka] or c = cls[kb])) <= 3
        then list_transform(cls, lambda c: case when c = greatest(cls[ka], cls[kb]) then least(cls[ka], cls[kb]) else c end) else cls end
      from fold f join step s on s.i = f.i + 1""",
    "last": "select cls from fold order by i desc limit 1"}, body="""
  select 'c' as candidate_id, l.label, m.label as class from lab l join lab m on m.k = (select cls from last)[l.k]"""))
def _(t):
    """Classes of at most three labels; edits that would exceed them are refused in order."""
    from dendrospark.operators.sites import split_sites

    s = split_sites(t.frag_node, t.frag_edge, 15.0, max_sites=None)
    e = s.select(F.lit("c").alias("candidate_id"), F.concat_ws("-", F.lpad(F.col("d2").cast("string"), 6, "0"), "node_a", "node_b").alias("edit_seq"),
                 F.lit(E.MERGE).alias("kind"), "label_a", "label_b")
    return E.merge_classes(e.withColumn("edit_seq", F.col("edit_seq").cast("string")).join(
        _sequence(e), "edit_seq").drop("edit_seq").withColumnRenamed("seq", "edit_seq"), max_class_size=3)


def _sequence(e):
    return global_rank(e.select("edit_seq"), [F.col("edit_seq")], "seq")


@query("e7_class_members", with_tables("gt_node", recursive=True, extra=_CLS, body="""
  select candidate_id, class, label, count(*) over (partition by candidate_id, class) as n_members from cls"""))
def _(t):
    return E.class_members(E.merge_classes(merge_edits(t))).select("candidate_id", "class", "label", "n_members")


@query("e6_apply_merge_edits", with_tables("gt_node", recursive=True, extra={k: v for k, v in MERGED_NODES.items() if k not in ("len2", "inc2")}, body="""
  select n.candidate_id, n.node_id, g.raw_label as old_label, n.raw_label as new_label from node2 n join gt_node g using (node_id)
  where n.raw_label <> g.raw_label"""))
def _(t):
    return E.apply_edits(t.gt_node, t.frag_node, t.frag_edge, merge_edits(t)).select("candidate_id", "node_id", "old_label", "new_label")


@query("e6_apply_split_edits", with_tables("frag_sym", recursive=True, extra=SIDE_SQL, body="""
  select 'split' as candidate_id, node_id, label as old_label, label || case i when 1 then '#a' else '#b' end as new_label from side_g"""))
def _(t):
    return E.apply_edits(t.gt_node, t.frag_node, t.frag_edge, split_edits(t)).select("candidate_id", "node_id", "old_label", "new_label")


def _partition(t):
    seeds = E.split_seeds(split_edits(t))
    return E.partition_by_path(E.split_nodes(t.frag_node.select("node_id", "label", "x", "y", "z"), seeds), t.frag_edge, seeds), seeds


@query("g4_partition_by_path", with_tables("frag_sym", recursive=True, extra=SIDE_SQL, body="""
  select node_id, label, case i when 1 then 'a' else 'b' end as suffix from side_f"""))
def _(t):
    return _partition(t)[0].select("node_id", "label", "suffix")


# distance along the fragment from the first node of every component, by walking the tree
@query("g4_path_distance", with_tables("frag_sym", recursive=True, extra={
    **SIDE_SQL, "walk": """select node_id, cast(-1 as bigint) as prev, 0.0::double as dist from seed union all
      select e.v, w.node_id, w.dist + e.length from walk w join frag_sym e on e.u = w.node_id where e.v <> w.prev"""}, body="""
  select node_id, round(dist, 5) as dist from walk"""))
def _(t):
    part, _ = _partition(t)
    return part.filter(F.col("dist").isNotNull()).select("node_id", F.round("dist", 5).alias("dist"))


@query("j7_assign_seed_euclid", with_tables("frag_sym", recursive=True, extra=SIDE_SQL, body="""
  select g.node_id, (select case min_by(sd.i, ((sd.x-g.x)*(sd.x-g.x) + (sd.y-g.y)*(sd.y-g.y) + (sd.z-g.z)*(sd.z-g.z)) * 10 + sd.i)
    when 1 then 'a' else 'b' end from seed sd where sd.label = g.raw_label) as suffix from gt_node g join shared s on s.label = g.raw_label"""))
def _(t):
    seeds = E.split_seeds(split_edits(t))
    points = E.split_nodes(t.gt_node.select("node_id", F.col("raw_label").alias("label"), "x", "y", "z"), seeds)
    return E.assign_seed_euclid(points, seeds).select("node_id", "suffix")


@query("j8_assign_side", with_tables("frag_sym", recursive=True, extra=SIDE_SQL, body="""
  select node_id, label, case i when 1 then 'a' else 'b' end as suffix from side_g"""))
def _(t):
    part, seeds = _partition(t)
    points = E.split_nodes(t.gt_node.select("node_id", F.col("raw_label").alias("label"), "x", "y", "z"), seeds)
    return E.assign_side(points, part).select("node_id", "label", "suffix")


@query("e5_split_fragments", with_tables("frag_sym", recursive=True, extra={
    **SIDE_SQL, "cut_sym": """select e.u, e.v from frag_sym e join side_f a on a.node_id = e.u join side_f b on b.node_id = e.v where a.i = b.i""",
    "pc": "select node_id, node_id as root from side_f union select e.v, p.root from pc p join cut_sym e on e.u = p.node_id where p.root < e.v",
    "piece": "select node_id, min(root) as piece from pc group by node_id"}, body="""
  select p.node_id, f.label || case f.i when 1 then '#a' else '#b' end as pseudo, piece,
    row_number() over (partition by piece order by p.node_id) - 1 as new_id, count(*) over (partition by piece) as n_nodes
  from piece p join side_f f on f.node_id = p.node_id"""))
def _(t):
    part, _ = _partition(t)
    return E.split_fragments(part, t.frag_edge).select("node_id", "pseudo", "piece", "new_id", "n_nodes")


@query("e8_fill_background_runs", with_tables("gt_le", recursive=True, extra={
    "sym": "select src as u, dst as v, label_src as lu, label_dst as lv from gt_le union all select dst, src, label_dst, label_src from gt_le",
    "zc": """select node_id, node_id as root from gt_node where raw_label = '0'
      union select e.v, z.root from zc z join sym e on e.u = z.node_id and e.lv = '0' where z.root < e.v""",
    "zt": "select node_id, min(root) as component from zc group by node_id",
    "fill": """select component, min(e.lv) as l from zt join sym e on e.u = zt.node_id and e.lv <> '0' group by component having min(e.lv) = max(e.lv)"""}, body="""
  select g.node_id, coalesce(f.l, g.raw_label) as filled_label from gt_node g left join zt using (node_id) left join fill f using (component)"""))
def _(t):
    return E.fill_background_runs(t.gt_node, t.gt_edge, "raw_label").select("node_id", "filled_label")


@query("u7_report_labels", with_tables("split_site", extra={"mixed": _MIXED}, body="""
  select label_a as label from mixed union select label_b from mixed union
  select raw_label from gt_node where raw_label <> '0' group by raw_label having count(distinct neuron) >= 2"""))
def _(t):
    targets = G.labelled(t.gt_node, "raw_label").groupBy(F.col("raw_label").alias("label")).agg(
        F.countDistinct("neuron").alias("n")).filter(F.col("n") >= 2)
    return E.label_report_set(targets, mixed_edits(t))


@query("a26_edit_histogram", with_tables("split_site", extra={"mixed": _MIXED}, body="""
  select candidate_id, coalesce(kind, 'merge_labels') as kind, count(*) as n from mixed group by all"""))
def _(t):
    return E.edit_histogram(E.normalize_edits(mixed_edits(t)))


@query("a26_rendered_edits", with_tables("split_site", extra={"mixed": _MIXED, "r": """
    select *, row_number() over (partition by candidate_id order by edit_seq, label_b) as rn from mixed"""}, body="""
  select candidate_id, string_agg(case when coalesce(kind, 'merge_labels') = 'merge_labels' then 'merge(' || label_a || ', ' || label_b || ')' else kind end,
    ', ' order by rn) filter (rn <= 5) as edits, count(*) as n_edits from r group by candidate_id"""))
def _(t):
    return E.render_edits(E.normalize_edits(mixed_edits(t)), 5, ["edit_seq", "label_b"])
