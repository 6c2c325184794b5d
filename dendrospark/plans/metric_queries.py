"""Edge classes, error counts, weighted means and full scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import edits as E
from dendrospark.operators import graph as G
from dendrospark.operators import metrics as M
from dendrospark.operators import spatial as SP
from dendrospark.plans import scoring as SC
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables
from dendrospark.plans.graph_queries import COMP_SQL
from dendrospark.plans.spatial_queries import OFFSET, PRED, PRED_EDGE_SQL, SHAPE
from dendrospark.session import cut, merged

MIN_NODES = 10  # the largest label of the fixture has 20 nodes per neuron


def class_sql(rule: str) -> str:
    zero = "label_src = '0' {} label_dst = '0'".format("or" if rule == "either" else "and")
    return f"case when {zero} then 'omit' when label_src <> label_dst then 'split' else 'correct' end"


_INC = "select raw_label as label, neuron, count(*) as n_nodes from gt_node where raw_label <> '0' group by all"
_MERGED = f"""select label from inc where n_nodes > {MIN_NODES} group by label having count(*) >= 2"""


def _incidence(t):
    return M.label_neuron_counts(t.gt_node, "raw_label")


for _rule in ("either", "both"):
    @query(f"a1_edge_class_{_rule}", with_tables("gt_le", body=f"select src, dst, {class_sql(_rule)} as edge_class from gt_le"))
    def _(t, rule=_rule):
        return M.classify_edges(t.gt_labelled_edge, rule).select("src", "dst", "edge_class")

_CLASS_COUNTS = """count(*) as n_edges, count(*) filter (c = 'correct') as correct, count(*) filter (c = 'split') as split,
  count(*) filter (c = 'omit') as omit, round(100.0 * count(*) filter (c = 'correct') / count(*), 6) as pct_correct,
  round(100.0 * count(*) filter (c = 'split') / count(*), 6) as pct_split, round(100.0 * count(*) filter (c = 'omit') / count(*), 6) as pct_omit"""


@query("a2_edge_class_counts", with_tables("gt_le", extra={"cls": f"select neuron, {class_sql('either')} as c from gt_le"}, body=f"""
  select cast(neuron as varchar) as neuron, {_CLASS_COUNTS} from cls group by neuron union all select 'ALL', {_CLASS_COUNTS} from cls"""))
def _(t):
    c = M.edge_class_counts(M.classify_edges(t.gt_labelled_edge), ["neuron"], total_row="ALL")
    return c.withColumns({p: F.round(p, 6) for p in ("pct_correct", "pct_split", "pct_omit")})


@query("a3_split_counts", with_tables("gt_node", body="""
  select neuron, greatest(count(distinct raw_label) filter (raw_label <> '0') - 1, 0) as n_splits from gt_node group by neuron"""))
def _(t):
    return M.split_counts(_incidence(t), t.gt_node.select("neuron").distinct())


@query("a4_merge_segments", with_tables("gt_node", extra={"inc": _INC}, body="""
  select label, neuron, n - 1 as n_merges from (select label, neuron, count(*) over (partition by label) as n from inc) q where n >= 2"""))
def _(t):
    return M.merge_segments(_incidence(t)).select("label", "neuron", "n_merges")


@query("a5_merged_edges", with_tables("gt_le", extra={"inc": _INC, "merged": _MERGED}, body="""
  select neuron, label_src as label, count(*) as n from gt_le where label_src = label_dst and label_src in (select label from merged)
  group by all"""))
def _(t):
    e = M.merged_edges(t.gt_labelled_edge, M.merge_labels(_incidence(t), MIN_NODES))
    return e.groupBy("neuron", F.col("label_src").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("a6_merge_targets", with_tables("gt_node", extra={"inc": """
    select raw_label as label, neuron, count(*) as n_nodes, avg(x) as cx, avg(y) as cy, avg(z) as cz from gt_node
    where raw_label <> '0' group by all"""}, body=f"""
  select label, count(*) as n_neurons, sum(n_nodes)::bigint as n_nodes,
    string_agg(neuron || ':' || n_nodes || printf('@%.2f/%.2f/%.2f', round(cx, 2), round(cy, 2), round(cz, 2)), ',' order by place) as sites
  from (select *, row_number() over (partition by label order by n_nodes desc, neuron) as place from inc where n_nodes > {MIN_NODES}) q
  group by label having count(*) >= 2"""))
def _(t):
    m = M.merge_targets(t.gt_node, "raw_label", MIN_NODES)
    return m.select("label", "n_neurons", "n_nodes", F.array_join(F.transform("sites", lambda s: F.format_string(
        "%d:%d@%.2f/%.2f/%.2f", s["neuron"], s["n_nodes"], s["x"], s["y"], s["z"])), ",").alias("sites"))


@query("a6_target_neurons", with_tables("gt_node", extra={"inc": """
    select raw_label as label, neuron, count(*) as n_nodes, avg(x) as cx, avg(y) as cy, avg(z) as cz from gt_node
    where raw_label <> '0' group by all"""}, body=f"""
  select label, neuron, n_nodes, place, round(cx, 2) as cx, round(cy, 2) as cy, round(cz, 2) as cz from (
    select *, row_number() over (partition by label order by n_nodes desc, neuron) as place, count(*) over (partition by label) as k
    from inc where n_nodes > {MIN_NODES}) q where k >= 2"""))
def _(t):
    return M.target_neurons(t.gt_node, "raw_label", MIN_NODES)


_EDGE_ACC = f"""
  select e.neuron, count(*) as n_edges, 100.0 * count(*) filter (c = 'split') / count(*) as pct_split,
    100.0 * count(*) filter (c = 'omit') / count(*) as pct_omit, 100.0 * count(*) filter (m) / count(*) as pct_merged
  from (select neuron, {class_sql('either')} as c, label_src = label_dst and label_src in (select label from merged) as m from gt_le) e group by e.neuron"""


def _accuracy(t):
    e = M.classify_edges(t.gt_labelled_edge)
    merged = M.merged_edges(e, M.merge_labels(_incidence(t), MIN_NODES)).groupBy("neuron").agg(F.count(F.lit(1)).alias("_m"))
    c = M.edge_class_counts(e, ["neuron"]).join(merged, "neuron", "left")
    c = c.withColumn("pct_merged", F.lit(100.0) * F.coalesce("_m", F.lit(0)) / F.col("n_edges"))
    return c.withColumn("edge_accuracy", M.edge_accuracy())


@query("a7_edge_accuracy", with_tables("gt_le", extra={"inc": _INC, "merged": _MERGED, "acc": _EDGE_ACC}, body="""
  select neuron, n_edges, round(100.0 - (pct_split + pct_omit + pct_merged), 6) as edge_accuracy from acc"""))
def _(t):
    return _accuracy(t).select("neuron", "n_edges", F.round("edge_accuracy", 6).alias("edge_accuracy"))


@query("a8_split_accuracy", with_tables("gt_le", extra={"inc": _INC, "merged": _MERGED, "acc": _EDGE_ACC}, body="""
  select neuron, round(100.0 - pct_split, 6) as split_accuracy from acc"""))
def _(t):
    return M.with_derived(M.with_derived(_accuracy(t))).select("neuron", F.round("split_accuracy", 6).alias("split_accuracy"))


@query("a9_run_length", with_tables("gt_len", body="""
  select neuron, round(sum(length), 5) as run_length, count(*) as n_edges from gt_len group by neuron"""))
def _(t):
    r = G.run_length(G.edge_length(t.gt_edge, t.gt_node), ["neuron"])
    return r.select("neuron", F.round("run_length", 5).alias("run_length"), "n_edges")


# error-free runs: connected stretches of correct edges
RUN_SQL = {
    "ok": "select * from gt_len where label_src = label_dst and label_src <> '0'",
    "ok_sym": "select src as u, dst as v from ok union all select dst, src from ok",
    "grow": """select src as node, src as root from ok union select dst, dst from ok
      union select l.v, g.root from grow g join ok_sym l on l.u = g.node where g.root < l.v""",
    "run": "select node, min(root) as run from grow group by node",
    "inc": _INC, "merged": _MERGED,
    "run_um": """select o.neuron, r.run, o.label_src as label, sum(o.length) as um from ok o join run r on r.node = o.src group by all""",
    "sq": "select neuron, sum(um * um) as sq from run_um where label not in (select label from merged) group by neuron",
    "tot": "select neuron, sum(length) as run_length from gt_len group by neuron",
}


@query("a10_erl", with_tables("gt_len", recursive=True, extra=RUN_SQL, body="""
  select neuron, round(coalesce(sq, 0) / run_length, 5) as erl, round(coalesce(sq, 0) / run_length / run_length, 6) as normalized_erl
  from tot left join sq using (neuron)"""))
def _(t):
    e = G.edge_length(t.gt_labelled_edge, t.gt_node)
    r = M.erl(e, t.gt_node, M.merge_labels(_incidence(t), MIN_NODES))
    return r.select("neuron", F.round("erl", 5).alias("erl"), F.round("normalized_erl", 6).alias("normalized_erl"))


def brain(t):
    """Prepared state of the derived graph, built once per session and folder."""
    if not hasattr(t, "_brain"):
        t._brain = SC.prepare(t.gt_node, t.gt_edge, t.frag_node, t.frag_edge, min_nodes=MIN_NODES)
    return t._brain


def incidence(t):
    """Label-neuron counts alone, for queries that need no other part of the prepared state."""
    if hasattr(t, "_brain"):
        return t._brain.incidence
    if not hasattr(t, "_incidence"):
        t._incidence = cut(_incidence(t))
    return t._incidence


_PER_NEURON = {**RUN_SQL, "acc": _EDGE_ACC, "lab": """
    select neuron, greatest(count(*) - 1, 0) as n_splits, count(*) filter (k >= 2) as n_merges
    from (select *, count(*) over (partition by label) as k from inc) q group by neuron""",
    "pn": """select neuron, run_length, coalesce(n_splits, 0) as n_splits, coalesce(n_merges, 0) as n_merges, pct_split, pct_omit, pct_merged,
      coalesce(sq, 0) / run_length as erl, coalesce(sq, 0) / run_length / run_length as normalized_erl,
      100.0 - (pct_split + pct_omit + pct_merged) as edge_accuracy, 100.0 - pct_split as split_accuracy,
      run_length / nullif(n_splits, 0) as split_rate, run_length / nullif(n_merges, 0) as merge_rate
      from tot join acc using (neuron) left join lab using (neuron) left join sq using (neuron)"""}
_PN_TABLES = ("gt_len", "gt_le")
_ROUND_PN = "neuron, n_splits, n_merges, " + ", ".join(f"round({c}, 5) as {c}" for c in SC.PER_NEURON if c not in ("neuron", "n_splits", "n_merges"))


def round_per_neuron(df, *keys):
    return df.select(*keys, "neuron", "n_splits", "n_merges",
                     *[F.round(c, 5).alias(c) for c in SC.PER_NEURON if c not in ("neuron", "n_splits", "n_merges")])


@query("a11_error_rates", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body="""
  select neuron, round(split_rate, 5) as split_rate, round(merge_rate, 5) as merge_rate from pn"""))
def _(t):
    return M.error_rates(brain(t).baseline).select("neuron", F.round("split_rate", 5).alias("split_rate"), F.round("merge_rate", 5).alias("merge_rate"))


@query("a12_weighted_mean", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body="""
  select round(sum(split_rate * run_length) / sum(case when split_rate is not null then run_length end), 5) as split_rate,
    round(sum(edge_accuracy * run_length) / sum(run_length), 5) as edge_accuracy from pn"""))
def _(t):
    return brain(t).baseline.agg(F.round(M.weighted_mean("split_rate"), 5).alias("split_rate"),
                                 F.round(M.weighted_mean("edge_accuracy"), 5).alias("edge_accuracy"))


def _long(metrics, expr, rel):
    return " union all ".join(f"select '{m}' as metric, round({expr(m)}, 5) as value from {rel}" for m in metrics)


def weighted_sql(m: str) -> str:
    return f"sum({m} * run_length) / sum(case when {m} is not null then run_length end)"


@query("a13_metric_summary", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body=_long(M.TRACKED, weighted_sql, "pn")))
def _(t):
    return M.metric_summary(brain(t).baseline).select("metric", F.round("value", 5).alias("value"))


def report_sql(m: str) -> str:
    return f"sum({m})::double" if m in M.COUNT_METRICS else weighted_sql(m)


@query("a14_report_metrics", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body=_long(
    M.ERROR_METRICS + M.QUALITY_METRICS, report_sql, "pn")))
def _(t):
    return M.report_metrics(brain(t).baseline).select("metric", F.round("value", 5).alias("value"))


_DISPLAY = " ".join(f"when '{k}' then '{v}'" for k, v in M.METRIC_NAMES.items())


@query("a16_score_no_edit", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body=f"select 'none' as candidate_id, {_ROUND_PN} from pn"))
def _(t):
    none = t.spark.createDataFrame([], E.EDIT_SCHEMA)
    return round_per_neuron(SC.score(brain(t), none, ["none"]), "candidate_id")


# two candidates without location: one unites neighbouring runs of a neuron, one unites runs across neurons
_MERGE_EDITS = """
  select distinct 'within' as candidate_id, cast(neuron * 1000 + run as varchar) as a, cast(neuron * 1000 + run + 1 as varchar) as b
  from gt_node where run = 2 and neuron % 5 = 0
  union select distinct 'across', cast(neuron * 1000 as varchar), cast((neuron + 1) * 1000 as varchar) from gt_node where neuron % 7 = 0 and neuron > 0"""
# scored by brute force: rename every node, then the plain definition
MERGED_NODES = {
    "cand": _MERGE_EDITS, "near": "select candidate_id, a as u, b as v from cand union all select candidate_id, b, a from cand",
    "grow0": """select candidate_id, u as label, u as root from near union
      select g.candidate_id, n.v, g.root from grow0 g join near n on n.candidate_id = g.candidate_id and n.u = g.label where g.root < n.v""",
    "cls": "select candidate_id, label, min(root) as class from grow0 group by all",
    "names": "select distinct candidate_id from cand",
    "node2": """select n.candidate_id, g.node_id, g.neuron, coalesce(c.class, g.raw_label) as raw_label from gt_node g join names n on true
      left join cls c on c.candidate_id = n.candidate_id and c.label = g.raw_label""",
    "len2": """select a.candidate_id, e.src, e.dst, e.neuron, e.length, a.raw_label as label_src, b.raw_label as label_dst from gt_len e
      join node2 a on a.node_id = e.src join node2 b on b.node_id = e.dst and b.candidate_id = a.candidate_id""",
    "inc2": "select candidate_id, raw_label as label, neuron, count(*) as n_nodes from node2 where raw_label <> '0' group by all",
}


def scored_sql(nodes: dict[str, str]) -> dict[str, str]:
    """Plain per-candidate scoring on top of ``len2`` and ``inc2``."""
    return {
        **nodes,
        "merged2": f"select candidate_id, label from inc2 where n_nodes > {MIN_NODES} group by all having count(*) >= 2",
        "ok2": "select * from len2 where label_src = label_dst and label_src <> '0'",
        "sym2": "select candidate_id, src as u, dst as v from ok2 union all select candidate_id, dst, src from ok2",
        "grow2": """select candidate_id, src as node, src as root from ok2 union select candidate_id, dst, dst from ok2
          union select g.candidate_id, l.v, g.root from grow2 g join sym2 l on l.candidate_id = g.candidate_id and l.u = g.node where g.root < l.v""",
        "run2": "select candidate_id, node, min(root) as run from grow2 group by all",
        "um2": """select o.candidate_id, o.neuron, r.run, o.label_src as label, sum(o.length) as um from ok2 o
          join run2 r on r.candidate_id = o.candidate_id and r.node = o.src group by all""",
        "sq2": "select candidate_id, neuron, sum(um * um) as sq from um2 u where not exists (select 1 from merged2 m where m.candidate_id = u.candidate_id and m.label = u.label) group by all",
        "acc2": f"""select candidate_id, neuron, count(*) as n, sum(length) as run_length, 100.0 * count(*) filter (c = 'split') / count(*) as pct_split,
          100.0 * count(*) filter (c = 'omit') / count(*) as pct_omit, 100.0 * count(*) filter (m) / count(*) as pct_merged
          from (select e.candidate_id, neuron, length, {class_sql('either')} as c, label_src = label_dst and mm.label is not null as m from len2 e
            left join merged2 mm on mm.candidate_id = e.candidate_id and mm.label = e.label_src) q group by all""",
        "lab2": """select candidate_id, neuron, greatest(count(*) - 1, 0) as n_splits, count(*) filter (k >= 2) as n_merges
          from (select *, count(*) over (partition by candidate_id, label) as k from inc2) q group by all""",
        "pn": """select candidate_id, neuron, run_length, coalesce(n_splits, 0) as n_splits, coalesce(n_merges, 0) as n_merges, pct_split,
          pct_omit, pct_merged, coalesce(sq, 0) / run_length as erl, coalesce(sq, 0) / run_length / run_length as normalized_erl,
          100.0 - (pct_split + pct_omit + pct_merged) as edge_accuracy, 100.0 - pct_split as split_accuracy,
          run_length / nullif(n_splits, 0) as split_rate, run_length / nullif(n_merges, 0) as merge_rate
          from acc2 left join lab2 using (candidate_id, neuron) left join sq2 using (candidate_id, neuron)""",
    }


def merge_edits(t):
    g = t.gt_node
    within = g.filter((F.col("run") == 2) & (F.col("neuron") % 5 == 0)).select(
        F.lit("within").alias("candidate_id"), (F.col("neuron") * 1000 + F.col("run")).cast("string").alias("label_a"),
        (F.col("neuron") * 1000 + F.col("run") + 1).cast("string").alias("label_b"))
    across = g.filter((F.col("neuron") % 7 == 0) & (F.col("neuron") > 0)).select(
        F.lit("across").alias("candidate_id"), (F.col("neuron") * 1000).cast("string").alias("label_a"),
        ((F.col("neuron") + 1) * 1000).cast("string").alias("label_b"))
    e = within.union(across).distinct().withColumn("edit_seq", F.xxhash64("label_a", "label_b"))
    return e.select("candidate_id", "edit_seq", F.lit(E.MERGE).alias("kind"), "label_a", "label_b",
                    F.lit(None).cast("string").alias("label"), F.lit(None).cast(E.SEED_TYPE).alias("seeds"))


@query("a16_score_merge_candidates", with_tables("gt_len", recursive=True, extra=scored_sql(MERGED_NODES), body=f"select candidate_id, {_ROUND_PN} from pn"))
def _(t):
    return round_per_neuron(SC.score(brain(t), merge_edits(t), ["within", "across"]), "candidate_id")


def split_edits(t):
    """Every label on two neurons is split at its first node on each."""
    shared = t.frag_node.filter((F.col("neuron") % 2 == 1) & (F.col("label") == ((F.col("neuron") - 1) * 1000 + 1).cast("string")))
    first = t.frag_node.join(shared.select("label").distinct(), "label", "left_semi").groupBy("label", "neuron").agg(
        F.min(F.struct("ord", "x", "y", "z", "node_id")).alias("p"))
    seed = F.struct(F.lit(None).cast("string").alias("suffix"), *[F.col(f"p.{c}").cast("double").alias(c) for c in "xyz"],
                    F.col("p.node_id").alias("node"))
    return first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("neuron", seed.alias("s")))).alias("q")).select(
        F.lit("split").alias("candidate_id"), F.xxhash64("label").alias("edit_seq"), F.lit(E.SPLIT).alias("kind"),
        F.lit(None).cast("string").alias("label_a"), F.lit(None).cast("string").alias("label_b"), "label",
        F.transform("q", lambda r: r["s"]).cast(E.SEED_TYPE).alias("seeds"))


# a piece of a shared label stays within one neuron, so it holds at most one seed: the side is that seed,
# or the nearest seed by straight line; a true node follows the nearest fragment node of its label
SIDE_SQL = {
    "comp": COMP_SQL, "top": "select node_id, min(root) as component from comp group by node_id",
    "shared": "select label from frag_node group by label having count(distinct neuron) > 1",
    "seed": """select f.label, f.neuron, min_by(f.node_id, f.ord) as node_id, min_by(f.x, f.ord) as x, min_by(f.y, f.ord) as y,
      min_by(f.z, f.ord) as z, row_number() over (partition by f.label order by f.neuron) as i
      from frag_node f join shared using (label) group by f.label, f.neuron""",
    "side_f": """select f.node_id, f.label, f.x, f.y, f.z, t.component, coalesce(
        (select sd.i from seed sd join top ts on ts.node_id = sd.node_id where ts.component = t.component),
        (select min_by(sd.i, ((sd.x-f.x)*(sd.x-f.x) + (sd.y-f.y)*(sd.y-f.y) + (sd.z-f.z)*(sd.z-f.z)) * 10 + sd.i) from seed sd where sd.label = f.label)) as i
      from frag_node f join shared using (label) join top t on t.node_id = f.node_id""",
    "side_g": """select g.node_id, g.raw_label as label, min_by(sf.i, ((sf.x-g.x)*(sf.x-g.x) + (sf.y-g.y)*(sf.y-g.y) + (sf.z-g.z)*(sf.z-g.z)) * 100000000 + sf.node_id) as i
      from gt_node g join side_f sf on sf.label = g.raw_label group by all""",
}
_SPLIT_NODES = {
    **SIDE_SQL,
    "node2": """select 'split' as candidate_id, g.node_id, g.neuron,
      g.raw_label || case s.i when 1 then '#a' when 2 then '#b' else '' end as raw_label
      from gt_node g left join side_g s using (node_id)""",
    "len2": MERGED_NODES["len2"], "inc2": MERGED_NODES["inc2"],
}


@query("a16_score_split_candidate", with_tables("gt_len", "frag_sym", recursive=True, extra=scored_sql(_SPLIT_NODES), body=f"select candidate_id, {_ROUND_PN} from pn"))
def _(t):
    return round_per_neuron(SC.score(brain(t), split_edits(t), ["split"]), "candidate_id")


@query("a17_merge_count", with_tables("frag_sym", recursive=True, extra=MERGED_NODES | {"len2": "select 1", "comp": COMP_SQL,
    "top": "select node_id, min(root) as component from comp group by node_id",
    "piece2": """select m.candidate_id, coalesce(c.class, n.label) as label, count(distinct t.component) as n_pieces from frag_node n join top t using (node_id)
      join names m on true left join cls c on c.candidate_id = m.candidate_id and c.label = n.label group by all"""}, body="""
  select candidate_id, label, n_pieces, n_neurons from (select candidate_id, label, count(*) as n_neurons from inc2 group by all) q
    join piece2 using (candidate_id, label) where n_neurons >= 2"""))
def _(t):
    classes = cut(E.merge_classes(merge_edits(t)))
    names = F.explode(F.array(F.lit("within"), F.lit("across"))).alias("candidate_id")

    def renamed(df, *cols):
        return df.select(names, *cols).join(classes, ["candidate_id", "label"], "left").withColumns(
            {"raw": F.col("label"), "label": F.coalesce("class", "label")})

    named = cut(renamed(incidence(t), "label", "neuron", "n_nodes"))
    inc = cut(named.groupBy("candidate_id", "label", "neuron").agg(F.sum("n_nodes").alias("n_nodes")))
    # an edge stays inside its label, so the pieces of a label are found among its own nodes: only labels that some candidate counts are needed
    spread = inc.groupBy("candidate_id", "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    counted = cut(named.join(merged(spread), ["candidate_id", "label"], "left_semi").select(F.col("raw").alias("label")).distinct())
    comp = G.connected_components(t.frag_node.select("node_id", "label").join(merged(counted), "label", "left_semi"),
                                  t.frag_edge.join(merged(counted), "label", "left_semi").select("src", "dst"), out="piece")
    pieces = renamed(comp.select("label", "piece").distinct(), "label", "piece")
    return SC.merge_count(pieces, inc).select("candidate_id", "label", "n_pieces", "n_neurons")


_CEILING = {"inc0": _INC, "probe": f"select label from inc0 where n_nodes >= {MIN_NODES} group by label having count(*) >= 2",
            "node2": "select 'p' as candidate_id, node_id, neuron, case when raw_label in (select label from probe) then raw_label || '#' || neuron else raw_label end as raw_label from gt_node union all select 'base', node_id, neuron, raw_label from gt_node",
            "len2": MERGED_NODES["len2"], "inc2": MERGED_NODES["inc2"]}


_CEILING |= {"perfect": _long(M.TRACKED, weighted_sql, "pn where candidate_id = 'p'"), "plain": _long(M.TRACKED, weighted_sql, "pn where candidate_id = 'base'")}
_CEILING_SQL = scored_sql({k: v for k, v in _CEILING.items() if k not in ("perfect", "plain")}) | {k: _CEILING[k] for k in ("perfect", "plain")}


@query("a18_split_ceiling", with_tables("gt_len", recursive=True, extra=_CEILING_SQL, body="""
  select metric, b.value as baseline, p.value as perfect, round(p.value - b.value, 3) as delta from perfect p join plain b using (metric)"""))
def _(t):
    return SC.split_ceiling(brain(t), MIN_NODES).select("metric", F.round("baseline", 5).alias("baseline"), F.round("perfect", 5).alias("perfect"), F.round("delta", 3).alias("delta"))


@query("a21_patch_metrics", with_tables("gt_le", extra={
    "box": "select * from gt_node where x >= 20 and x < 220 and y >= 800 and y < 3200 and z >= 0 and z < 4",
    "pe": f"select e.*, {class_sql('both')} as c from gt_le e join box a on e.src = a.node_id join box b on e.dst = b.node_id",
    "m": """select raw_label as label from (select raw_label, neuron, count(*) as n from box where raw_label <> '0' group by all) q
      where n > 10 group by raw_label having count(*) >= 2"""}, body="""
  select count(*) as n_edges, count(*) filter (c = 'correct') as correct, count(*) filter (c = 'split') as split, count(*) filter (c = 'omit') as omit,
    count(*) filter (label_src = label_dst and label_src in (select label from m)) as merged, (select count(*) from m) as n_merges,
    (select count(*) from box) as n_nodes, round(100.0 - 100.0 * (count(*) filter (c = 'split') + count(*) filter (c = 'omit') +
      count(*) filter (label_src = label_dst and label_src in (select label from m))) / count(*), 6) as edge_accuracy from pe"""))
def _(t):
    p = M.patch_metrics(t.gt_node, t.gt_edge, OFFSET, SHAPE, "raw_label", min_nodes=10)
    return p.select("n_edges", "correct", "split", "omit", "merged", "n_merges", "n_nodes", F.round("edge_accuracy", 6).alias("edge_accuracy"))


@query("a23_edge_agreement", with_tables("gt_le", "gt_edge", "frag_node", extra={**PRED, "pe": PRED_EDGE_SQL,
    "ca": f"select src, dst, {class_sql('either')} as class_a from gt_le", "cb": f"select src, dst, {class_sql('either')} as class_b from pe",
    "cell": "select class_a, class_b, count(*) as n from ca join cb using (src, dst) group by all", "tot": "select sum(n)::double as t from cell",
    "k": """select (select sum(n) from cell where class_a = class_b) / t as po,
      (select sum((ra / t) * (rb / t)) from (select class_a as c, sum(n) as ra from cell group by 1) x join (select class_b as c, sum(n) as rb from cell group by 1) y using (c)) as pe
      from tot"""}, body="""
  select class_a, class_b, n, round(po, 9) as observed, round((po - pe) / nullif(1 - pe, 0), 9) as kappa from cell, k"""))
def _(t):
    gt = SP.nearest_label(t.gt_node, t.frag_node, 5.0)
    b = M.classify_edges(M.edge_labels(t.gt_edge, gt, "pred_label"))
    a = M.edge_agreement(M.classify_edges(t.gt_labelled_edge), b)
    return a.select("class_a", "class_b", "n", F.round("observed", 9).alias("observed"), F.round("kappa", 9).alias("kappa"))


@query("j9_label_neuron_counts", with_tables("gt_node", extra={"inc": _INC}, body="select label, neuron, n_nodes from inc"))
def _(t):
    return _incidence(t)


@query("j10_attribute_merges", with_tables("gt_node", recursive=True, extra={k: v for k, v in MERGED_NODES.items() if k != "len2"} | {
    "size": "select candidate_id, class as label, count(*) as n_fused from cls group by all",
    "spread": "select candidate_id, label from inc2 group by all having count(*) >= 2"}, body="""
  select i.candidate_id, i.label, i.neuron, coalesce(s.n_fused, 1) as n_fused, coalesce(s.n_fused, 1) >= 2 as caused_by_edit
  from inc2 i join spread p using (candidate_id, label) left join size s using (candidate_id, label)"""))
def _(t):
    classes = E.merge_classes(merge_edits(t))
    names = F.explode(F.array(F.lit("within"), F.lit("across"))).alias("candidate_id")
    inc = brain(t).incidence.select(names, "label", "neuron", "n_nodes").join(classes, ["candidate_id", "label"], "left").groupBy(
        "candidate_id", F.coalesce("class", "label").alias("label"), "neuron").agg(F.sum("n_nodes").alias("n_nodes"))
    return SC.attribute_merges(inc, classes).select("candidate_id", "label", "neuron", "n_fused", "caused_by_edit")


@query("j12_label_gap", with_tables("frag_edge", body="""
  select (select count(distinct label) from frag_edge) as n_left, (select count(distinct raw_label) from gt_node where raw_label <> '0') as n_right,
    (select count(distinct label) from frag_edge where label in (select raw_label from gt_node)) as n_common,
    0 as only_left, (select count(distinct raw_label) from gt_node where raw_label <> '0' and raw_label not in (select label from frag_edge)) as only_right"""))
def _(t):
    right = G.labelled(t.gt_node, "raw_label").select(F.col("raw_label").alias("label"))
    return M.label_gap(t.frag_edge, right).select("n_left", "n_right", "n_common", "only_left", "only_right")


@query("j13_label_gap_lengths", with_tables("frag_len", body="""
  select count(*) as n_labels, round(min(um), 5) as min_um, round(median(um), 5) as median_um, round(max(um), 5) as max_um,
    count(*) filter (um >= 60) as n_long
  from (select label, sum(length) as um from frag_len where label not in (select label from frag_node where z = 3 and ord % 9 = 0) group by label) q"""))
def _(t):
    known = t.frag_node.filter((F.col("z") == 3) & (F.col("ord") % 9 == 0)).select("label")
    g = M.label_gap_lengths(G.edge_length(t.frag_edge, t.frag_node), known, 60.0)
    return g.select("n_labels", *[F.round(c, 5).alias(c) for c in ("min_um", "median_um", "max_um")], "n_long")


@query("j17_label_agreement", with_tables("gt_edge", "frag_node", extra=PRED, body="""
  select count(*) as n, count(*) filter ((raw_label = '0') = (pred_label = '0')) as n_presence_agrees,
    count(*) filter (raw_label <> '0' and pred_label <> '0') as n_both,
    count(*) filter (raw_label <> '0' and pred_label <> '0' and raw_label = pred_label) as n_id_agrees from pred"""))
def _(t):
    proxy = SP.nearest_label(t.gt_node, t.frag_node, 5.0)
    return M.label_agreement(t.gt_node.select("node_id", F.col("raw_label").alias("pred_label")), proxy)


@query("j18_patch_lookup", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body=f"""
  select {_ROUND_PN} from pn where neuron in (select neuron from gt_node where x >= 20 and x < 220 and y >= 800 and y < 3200 and z >= 0 and z < 4)"""))
def _(t):
    return round_per_neuron(M.patch_metrics_lookup(t.gt_node, brain(t).baseline, OFFSET, SHAPE))


@query("p17_filter_neurons", with_tables(*_PN_TABLES, recursive=True, extra=_PER_NEURON, body=f"select {_ROUND_PN} from pn where neuron % 4 = 1"))
def _(t):
    names = t.gt_node.select("neuron").distinct().filter(F.col("neuron") % 4 == 1)
    return round_per_neuron(M.filter_neurons(brain(t).baseline, names))


@query("u3_label_sets", with_tables("frag_edge", body="""
  select label, case when label in (select label from frag_edge) then 'both' else 'scoring' end as side from (select distinct label from frag_node) q"""))
def _(t):
    return M.label_sets(t.frag_edge, t.frag_node)


@query("u4_namespaces_disjoint", with_tables("frag_node", body="""
  select count(*) as n_shared, count(*) = 0 as disjoint from (select distinct 'N' || neuron as id from gt_node intersect select label from frag_node) q"""))
def _(t):
    gt = t.gt_node.select(F.concat(F.lit("N"), F.col("neuron").cast("string")).alias("id"))
    return M.namespaces_disjoint(gt, t.frag_node.select(F.col("label").alias("id")))
