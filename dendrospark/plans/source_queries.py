"""Readers and writers, fed with text and tables that Spark makes from the driver tables.

What a reader needs on disk is written to the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import metrics as M
from dendrospark.operators import policy as P
from dendrospark.operators import report as R
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables
from dendrospark.plans.record_queries import LEDGER_SQL, ledger
from dendrospark.session import scratch_path
from dendrospark.sources import readers as RD
from dendrospark.sources import writers as WR


@query("s1_read_skeletons", with_tables("frag_edge", body="""
  select cast(neuron % 3 as varchar) as brain_id, count(*) as n_nodes, sum(x)::double as sum_x, count(distinct label) as n_labels from frag_node group by 1"""))
def _(t):
    path = scratch_path(t.spark, "skeletons")
    brain = (F.col("neuron") % 3).cast("string").alias("brain_id")
    nodes = t.frag_node.select("node_id", F.col("neuron").alias("component_id"), F.concat("label", F.lit(".0")).alias("swc_id"), "label",
                               *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("radius").cast("float").alias("radius"), brain)
    edges = t.frag_edge.join(t.frag_node.select(F.col("node_id").alias("src"), "neuron"), "src").select("src", "dst", brain)
    meta = nodes.select("brain_id").distinct().select(F.lit(0.748).alias("anis_x"), F.lit(0.748).alias("anis_y"), F.lit(1.0).alias("anis_z"),
                                                      F.lit(100.0).alias("min_cable_length"), F.lit(1.0).alias("node_spacing"), "brain_id")
    WR.write_skeletons(path, nodes, edges, meta)
    back = RD.read_skeletons(t.spark, path)
    n = back["nodes"].join(back["meta"].select("brain_id"), "brain_id", "left_semi")
    return n.groupBy("brain_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("x").alias("sum_x"), F.countDistinct("label").alias("n_labels"))


@query("s2_read_swc", with_tables("gt_edge", body="""
  select e.src as dst, e.dst as src, x, y, z from gt_edge e join gt_node n on n.node_id = e.src"""))
def _(t):
    path = scratch_path(t.spark, "swc")
    parent = t.gt_edge.select(F.col("src").alias("node_id"), F.col("dst").alias("parent"))
    n = t.gt_node.join(parent, "node_id", "left")
    line = F.concat_ws(" ", "node_id", F.lit("2"), "x", "y", "z", "radius", F.coalesce("parent", F.lit(-1)))
    lines = n.select(line.alias("value")).unionByName(t.gt_node.filter(F.col("ord") == 1).select(F.concat(F.lit("# neuron "), "neuron").alias("value")))
    lines.write.text(path)
    nodes, edges = RD.read_swc(t.spark, path)
    at = nodes.select(F.col("node_id").alias("dst"), *[F.col(c).cast("bigint").alias(c) for c in "xyz"])
    return edges.select("src", "dst").join(at, "dst")


@query("s3_brain_id_from_name", """
  select c_custkey, cast(100000 + c_custkey as varchar) as brain_id, c_nationkey as min_cable_length from customer""")
def _(t):
    c = t.raw("customer").withColumn("file_name", F.format_string("dataset_cache_%d_mcl%d.parquet", F.col("c_custkey") + 100000, "c_nationkey"))
    return RD.with_brain_id(c).select("c_custkey", "brain_id", "min_cable_length")


_BRAIN = "cast(100000 + c_custkey % 1000 as varchar)"


@query("s4_brain_lookup", f"""
  select brain_id, min_by(seg, c_custkey) as segmentation_id from (select c_custkey, {_BRAIN} as brain_id, 'seg_' || c_custkey || '.v1' as seg from customer) q group by brain_id""")
def _(t):
    return RD.parse_brain_lookup(_markup(t))


def _markup(t):
    c = t.raw("customer").withColumn("b", (F.col("c_custkey") % 1000 + 100000).cast("string"))
    linked = F.concat(F.lit(r'{\field{\*\fldinst{HYPERLINK "http://seg/'), "c_custkey", F.lit(r'"}}{\fldrslt \cf2 '), "b", F.lit(", seg_"), "c_custkey", F.lit(r".v1}}\par"))
    plain = F.concat(F.lit(r"\f0 "), "b", F.lit(" ,  seg_"), "c_custkey", F.lit(r".v1\par"))
    return c.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, linked).otherwise(plain).alias("value"))


@query("s5_image_paths", "select cast(c_custkey as varchar) as brain_id, 's3://img/' || c_custkey || '/fused/0' as image_path from customer")
def _(t):
    c = t.raw("customer")
    doc = F.concat(F.lit('{"'), "c_custkey", F.lit('": "s3://img/'), "c_custkey", F.lit('/fused'), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(""), F.lit('"}'))
    return RD.image_paths(c.select(doc.alias("value")))


@query("p22_paths", f"""
  select brain_id, 'gs://b/ground_truth/' || brain_id || '/voxel' as gt_path, 'gs://b/fragments/' || brain_id || '/whole_brain/' || seg || '/swcs' as fragments_path,
    'gs://b/fragments/' || brain_id || '/whole_brain/' || seg || '/' as segmentation_path
  from (select brain_id, min_by(seg, c_custkey) as seg from (select c_custkey, {_BRAIN} as brain_id, 'seg_' || c_custkey || '.v1' as seg from customer) q group by brain_id) r""")
def _(t):
    lookup = RD.parse_brain_lookup(_markup(t))
    return RD.with_paths(RD.require_brains(lookup, lookup), "gs://b").drop("segmentation_id")


_RES = "select c_custkey, c_nationkey, c_acctbal, case when c_custkey % 7 = 0 then null else c_custkey % 100 end as acc from customer"


@query("s6_read_results", f"""with r as ({_RES})
  select cast(c_nationkey % 3 as varchar) as brain_id, 'seg' as segmentation_id, count(*) as n, count(acc) as n_known, round(sum(c_acctbal), 2) as run_length, sum(acc)::double as edge_accuracy
  from r group by 1""")
def _(t):
    root = scratch_path(t.spark, "metrics")
    c = t.raw("customer").select(F.col("c_custkey").cast("string").alias("neuron"), F.col("c_acctbal").alias("run_length"),
                                 *[F.lit(None).cast("double").alias(m) for m in M.METRIC_NAMES if m not in ("run_length", "edge_accuracy")],
                                 F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 100).cast("double")).alias("edge_accuracy"), "c_nationkey")
    ordered = ["neuron", *[m for m in M.METRIC_NAMES if m != "split_accuracy"]]
    for brain in range(3):
        WR.write_results(c.filter(F.col("c_nationkey") % 3 == brain).select(*ordered), root, str(brain), "seg")
    back = RD.read_results(t.spark, root)
    return back.groupBy("brain_id", "segmentation_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("edge_accuracy").alias("n_known"), F.round(F.sum("run_length"), 2).alias("run_length"), F.sum("edge_accuracy").alias("edge_accuracy"))


@query("s7_read_connections", """
  select distinct cast(o_custkey as varchar) as label_a, cast(o_custkey % 50 as varchar) as label_b from orders where o_orderkey % 4 in (0, 1)""")
def _(t):
    path = scratch_path(t.spark, "connections")
    a, b, k = F.col("o_custkey").cast("string"), (F.col("o_custkey") % 50).cast("string"), F.col("o_orderkey") % 4
    line = (F.when(k == 0, F.concat_ws(",", a, b)).when(k == 1, F.concat(F.lit(" "), a, F.lit(" ,, "), b, F.lit(" ")))
            .when(k == 2, a).otherwise(F.concat_ws(",", a, b, F.lit("x"))))
    t.raw("orders").select(line.alias("value")).write.text(path)
    return RD.read_connections(t.spark, path)


@query("s8_read_labels", "select distinct cast(o_custkey as varchar) as label from orders where o_orderkey % 3 <> 0")
def _(t):
    path = scratch_path(t.spark, "labels")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    t.raw("orders").select(line.alias("value")).write.text(path)
    return RD.read_labels(t.spark, path)


@query("s9_read_hypotheses", """
  select doc_id || '.json' as source_file, cast(doc_id as varchar) as run, cast(doc_id as varchar) as id, n_chars / 1000.0::double as prior, 'aim ' || doc_id as objective from documents""")
def _(t):
    return _exports(t).select("source_file", "run", "id", "prior", F.col("experimentPlan.objective").alias("objective"))


def _exports(t):
    rec = F.to_json(F.array(F.struct(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("prior"), F.lit(0.5).alias("surprisal"),
                                     F.struct(F.concat(F.lit("aim "), "doc_id").alias("objective")).alias("experimentPlan"))))
    k = F.col("doc_id") % 5
    body = F.when(k == 0, rec)
    for i, key in enumerate(RD.LIST_KEYS):
        body = body.when(k == i + 1, F.concat(F.lit('{"' + key + '": '), rec, F.lit("}")))
    docs = t.raw("documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("﻿")).otherwise(""), body).alias("value"),
                                     F.concat("doc_id", F.lit(".json")).alias("file"))
    return RD.parse_hypotheses(docs)


@query("s10_resolve_inputs", "select least(count(*), 1) as n_kinds, true as all_json from documents")
def _(t):
    path = scratch_path(t.spark, "exports")
    t.raw("documents").select("doc_id").write.json(path)
    t.raw("documents").select("doc_id").write.csv(path + "/other")
    files = RD.list_files(t.spark, path, "*.json")
    kinds = files.select(F.element_at(F.split("file_name", r"\."), -1).alias("kind")).distinct()
    return kinds.agg(F.count(F.lit(1)).alias("n_kinds"), F.min(F.col("kind") == "json").alias("all_json"))


@query("s11_ledger_round_trip", f"""with l as ({LEDGER_SQL})
  select count(*) as n_generations, count(*) filter (accepted) as n_accepted, round(max(heldout_primary), 6) as best_heldout, sum(output_tokens)::bigint as output_tokens from l""")
def _(t):
    path = scratch_path(t.spark, "run")
    rows = ledger(t).drop("run_id")
    WR.append_ledger(rows.filter(F.col("generation") % 2 == 0), path)
    WR.append_ledger(rows.filter(F.col("generation") % 2 == 1), path)
    s = R.ledger_summary(RD.read_ledger(t.spark, f"{path}/ledger.jsonl"))
    return s.select("n_generations", "n_accepted", F.round("best_heldout", 6).alias("best_heldout"), "output_tokens")


@query("s12_report_round_trip", "select o_custkey, count(*) as n from orders group by o_custkey")
def _(t):
    path = scratch_path(t.spark, "report")
    WR.write_report(t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.csv(path, header=True, schema="o_custkey long, n long")


_MEANS = """select '# Splits' as metric, sum(c_custkey % 7)::double as before, sum(c_custkey % 5)::double as after from customer
  union all select 'Edge Accuracy', avg(c_custkey % 90), avg(c_custkey % 100) from customer"""


@query("s13_text_report", f"""with m as ({_MEANS}) select pos, line from (
  select 0 as pos, 'Proofreading Before/After Summary' as line union all select 1, '' union all select 2, 'Error reductions' union all select 8, '' union all select 9, 'Quality changes'
  union all select 3, printf('  %s: %.4f -> %.4f (reduction %.4f, corrected %.2f%%)', metric, before, after, before - after, 100 * (before - after) / before) from m where metric = '# Splits'
  union all select 12, printf('  %s: %.4f -> %.4f (delta %.4f, relative %.2f%%)', metric, before, after, after - before, 100 * (after - before) / before) from m where metric = 'Edge Accuracy') q""")
def _(t):
    k = F.col("c_custkey")
    m = t.raw("customer").agg(F.sum(k % 7).cast("double").alias("sb"), F.sum(k % 5).cast("double").alias("sa"), F.avg(k % 90).alias("eb"), F.avg(k % 100).alias("ea"))
    before = m.select(F.col("sb").alias("n_splits"), F.col("eb").alias("edge_accuracy")).unpivot([], ["n_splits", "edge_accuracy"], "metric", "value")
    after = m.select(F.col("sa").alias("n_splits"), F.col("ea").alias("edge_accuracy")).unpivot([], ["n_splits", "edge_accuracy"], "metric", "value")
    return R.format_report(M.compare_before_after(before, after))


@query("s14_write_split", with_tables("gt_node", extra={"h": """
    select neuron, row_number() over (order by md5('3|' || neuron), neuron) as r, count(*) over () as n from (select distinct neuron from gt_node) q"""}, body="""
  select neuron, case when r <= greatest(1, round_even(n * 0.25::double, 0)) then 'heldout' else 'train' end as part, 3 as seed, 0.25::double as fraction from h"""))
def _(t):
    path = scratch_path(t.spark, "split")
    WR.write_split(P.neuron_split(t.gt_node, 0.25, 3), path, 3, 0.25)
    return t.spark.read.parquet(path)


@query("s15_latest_run", """
  select cast(o_custkey as varchar) as brain_id, max_by(cast(o_custkey as varchar) || '_' || o_orderkey, (o_orderdate, cast(o_custkey as varchar) || '_' || o_orderkey)) as run_id from orders group by o_custkey""")
def _(t):
    runs = t.raw("orders").select(F.concat_ws("_", "o_custkey", "o_orderkey").alias("run_id"), F.col("o_orderdate").alias("modified"))
    return RD.latest_run(runs)


@query("date_run_timestamp", f"""with l as ({LEDGER_SQL}) select distinct run_id, strptime(regexp_extract(run_id, '_([0-9]+_[0-9]+)$', 1), '%Y%m%d_%H%M%S') as started from l""")
def _(t):
    from dendrospark.functions.scalar import run_timestamp

    return ledger(t).select("run_id").distinct().select("run_id", run_timestamp(F.col("run_id")).cast("timestamp_ntz").alias("started"))
