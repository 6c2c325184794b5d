"""Statistics of the recorded analyses on the driver tables and the derived graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import graph as G
from dendrospark.operators import sites as SI
from dendrospark.operators import statistic as ST
from dendrospark.plans.catalog import query
from dendrospark.plans.derived import with_tables


@query("x1_chi2", """
  select a, b, c, d, round(n * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 5) as chi2, round(a / (a + b), 6) as rate_in,
    round(c / (c + d), 6) as rate_out, round((a / (a + b)) / (c / (c + d)), 6) as ratio
  from (select count(*) filter (g and o)::double as a, count(*) filter (g and not o)::double as b, count(*) filter (not g and o)::double as c,
    count(*) filter (not g and not o)::double as d, count(*)::double as n from (select l_returnflag = 'R' as g, l_quantity > 25 as o from lineitem) q) t""")
def _(t):
    x = ST.chi2_2x2(t.raw("lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity") > 25)
    return x.withColumns({c: F.round(c, 5 if c == "chi2" else 6) for c in ("chi2", "rate_in", "rate_out", "ratio")})


@query("x2_mcnemar", """
  select b, c, round(pow(greatest(abs(b - c) - 1, 0), 2) / (b + c), 6) as statistic from (
    select count(*) filter (p and not q) as b, count(*) filter (not p and q) as c from (
      select l_quantity > 25 as p, l_extendedprice > 30000 as q from lineitem) x) y""")
def _(t):
    m = ST.mcnemar(t.raw("lineitem"), F.col("l_quantity") > 25, F.col("l_extendedprice") > 30000)
    return m.withColumn("statistic", F.round("statistic", 6))


_MW = """
  with r as (select {pos} as pos, rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0::double as mr from {rel}),
  s as (select count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg, sum(mr) filter (pos) as s from r)"""


@query("x3_mann_whitney", _MW.format(pos="l_returnflag = 'R'", v="l_quantity", rel="lineitem") + """
  select n_pos, n_neg, round(s - n_pos * (n_pos + 1) / 2.0::double, 2) as u from s""")
def _(t):
    m = ST.mann_whitney(t.raw("lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return m.select("n_pos", "n_neg", F.round("u", 2).alias("u"))


@query("x4_welch_t", """
  select round(ma, 5) as mean_a, round(mb, 5) as mean_b, n_a, n_b, round((ma - mb) / sqrt(va / n_a + vb / n_b), 5) as t,
    round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 3) as df
  from (select avg(v) filter (p) as ma, avg(v) filter (not p) as mb, var_samp(v) filter (p) as va, var_samp(v) filter (not p) as vb,
    count(*) filter (p) as n_a, count(*) filter (not p) as n_b from (select l_extendedprice as v, l_returnflag = 'A' as p from lineitem) x) y""")
def _(t):
    w = ST.welch_t(t.raw("lineitem"), "l_extendedprice", F.col("l_returnflag") == "A")
    return w.withColumns({c: F.round(c, 3 if c == "df" else 5) for c in ("mean_a", "mean_b", "t", "df")})


@query("x4_paired_t", """
  select round(avg(d), 5) as mean_diff, count(*) as n, round(avg(d) / sqrt(var_samp(d) / count(*)), 5) as t, count(*) - 1 as df
  from (select l_discount - l_tax as d from lineitem) q""")
def _(t):
    return ST.paired_t(t.raw("lineitem"), "l_discount", "l_tax").withColumns({c: F.round(c, 5) for c in ("mean_diff", "t")})


@query("x5_correlations", """
  with r as (select l_quantity as x, l_extendedprice as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as rx,
    rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0::double as ry from lineitem)
  select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, count(*) as n from r""")
def _(t):
    c = ST.correlations(t.raw("lineitem"), "l_quantity", "l_extendedprice")
    return c.withColumns({k: F.round(k, 6) for k in ("pearson", "spearman")})


@query("x6_roc_auc", _MW.format(pos="quality = 1", v="n_chars", rel="(select quality, n_chars from labels join documents using (doc_id)) j") + """
  select n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0::double) / (n_pos * n_neg), 6) as auc from s""")
def _(t):
    j = t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id")
    return ST.roc_auc(j, "n_chars", F.col("quality") == 1).withColumn("auc", F.round("auc", 6))


@query("x7_rate_by_bin", with_tables("tip_pair", body="""
  select cast(floor(sqrt(d2) / 3.0::double) as bigint) as bin, count(*) as n, count(*) filter (a.neuron = b.neuron) as n_pos,
    round(count(*) filter (a.neuron = b.neuron) / count(*)::double, 6) as precision, round(count(*) filter (a.neuron <> b.neuron) / count(*)::double, 6) as false_rate
  from tip_pair p join frag_node a on a.node_id = node_a join frag_node b on b.node_id = node_b group by 1"""))
def _(t):
    who = t.frag_node.select("node_id", "neuron")
    p = SI.tip_pairs(t.frag_node, t.frag_edge, 15.0).withColumn("gap", F.sqrt("d2"))
    p = p.join(who.withColumnsRenamed({"node_id": "node_a", "neuron": "na"}), "node_a").join(
        who.withColumnsRenamed({"node_id": "node_b", "neuron": "nb"}), "node_b")
    r = ST.rate_by_bin(p, "gap", 3.0, F.col("na") == F.col("nb"))
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "false_rate")})


@query("x8_bh_fdr", """
  with p as (select p_partkey, power((p_partkey % 997 + 1) / 997.0::double, 3) as p from part),
  r as (select p, row_number() over (order by p, p_partkey) as k, count(*) over () as m from p)
  select count(*) as n_tests, count(*) filter (p <= 0.05::double) as n_raw, count(*) filter (p <= 0.05::double / m) as n_bonferroni,
    coalesce(max(k) filter (p <= k * 0.05::double / m), 0) as n_bh from r""")
def _(t):
    p = t.raw("part").select("p_partkey", F.pow((F.col("p_partkey") % 997 + 1) / F.lit(997.0), F.lit(3.0)).alias("p"))
    return ST.bh_fdr(p, "p", "p_partkey")


@query("x9_logit_slope", """
  with recursive g as (select l_quantity::double / 10 as x, count(*)::double as n, sum(case when l_extendedprice > 30000 then 1 else 0 end)::double as s
    from lineitem group by 1),
  fit as (select 0 as i, 0::double as b0, 0::double as b1
    union all
    select i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
      select i, b0, b1, sum(s - n * p) as g0, sum(x * (s - n * p)) as g1, sum(n * p * (1 - p)) as h00, sum(n * p * (1 - p) * x) as h01,
        sum(n * p * (1 - p) * x * x) as h11
      from (select f.*, g.*, 1 / (1 + exp(-(b0 + b1 * x))) as p from fit f, g where f.i < 25) q group by i, b0, b1) r)
  select round(b1, 3) as slope, round(b0, 3) as intercept from fit where i = 25""")
def _(t):
    """Logistic fit; the SQL takes Newton steps on the grouped table."""
    d = t.raw("lineitem").select((F.col("l_quantity") / 10.0).alias("x"), (F.col("l_extendedprice") > 30000).cast("double").alias("y"))
    return ST.logit_slope(d, "x", "y").select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("x11_zone_of_edge", with_tables("frag_deg", "gt_le", extra={
    "mid": "select e.src, (a.x + b.x) / 2.0::double as x, (a.y + b.y) / 2.0::double as y, (a.z + b.z) / 2.0::double as z from gt_edge e join gt_node a on a.node_id = e.src join gt_node b on b.node_id = e.dst",
    "lm": "select * from frag_deg where degree >= 3"}, body="""
  select m.src as edge_id, round(sqrt(min((m.x-l.x)*(m.x-l.x) + (m.y-l.y)*(m.y-l.y) + (m.z-l.z)*(m.z-l.z))), 6) as distance, count(l.node_id) > 0 as near
  from mid m left join lm l on l.x between m.x - 10 and m.x + 10 and l.y between m.y - 10 and m.y + 10
    and (m.x-l.x)*(m.x-l.x) + (m.y-l.y)*(m.y-l.y) + (m.z-l.z)*(m.z-l.z) <= 100 group by m.src"""))
def _(t):
    mid = G.edge_midpoints(t.gt_edge.select("src", "dst"), t.gt_node).select(
        F.col("src").alias("edge_id"), F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("mid_z").alias("z"))
    lm = G.degrees(t.frag_node, t.frag_edge).filter(F.col("degree") >= 3).select("node_id", "x", "y", "z")
    return ST.zone_of_edge(mid, lm, 10.0).select("edge_id", F.round("distance", 6).alias("distance"), "near")


_ALIGN = "select cast(floor(sqrt(d2) / 3.0::double) as bigint) as bin, abs(ax - bx) / sqrt(d2) as al from tip_pair where d2 > 0"


def _alignment(t):
    return SI.tip_pairs(t.frag_node, t.frag_edge, 15.0).filter(F.col("d2") > 0).select(
        F.sqrt("d2").alias("gap"), (F.abs(F.col("ax") - F.col("bx")) / F.sqrt("d2")).alias("al"))


@query("x12_alignment_by_gap", with_tables("tip_pair", extra={"al": _ALIGN}, body="select bin, count(*) as n, round(avg(al), 6) as mean_alignment from al group by bin"))
def _(t):
    return ST.alignment_by_gap(_alignment(t), "gap", "al", 3.0).withColumn("mean_alignment", F.round("mean_alignment", 6))


@query("x12_alignment_decay", with_tables("tip_pair", extra={"al": _ALIGN, "b": "select bin, avg(al) as m from al group by bin"}, body="""
  select round(regr_slope(ln(m - 0.1), (bin + 0.5) * 3.0), 6) as slope, round(regr_intercept(ln(m - 0.1), (bin + 0.5) * 3.0), 6) as intercept, count(*) as n_bins
  from b where m > 0.1"""))
def _(t):
    d = ST.decay_rate(ST.alignment_by_gap(_alignment(t), "gap", "al", 3.0), 0.1, 3.0)
    return d.withColumns({c: F.round(c, 6) for c in ("slope", "intercept")})
