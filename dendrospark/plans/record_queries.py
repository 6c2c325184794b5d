"""Hypothesis ranking, ledgers and comparison across data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import policy as P
from dendrospark.operators import ranking as RK
from dendrospark.operators import report as R
from dendrospark.plans.catalog import query

# hypotheses made from documents: some ids are text, some surprisals cannot be read
_HYP = """
  select case when doc_id % 5 = 0 then 'x' || doc_id else cast(doc_id as varchar) end as id, source as run, source || '.json' as source_file,
    case when doc_id % 3 = 0 then null else 'done' end as status,
    case when n_chars % 10 = 7 then null when n_chars % 10 = 3 then 'n/a' else (n_chars % 37 - 18) || '.' || n_chars % 10 end as surprisal,
    case when n_chars % 4 = 0 then n_chars % 2 = 0 end as surprising, (n_chars % 101) / 100.0::double as prior,
    case when n_chars % 11 = 0 then null else (n_chars * 7 % 101) / 100.0::double end as posterior from documents"""
_RANKED = """select *, abs(try_cast(surprisal as double)) as mag, coalesce(posterior, 0) * abs(try_cast(surprisal as double)) as pri
  from h where try_cast(surprisal as double) is not null"""
_TIE = "run, try_cast(id as bigint) is null, coalesce(try_cast(id as bigint), 0), id"


def hypotheses(t):
    n, d = F.col("n_chars"), F.col("doc_id")
    return t.raw("documents").select(
        F.when(d % 5 == 0, F.concat(F.lit("x"), d)).otherwise(d.cast("string")).alias("id"), F.col("source").alias("run"),
        F.concat("source", F.lit(".json")).alias("source_file"), F.when(d % 3 != 0, F.lit("done")).alias("status"),
        F.when(n % 10 == 7, None).when(n % 10 == 3, F.lit("n/a")).otherwise(F.concat((n % 37 - 18).cast("string"), F.lit("."), (n % 10).cast("string"))).alias("surprisal"),
        F.when(n % 4 == 0, n % 2 == 0).alias("isSurprising"), ((n % 101) / F.lit(100.0)).alias("prior"),
        F.when(n % 11 != 0, (n * 7 % 101) / F.lit(100.0)).alias("posterior"), F.concat(F.lit(" doc "), d).alias("hypothesis"),
        F.struct(F.concat(F.lit("look at "), d, F.lit(" ")).alias("objective")).alias("experimentPlan"),
        F.lit(None).cast("string").alias("analysis"), F.lit("ok").alias("review"))


for _mode, _score in (("surprise", "mag"), ("posterior-surprise", "pri")):
    @query(f"w3_rank_{_mode.replace('-', '_')}", f"""with h as ({_HYP}), r as ({_RANKED})
      select id, run, row_number() over (order by {_score} desc, {_TIE}) as rank from r""")
    def _(t, mode=_mode):
        return RK.rank_hypotheses(hypotheses(t), mode).select("id", "run", "rank")


@query("w4_top_hypotheses", f"""with h as ({_HYP}), r as ({_RANKED})
  select id, run, rank from (select *, row_number() over (order by mag desc, {_TIE}) as rank from r) q where rank <= 25""")
def _(t):
    return RK.rank_hypotheses(hypotheses(t), top=25).select("id", "run", "rank")


_BELIEF = """case when {p} is null then 'Unknown' when {p} >= 0.80 then 'Likely True' when {p} >= 0.60 then 'Leaning True' when {p} > 0.40 then 'Uncertain'
  when {p} > 0.20 then 'Leaning False' else 'Likely False' end"""


@query("p21_hypothesis_records", f"""with h as ({_HYP}), r as ({_RANKED})
  select row_number() over (order by mag desc, {_TIE}) as rank, id, coalesce(status, '') as status, round(try_cast(surprisal as double), 4) as surprisal, round(mag, 4) as surprise_magnitude,
    round(pri, 4) as priority_score, coalesce(surprising, mag >= 0.3) as is_surprising, {_BELIEF.format(p='prior')} as belief_before, {_BELIEF.format(p='posterior')} as belief_after,
    case when posterior is null then 'Unknown' when posterior - prior > 0.02::double then 'Positive' when posterior - prior < -0.02::double then 'Negative' else 'Neutral' end as direction,
    'doc ' || replace(id, 'x', '') as hypothesis, 'look at ' || replace(id, 'x', '') as objective, '' as analysis, 'ok' as review from r""")
def _(t):
    return RK.hypothesis_records(RK.rank_hypotheses(hypotheses(t))).drop("run", "source_file", "prior", "posterior")


@query("a29_rank_summary", f"""with h as ({_HYP}), r as ({_RANKED})
  select (select count(*) from h) as n_total, count(*) as n_ranked, (select count(*) from h) - count(*) as n_dropped, round(max(mag), 4) as magnitude_max,
    round(min(mag), 4) as magnitude_min, (select count(distinct run) from h) as n_files, least(count(*), 25) as n_returned from r""")
def _(t):
    return RK.rank_summary(hypotheses(t), top=25)


@query("u6_ranked_and_dropped", f"""with h as ({_HYP})
  select run, count(*) filter (try_cast(surprisal as double) is not null) as n_ranked, count(*) filter (try_cast(surprisal as double) is null) as n_dropped from h group by run""")
def _(t):
    ranked, dropped = RK.split_missing(hypotheses(t))
    both = ranked.select("run", F.lit(1).alias("r")).unionByName(dropped.select("run", F.lit(0).alias("r")))
    return both.groupBy("run").agg(F.count_if(F.col("r") == 1).alias("n_ranked"), F.count_if(F.col("r") == 0).alias("n_dropped"))


@query("u2_pooled_runs", f"""with h as ({_HYP}), a as (select * from h where run <= 'm' union all select * from h where run > 'm')
  select run, count(*) as n from a group by run""")
def _(t):
    h = hypotheses(t)
    pooled = h.filter(F.col("run") <= "m").unionByName(h.filter(F.col("run") > "m"))
    return pooled.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("u5_distinct_pairs", """
  select distinct least(c_nationkey, s) as a, greatest(c_nationkey, s) as b from (
    select c_nationkey, cast(c_custkey % 25 as integer) as s from customer) q""")
def _(t):
    c = t.raw("customer").withColumn("s", (F.col("c_custkey") % 25).cast("int"))
    return c.select(F.least("c_nationkey", "s").alias("a"), F.greatest("c_nationkey", "s").alias("b")).distinct()


# --- ledgers: a customer is a run, its orders in key order are the generations --------------------------------------

LEDGER_SQL = """
  select cast(o_custkey as varchar) || '_20250101_' || lpad(cast(o_custkey % 86400 // 3600 * 10000 as varchar), 6, '0') as run_id, o_orderkey as generation,
    o_totalprice as wall_seconds, case when o_orderkey % 9 = 0 then null else o_totalprice % 1000 / 10.0 end as heldout_primary,
    50.0::double as parent_heldout, o_orderstatus = 'F' as accepted, o_orderkey % 1000 as output_tokens, round(o_totalprice % 7, 2) as cost_usd,
    o_orderkey % 2 as human_interventions from orders"""


def ledger(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    run = F.concat(c.cast("string"), F.lit("_20250101_"), F.lpad((F.floor(c % 86400 / 3600) * 10000).cast("string"), 6, "0"))
    return t.raw("orders").select(
        run.alias("run_id"), k.alias("generation"), F.col("o_totalprice").alias("wall_seconds"),
        F.when(k % 9 != 0, F.col("o_totalprice") % 1000 / 10.0).alias("heldout_primary"), F.lit(50.0).alias("parent_heldout"),
        (F.col("o_orderstatus") == "F").alias("accepted"), (k % 1000).alias("output_tokens"), F.round(F.col("o_totalprice") % 7, 2).alias("cost_usd"),
        (k % 2).alias("human_interventions"), F.lit("").alias("candidate_path"))


@query("a24_ledger_summary", f"""with l as ({LEDGER_SQL})
  select run_id, count(*) as n_generations, count(*) filter (accepted) as n_accepted, round(max(heldout_primary), 6) as best_heldout,
    round(sum(wall_seconds), 2) as wall_seconds, sum(output_tokens)::bigint as output_tokens, round(sum(cost_usd), 4) as cost_usd, sum(human_interventions)::bigint as human_interventions
  from l group by run_id""")
def _(t):
    return R.ledger_summary(ledger(t), ["run_id"]).withColumns({
        "best_heldout": F.round("best_heldout", 6), "wall_seconds": F.round("wall_seconds", 2), "cost_usd": F.round("cost_usd", 4)})


@query("a25_run_facts", f"""with l as ({LEDGER_SQL})
  select run_id, count(*) as n_generations, count(*) filter (accepted) as n_accepted, min_by(parent_heldout, generation) as baseline_heldout,
    round(max(heldout_primary), 6) as final_heldout, round(sum(cost_usd), 3) as total_cost_usd, split_part(run_id, '_', 1) as brain_id,
    round(max(heldout_primary) - min_by(parent_heldout, generation), 6) as net_heldout_gain from l group by run_id""")
def _(t):
    return R.run_facts(ledger(t)).withColumns({
        "final_heldout": F.round("final_heldout", 6), "net_heldout_gain": F.round("net_heldout_gain", 6), "total_cost_usd": F.round("total_cost_usd", 3)})


@query("a25_accepted_generations", f"with l as ({LEDGER_SQL}) select run_id, generation, round(heldout_primary, 6) as heldout from l where accepted")
def _(t):
    return R.accepted_generations(ledger(t)).select("run_id", "generation", F.round("heldout_primary", 6).alias("heldout"))


@query("w8_gate_lineage", f"""with recursive l as materialized ({LEDGER_SQL}),
  n as (select run_id, generation, heldout_primary as h, row_number() over (partition by run_id order by generation) as i from l),
  fold as (select run_id, cast(0 as bigint) as i, 50.0::double as parent, null::bigint as generation, null::boolean as accepted from (select distinct run_id from l) q
    union all select n.run_id, n.i, case when coalesce(n.h > f.parent + 0.5, false) then n.h else f.parent end, n.generation, coalesce(n.h > f.parent + 0.5, false)
    from fold f join n on n.run_id = f.run_id and n.i = f.i + 1)
  select run_id, generation, accepted from fold where i > 0""")
def _(t):
    g = ledger(t).select("run_id", "generation", F.col("heldout_primary").alias("heldout"), F.col("parent_heldout").alias("baseline"))
    return P.gate_lineage(g, eps=0.5).select("run_id", "generation", "accepted")


@query("w9_last_accepted", f"""with l as ({LEDGER_SQL})
  select run_id, max(generation) as generation, round(max_by(wall_seconds, generation), 2) as wall_seconds from l where accepted group by run_id""")
def _(t):
    last = R.latest(ledger(t).filter("accepted"), "run_id", "generation", "wall_seconds")
    return last.select("run_id", "generation", F.round("wall_seconds", 2).alias("wall_seconds"))


# --- data sets: nations as brains, customers as neurons -------------------------------------------------------------

_RESULTS = """
  select cast(c_nationkey as varchar) as brain_id, c_acctbal as erl, 100.0::double * count(*) filter (o_orderstatus = 'F') / count(*) as edge_accuracy,
    100.0::double * count(*) filter (o_orderpriority = '5-LOW') / count(*) as pct_split, 100.0::double * count(*) filter (o_orderstatus = 'P') / count(*) as pct_omit
  from customer join orders on o_custkey = c_custkey group by c_custkey, c_nationkey, c_acctbal"""
_METRICS = ["erl", "edge_accuracy", "pct_split", "pct_omit"]


def dataset_results(t):
    j = t.raw("customer").join(t.raw("orders"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.count(F.lit(1))
    return j.groupBy("c_custkey", F.col("c_nationkey").cast("string").alias("brain_id"), F.col("c_acctbal").alias("erl")).agg(
        (F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / n).alias("edge_accuracy"),
        (F.lit(100.0) * F.count_if(F.col("o_orderpriority") == "5-LOW") / n).alias("pct_split"),
        (F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "P") / n).alias("pct_omit"))


@query("a19_dataset_means", f"""with r as ({_RESULTS})
  select brain_id, count(*) as n_neurons, {', '.join(f'round(avg({m}), 4) as {m}' for m in _METRICS)} from r group by brain_id""")
def _(t):
    return R.dataset_means(dataset_results(t), _METRICS).select("brain_id", "n_neurons", *[F.round(m, 4).alias(m) for m in _METRICS])


_CV = f"""with r as ({_RESULTS}), m as (select brain_id, {', '.join(f'avg({m}) as {m}' for m in _METRICS)} from r group by brain_id),
  u as (unpivot m on {', '.join(_METRICS)} into name metric value value),
  cv as (select metric, avg(value) as mean_of_means, stddev_pop(value) as std, min(value) as min, max(value) as max, min_by(brain_id, value) as lowest,
    max_by(brain_id, value) as highest, stddev_pop(value) / abs(avg(value)) as cv, metric <> 'erl' as scale_normalized from u group by metric)"""


@query("a20_cross_dataset_cv", f"""{_CV} select metric, round(mean_of_means, 4) as mean_of_means, round(std, 4) as std, lowest, highest, round(cv, 6) as cv,
  scale_normalized, case when cv < 0.25 then 'consistent' else 'diverges' end as verdict from cv""")
def _(t):
    c = R.cross_dataset_cv(R.dataset_means(dataset_results(t), _METRICS), _METRICS)
    return c.select("metric", F.round("mean_of_means", 4).alias("mean_of_means"), F.round("std", 4).alias("std"), "lowest", "highest",
                    F.round("cv", 6).alias("cv"), "scale_normalized", "verdict")


@query("a20_consistency_ends", f"""{_CV} select round(min(cv), 6) as min_cv, round(max(cv), 6) as max_cv, min_by(metric, cv) as most_consistent,
  max_by(metric, cv) as least_consistent from cv where scale_normalized""")
def _(t):
    e = R.consistency_ends(R.cross_dataset_cv(R.dataset_means(dataset_results(t), _METRICS), _METRICS))
    return e.select(F.round("min_cv", 6).alias("min_cv"), F.round("max_cv", 6).alias("max_cv"), "most_consistent", "least_consistent")
