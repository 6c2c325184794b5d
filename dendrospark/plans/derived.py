"""Graph tables derived from the ``events`` table, in Spark and as SQL text.

A user is a neuron and an event is a node, chained by time. All coordinates are
integers, so that two engines agree to the last bit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrospark.session import cut, merged

class Tables:
    """The driver tables under one folder and the graphs derived from them.

    The derived graphs are written to the shared folder when they are first asked for: queries of one
    session share them, the planner knows their sizes, and they come in as few parts as they have data.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, merged_run: int = 1):
        self.merged_run = merged_run  # the run of an odd user that carries its neighbour's label
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _label(self, background) -> Column:
        return (
            F.when(background, F.lit("0"))
            .when((F.col("run") == self.merged_run) & (F.col("neuron") % 2 == 1),
                  ((F.col("neuron") - 1) * 1000 + F.col("run")).cast("string"))
            .otherwise((F.col("neuron") * 1000 + F.col("run")).cast("string")))

    @cached_property
    def gt_node(self) -> DataFrame:
        if self.merged_run != 1:  # the same nodes under other labels
            return tables(self.spark, self.sf_dir).gt_node.withColumn("raw_label", self._label(F.col("raw_label") == "0"))
        e = self.raw("events").select(
            "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"), "ts")
        # position in the user's history: rank inside the hour plus the events of the hours before,
        # so a user with a third of all events is still spread over many tasks
        e = e.withColumn("_hour", F.date_trunc("hour", "ts"))
        inner = Window.partitionBy("user_id", "_hour").orderBy("ts", "event_id")
        hours = e.groupBy("user_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("user_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
        hours = hours.select("user_id", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        o = e.withColumn("_in", F.row_number().over(inner)).join(merged(hours), ["user_id", "_hour"]).withColumn(
            "ord", (F.col("_in") + F.col("_before")).cast("bigint"))
        g = o.select(
            F.col("event_id").alias("node_id"), F.col("user_id").alias("neuron"), "ord", "event_type", "v",
            (F.lit(5) * F.col("ord")).cast("bigint").alias("x"), (F.lit(40) * F.col("user_id")).cast("bigint").alias("y"),
            (F.col("v") % 4).cast("bigint").alias("z"), F.floor((F.col("ord") - 1) / 20).cast("bigint").alias("run"))
        return cut(g.select(
            "node_id", "neuron", "ord", (F.col("neuron") % 3).cast("bigint").alias("brain_id"), "x", "y", "z",
            (F.lit(1) + F.col("v") % 5).alias("radius"), "run", self._label(F.col("event_type") == "error").alias("raw_label")))

    @cached_property
    def gt_edge(self) -> DataFrame:
        if self.merged_run != 1:
            return tables(self.spark, self.sf_dir).gt_edge
        back = F.when(F.col("ord") % 10 == 0, F.col("ord") - 5).otherwise(F.col("ord") - 1)
        a = self.gt_node.filter(F.col("ord") > 1).select(
            F.col("node_id").alias("src"), "neuron", back.cast("bigint").alias("ord"))
        b = self.gt_node.select(F.col("node_id").alias("dst"), "neuron", "ord")
        return cut(a.join(merged(b), ["neuron", "ord"]).select("src", "dst", "neuron"))

    @cached_property
    def frag_node(self) -> DataFrame:
        n = self.gt_node.filter(F.col("raw_label") != "0")
        return cut(n.select(
            "node_id", F.col("raw_label").alias("label"), "neuron", "ord",
            (F.col("x") + F.col("node_id") % 3 - 1).alias("x"), "y", "z", "radius"))

    @cached_property
    def frag_edge(self) -> DataFrame:
        a = self.frag_node.select(F.col("node_id").alias("src"), "label")
        b = self.frag_node.select(F.col("node_id").alias("dst"), F.col("label").alias("_l"))
        e = self.gt_edge.select("src", "dst").join(merged(a), "src").join(merged(b), "dst").filter(F.col("label") == F.col("_l"))
        return cut(e.select("src", "dst", "label"))

    @cached_property
    def kink_node(self) -> DataFrame:
        n = self.gt_node.filter(F.col("raw_label") != "0")
        step = (F.col("ord") - 1) % 20
        return cut(n.select(
            "node_id", F.col("raw_label").alias("label"), "neuron", "ord",
            (F.lit(100) * F.col("run") + F.lit(5) * F.abs(step - 10)).cast("bigint").alias("x"),
            (F.lit(40) * F.col("neuron") + F.lit(2) * step).cast("bigint").alias("y"), "z", "radius"))

    @cached_property
    def kink_edge(self) -> DataFrame:
        a = self.kink_node.select(F.col("node_id").alias("dst"), "neuron", (F.col("ord") - 1).alias("ord"), "label")
        b = self.kink_node.select(F.col("node_id").alias("src"), "neuron", "ord", F.col("label").alias("_l"))
        e = a.join(merged(b), ["neuron", "ord"]).filter(F.col("label") == F.col("_l"))
        return cut(e.select("src", "dst", "label"))

    @cached_property
    def gt_labelled_edge(self) -> DataFrame:
        """GT edges with the raw label of both ends."""
        n = self.gt_node
        return cut(
            self.gt_edge.join(merged(n.select(F.col("node_id").alias("src"), F.col("raw_label").alias("label_src"))), "src")
            .join(merged(n.select(F.col("node_id").alias("dst"), F.col("raw_label").alias("label_dst"))), "dst"))


_CACHE: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str, merged_run: int = 1) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir, merged_run)
    if key not in _CACHE:
        _CACHE[key] = Tables(spark, sf_dir, merged_run)
    return _CACHE[key]


class Brains:
    """Two brains in one set of tables, told apart by ``brain`` alone: same node ids, same coordinates, other labels."""

    def __init__(self, t: Tables):
        self.spark, self.one, self.two = t.spark, t, tables(t.spark, t.sf_dir, 2)

    def __getattr__(self, name: str) -> DataFrame:
        a, b = (getattr(x, name).withColumn("brain", F.lit(tag)) for x, tag in ((self.one, "a"), (self.two, "b")))
        return a.unionByName(b)


def by_brain(sql: str) -> str:
    """SQL over both brains from the SQL over one."""
    other = sql.replace("when run = 1 and neuron % 2 = 1", "when run = 2 and neuron % 2 = 1")
    return f"select 'a' as brain, q.* from ({sql}) q union all select 'b' as brain, q.* from ({other}) q"


# The same tables as SQL, in order of dependence.
_SQL = {
    "gt_node": """
      select node_id, neuron, ord, cast(neuron % 3 as bigint) as brain_id, x, y, z, 1 + v % 5 as radius, run,
        case when event_type = 'error' then '0'
             when run = 1 and neuron % 2 = 1 then cast((neuron - 1) * 1000 + run as varchar)
             else cast(neuron * 1000 + run as varchar) end as raw_label
      from (
        select event_id as node_id, user_id as neuron, ord, event_type, v, cast(5 * ord as bigint) as x,
          cast(40 * user_id as bigint) as y, cast(v % 4 as bigint) as z, cast(floor((ord - 1) / 20) as bigint) as run
        from (select event_id, user_id, event_type, cast(round(value * 100) as bigint) as v,
                row_number() over (partition by user_id order by ts, event_id) as ord from events) o) g""",
    "gt_edge": """
      select a.node_id as src, b.node_id as dst, a.neuron from gt_node a join gt_node b on a.neuron = b.neuron
        and b.ord = case when a.ord % 10 = 0 then a.ord - 5 else a.ord - 1 end where a.ord > 1""",
    "frag_node": """
      select node_id, raw_label as label, neuron, ord, x + node_id % 3 - 1 as x, y, z, radius
      from gt_node where raw_label <> '0'""",
    "frag_edge": """
      select e.src, e.dst, a.label from gt_edge e join frag_node a on e.src = a.node_id
        join frag_node b on e.dst = b.node_id where a.label = b.label""",
    "kink_node": """
      select node_id, raw_label as label, neuron, ord,
        cast(100 * run + 5 * abs((ord - 1) % 20 - 10) as bigint) as x,
        cast(40 * neuron + 2 * ((ord - 1) % 20) as bigint) as y, z, radius from gt_node where raw_label <> '0'""",
    "kink_edge": """
      select b.node_id as src, a.node_id as dst, a.label from kink_node a join kink_node b
        on a.neuron = b.neuron and b.ord = a.ord - 1 and a.label = b.label""",
    "gt_le": """
      select e.src, e.dst, e.neuron, a.raw_label as label_src, b.raw_label as label_dst from gt_edge e
        join gt_node a on e.src = a.node_id join gt_node b on e.dst = b.node_id""",
    "frag_len": """
      select e.src, e.dst, e.label, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as length
      from frag_edge e join frag_node a on e.src = a.node_id join frag_node b on e.dst = b.node_id""",
    "gt_len": """
      select e.src, e.dst, e.neuron, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as length,
        a.raw_label as label_src, b.raw_label as label_dst
      from gt_edge e join gt_node a on e.src = a.node_id join gt_node b on e.dst = b.node_id""",
    "frag_sym": """
      select src as u, dst as v, length, label from frag_len union all select dst, src, length, label from frag_len""",
    "frag_deg": """
      select n.*, coalesce(d.degree, 0) as degree from frag_node n left join
        (select u as node_id, count(*) as degree from frag_sym group by u) d using (node_id)""",
    "tip_pair": """
      select a.node_id as node_a, a.label as label_a, a.x as ax, a.y as ay, a.z as az, b.node_id as node_b,
        b.label as label_b, b.degree as degree_b, b.x as bx, b.y as "by", b.z as bz,
        (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) as d2
      from (select * from frag_deg where degree = 1) a join frag_deg b
        on b.x between a.x - 15 and a.x + 15 and b.y between a.y - 15 and a.y + 15 and b.z between a.z - 15 and a.z + 15
        and a.label <> b.label
      where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 225""",
    "split_site": """
      select node_a, node_b, label_a, label_b, degree_b, ax, ay, az, bx, "by", bz, d2, sqrt(d2) as gap_um from (
        select *, row_number() over (partition by least(label_a, label_b), greatest(label_a, label_b)
                                     order by d2, node_a, node_b) as rn from tip_pair) where rn = 1""",
}

_NEEDS = {
    "gt_node": [], "gt_edge": ["gt_node"], "frag_node": ["gt_node"], "frag_edge": ["gt_edge", "frag_node"],
    "kink_node": ["gt_node"], "kink_edge": ["kink_node"], "gt_le": ["gt_edge"], "frag_len": ["frag_edge"],
    "gt_len": ["gt_edge"], "frag_sym": ["frag_len"], "frag_deg": ["frag_sym"], "tip_pair": ["frag_deg"],
    "split_site": ["tip_pair"],
}


def with_tables(*names: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH`` prefix holding the named derived tables and what they need, then ``body``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS[name]:
            need(n)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    parts = [f"{n} as {'materialized ' if n not in (extra or {}) else ''}({_SQL[n]})" for n in ordered]
    parts += [f"{n} as ({sql})" for n, sql in (extra or {}).items()]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + f"\n{body}"
