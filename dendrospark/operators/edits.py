"""Typed label edits: unify two labels, or partition one label by location.

Edits are rows ``candidate_id, edit_seq, kind, label_a, label_b, label, seeds``.
All operators work on every candidate at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.functions.scalar import BACKGROUND, PSEUDO_SEP, base26_suffix
from dendrospark.operators.graph import XYZ, connected_components, symmetric
from dendrospark.operators.ordering import global_rank
from dendrospark.operators.spatial import as_build, nearest
from dendrospark.operators.walk import chain_ends, directed_edges
from dendrospark.session import cut, is_empty, merged

# The edit kinds.
MERGE, SPLIT, FLAG, REJECT = "merge_labels", "split_label", "flag_review", "reject_candidate"
KINDS = [MERGE, SPLIT, FLAG, REJECT]

SEED_TYPE = "array<struct<suffix:string,x:double,y:double,z:double,node:bigint>>"
EDIT_SCHEMA = T.StructType([
    T.StructField("candidate_id", T.StringType()), T.StructField("edit_seq", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("label_a", T.StringType()), T.StructField("label_b", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("seeds", T.ArrayType(T.StructType([
        T.StructField("suffix", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()), T.StructField("node", T.LongType())])))])

CAND = ["candidate_id"]
#: a label of a candidate; the key with more values comes first, since rows are sorted by its leading bytes
BY_LABEL = ["label", "candidate_id"]


def normalize_edits(edits: DataFrame) -> DataFrame:
    """A bare label pair becomes a ``merge_labels`` edit; any other unknown kind is an error when the rows are used."""
    pair = F.col("kind").isNull() & F.col("label_a").isNotNull() & F.col("label_b").isNotNull()
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind")).when(pair, F.lit(MERGE)).otherwise(
        F.raise_error(F.concat(F.lit("unknown edit kind: "), F.coalesce("kind", F.lit("none")))).cast("string"))
    return edits.withColumn("kind", kind)


def merge_pairs(edits: DataFrame) -> DataFrame:
    """Label pairs to unite. Background is never relabelled, so a pair naming it has no effect."""
    real = (F.col("kind") == MERGE) & (F.col("label_a") != BACKGROUND) & (F.col("label_b") != BACKGROUND)
    return edits.filter(real).select("candidate_id", "edit_seq", "label_a", "label_b")


#: wanted suffixes of a label that travel as one array
CHUNK = 64


def suffix_index(name: Column) -> Column:
    """Place of a suffix in a, b, ..., z, aa, ...; null for other names (and for those too long ever to be given out)."""
    letters = F.split(name, "")
    place = F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 96)) - 1
    return F.when(name.rlike("^[a-z]{1,9}$"), place)


def split_seeds(edits: DataFrame) -> DataFrame:
    """Seeds of the split edits with a suffix that is unique in their label, numbered in edit order.

    A given suffix is kept if still unused in that label, otherwise the smallest unused one of a, b, ..., z, aa, ... is taken.
    No fold is needed for that. Every seed uses up one name, so with ``A`` seeds before that repeat a wish or have none, the smallest unused name
    is the one of rank ``A`` among the names nobody has wanted before. Going up the wanted names in order finds it; they come
    in arrays of ``CHUNK`` names, one after the other. A first wish is granted unless that smallest name has passed it.
    """
    key = ["candidate_id", "label"]
    s = edits.filter(F.col("kind") == SPLIT).select(*key, "edit_seq", F.posexplode("seeds").alias("_pos", "s"))
    s = s.select(*key, "edit_seq", "_pos", F.col("s.suffix").alias("_wish"), *[F.col(f"s.{c}").alias(c) for c in XYZ])
    order = Window.partitionBy(*key).orderBy("edit_seq", "_pos")
    s = s.withColumn("seed_idx", F.row_number().over(order).cast("int") - 1)
    first = F.row_number().over(Window.partitionBy(*key, "_wish").orderBy("seed_idx")) == 1
    s = s.withColumns({"_first": F.col("_wish").isNotNull() & first, "_k": suffix_index(F.col("_wish"))})
    before = Window.partitionBy(*key).orderBy("seed_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = cut(s.withColumn("_m", F.coalesce(F.sum(F.when(F.col("_first"), 0).otherwise(1)).over(before), F.lit(0)).cast("bigint")))
    wanted = s.filter(F.col("_first") & F.col("_k").isNotNull()).withColumn(
        "_chunk", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("_k")) - 1) / CHUNK))
    chunks = cut(wanted.groupBy(*key, "_chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("seed_idx").alias("at")))).alias("_names")))
    for c in range((chunks.agg(F.max("_chunk")).first()[0] or 0) + 1):
        passed = F.aggregate("_names", F.col("_m"), lambda m, w: m + F.when((w["at"] < F.col("seed_idx")) & (w["k"] <= m), 1).otherwise(0))
        s = s.join(merged(chunks.filter(F.col("_chunk") == c).drop("_chunk")), BY_LABEL, "left").withColumn("_m", F.coalesce(passed, "_m")).drop("_names")
        s = cut(s) if c else s
    granted = F.col("_first") & (F.col("_k").isNull() | (F.col("_m") <= F.col("_k")))
    return s.select(*key, "seed_idx", F.when(granted, F.col("_wish")).otherwise(base26_suffix(F.col("_m"))).alias("suffix"), *XYZ)


# --- merge classes --------------------------------------------------------------------------------------------------


def merge_classes(edits: DataFrame, max_class_size: int | None = None, group_rows: int = 200_000) -> DataFrame:
    """``candidate_id, label, class`` for the labels named in merge edits; class = smallest label.

    With a size limit a union that would exceed it is refused, in edit order.
    """
    pairs = cut(merge_pairs(edits))  # read several times below
    if max_class_size is None:
        return _classes(pairs)
    kept, _ = capped_unions(pairs, max_class_size, group_rows)
    return _classes(kept, pairs)


def _classes(kept: DataFrame, named: DataFrame | None = None) -> DataFrame:
    named = kept if named is None else named
    labels = named.select("candidate_id", F.explode(F.array("label_a", "label_b")).alias("label")).distinct()
    e = kept.select("candidate_id", F.col("label_a").alias("src"), F.col("label_b").alias("dst"))
    return connected_components(labels, e, CAND, id_col="label", out="class")


def capped_unions(pairs: DataFrame, max_class_size: int, group_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The merge edits that the size limit lets through, and those it refuses.

    Whether an edit is refused depends only on the edits of the same uncapped
    class. Classes within the limit need no look at all. Others are folded in
    order, one class per group, while the class has at most ``group_rows``
    edits; larger ones are decided in rounds that touch disjoint classes.
    """
    uncapped = _classes(pairs)
    size = uncapped.groupBy("candidate_id", "class").agg(F.count(F.lit(1)).alias("_n"))
    tagged = pairs.join(uncapped.withColumnRenamed("label", "label_a"), ["candidate_id", "label_a"])
    edits_in = tagged.groupBy("candidate_id", "class").agg(F.count(F.lit(1)).alias("_m"))
    tagged = cut(tagged.join(size.join(edits_in, ["candidate_id", "class"]), ["candidate_id", "class"]))
    cols = ["candidate_id", "edit_seq", "label_a", "label_b"]
    free = tagged.filter(F.col("_n") <= max_class_size).select(*cols, F.lit(True).alias("ok"))
    tight = tagged.filter(F.col("_n") > max_class_size)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("edit_seq")
        owner: dict[str, list[str]] = {}
        verdict = []
        for a, b in zip(pdf["label_a"], pdf["label_b"]):
            ca, cb = owner.setdefault(a, [a]), owner.setdefault(b, [b])
            good = ca is cb or len(ca) + len(cb) <= max_class_size
            if good and ca is not cb:
                big, small = (ca, cb) if len(ca) >= len(cb) else (cb, ca)
                big.extend(small)
                owner.update((m, big) for m in small)
            verdict.append(good)
        return pdf[cols].assign(ok=verdict)

    schema = "candidate_id string, edit_seq long, label_a string, label_b string, ok boolean"
    small = tight.filter(F.col("_m") <= group_rows).select(*cols, "class").groupBy("candidate_id", "class").applyInPandas(
        fold, schema)
    decided = free.unionByName(small)
    large = cut(tight.filter(F.col("_m") > group_rows).select(*cols))
    if not is_empty(large):
        decided = decided.unionByName(_capped_rounds(large, max_class_size))
    decided = cut(decided)
    return decided.filter("ok").drop("ok"), decided.filter(~F.col("ok")).drop("ok")


def _capped_rounds(pairs: DataFrame, limit: int) -> DataFrame:
    """An edit can be decided once no earlier undecided edit touches either of its two classes."""
    state = cut(pairs.select("candidate_id", F.explode(F.array("label_a", "label_b")).alias("c")).distinct().select(
        "candidate_id", "c", F.lit(1).cast("bigint").alias("size")))
    live = cut(pairs.withColumns({"ca": F.col("label_a"), "cb": F.col("label_b")}))
    out: DataFrame | None = None
    while not is_empty(live):
        first = live.select("candidate_id", "edit_seq", F.explode(F.array("ca", "cb")).alias("c")).groupBy(
            "candidate_id", "c").agg(F.min("edit_seq").alias("_first"))
        ready = live
        for end in ("ca", "cb"):
            ready = ready.join(first.withColumnsRenamed({"c": end, "_first": f"_f{end}"}), ["candidate_id", end])
            ready = ready.join(state.withColumnsRenamed({"c": end, "size": f"_s{end}"}), ["candidate_id", end])
        ready = ready.filter((F.col("edit_seq") == F.col("_fca")) & (F.col("edit_seq") == F.col("_fcb")))
        ready = cut(ready.withColumn("ok", (F.col("ca") == F.col("cb")) | (F.col("_sca") + F.col("_scb") <= limit)))
        step = ready.select("candidate_id", "edit_seq", "label_a", "label_b", "ok")
        out = step if out is None else out.unionByName(step)
        joined = ready.filter(F.col("ok") & (F.col("ca") != F.col("cb")))
        move = joined.select("candidate_id", F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("_to"))
        state = cut(state.join(move, ["candidate_id", "c"], "left").groupBy(
            "candidate_id", F.coalesce("_to", "c").alias("c")).agg(F.sum("size").alias("size")))
        live = live.join(ready.select("candidate_id", "edit_seq"), ["candidate_id", "edit_seq"], "left_anti")
        for end in ("ca", "cb"):
            live = live.join(move.withColumnRenamed("c", end), ["candidate_id", end], "left").withColumn(
                end, F.coalesce("_to", end)).drop("_to")
        live = cut(live.select(*pairs.columns, "ca", "cb"))
    return out


def class_members(classes: DataFrame) -> DataFrame:
    """``candidate_id, class, label, n_members``: one row per member, so that no class is gathered in one place."""
    size = classes.groupBy("candidate_id", "class").agg(F.count(F.lit(1)).alias("n_members"))
    return classes.join(size, ["candidate_id", "class"])


# --- partition by location ------------------------------------------------------------------------------------------


def assign_seed_euclid(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """Points (``candidate_id, label, x, y, z``) with the ``suffix`` of the nearest seed of their label; ties to the earlier seed.

    Seeds come to the points in arrays of at most ``CHUNK``, one after the other, with a running best; a point stays one row.
    """
    key = ["candidate_id", "label"]
    packed = seeds.groupBy(*key, F.floor(F.col("seed_idx") / CHUNK).alias("_chunk")).agg(
        F.collect_list(F.struct("seed_idx", "suffix", "x", "y", "z")).alias("_seeds"))
    ranked = F.transform("_seeds", lambda s: F.struct(
        sum(((F.col(c) - s[c]) * (F.col(c) - s[c]) for c in XYZ), F.lit(0.0)).alias("d2"), s["seed_idx"].alias("i"),
        s["suffix"].alias("suffix")))
    out = points.join(merged(seeds.select(*key).distinct()), BY_LABEL, "left_semi").withColumn("_best", F.lit(None).cast("struct<d2:double,i:int,suffix:string>"))
    for c in range(int((seeds.agg(F.max("seed_idx")).first()[0] or 0) // CHUNK) + 1):
        part = packed.filter(F.col("_chunk") == c).drop("_chunk")
        better = F.least("_best", F.array_min(ranked).cast("struct<d2:double,i:int,suffix:string>"))
        out = out.join(merged(part), BY_LABEL, "left").withColumn("_best", better).drop("_seeds")
    return out.withColumn("suffix", F.col("_best.suffix")).drop("_best")


def split_nodes(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes of the labels that some candidate splits, once per such candidate."""
    wanted = seeds.select("candidate_id", "label").distinct()
    return nodes.join(merged(wanted), "label")


def partition_by_path(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, start: float = 5.0) -> DataFrame:
    """Side of every fragment node by path length to the seeds: ``candidate_id, node_id, label, x, y, z, suffix, dist``.

    ``nodes`` come from ``split_nodes``; ``edges`` are (src, dst). Each seed snaps
    to the nearest node of its label, a later seed wins the same node. Chains are
    contracted first, so the relaxation needs as many rounds as there are
    junctions on a path, not nodes. Nodes no seed can reach go by straight line.
    """
    nodes = cut(nodes.select("candidate_id", "node_id", "label", *XYZ))
    ends = nodes.select("candidate_id", F.col("node_id").alias("src"), F.col("label").alias("_ls"))
    other = nodes.select("candidate_id", F.col("node_id").alias("dst"), F.col("label").alias("_ld"))
    inner = cut(edges.select("src", "dst").join(merged(ends), "src").join(merged(other), ["dst", "candidate_id"]).filter(
        F.col("_ls") == F.col("_ld")).select("candidate_id", "src", "dst"))

    probe = seeds.withColumn("seed_key", F.concat_ws("#", "label", "seed_idx"))
    snap = nearest(probe.select("candidate_id", "label", "seed_key", *XYZ), as_build(nodes, by=BY_LABEL),
                   probe_id="seed_key", build_id="b_id", radius=start, by=BY_LABEL, bounded=False)
    sources = snap.join(merged(probe.select("candidate_id", "label", "seed_key", "seed_idx")), ["seed_key", *BY_LABEL])
    sources = cut(sources.groupBy("candidate_id", F.col("b_id").alias("node_id")).agg(F.max("seed_idx").alias("seed_idx")))

    directed = directed_edges(nodes, inner, sources, CAND)
    chains = cut(chain_ends(directed, CAND))
    # nodes a walk may pass are chain interiors, all others are junctions of the contracted graph
    passing = directed.filter("passes").select("candidate_id", F.col("v").alias("u")).distinct()
    links = cut(chains.join(merged(passing), ["u", "candidate_id"], "left_anti").groupBy(
        "candidate_id", F.col("u").alias("node_id"), "end").agg(F.min("cable").alias("cable")))

    seen = sources.select("candidate_id", "node_id", F.struct(F.lit(0.0).alias("dist"), "seed_idx").alias("best"))
    frontier = seen
    while True:
        onward = frontier.join(merged(links), ["node_id", "candidate_id"]).groupBy("candidate_id", F.col("end").alias("node_id")).agg(
            F.min(F.struct(F.round(F.col("best.dist") + F.col("cable"), 9).alias("dist"), F.col("best.seed_idx"))).alias("_new"))
        frontier = cut(onward.join(merged(seen), ["node_id", "candidate_id"], "left").filter(
            F.col("best").isNull() | (F.col("_new") < F.col("best"))).select("candidate_id", "node_id", F.col("_new").alias("best")))
        if is_empty(frontier):
            break
        seen = cut(seen.unionByName(frontier).groupBy("candidate_id", "node_id").agg(F.min("best").alias("best")))

    inside = chains.join(merged(passing), ["u", "candidate_id"], "left_semi").join(
        merged(seen.select("candidate_id", F.col("node_id").alias("end"), "best")), ["end", "candidate_id"]).groupBy(
        "candidate_id", F.col("u").alias("node_id")).agg(F.min(F.struct(
            F.round(F.col("best.dist") + F.col("cable"), 9).alias("dist"), F.col("best.seed_idx"))).alias("best"))
    side = seen.unionByName(inside).select("candidate_id", "node_id", "best.dist", "best.seed_idx")
    reached = cut(nodes.join(merged(side), ["node_id", "candidate_id"], "left"))  # read twice
    by_path = reached.filter(F.col("seed_idx").isNotNull()).join(
        merged(seeds.select("candidate_id", "label", "seed_idx", "suffix")), [*BY_LABEL, "seed_idx"]).drop("seed_idx")
    rest = reached.filter(F.col("seed_idx").isNull()).drop("seed_idx")
    return by_path if is_empty(rest) else by_path.unionByName(assign_seed_euclid(rest, seeds))


def assign_side(points: DataFrame, partition: DataFrame, start: float = 5.0) -> DataFrame:
    """Points (``candidate_id, label, node_id, x, y, z``) with the side of the nearest partitioned node of their label."""
    hit = nearest(points, as_build(partition, keep={"suffix": "suffix"}, by=BY_LABEL), probe_id="node_id",
                  build_id="b_id", radius=start, by=BY_LABEL, carry=["suffix"], bounded=False)
    return points.join(merged(hit.select("candidate_id", "label", "node_id", "suffix")), ["node_id", *BY_LABEL], "left")


def resolve_sides(points: DataFrame, partition: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nearest partitioned node where the label has a fragment graph, nearest seed by straight line elsewhere."""
    sided = cut(assign_side(points, partition))  # read twice
    rest, found = sided.filter(F.col("suffix").isNull()).drop("suffix"), sided.filter(F.col("suffix").isNotNull())
    return found if is_empty(rest) else found.unionByName(assign_seed_euclid(rest, seeds))


def pseudo(label: str = "label", suffix: str = "suffix") -> Column:
    return F.concat(F.col(label), F.lit(PSEUDO_SEP), F.col(suffix))


def split_fragments(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """Pieces of the split fragments: cross-side edges dropped, one piece per component, nodes renumbered from 0."""
    side = partition.withColumn("pseudo", pseudo())
    a = side.select("candidate_id", F.col("node_id").alias("src"), F.col("pseudo").alias("_a"))
    b = side.select("candidate_id", F.col("node_id").alias("dst"), F.col("pseudo").alias("_b"))
    kept = edges.select("src", "dst").join(a, "src").join(b, ["candidate_id", "dst"]).filter(F.col("_a") == F.col("_b"))
    pieces = connected_components(side, kept.select("candidate_id", "src", "dst"), CAND, out="piece")
    ranked = global_rank(pieces, [F.col("candidate_id"), F.col("piece"), F.col("node_id")], "_g")
    first = ranked.groupBy("candidate_id", "piece").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n_nodes"))
    return ranked.join(first, ["candidate_id", "piece"]).withColumn("new_id", F.col("_g") - F.col("_first")).drop("_g", "_first")


def apply_edits(nodes: DataFrame, frag_node: DataFrame, frag_edge: DataFrame, edits: DataFrame, label: str = "raw_label",
                max_class_size: int | None = None) -> DataFrame:
    """Edited labels of the nodes each candidate touches: ``candidate_id, node_id, old_label, new_label``.

    Location decides first, then the classes; background never changes. Nodes
    that keep their label are not listed.
    """
    classes = merge_classes(edits, max_class_size)
    sides = split_sides(nodes, frag_node, frag_edge, edits, label)
    split = sides.select("candidate_id", "node_id", F.col("label").alias("old_label"), pseudo().alias("label"))
    plain = nodes.filter(F.col(label) != BACKGROUND).select("node_id", F.col(label).alias("label"), F.col(label).alias("old_label"))
    merged = plain.join(classes, "label").select("candidate_id", "node_id", "old_label", F.col("class").alias("new_label"))
    # a label that is split has no nodes left under its raw name
    merged = merged.join(sides.select("candidate_id", "node_id"), ["candidate_id", "node_id"], "left_anti")
    split = split.join(classes, ["candidate_id", "label"], "left").select(
        "candidate_id", "node_id", "old_label", F.coalesce("class", "label").alias("new_label"))
    return split.unionByName(merged).filter(F.col("old_label") != F.col("new_label"))


def split_sides(nodes: DataFrame, frag_node: DataFrame, frag_edge: DataFrame, edits: DataFrame, label: str = "raw_label") -> DataFrame:
    """``candidate_id, node_id, label, suffix`` of the true nodes whose label some candidate splits."""
    seeds = cut(split_seeds(edits))
    points = nodes.filter(F.col(label) != BACKGROUND).select("node_id", F.col(label).alias("label"), *XYZ)
    points = split_nodes(points, seeds)
    if is_empty(seeds):
        return points.withColumn("suffix", F.lit(None).cast("string")).select("candidate_id", "node_id", "label", "suffix")
    partition = cut(partition_by_path(split_nodes(frag_node.select("node_id", "label", *XYZ), seeds), frag_edge, seeds))
    return cut(resolve_sides(points, partition, seeds).select("candidate_id", "node_id", "label", "suffix"))


def fill_background_runs(nodes: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """Background stretches whose labelled neighbours all share one label take that label.

    This definition is ours and optional: the original correction is only known by description.
    """
    zero = nodes.filter(F.col(label) == BACKGROUND).select("node_id")
    inner = edges.join(zero.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        zero.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    comp = cut(connected_components(zero, inner.select("src", "dst")))
    touch = symmetric(edges).join(comp.withColumnRenamed("node_id", "src"), "src").join(
        nodes.filter(F.col(label) != BACKGROUND).select(F.col("node_id").alias("dst"), F.col(label).alias("_l")), "dst")
    fill = touch.groupBy("component").agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi")).filter(F.col("_lo") == F.col("_hi"))
    filled = comp.join(fill, "component").select("node_id", "_lo")
    return nodes.join(filled, "node_id", "left").withColumn("filled_label", F.coalesce("_lo", label)).drop("_lo")


def label_report_set(targets: DataFrame, edits: DataFrame) -> DataFrame:
    """Labels a failure report may name: those of the targets and of the candidate's own edits."""
    own = edits.select(F.explode(F.array("label", "label_a", "label_b")).alias("label")).filter(F.col("label").isNotNull())
    return targets.select("label").union(own).distinct()


def edit_histogram(edits: DataFrame) -> DataFrame:
    return edits.groupBy("candidate_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def render_edits(edits: DataFrame, limit: int = 40, order: Sequence[str] = ("edit_seq",)) -> DataFrame:
    """The first ``limit`` edits of each candidate as text, with the total number of edits."""
    total = edits.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_edits"))
    # rows for the report only: the limit is the feature here
    shown = edits.withColumn("_r", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order))).filter(F.col("_r") <= limit)

    def at(i):
        s = F.col("seeds")[i]
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.format_number(s[c], 1) for c in XYZ]), F.lit(")"))

    text = (F.when(F.col("kind") == MERGE, F.concat(F.lit("merge("), "label_a", F.lit(", "), "label_b", F.lit(")")))
            .when(F.col("kind") == SPLIT, F.concat(F.lit("split("), "label", F.lit(" @ "), at(0), F.lit("|"), at(1), F.lit(")")))
            .otherwise(F.col("kind")))
    return shown.withColumn("_t", text).groupBy("candidate_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda s: s["_t"]), ", ").alias("edits")).join(
        total, "candidate_id")
