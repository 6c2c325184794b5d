"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from dendrospark.operators import edits as E
from dendrospark.plans import catalog, scoring
from dendrospark.plans.derived import tables
from dendrospark.plans.metric_queries import brain, merge_edits
from dendrospark.session import local_session

HEADLINE = [
    "flagship_edge_classes_per_neuron", "j1_split_sites", "j3_nearest_label", "j14_mutual_nearest_tips", "a2_edge_class_counts",
    "a6_merge_targets", "a10_erl", "g1_connected_components", "g7_merge_sites_branch", "g8_merge_sites_bridge",
    "g9_merge_sites_component", "e3_merge_classes", "e6_apply_split_edits", "p19_rasterize_edges", "x3_mann_whitney",
    "w3_rank_surprise", "a20_cross_dataset_cv",
]


def force(df) -> int:
    """Run the whole plan, all columns, without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    catalog.load_all()
    t = tables(spark, sf_dir)
    times: dict[str, float] = {}

    start = time.time()
    for name in ("gt_node", "gt_edge", "frag_node", "frag_edge", "kink_node", "kink_edge", "gt_labelled_edge"):
        getattr(t, name).count()
    times["derive_graphs"] = round(time.time() - start, 3)

    for name in HEADLINE:
        start = time.time()
        force(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)

    start = time.time()
    prepared = brain(t)
    times["a16_prepare"] = round(time.time() - start, 3)
    base = merge_edits(t)
    for n in (1, 10, 100):
        # every candidate has the full list of edits
        names = [f"c{i}" for i in range(n)]
        edits = base.withColumn("candidate_id", F.explode(F.array(*[F.lit(c) for c in names]))).select(*E.EDIT_SCHEMA.fieldNames())
        start = time.time()
        force(scoring.score(prepared, edits, names))
        times[f"a16_score_{n}_candidates"] = round(time.time() - start, 3)

    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
