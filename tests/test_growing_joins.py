"""Sides of joins that grow with the tables are never broadcast, and greedy picks look at no more points than they need."""

import random

from pyspark.sql import functions as F

from dendrospark.operators import greedy as GR
from dendrospark.operators import sites as SI
from dendrospark.operators import spatial as SP
from dendrospark.operators import walk as W

NODE = "node_id long, x double, y double, z double"


def plain_pick(points, k, separation):
    kept = []
    for p in sorted(points):
        if len(kept) < k and all(sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])) >= separation**2 for q in kept):
            kept.append(p)
    return [p[0] for p in kept]


def test_pick_looks_at_more_points_only_until_enough_are_picked(spark, monkeypatch):
    draw, seen, whole = random.Random(3), [], GR.suppress
    # the best 200 points stand in one place, so the first look at 64 x 2 points picks one point only
    points = [(i, draw.random(), 0.0, 0.0) if i < 200 else (i, 50.0 * i, 0.0, 0.0) for i in range(6000)]

    def counted(df, *args, **kw):
        seen.append(df.count())
        return whole(df, *args, **kw)

    monkeypatch.setattr(GR, "suppress", counted)
    df = spark.createDataFrame(points, NODE)
    assert sorted(r[0] for r in GR.pick_spread(df, [F.col("node_id")], 2, 6.0).select("node_id").collect()) == plain_pick(points, 2, 6.0)
    assert seen == [128, 2048]
    # fewer points than asked for: all are looked at; two scopes do not meet
    few = [(s, *p) for s in "ab" for p in points[:150] + points[300:302]]
    got = GR.pick_spread(spark.createDataFrame(few, "s string, " + NODE), [F.col("node_id")], 4, 6.0, by=["s"])
    want = plain_pick([p[1:] for p in few[:152]], 4, 6.0)
    assert sorted((r["s"], r["node_id"]) for r in got.collect()) == [(s, i) for s in "ab" for i in want]


def test_walks_and_distance_joins_are_not_broadcast(spark):
    nodes = spark.createDataFrame([(i, "l", 5.0 * i, 0.0, 0.0, 1.0) for i in range(40)], "node_id long, label string, x double, y double, z double, radius double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    directed, tables = W.chain_tables(nodes, edges, 24.0)
    ends = W.arm_ends(W.start_arms(nodes, directed, nodes), tables, 24.0)
    near = SP.within_distance(nodes.select("node_id", "x", "y", "z"), SP.as_build(nodes), 6.0)
    pairs = SI.tip_pairs(nodes, edges)
    for df in (ends, near, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_far_probes_skip_the_ball_search(spark, monkeypatch):
    looked, plain = [], SP.within_distance

    def counted(probe, *args, **kw):
        looked.append(probe.count())
        return plain(probe, *args, **kw)

    monkeypatch.setattr(SP, "within_distance", counted)
    gt = spark.createDataFrame([(i, 5.0 * i + far, 0.0, 0.0) for i, far in [(0, 0.0), (1, 0.0), (2, 10_000.0), (3, -10_000.0)]], NODE)
    frag = spark.createDataFrame([(i, 5.0 * i, 1.0, 0.0) for i in range(20)], NODE)
    got = {r["node_id"]: (r["b_id"], r["d2"]) for r in SP.nearest_distance(gt, frag, 5.0).collect()}
    assert got == {0: (0, 1.0), 1: (1, 1.0), 2: (19, 9915.0**2 + 1), 3: (0, 9985.0**2 + 1)}
    assert looked == [2]


def test_detectors_walk_all_arms_together(spark, monkeypatch):
    """A walk reads the tables of steps whole, however few its starts: one walk to the ends of all arms, one to the seeds of the sites."""
    kink = [(i, "k", 5.0 * abs(i - 5), 2.0 * i, 0.0, 1.0) for i in range(11)]
    fork = [(20, "f", 500.0, 0.0, 0.0, 1.0)] + [(21 + 5 * k + i, "f", 500.0 + 5.0 * (i + 1) * dx, 5.0 * (i + 1) * dy, 0.0, 1.0)
                                              for k, (dx, dy) in enumerate([(1, 0), (0, 1), (-1, 0)]) for i in range(5)]
    nodes = spark.createDataFrame(kink + fork, "node_id long, label string, x double, y double, z double, radius double")
    pairs = [(i, i + 1) for i in range(10)] + [(20 if i == 0 else 20 + 5 * k + i, 21 + 5 * k + i) for k in range(3) for i in range(5)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    walks, plain = [], W.walk_until
    monkeypatch.setattr(W, "walk_until", lambda *a, **k: walks.append(1) or plain(*a, **k))
    assert {(r.detector, r.cut_node) for r in SI.merge_sites(nodes, edges).collect()} == {("branch", 20), ("bridge", 5)}
    assert len(walks) == 2


def test_descent_of_far_probes_goes_by_blocks(spark, monkeypatch):
    """Rows that go down the pyramid are blocks of probes, not probes: 4,096 far probes in few blocks write few rows at each level."""
    probes = [(i, 50_000.0 + i % 16, float(i // 16 % 16), float(i // 256)) for i in range(4096)]
    build = [(i, float(i % 7), 40.0 * i, 0.0) for i in range(300)]
    written, plain = [], SP.cut

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(SP, "cut", counted)
    got = SP._descend(spark.createDataFrame(probes, NODE), SP.as_build(spark.createDataFrame(build, NODE)).select("b_id", "bx", "by", "bz"),
                      ["node_id"], "b_id", 0.25, [], [], ("x", "y", "z"), ("bx", "by", "bz"))
    want = {p[0]: min((sum((u - v) ** 2 for u, v in zip(p[1:], q[1:])), q[0]) for q in build)[1] for p in probes}
    assert {r.node_id: r.b_id for r in got.collect()} == want
    assert sorted(written)[-2] < 4096 and sum(written) < 3 * 4096


def test_policies_run_the_detectors_of_their_kind_only(spark, monkeypatch):
    """A policy on split sites does not look for merge sites, and one on merge sites not for split sites; numbers are those of the whole stream."""
    from types import SimpleNamespace

    from dendrospark.plans import policy_queries as PQ

    split = spark.createDataFrame([(9, 8, 2.0), (3, 4, 1.0), (1, 2, 2.0)], "node_a long, node_b long, gap_um double")
    merge = spark.createDataFrame([(5, 6, 10.0, 12.0), (6, 7, 30.0, 11.0)], "cut_node long, seed_b_node long, cable_a_um double, cable_b_um double")
    asked, t = [], SimpleNamespace(frag_node=None, frag_edge=None)
    monkeypatch.setattr(SI, "split_sites", lambda *_, **__: asked.append("split") or split)
    monkeypatch.setattr(SI, "merge_sites", lambda *_, **__: asked.append("merge") or merge)

    def found(df, node):
        return [r[node] for r in df.orderBy("site_seq").collect()]

    assert found(PQ.sites(t, "split"), "node_a") == [3, 1, 9] and asked == ["split"]
    assert found(PQ.sites(t, "merge"), "cut_node") == [6, 5] and asked == ["split", "merge"]
    whole = PQ.P.number_sites(SI.site_stream(split, merge))
    key = ["site_seq", "kind", "node_a", "cut_node"]
    assert sorted(map(repr, PQ.stream(t).select(*key).collect())) == sorted(map(repr, whole.select(*key).collect()))
    assert asked == ["split", "merge"]


def test_merge_count_prepares_no_scores(spark, monkeypatch):
    """The count of pieces needs label-neuron counts only, and the pieces of labels that lie on several neurons."""
    from dendrospark.plans import catalog
    from dendrospark.plans import metric_queries as MQ
    from dendrospark.plans.derived import tables

    catalog.load_all()
    split, seen = MQ.G.connected_components, []

    def counted(nodes, *args, **kw):
        seen.append(nodes.count())
        return split(nodes, *args, **kw)

    def refused(*_):
        raise AssertionError("the whole state for scoring was prepared")

    monkeypatch.setattr(MQ, "brain", refused)
    monkeypatch.setattr(MQ.G, "connected_components", counted)
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["a17_merge_count"](spark, sf).count() > 0
    assert 0 < seen[-1] < tables(spark, sf).frag_node.count()


def test_wide_cells_find_the_same_nearest(spark):
    draw = random.Random(5)
    probe = [(i % 3, i, *[draw.uniform(-40, 40) for _ in "xyz"]) for i in range(200)]
    build = [(i % 2, i, *[draw.uniform(-30, 30) for _ in "xyz"]) for i in range(150)]
    p = spark.createDataFrame(probe, "s long, node_id long, x double, y double, z double")
    b = spark.createDataFrame(build, "s long, b_id long, bx double, by double, bz double")
    got = [sorted(tuple(r) for r in SP.nearest(p, b, probe_id="node_id", build_id="b_id", radius=8.0, by=["s"], bounded=False, side=side).select(
        "s", "node_id", "b_id").collect()) for side in (None, 64.0)]
    want = sorted((s, i, min((sum((u - v) ** 2 for u, v in zip(at, r[2:])), r[1]) for r in build if r[0] == s)[1]) for s, i, *at in probe if s < 2)
    assert got[0] == want and got[1] == want


def test_truth_is_looked_up_at_the_ends_of_proposals_only(spark, monkeypatch):
    from dendrospark.plans import spatial_queries as SQ
    from dendrospark.plans.derived import tables

    t, seen, whole = tables(spark, "/root/testdata/sf0.001"), [], SQ.SP.nearest

    def counted(probe, *args, **kw):
        seen.append(probe.count())
        return whole(probe, *args, **kw)

    monkeypatch.setattr(SQ.SP, "nearest", counted)
    truth = SQ._proposal_truth(t, max_projection=2.3)
    ends = truth.select(F.explode(F.array("node_a", "node_b"))).distinct().count()
    assert seen[0] == ends < t.frag_node.count()


def test_image_of_cuts_is_not_broadcast(spark):
    """Samples of the chords, voxels, profiles and confirmed cuts all grow with the tables."""
    from dendrospark.operators import policy as P

    seeds = ", ".join(f"seed_{t}_node long, " + ", ".join(f"seed_{t}_{c} double" for c in "xyz") for t in "ab")
    made = [(n, "merge", "component", str(n), 20.0, 20.0, None, None, 0, n, 0.0, y, 0.0, n + 100, 96.0, y, 0.0) for n, y in [(1, 0.0), (2, 400.0)]]
    sites = spark.createDataFrame(made, "site_seq long, kind string, detector string, label string, cable_a_um double, cable_b_um double, angle_deg double, "
                                        "radius_ratio double, branch_degree long, " + seeds)
    # dark halfway along the first chord only
    light = [(0, y, x, 1.0 if y == 0 and 36 <= x < 60 else 10.0) for y in (0, 400) for x in range(-8, 108)]
    voxels = spark.createDataFrame(light, "z long, y long, x long, value double")
    edits = P.policy_merge_cut(sites, P.Context(None, None, voxels))
    assert [r.edit_seq for r in edits.collect()] == [1]
    assert "Broadcast" not in edits._jdf.queryExecution().executedPlan().toString()


def test_scores_of_several_brains_by_numbers(spark, monkeypatch):
    """Ids of several brains are numbers where they fit, and no growing side is broadcast when edits are scored."""
    from dendrospark.operators import edits as E
    from dendrospark.plans import scoring as SC

    node = "brain string, node_id long, neuron long, raw_label string, x double, y double, z double"
    # one label over two neurons, a background node inside of the second; ids reach below zero and differ in range
    made = [(b, i + at, 1 + (i > 5), "0" if i == 8 else "l", 5.0 * i, 40.0 * (i > 5), 0.0) for b, at in (("a", -3), ("b", 7)) for i in range(12)]
    gt = spark.createDataFrame(made, node)
    pairs = [(b, i + at, i + 1 + at) for b, at in (("a", -3), ("b", 7)) for i in range(11) if i != 5]
    neuron = {(r[0], r[1]): r[2] for r in made}
    edge = spark.createDataFrame([(b, u, v, neuron[b, u]) for b, u, v in pairs], "brain string, src long, dst long, neuron long")
    frag = gt.filter("raw_label <> '0'").withColumnRenamed("raw_label", "label")
    kept = {(r.brain, r.node_id) for r in frag.collect()}
    inner = spark.createDataFrame([p for p in pairs if {(p[0], p[1]), (p[0], p[2])} <= kept], "brain string, src long, dst long")
    number = SC.numbered([gt, frag], ["brain"])
    seen = SC.pooled(gt.union(gt.limit(1).withColumn("node_id", F.lit(99).cast("bigint"))), ["brain"], ids=["node_id"], number=number)
    assert [r[0] for r in seen.select("node_id").orderBy(F.col("node_id").asc_nulls_last()).collect()] == [*range(24), None]
    wide = spark.createDataFrame([("a", -2**62), ("a", 2**62)], "brain string, node_id long")
    assert SC.numbered([wide], ["brain"]) is None
    seeds = [[(None, 0.0, 0.0, 0.0, None), (None, 55.0, 40.0, 0.0, None)]]
    edits = spark.createDataFrame([("split", k, E.SPLIT, None, None, f"{b}/l", *seeds) for k, b in enumerate("ab")], E.EDIT_SCHEMA)
    plans, plain = [], SC.cut

    def read(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    def scored(number):
        ids = lambda df, *c: SC.pooled(df, ["brain"], ids=c, names=["neuron"] if "neuron" in df.columns else [], number=number)
        brain = SC.prepare(SC.pooled(gt, ["brain"], ids=["node_id"], labels=["raw_label"], names=["neuron"], number=number), ids(edge, "src", "dst"),
                           SC.pooled(frag, ["brain"], ids=["node_id"], labels=["label"], number=number), ids(inner, "src", "dst"), min_nodes=1)
        return sorted(map(repr, SC.score(brain, edits, ["split"]).orderBy("neuron").collect()))

    monkeypatch.setattr(SC, "cut", read)
    monkeypatch.setattr(E, "cut", read)
    got = scored(number)
    assert plans and not [line for p in plans for line in p.splitlines() if "Broadcast" in line]
    # both brains have one shape
    assert len(got) == 4 and got[2:] == [r.replace("a/", "b/") for r in got[:2]] and got[0] != got[1].replace("a/2", "a/1")
