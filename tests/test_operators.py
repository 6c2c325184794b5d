"""Spatial, graph, greedy, gate and reader checks against plain loops."""

import itertools
import math
import random

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from dendrospark import session
from dendrospark.functions.scalar import belief_label, direction
from dendrospark.operators import graph as G
from dendrospark.operators import greedy as GR
from dendrospark.operators import metrics as M
from dendrospark.operators import ordering as O
from dendrospark.operators import policy as P
from dendrospark.operators import ranking as RK
from dendrospark.operators import sites as SI
from dendrospark.operators import spatial as SP
from dendrospark.operators import statistic as ST
from dendrospark.operators import voxel as V
from dendrospark.operators import walk as W
from dendrospark.plans.derived import Tables
from dendrospark.sources import readers as RD

NODE = "node_id long, x double, y double, z double"


def cloud(n, seed, spread=40.0, hot=0.0):
    """Random points; a share of them crowds into one small place."""
    rng = random.Random(seed)
    return [(i, *(rng.uniform(-0.5, 0.5) if rng.random() < hot else rng.uniform(-spread, spread) for _ in range(3))) for i in range(n)]


def d2(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4]))


@pytest.mark.parametrize("hot_rows", [500_000, 10])
def test_within_distance_also_when_a_cell_is_hot(spark, hot_rows):
    a, b = cloud(200, 1, hot=0.4), cloud(300, 2, hot=0.4)
    got = SP.within_distance(spark.createDataFrame(a, NODE), SP.as_build(spark.createDataFrame(b, NODE)), 9.0, hot_rows=hot_rows)
    pairs = [(r.node_id, r.b_id) for r in got.collect()]
    want = {(p[0], q[0]) for p in a for q in b if d2(p, q) <= 81.0}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("shift", [0, 50_000])
@pytest.mark.parametrize("bounded", [True, False])
def test_nearest(spark, bounded, shift):
    a, b = [(i, x + shift, *rest) for i, x, *rest in cloud(150, 3, hot=0.3)], cloud(150, 4, hot=0.3)
    got = SP.nearest(spark.createDataFrame(a, NODE), SP.as_build(spark.createDataFrame(b, NODE)), probe_id="node_id", build_id="b_id",
                     radius=8.0, bounded=bounded)
    want = {}
    for p in a:
        best = min((d2(p, q), q[0]) for q in b)
        if not bounded or best[0] <= 64.0:
            want[p[0]] = best[1]
    rows = got.collect()
    assert len(rows) == len(want) and {r.node_id: r.b_id for r in rows} == want


@pytest.mark.parametrize("leaf_rows", [1, 64])
def test_descent_keeps_scopes_and_ties(spark, leaf_rows):
    """Every probe goes down the pyramid: several scopes, fine and coarse structure, negative places, ties to the smaller id."""
    rng = random.Random(12)
    scale = [1.0, 30.0, 4000.0]
    b = [(s, i, *[rng.choice([-1, 1]) * rng.random() * scale[i % 3] for _ in range(3)]) for s in "xy" for i in range(120)]
    b += [("x", 500, 7.0, 0.0, 0.0), ("x", 400, -7.0, 0.0, 0.0)] + [("z", i, 1e-3 * i, 0.0, 0.0) for i in range(40)]
    a = [(s, i, rng.uniform(-9000, 9000), rng.uniform(-50, 50), 0.0) for s in "xyzw" for i in range(40)] + [("x", 99, 0.0, 0.0, 0.0)]
    build = spark.createDataFrame(b, "s string, b_id long, bx double, by double, bz double")
    probe = spark.createDataFrame(a, "s string, node_id long, x double, y double, z double")
    got = SP._descend(probe.filter("s <> 'w'"), build, ["s", "node_id"], "b_id", 0.5, ["s"], [], ("x", "y", "z"), ("bx", "by", "bz"), leaf_rows).collect()
    want = {(s, i): min(((x - q[2]) ** 2 + (y - q[3]) ** 2 + (z - q[4]) ** 2, q[1]) for q in b if q[0] == s)[1] for s, i, x, y, z in a if s != "w"}
    assert len(got) == len(want) and {(r.s, r.node_id): r.b_id for r in got} == want


def test_components_of_random_graphs_and_long_chains(spark):
    rng = random.Random(7)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(200)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    nodes = sorted(set(range(300)) | set(range(1000, 1201)))
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = G.connected_components(spark.createDataFrame([(n,) for n in nodes], "node_id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node_id: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_rings_end_and_belong_to_no_chain(spark):
    nodes = [(i, float(i), 0.0, 0.0) for i in range(9)]
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (6, 8)]
    table, members = W.chains(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src long, dst long"))
    assert {(r.start, r.end, r.cable) for r in table.collect()} == {(4, 6, 2.0), (6, 7, 1.0), (6, 8, 2.0)}
    assert members.count() == 4


def test_suppression_like_one_pass(spark):
    pts = cloud(250, 9, 25.0, hot=0.3)
    scored = [(*p, float(i * 7 % 100)) for i, p in enumerate(pts)]
    kept = []
    for p in sorted(scored, key=lambda p: (-p[4], p[0])):
        if all(d2(p, k) >= 36.0 for k in kept):
            kept.append(p)
    df = spark.createDataFrame(scored, NODE + ", score double")
    got = GR.suppress(df, [-F.col("score")], 6.0)
    assert {r.node_id for r in got.collect()} == {p[0] for p in kept}
    first = GR.pick_spread(df, [-F.col("score")], 5, 6.0)
    assert {r.node_id for r in first.collect()} == {p[0] for p in kept[:5]}


@pytest.mark.parametrize("step", [0.6, 0.9])
def test_suppression_decides_chains_in_few_rounds(spark, step):
    """A line of points, each better than the next, of two scopes; also ties and coincident points."""
    n, rng = 3000, random.Random(8)
    pts = [(s, i, i * step, 0.0, 0.0, float(i)) for s in "ab" for i in range(n)]
    pts += [("c", i, rng.random() * 30, rng.random() * 2, 0.0, float(i % 5)) for i in range(300)] + [("c", 400 + i, 1.0, 1.0, 1.0, 0.0) for i in range(30)]
    want = set()
    for s in "abc":
        kept = []
        for p in sorted((p for p in pts if p[0] == s), key=lambda p: (p[5], p[1])):
            if all(sum((u - v) ** 2 for u, v in zip(p[2:5], q[2:5])) >= 1.0 for q in (kept[-4:] if s != "c" else kept)):
                kept.append(p)
        want |= {p[:2] for p in kept}
    before = len(session.WRITTEN)
    got = GR.suppress(spark.createDataFrame(pts, "s string, " + NODE + ", score double"), [F.col("score")], 1.0, by=["s"])
    assert {(r.s, r.node_id) for r in got.collect()} == want and got.count() == len(want)
    assert step < 0.9 or len(session.WRITTEN) - before < 90


def test_reach_of_suppression_is_narrow_and_never_broadcast(spark):
    """Rows that are repeated for what is near must not go to the driver: the planner takes them for as few as before."""
    cells = spark.createDataFrame([(i, *c) for i, c in enumerate(itertools.product(range(-3, 4), repeat=3))], "node_id long, _gx long, _gy long, _gz long")
    reach = GR._in_reach(cells, [F.col("node_id").alias("_mine")])
    assert reach.count() == 8 * cells.count()
    pairs = GR._in_blocks(cells).join(reach, list(GR._BLOCK))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    met = {(r._mine, r.node_id) for r in pairs.collect()}
    at = {r.node_id: r[1:] for r in cells.collect()}
    assert all((i, j) in met for i in at for j in at if all(abs(u - v) <= 2 for u, v in zip(at[i], at[j])))


def test_derived_graphs_are_written_once_and_detectors_share_their_chains(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    for kept in (t.gt_node, t.frag_edge):
        assert kept.storageLevel == StorageLevel.NONE and all(session.shared_dir(spark).split(":")[-1] in f for f in kept.inputFiles())
    calls = []
    made = W.directed_edges
    monkeypatch.setattr(W, "directed_edges", lambda *a, **k: calls.append(1) or made(*a, **k))
    found = SI.merge_sites(t.frag_node, t.frag_edge)
    assert len(calls) == 1
    alone = SI.merge_sites_branch(t.frag_node, t.frag_edge).unionByName(SI.merge_sites_bridge(t.frag_node, t.frag_edge)).unionByName(
        SI.merge_sites_component(t.frag_node, t.frag_edge))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)


def test_matching_decides_chains_in_few_rounds(spark):
    """10,000 edges in rising order along one path; parallel edges and a comb beside it."""
    rows = [(i, i, i + 1, float(i)) for i in range(10_000)]
    rows += [(20_000 + i, 20_000 + i // 3, 20_001 + i // 3, float(i % 7)) for i in range(600)]
    rows += [(30_000 + i, 30_000 + i, 40_000 + i, float(i % 3)) for i in range(50)] + [(31_000 + i, 30_000 + i, 30_001 + i, 1.0) for i in range(49)]
    used, kept = set(), set()
    for i, a, b, _ in sorted(rows, key=lambda e: (e[3], e[0])):
        if a not in used and b not in used:
            kept.add(i)
            used |= {a, b}
    before = len(session.WRITTEN)
    got = GR.greedy_matching(spark.createDataFrame(rows, "edge_id long, a long, b long, score double"), [F.col("score")])
    assert {r.edge_id for r in got.collect()} == kept
    assert len(session.WRITTEN) - before < 60  # 14 doublings in the first round, four tables a round besides


def random_edges(seed, n=120, v=40):
    rng = random.Random(seed)
    return [(i, rng.randrange(v), rng.randrange(v, 2 * v) if rng.random() < 0.5 else rng.randrange(v), round(rng.random(), 1)) for i in range(n)]


def test_greedy_matching_budget_and_cap(spark):
    rows = [e for e in random_edges(11) if e[1] != e[2]]
    used, kept = set(), []
    for e in sorted(rows, key=lambda e: (-e[3], e[0])):
        if e[1] not in used and e[2] not in used:
            kept.append(e[0])
            used |= {e[1], e[2]}
    df = spark.createDataFrame(rows, "edge_id long, a long, b long, score double")
    assert {r.edge_id for r in GR.greedy_matching(df, [-F.col("score")]).collect()} == set(kept)
    assert {r.edge_id for r in GR.edit_budget(df, "score", 3, a="a", b="b").collect()} == set(kept[:3])
    used, first = set(), set()
    for e in rows:
        if e[1] not in used and e[2] not in used:
            first.add(e[0])
            used |= {e[1], e[2]}
    assert {r.edge_id for r in GR.label_cap(df, [F.col("edge_id")], a="a", b="b").collect()} == first


def test_progressive_accept_closes_no_cycle(spark):
    rows = random_edges(13, 200, 30)
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    def level(s):
        return max(0, math.ceil(round((0.95 - s) / 0.05, 9)))

    want = set()
    for e in sorted((e for e in rows if e[3] >= 0.5), key=lambda e: (level(e[3]), -e[3], e[0])):
        a, b = find(e[1]), find(e[2])
        if a != b:
            parent[a] = b
            want.add(e[0])
    df = spark.createDataFrame(rows, "edge_id long, a long, b long, score double")
    assert {r.edge_id for r in GR.progressive_accept(df, low=0.5).collect()} == want


def test_omit_rules(spark):
    e = spark.createDataFrame([(1, 2, "0", "0"), (2, 3, "0", "5"), (3, 4, "5", "5"), (4, 5, "5", "6")], "src long, dst long, label_src string, label_dst string")
    for rule, want in (("either", (1, 1, 2)), ("both", (1, 2, 1))):
        r = M.edge_class_counts(M.classify_edges(e, rule)).first()
        assert (r.correct, r.split, r.omit) == want
    with pytest.raises(ValueError):
        M.edge_class("none")


def test_weighted_mean_ignores_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (4.0, 1.0)], "v double, run_length double")
    assert df.agg(M.weighted_mean("v").alias("m")).first().m == pytest.approx(2.0)
    assert df.filter("v is null").agg(M.weighted_mean("v").alias("m")).first().m is None


def test_gate(spark):
    cols = "candidate_id string, edge_accuracy double, pct_merged double, n_merges double, pct_split double, has_split boolean"
    parent = [(c, 50.0, 5.0, 2.0, 1.0) for c in "abcdef"]
    cand = [("a", 51.0, 5.0, 2.0, 1.06, True), ("b", 51.0, 5.0, 2.0, 1.06, False), ("c", None, 5.0, 2.0, 1.0, False),
            ("d", 50.0, 0.0, 0.0, 0.0, False), ("e", 51.0, 5.1, 2.0, 1.0, True), ("f", 51.0, 4.0, 1.0, 1.04, True)]
    got = P.gate(spark.createDataFrame(cand, cols), spark.createDataFrame(parent, "candidate_id string, edge_accuracy double, pct_merged double, n_merges double, pct_split double"))
    assert {r.candidate_id: r.accepted for r in got.collect()} == {"a": False, "b": True, "c": False, "d": False, "e": False, "f": True}


def test_rank_ids(spark):
    rows = [(i, "r", "0.5", 0.1) for i in ("10", "9", "x2")] + [("7", "r", None, 0.1), ("8", "r", "bad", 0.1)]
    df = spark.createDataFrame(rows, "id string, run string, surprisal string, posterior double")
    got = RK.rank_hypotheses(df)
    assert [r.id for r in got.orderBy("rank").collect()] == ["9", "10", "x2"]
    assert RK.split_missing(df)[1].count() == 2


def test_belief_edges(spark):
    df = spark.createDataFrame([(p,) for p in (None, 0.8, 0.6, 0.4, 0.2)], "p double")
    assert [r[0] for r in df.select(belief_label(F.col("p"))).collect()] == ["Unknown", "Likely True", "Leaning True", "Leaning False", "Likely False"]
    pair = spark.createDataFrame([(0.5, 0.6), (0.5, 0.51), (0.6, 0.5), (None, 0.5)], "a double, b double")
    assert [r[0] for r in pair.select(direction(F.col("a"), F.col("b"))).collect()] == ["Positive", "Neutral", "Negative", "Unknown"]


def test_ordering_without_one_task(spark):
    rng = random.Random(3)
    v = [rng.randrange(50) for _ in range(203)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v long")
    ranked = O.global_rank(df, [F.col("v"), F.col("i")]).collect()
    assert [r.i for r in sorted(ranked, key=lambda r: r["rank"])] == [i for i, _ in sorted(enumerate(v), key=lambda t: (t[1], t[0]))]
    total = O.running_total(df, [F.col("i")], "v").collect()
    assert [r.running for r in sorted(total, key=lambda r: r.i)] == list(itertools.accumulate(v))
    sizes = O.ntile(df, [F.col("v"), F.col("i")], 10).groupBy("tile").count().orderBy("tile").collect()
    assert [r["count"] for r in sizes] == [21] * 3 + [20] * 7
    q = O.exact_percentiles(df, "v", {"a": 0.5, "b": 0.9}).first()
    s = sorted(v)
    assert (q.a, q.b) == (s[101], pytest.approx(s[181] + 0.8 * (s[182] - s[181])))


def test_logit_solves_the_score_equations(spark):
    rng = random.Random(2)
    rows = [(x, 1.0 if rng.random() < 1 / (1 + math.exp(1 - 2 * x)) else 0.0) for x in (rng.uniform(-1, 2) for _ in range(400))]
    r = ST.logit_slope(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    res = [y - 1 / (1 + math.exp(-(r.intercept + r.slope * x))) for x, y in rows]
    assert abs(sum(res)) < 1e-2 and abs(sum(e * x for e, (x, _) in zip(res, rows))) < 1e-2


def test_split_sites_keep_one_per_label_pair(spark):
    nodes = [(1, "a", 0.0, 0.0, 0.0, 1.0), (2, "a", 5.0, 0.0, 0.0, 1.0), (3, "b", 8.0, 0.0, 0.0, 1.0), (4, "b", 14.0, 0.0, 0.0, 1.0), (5, "b", 14.0, 4.0, 0.0, 1.0)]
    n = spark.createDataFrame(nodes, "node_id long, label string, x double, y double, z double, radius double")
    e = spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "src long, dst long")
    for rows in (500_000, 1):
        pairs = SI.tip_pairs(n, e, 15.0, hot_rows=rows)
        got = SI.closest_per_label_pair(pairs).collect()
        assert [(r.node_a, r.node_b, r.gap_um) for r in got] == [(2, 3, 3.0)]
    assert [(r.node_a, r.node_b) for r in SI.mutual_nearest(SI.tip_pairs(n, e, 15.0, tip_to_shaft=False)).collect()] == [(2, 3)]


def test_sharp_edges(spark):
    nodes = [(0, 0.0, 0.0, 0.0), (1, 10.0, 0.0, 0.0), (2, 10.0, 2.0, 0.0), (3, -10.0, 0.0, 0.0)]
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "src long, dst long")
    flagged = SI.sharp_edges(spark.createDataFrame(nodes, NODE), e, 30.0)
    assert [(r._lo, r._hi) for r in flagged.collect()] == [(0, 2)]
    assert SI.sever(e, flagged).count() == 2


def test_valley(spark):
    vox = [(0, 0, x, 1.0 if 8 <= x <= 12 else 10.0) for x in range(21)]
    v = spark.createDataFrame(vox, "z long, y long, x long, value double")
    s = spark.createDataFrame([("s", 0.0, 0.0, 0.0, 20.0, 0.0, 0.0)], "site string, ax double, ay double, az double, bx double, by double, bz double")
    r = V.merge_cut_evidence(s, v, n_samples=5, shape=(1, 1, 1)).first()
    assert (r.profile, r.valley, r.endpoint_mean, r.valley_ratio, r.valley_pos) == ([10.0, 10.0, 1.0, 10.0, 10.0], 1.0, 10.0, 0.1, 0.5)


def test_readers(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a,b\na,b\na\na,b,c\n\n")
    assert [tuple(r) for r in RD.read_connections(spark, str(tmp_path / "c.txt")).collect()] == [("a", "b")]
    assert RD.read_connections(spark, str(tmp_path / "missing.txt")).count() == 0
    (tmp_path / "one.json").write_text('﻿[{"id": 1, "surprisal": "0.5", "experimentPlan": {"objective": "o"}}]', encoding="utf-8")
    (tmp_path / "two.json").write_text('{"results": [{"id": "x", "surprisal": null}]}')
    (tmp_path / "skip.txt").write_text("nothing")
    got = RD.read_hypotheses(spark, [str(tmp_path), str(tmp_path / "one.json")])
    assert {(r.run, r.id, r.surprisal) for r in got.collect()} == {("one", "1", "0.5"), ("two", "x", None)}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no hypotheses"):
        RD.read_hypotheses(spark, str(tmp_path / "bad.json")).collect()


def test_ledger_stream(spark, tmp_path):
    from dendrospark.streaming.ledger import summary_stream

    (tmp_path / "l.jsonl").write_text('{"generation": 1, "accepted": true, "heldout_primary": 70.5, "wall_seconds": 2.0}\n\n{"generation": 2, "accepted": false}\n')
    q = summary_stream(spark, str(tmp_path)).writeStream.outputMode("complete").format("memory").queryName("ledger_now").start()
    try:
        q.processAllAvailable()
        r = spark.table("ledger_now").first()
    finally:
        q.stop()
    assert (r.n_generations, r.n_accepted, r.best_heldout) == (2, 1, 70.5)


def test_projection_of_proposals(spark):
    from dendrospark.operators import sites
    from dendrospark.session import cut
    gt = [("b", i, n, float(x), 0.0, 0.0) for i, (n, x) in enumerate([("n1", 0), ("n1", 3), ("n1", 40), ("n2", 20)])]
    gt += [("c", i, n, x + 1000.0, y, z) for _, i, n, x, y, z in gt]
    frag = [(b, 10 * i, x, 0.0, 0.0) for b, i, _, x, _, _ in gt]
    props = [(b, 0, 10, 0.0) for b in "bc"] + [(b, 0, 20, 0.0) for b in "bc"] + [("b", 0, 30, 0.0), ("b", 0, 99, 0.0)]
    gt = cut(spark.createDataFrame(gt, "brain_id string, node_id long, neuron string, x double, y double, z double"))
    frag = cut(spark.createDataFrame(frag, "brain_id string, node_id long, x double, y double, z double"))
    props = spark.createDataFrame(props, "brain_id string, node_a long, node_b long, d2 double")
    neurons = gt.select("brain_id", (gt.node_id * 10).alias("node_id"), "neuron")
    got = sites.label_proposals(props, neurons, ["brain_id"], frag, gt)
    # 41 points on the long line: at most 18.5 from a node of its own neuron, the other neuron in the middle does not count
    far = sorted(min(abs(p - x) for x in (0, 3, 40)) for p in range(41))[36]
    want = {(b, 10): ("accept", 1.0) for b in "bc"} | {(b, 20): ("reject", float(far)) for b in "bc"}
    want |= {("b", 30): ("reject", None), ("b", 99): ("unknown", None)}
    assert {(r["brain_id"], r["node_b"]): (r["truth"], r["projection_p90"]) for r in got.collect()} == want
    assert sites.label_proposals(props, neurons, ["brain_id"]).count() == 6


def test_images_of_brains_stay_apart(spark):
    """Two brains with the same coordinates and different images; an end without voxels gives nulls."""
    vox = [(b, z, y, x, v) for b, v in (("p", 10.0), ("q", 90.0)) for z in range(4) for y in range(12) for x in range(12)]
    voxels = spark.createDataFrame(vox, "brain string, z long, y long, x long, value double")
    pairs = [(i, b, 4.0, 4.0, 2.0, far, 8.0, 2.0) for i, (b, far) in enumerate([("p", 8.0), ("q", 8.0), ("q", 500.0)])]
    ends = spark.createDataFrame(pairs, "site long, brain string, ax double, ay double, az double, bx double, by double, bz double")
    got = {r.site: (r.mean_a, r.mean_b) for r in V.gap_connectivity(ends, voxels, by=["brain"]).collect()}
    assert got == {0: (10.0, 10.0), 1: (90.0, 90.0), 2: (90.0, None)}
    cut_at = {r.site: r.valley for r in V.merge_cut_evidence(ends, voxels, by=["brain"]).collect()}
    assert cut_at == {0: 10.0, 1: 90.0, 2: None}


def test_merge_targets_list_every_neuron(spark):
    nodes = spark.createDataFrame([(100 * n + i, n, "m", float(n), 0.0, 0.0) for n in range(8) for i in range(20 + n)],
                                  "node_id long, neuron long, label string, x double, y double, z double")
    row = M.merge_targets(nodes, min_nodes=10).first()
    assert row.n_neurons == 8 and [(s.neuron, s.n_nodes) for s in row.sites] == [(n, 20 + n) for n in range(7, -1, -1)]
    assert [s.neuron for s in M.merge_targets(nodes, min_nodes=10, max_sites=3).first().sites] == [7, 6, 5]


def test_dilation_is_dealt_out_by_blocks(spark, monkeypatch):
    """Parts grow with the voxels; what blocks grow into each other is still united."""
    monkeypatch.setattr(V, "TASK_VOXELS", 50)
    rng = random.Random(21)
    vox = {(rng.randrange(4), rng.randrange(70), rng.randrange(70)): rng.randrange(9) for _ in range(400)}
    df = spark.createDataFrame([(*k, v) for k, v in vox.items()], "z long, y long, x long, label long")
    assert V._in_blocks(df).rdd.getNumPartitions() == len(vox) // 50 + 1
    steps = [o for o in itertools.product(range(-2, 3), repeat=3) if sum(c * c for c in o) <= 4]
    best = {}
    for k, v in vox.items():
        for o in steps:
            at = tuple(a + b for a, b in zip(k, o))
            if all(0 <= c < s for c, s in zip(at, (4, 70, 70))):
                best[at] = min(best.get(at, (99, 99)), (sum(c * c for c in o), v))
    got = V.dilate_labels(df, 2, (4, 70, 70)).collect()
    assert len(got) == len(best) and {tuple(r)[:3]: r.label for r in got} == {k: v for k, (_, v) in best.items()}
    city = {tuple(a + b for a, b in zip(k, o)) for k in vox for o in itertools.product(range(-2, 3), repeat=3) if sum(map(abs, o)) <= 2}
    assert {tuple(r) for r in V.dilate(df, 2, (4, 70, 70)).collect()} == {k for k in city if all(0 <= c < s for c, s in zip(k, (4, 70, 70)))}
