"""Edit semantics on hand-made graphs."""

import random

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import edits as E
from dendrospark.plans import scoring as SC

SEED = "suffix string, x double, y double, z double, node long"


def edit(seq, kind=None, a=None, b=None, label=None, seeds=None, cand="c"):
    return (cand, seq, kind, a, b, label, [(s, float(x), float(y), float(z), None) for s, (x, y, z) in seeds] if seeds else None)


def edits(spark, *rows):
    return spark.createDataFrame(list(rows), E.EDIT_SCHEMA)


def two_lines(spark):
    gt, ge, fn, fe = [], [], [], []
    for i in range(80):
        gt.append((i, "A", "L", 0, 0, i))
        gt.append((100 + i, "B", "L", 0, 200, i))
        fn.append((i, "L", 0, 0, i))
        fn.append((100 + i, "L", 0, 200, i))
    for base, n in ((0, "A"), (100, "B")):
        ge += [(base + i, base + i + 1, n) for i in range(79)]
        fe += [(base + i, base + i + 1) for i in range(79)]
    fe.append((79, 100))
    node = "node_id long, neuron string, raw_label string, x long, y long, z long"
    return (spark.createDataFrame(gt, node), spark.createDataFrame(ge, "src long, dst long, neuron string"),
            spark.createDataFrame(fn, "node_id long, label string, x long, y long, z long"), spark.createDataFrame(fe, "src long, dst long"))


def test_two_lines_merge_is_repaired_by_a_split(spark):
    gt, ge, fn, fe = two_lines(spark)
    brain = SC.prepare(gt, ge, fn, fe)
    e = edits(spark, edit(1, E.SPLIT, label="L", seeds=[("a", (0, 0, 0)), ("b", (0, 200, 0))], cand="split"),
              edit(1, E.FLAG, cand="flag"))
    got = {(r.candidate_id, r.neuron): r for r in SC.score(brain, e, ["split", "flag"]).collect()}
    base = {r.neuron: r for r in brain.baseline.collect()}
    for n in "AB":
        assert base[n].n_merges == 1 and base[n].pct_merged == 100.0 and base[n].erl == 0.0
        assert got["split", n].n_merges == 0 and got["split", n].pct_merged == 0.0
        assert got["split", n].erl == pytest.approx(79.0) and got["split", n].edge_accuracy == 100.0
        # an inert edit changes nothing
        assert {k: v for k, v in got["flag", n].asDict().items() if k != "candidate_id"} == base[n].asDict()
    seeds = E.split_seeds(e)
    part = E.partition_by_path(E.split_nodes(fn, seeds), fe, seeds)
    pieces = E.split_fragments(part, fe)
    assert pieces.select("piece").distinct().count() == 2
    ids = {(r.piece): sorted(x.new_id for x in pieces.filter(F.col("piece") == r.piece).collect()) for r in pieces.select("piece").distinct().collect()}
    assert all(v == list(range(80)) for v in ids.values())


def test_fasciculus_path_beats_straight_line(spark):
    fn = [(x, "L", x, 0, 0) for x in range(21)] + [(100 + x, "L", x, 1, 0) for x in range(21)]
    fe = [(x, x + 1) for x in range(20)] + [(100 + x, 101 + x) for x in range(20)] + [(20, 120)]
    fn = spark.createDataFrame(fn, "node_id long, label string, x long, y long, z long")
    fe = spark.createDataFrame(fe, "src long, dst long")
    seeds = E.split_seeds(edits(spark, edit(1, E.SPLIT, label="L", seeds=[("a", (20, 0, 0)), ("b", (0, 1, 0))])))
    nodes = E.split_nodes(fn, seeds)
    assert E.assign_seed_euclid(nodes, seeds).filter("node_id = 1").first().suffix == "b"
    side = {r.node_id: (r.suffix, r.dist) for r in E.partition_by_path(nodes, fe, seeds).collect()}
    assert side[1] == ("a", 19.0)
    # along the second arm b reaches up to 10, a comes round from the far end
    assert [side[100 + x][0] for x in range(21)] == ["b"] * 11 + ["a"] * 10


def test_three_seeds_compose(spark):
    e = edits(spark, edit(1, E.SPLIT, label="L", seeds=[("a", (0, 0, 0)), ("b", (10, 0, 0))]),
              edit(2, E.SPLIT, label="L", seeds=[(None, (0, 20, 0))]), edit(3, E.SPLIT, label="L", seeds=[("a", (5, 5, 5))]))
    assert [r.suffix for r in E.split_seeds(e).orderBy("seed_idx").collect()] == ["a", "b", "c", "d"]


def test_suffix_after_z(spark):
    e = edits(spark, edit(1, E.SPLIT, label="L", seeds=[(None, (i, 0, 0)) for i in range(28)]))
    assert [r.suffix for r in E.split_seeds(e).orderBy("seed_idx").collect()][-3:] == ["z", "aa", "ab"]


def test_coincident_seeds_give_one_side(spark):
    fn = spark.createDataFrame([(i, "L", i, 0, 0) for i in range(5)], "node_id long, label string, x long, y long, z long")
    fe = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    seeds = E.split_seeds(edits(spark, edit(1, E.SPLIT, label="L", seeds=[("a", (2, 0, 0)), ("b", (2, 0, 0))])))
    nodes = E.split_nodes(fn, seeds)
    # the later seed wins the node, the earlier one wins a straight-line tie
    assert {r.suffix for r in E.partition_by_path(nodes, fe, seeds).collect()} == {"b"}
    assert {r.suffix for r in E.assign_seed_euclid(nodes, seeds).collect()} == {"a"}


def test_unknown_kind_is_an_error(spark):
    with pytest.raises(Exception, match="unknown edit kind"):
        E.normalize_edits(edits(spark, edit(1, "explode", "1", "2"))).collect()


def test_capped_union(spark):
    e = edits(spark, edit(1, E.MERGE, "1", "2"), edit(2, E.MERGE, "2", "3"), edit(3, E.MERGE, "3", "4"))
    got = {r.label: r["class"] for r in E.merge_classes(e, 2).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "3"}
    kept, refused = E.capped_unions(E.merge_pairs(e), 2)
    assert kept.count() == 2 and [r.edit_seq for r in refused.collect()] == [2]


@pytest.mark.parametrize("group_rows", [10**6, 0])
def test_capped_union_like_a_sequential_pass(spark, group_rows):
    rng = random.Random(5)
    pairs = [(f"{rng.randrange(25):02d}", f"{rng.randrange(25):02d}") for _ in range(40)]
    e = edits(spark, *[edit(i, E.MERGE, a, b) for i, (a, b) in enumerate(pairs)])
    owner: dict[str, set] = {}
    refused = []
    for i, (a, b) in enumerate(pairs):
        ca, cb = owner.setdefault(a, {a}), owner.setdefault(b, {b})
        if ca is cb:
            continue
        if len(ca) + len(cb) > 4:
            refused.append(i)
            continue
        ca |= cb
        for m in cb:
            owner[m] = ca
    got = {r.label: r["class"] for r in E.merge_classes(e, 4, group_rows).collect()}
    assert got == {m: min(c) for m, c in owner.items()}
    _, no = E.capped_unions(E.merge_pairs(e), 4, group_rows)
    assert sorted(r.edit_seq for r in no.collect()) == refused


def test_background_is_never_merged(spark):
    assert E.merge_classes(edits(spark, edit(1, E.MERGE, "0", "5"))).count() == 0


def test_runs_of_links_alone_count(spark):
    """Two nodes without a correct edge are joined by an edit: their edge is an error-free run of its own."""
    gt = spark.createDataFrame([(i, 1, label, 5.0 * i, 0.0, 0.0) for i, label in enumerate("abcc")],
                               "node_id long, neuron long, raw_label string, x double, y double, z double")
    ge = spark.createDataFrame([(i, i + 1, 1) for i in range(3)], "src long, dst long, neuron long")
    brain = SC.prepare(gt, ge, gt.withColumnRenamed("raw_label", "label"), ge)
    edit = spark.createDataFrame([("one", 1, E.MERGE, "a", "b", None, None)], E.EDIT_SCHEMA)
    got = {r.candidate_id: r.erl for r in SC.score(brain, edit, ["one", "none"]).collect()}
    assert got["one"] == (25.0 + 25.0) / 15.0 and got["none"] == 25.0 / 15.0
