"""Suffixes of all edits of a label against a plain fold."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from dendrospark.operators import edits as E
from dendrospark.plans.derived import tables

SF = "/root/testdata/sf0.001"


def name(i):
    out = ""
    i += 1
    while i:
        i, digit = divmod(i - 1, 26)
        out = chr(97 + digit) + out
    return out


def test_every_node_is_an_edit(spark):
    nodes = Counter(r["neuron"] for r in tables(spark, SF).frag_node.select("neuron").collect())
    want = []
    for label, n in nodes.items():
        used = []
        for wanted in ["a", "b"] * n:
            used.append(wanted if wanted not in used else next(name(i) for i in range(len(used) + 1) if name(i) not in used))
        want += [(label, i, s) for i, s in enumerate(used)]
    got = [tuple(r) for r in entry.queries()["e2_suffix_collisions"](spark, SF).select("label", "seed_idx", "suffix").collect()]
    assert sorted(got) == sorted(want) and max(nodes.values()) > 26


@pytest.mark.parametrize("chunk", [2, 64])
def test_wishes_against_a_plain_fold(spark, monkeypatch, chunk):
    """Repeated wishes, wishes that come after the name was given out, no wish, names out of order, names that no rule gives."""
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = random.Random(3)
    names = [None, None, "a", "b", "c", "d", "e", "aa", "z", "ab", "x1", "A", "", "zzzzzzzzzzzz"]
    rows, want = [], []
    for label in range(12):
        used = []
        pool = names if label % 2 else [name(i) for i in range(30)] + [None]
        for seq in range(40):
            seeds = [rng.choice(pool) for _ in range(rng.randrange(1, 4))]
            rows.append(("c", seq, E.SPLIT, None, None, str(label), [(w, float(seq), 0.0, 0.0, 1) for w in seeds]))
            for wish in seeds:
                used.append(wish if wish is not None and wish not in used else next(name(i) for i in range(len(used) + 1) if name(i) not in used))
        want += [(str(label), i, s) for i, s in enumerate(used)]
    rng.shuffle(rows)
    got = [tuple(r) for r in E.split_seeds(spark.createDataFrame(rows, E.EDIT_SCHEMA)).select("label", "seed_idx", "suffix").collect()]
    assert sorted(got) == sorted(want)
