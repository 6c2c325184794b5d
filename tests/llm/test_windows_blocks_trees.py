"""Decontamination, hard negatives and collocations against plain versions; families of near copies cost no pairs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import contamination, near_dups, negatives, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"


# --- 11 --------------------------------------------------------------------------------------------------------------


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(text, items, window=10):
    w, hit, found = contract_words(text), set(), set()
    for i, t in items:
        own = contract_words(t)
        size = min(len(own), window)
        for s in range(max(1, len(own) - window + 1) if own else 0):
            for at in range(len(w) - size + 1):
                if w[at: at + size] == own[s: s + size]:
                    hit.update(range(at, at + size))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(found)


DOCS = [
    (1, ITEM), (2, "x " + ITEM.upper() + " y " + ITEM), (2, "x " + ITEM.upper() + " y " + ITEM), (3, None), (4, ""), (5, " .,; "), (None, "one " + ITEM), (6, "short ITEM!"),
    (7, "the " * 30_000), (8, "É" + ITEM), (9, "éa short, short item item"), (10, " ".join(ITEM.split()[:9])), (11, "one"), (12, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
]
ITEMS = [(1, ITEM), (2, "short item"), (2, "the " * 12), (3, None), (4, ""), (5, "One"), (None, "éa short short item"), (10, ITEM + " nu"), (6, "never seen words " * 5)]


def as_docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("_rid", "term", "window", "place", "n_words", "item_id")])


def test_contamination_against_plain_windows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit(1))
    got = contamination.decontaminate(as_docs(spark), items).collect()
    want = Counter((i, *plain_hits(t, ITEMS)[:2], ",".join(plain_hits(t, ITEMS)[2])) for i, t in DOCS)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)


def test_contamination_without_broadcast(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda df: Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())
    few = key(contamination.decontaminate(as_docs(spark), items))
    monkeypatch.setattr(contamination, "FEW", 0)
    assert key(contamination.decontaminate(as_docs(spark), items)) == few


def test_contamination_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination.decontaminate(as_docs(spark).limit(0), items).count() == 0
    clean = contamination.decontaminate(as_docs(spark), items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r["contaminated"] or r["n_items"] for r in clean)


def test_proximity(spark):
    words = [f"w{i}" for i in range(10)]
    moved = words[:4] + ["extra", "more"] + words[4:]
    far = words[:5] + ["pad"] * 6 + words[5:]
    docs = [(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(far)), (4, " ".join(words[::-1])), (5, "w0 w1")]
    items = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    got = {r["doc_id"] for r in contamination.near_items(spark.createDataFrame(docs, "doc_id long, text string"), items, slop=3).collect()}
    assert got == {1, 2}


# --- 12 --------------------------------------------------------------------------------------------------------------


def plain_negatives(rows, every):
    known = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, q, label in known:
        if i % every:
            continue
        score = lambda r: sum(a * b for a, b in zip(q, r))
        near = sorted(((-score(r), j) for j, r, own in known if own == label and j != i))[:5]
        for ps, p in near:
            fit = sorted((-score(r), j) for j, r, own in known if own != label and j != i and -50 * ps <= 100 * score(r) <= -95 * ps)[:3]
            out += [(i, p, k + 1, j, -ps, -ns) for k, (ns, j) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("block", [4, 1024])
def test_negatives_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(draw.normal(size=6) + (i % 3), 1)], i % 3) for i in range(150)]
    rows += [(200, None, 1), (205, [1.0] * 5 + [None], 1), (210, [float("nan")] * 6, 2), (215, [float("inf")] + [0.0] * 5, 0), (220, [1.0] * 6, None), (None, [1.0] * 6, 1),
             (225, [0.0] * 6, 1), (230, [2.0] * 6, 1), (230, [2.0] * 6, 1), (231, [2.0] * 6, 2), (235, [-1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("block"), F.lit(2).alias("q"))
    got = Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.hard_negatives(df, every=5).collect())
    assert got == plain_negatives(rows, 5) and len(got) > 100


def test_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0, 2.0], 1)], schema)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [], 1), (51, None, 1)], schema)).count() == 0


def test_bounds_and_exact_products():
    draw = np.random.default_rng(4)
    a, rows = draw.integers(-500, 500, (5, 8)), draw.integers(-500, 500, (40, 8))
    low, high = negatives.bounds(a, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = negatives.inner(a, rows)
    assert (scores >= low).all() and (scores <= high).all()
    big = np.array([[1 << 30, 1]])
    assert negatives.inner(big, big)[0, 0] == (1 << 60) + 1
    with pytest.raises(OverflowError):
        negatives.inner(big << 2, big << 2)


# --- 13 --------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least=10, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i: i + k])) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(100 * f[lang, q] >= covered * a for (at, q) in f if at == lang and len(q) == 3 and f[lang, q] >= least and p in (q[:2], q[1:])):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {lang: [(i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(v)[:2000])] for lang, v in found.items()}


def phrase_rows():
    draw = np.random.default_rng(5)
    vocabulary = ["the", "a", "New", "york", "é", "sun\x0bset", "x\x1cy", "|", "-", "né e"]
    rows = [(["en", "de", None][i % 3], " ".join(draw.choice(vocabulary, 60)) + (". " if i % 2 else "\n") + "new york city. new\tyork  city") for i in range(60)]
    return rows + [("en", None), ("en", ""), (None, " \t\n"), ("fr", "one two"), ("en", "a b c " * 2000), ("en", rows[0][1])]


@pytest.mark.parametrize(("budget", "step", "chunk"), [(1_000_000, 1_000_000, 2_000_000), (40, 50, 300)])
def test_phrases_against_plain_counts(spark, monkeypatch, budget, step, chunk):
    monkeypatch.setattr(phrases, "STEP", step), monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").select("*", F.lit(1).alias("bucket"), F.lit("q").alias("phrase")).repartition(3)
    got = defaultdict(list)
    for r in phrases.collocations(df, budget=budget).orderBy("lang", "rank").collect():
        got[r["lang"]].append(tuple(r[c] for c in ("rank", "phrase", "a", "l", "r", "n", "score")))
    assert dict(got) == plain_phrases(rows)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_are_exact(spark):
    draw = np.random.default_rng(6)
    rows = [tuple(int(x) for x in (a, a + draw.integers(0, 10**6), a + draw.integers(0, 10**6))) for a in draw.integers(10, 10**14, 200)] + [(10**14, 10**14, 10**14), (10, 10**14, 10**14)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    for r in df.withColumn("s", phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"])


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("m", [150, 300])
def test_families_in_one_bucket_list_no_pairs(spark, monkeypatch, m):
    """Two families about 0.6 similar to each other, every copy with a word of its own: pairs stay linear in the members."""
    common, own = [f"c{i}" for i in range(300)], {f: [f"{f}{i}" for i in range(100)] for f in "ab"}
    rows = [(n, " ".join([*common, *own[f], f"only{f}{i}"])) for n, (f, i) in enumerate((f, i) for i in range(m) for f in "ab")]
    compared = []
    plain = near_dups._likely

    def counted(pairs, reps, threshold):
        compared.append(pairs.count())
        return plain(pairs, reps, threshold)

    monkeypatch.setattr(near_dups, "_likely", counted)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r["component_id"] for r in got} == {0, 1} and all(r["component_id"] == r["doc_id"] % 2 for r in got)
    assert sum(compared) <= 40 * m
