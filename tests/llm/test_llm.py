"""Every operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dendrospark.llm import licenses, mixing, near_dups, neighbours, packing, quality, queries, secrets, sharding, sketch, substrings, toxicity

SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


PROSE = " ".join(f"word{i % 97} of{i % 13} the{i % 7}" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \t\n ", None, "b"),
    (None, PROSE + " tail", "en", "b"), (6, "two words", "de", "b"), (7, "x " * 30_000, "fr", "a"), (8, "password=\"hunter2hunter2\" näh", "en", "a"),
    (9, "\x1cein\x85wort more é \U0001F600", "de", "c"), (10, PROSE.upper(), "en", "c"),
]
CLASH = ("kept", "n_words", "spans", "_rid", "position", "length", "slot", "_lang", "list", "score", "component_id", "_words")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


def words(text):
    return SPACES.findall(text or "")


# --- 1 ---------------------------------------------------------------------------------------------------------------


def plain_base(text):
    kinds = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
                        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
             ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0))
    found = [(m.start(), i, m.end()) for i, (_, p, least, g) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m.group(g)) >= least]
    return ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_against_plain_patterns(spark):
    dir_ = "/root/testdata/sf0.01"
    documents = {r["doc_id"]: r for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()}
    got = queries.QUERIES["op1_secrets"](spark, dir_).collect()
    assert len(got) == len(documents)
    for r in got:
        base = plain_base(documents[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_assign"] + r["n_access"] for r in got) > 0


@pytest.mark.parametrize("text", ["token=secret:abcdefgh1", "Password : 'abcdefgh' SECRET=short toKen=abcdefghij", "AKIA" + "Z" * 11 + " AKIA" + "A1" * 6,
                                  "0" * 31 + "g" + "f" * 33, 'api_key="a.b=c/d-e" APIKEY:12345678'])
def test_certain_findings(text):
    got = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.base_spans(text))
    assert got == plain_base(text)


def test_weak_parts_need_their_complement(spark):
    token = "Zx9kQ2mL7vB4nR8tW1pY5c"
    rows = [(1, f"login: alice then {token}"), (2, f"only {token} here"), (3, "login: alice alone"), (4, f"login: alice\n\n{token}"),
            (5, f"login: alice {'x ' * 300}{token}"), (6, f"https://db.example.com/x login=alice {token}"), (7, "https://db.example.com/x login=alice")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
           .select("doc_id", secrets.listed(F.col("spans")).alias("spans")).collect()}
    assert {k: [s.split(":")[0] for s in v.split(",") if s] for k, v in got.items()} == {
        1: ["login", "opaque"], 2: [], 3: [], 4: [], 5: [], 6: ["endpoint", "login", "opaque"], 7: []}


def test_masking(spark, odd):
    got = {(r["doc_id"], r["source"]): r for r in secrets.redact(odd).collect()}
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == len(ROWS)
    assert got[(8, "a")]["text"] == '[SECRET]" näh' and got[(8, "a")]["n_chars"] == 13
    assert got[(3, None)]["text"] is None and got[(1, "a")]["text"] == PROSE
    twice = spark.createDataFrame([(1, f"a token={'0123456789abcdef' * 2} z AKIA{'A' * 16}")], "doc_id long, text string")
    assert secrets.redact(twice).first()["text"] == "a [SECRET] z [SECRET]"


# --- 2 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    image = sharding.permute(np.arange(n), n, 5)
    assert sorted(image.tolist()) == list(range(n))
    assert n < 60 or (image != sharding.permute(np.arange(n), n, 6)).any()


def test_shards(spark, documents, odd):
    got = queries.QUERIES["op2_shards"](spark, SF).collect()
    slots = defaultdict(list)
    for r in got:
        text = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_number = {r["row_number"]: (r["shard"], r["slot"]) for r in got}
    image = sharding.permute(np.arange(len(got)), len(got), 20240917)
    assert all(by_number[i] == (p % 40, p // 40) for i, p in enumerate(image.tolist()))
    assert sharding.shard_rows(odd, 3).count() == len(ROWS)


# --- 3 ---------------------------------------------------------------------------------------------------------------


def plain_licenses(text):
    w, out = licenses.plain(text or ""), set()
    runs = lambda x: {tuple(x[i: i + 5]) for i in range(len(x) - 4)}
    for name, notice in licenses.TEMPLATES:
        t = licenses.plain(notice)
        size, step = next((s, p) for most, s, p in licenses.CLASSES if len(t) <= most)
        last = max(0, len(w) - size)
        if any(100 * len(runs(t) & runs(w[s: s + size])) >= 80 * len(runs(t)) for s in {*range(0, last + 1, step), last}):
            out.add(name)
    return ",".join(sorted(out))


def test_licenses(spark, documents, odd):
    got = queries.QUERIES["op3_licenses"](spark, SF).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: plain_licenses(d["text"]) for i, d in documents.items()}
    assert sum(r["licenses"] != "" for r in got) > 0
    rows = [(i, f"Lorem ipsum {'dolor ' * i}{t} sit amet") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(licenses.TEMPLATES[r["doc_id"]][0] in r["licenses"].split(",") for r in found)
    assert licenses.scan_licenses(odd).count() == len(ROWS)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 2**63, 1150).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[150:])
    ra, rb = sketch.registers(a), sketch.registers(b)
    assert (np.maximum(ra, rb) == sketch.registers(np.union1d(a, b))).all()
    truth = 850 / 1150
    assert abs(sketch.likely_jaccard(ra[None], rb[None], np.array([1000.0]), np.array([1000.0]))[0] - truth) < 6 * (truth * (1 - truth) / sketch.M) ** 0.5
    assert len(set(sketch.registers(a[:3]).tolist())) > 100


def plain_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op4_near_dups"](spark, SF).collect()}
    assert got == plain_components([(i, d["text"]) for i, d in documents.items()], 3, 85)
    assert len({c for _, c in got.values()}) < len(got)


def test_crowded_group_of_near_copies(spark):
    draw = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in draw.choice(120, draw.integers(1, 7), replace=False):
            copy[at] = f"n{draw.integers(3)}"  # same changes happen in several copies
        rows.append((i, " ".join(copy)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, 3, 85)


def test_near_duplicates_of_odd_rows(odd):
    got = near_dups.near_duplicates(odd, width=3, percent=85).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["kept"], r["n_shingles"] > 0))
    assert by[2] == {(1, False, True)} and by[10] == {(1, False, True)} and by[None] == {(1, False, True)}
    assert by[3] == {(3, True, False)} and by[5] == {(5, True, False)} and by[6] == {(6, True, True)}


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_curve_is_continuous():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


@pytest.mark.parametrize("text", ["Hello, world's ΑΣ. <|endoftext|>x a<|startoftext|> b", "a\x1cb  c d\n\ng", "é é x İstanbul ﬁ 12 3½ it's 'S", "", None])
def test_ids_of_words_are_ids_of_texts(text):
    coder = packing.Encoder(packing.tokenizer_path())
    whole = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == [*whole, 1]


def test_packing_round_trip(spark, odd):
    coder = packing.Encoder(packing.tokenizer_path())
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        texts = docs.select("doc_id", "text").collect()
        pieces = packing.pack(docs, packing.tokenizer_path(), 512).collect()
        lanes = defaultdict(list)
        for p in pieces:
            lanes[p["sequence_id"]].append(p)
        for i, lane in lanes.items():
            at = 0
            for p in sorted(lane, key=lambda p: p["offset"]):
                assert p["offset"] == at and len(p["ids"]) == 4 * p["length"]
                at += p["length"]
            assert at == 512 or i == max(lanes)
        whole = Counter()
        for t in texts:
            ids = np.array([*coder.tokenizer.encode(t["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            whole[(t["doc_id"], len(ids), int(ids.sum()))] += 1
        got, sums = Counter(), defaultdict(int)
        for p in pieces:
            sums[(p["doc_id"], p["doc_tokens"])] += int(np.frombuffer(p["ids"], "<u4").sum())
        expected = defaultdict(int)
        for (d, n, s), c in whole.items():
            expected[(d, n)] += s * c
        assert sums == expected


# --- 6 ---------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i: i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, documents, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in queries.QUERIES["op6_quality"](spark, SF).collect():
        want = plain_counts(documents[r["doc_id"]]["text"])
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    got = quality.judge(odd).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(plain_counts(x[1]) for x in ROWS)


def test_robust_shape_against_plain_concentration(spark):
    draw = np.random.default_rng(4)
    clean = np.round(draw.multivariate_normal([6000, 5000, 0, 0, 0], np.diag([700, 300, 1, 1, 1]) ** 2 + 1e5 * np.outer([1, 1, 0, 0, 0], [1, 1, 0, 0, 0]), 400))
    bad = np.round(draw.normal([6000, 9000, 2500, 0, 0], 50, (60, 5)))
    x = np.vstack([clean, bad])
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "_group string, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    got = quality.robust_shapes(rows).first()
    centre = np.array([got[f"m{i}"] for i in range(5)])
    assert np.abs(centre - clean.mean(axis=0)).max() < 150 and len(rows.columns) == 6
    factor = np.array([[got[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    d2 = ((np.linalg.solve(factor, (x - centre).T)) ** 2).sum(axis=0) / quality.CONSISTENCY
    assert d2[400:].min() > 60 > d2[:400].max()
    # a plain concentration step from the found shape changes little
    near = np.argsort(d2)[: int(np.ceil(0.75 * len(x)))]
    assert np.abs(x[near].mean(axis=0) - centre).max() < 60


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in queries.QUERIES["op7_neighbours"](spark, SF).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:10]
        hits += len({v for v, _ in got[ids[i]]} & set(ids[best].tolist()))
        assert all(abs(s - d[ids.tolist().index(v)]) < 1e-9 for v, s in got[ids[i]])
    assert hits >= 0.9 * 10 * len(got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(100, [1.0, 1.0]), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, None), (600, [None, 1.0]), (None, [1.0, 1.0]), (700, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("v", F.lit(2))
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [1, 4, 7, 10, 0, 2, 3, 5, 6, 8]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scan_keeps_the_nearest():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((3000, 64))
    kept = lost = 0
    for q in draw.standard_normal((20, 64)):
        best = set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist())
        found = neighbours.scan(q, x, 10)
        kept, lost = kept + len(found), lost + len(best - set(found.tolist()))
    assert lost <= 2 and kept < 20 * 3000 / 3


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_mixing_keeps_to_the_weights(spark, odd):
    rows = spark.createDataFrame([(i, s) for s, n in (("a", 700), ("b", 200), ("c", 90), (None, 10)) for i in range(n)], "doc_id long, source string")
    got = mixing.mixed(rows, {"a": 0.5, "b": 0.3, "c": 0.2}, block=2, period=100).collect()
    assert sorted(r["position"] for r in got) == list(range(1000))
    assert all(r["release"] <= r["slot"] < r["due"] for r in got)
    slots = {r["slot"]: r["source"] for r in got}
    share = {"a": 0.49, "b": 0.29, "c": 0.2, None: 0.02}
    quota = Counter(s for t, s in slots.items() if t < 100)
    assert sum(quota.values()) == 100 and all(abs(quota[s] - 100 * w) <= 1.01 for s, w in share.items())
    seen, end = Counter(), min(max(t for t, s in slots.items() if s == x) for x in share)
    for t in range(end + 1):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - quota[s] / 100 * (t + 1)) < 1 for s in share)
    assert [r["slot"] for r in sorted(got, key=lambda r: r["position"])] == sorted(r["slot"] for r in got)
    assert mixing.mixed(odd).count() == len(ROWS)
    ordered = mixing.in_mixed_order(odd)
    assert ordered.columns == odd.columns and ordered.count() == len(ROWS)


@pytest.mark.parametrize("targets", [None, {"big": 0.5, **{f"s{i}": 0.5 / 18 for i in range(18)}, "rare": 0.0001}])
def test_mixing_keeps_to_the_targets_themselves(spark, targets):
    sizes = {"big": 3000, **{f"s{i}": 150 + i for i in range(18)}, "rare": 40, "none": 30}
    rows = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = sorted(mixing.mixed(rows, targets, block=1).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == [r["slot"] for r in got] == list(range(len(got)))
    assert all(r["release"] <= r["slot"] < r["due"] for r in got)
    weight = {s: n ** 0.5 for s, n in sizes.items()} if targets is None else {s: targets.get(s, 0) for s in sizes}
    total, seen = sum(weight.values()), Counter()
    for t, r in enumerate(got):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weight.items())
        if seen[r["source"]] == sizes[r["source"]]:
            break
    assert t > 1500
    if targets is not None:
        assert {r["source"] for r in got[-30:]} == {"none"}


def test_schedule_keeps_to_the_targets_however_long():
    weights = [("a", 10 ** 6, 500_000), ("b", 10 ** 6, 499_900), ("c", 10 ** 6, 100)]
    seen = Counter()
    for t, (s, *_) in zip(range(100_000), mixing.schedule(weights, 1)):
        seen[s] += 1
        assert all(abs(seen[x] - w / 1_000_000 * (t + 1)) < 1 + 1e-6 for x, _, w in weights)


# --- 9 ---------------------------------------------------------------------------------------------------------------


def plain_repeats(rows):
    first = {}
    for i, text in rows:
        w = words(text)
        for a in range(len(w) - 49):
            key = tuple(w[a: a + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = {a + k for a in range(len(w) - 49) if i is not None and first[tuple(w[a: a + 50])] < i for k in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_repeats(spark, documents, odd):
    got = queries.QUERIES["op9_substrings"](spark, SF).collect()
    assert Counter(map(tuple, got)) == plain_repeats([(i, d["text"]) for i, d in documents.items()])
    short = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.expr("substr(text, 1, 400)")).otherwise(F.col("text")))
    want = plain_repeats([(i, t[:400] if i == 7 else t) for i, t, _, _ in ROWS])
    assert Counter(map(tuple, substrings.remove_repeats(short).collect())) == want


def test_very_frequent_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 3)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(i % 5 + 1))} {passage} {'z' * i} {'run ' * 120}") for i in range(12)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    assert Counter(map(tuple, got.drop("kept_text").collect())) == plain_repeats(rows)
    assert all("p30" not in r["kept_text"] for r in got.filter("doc_id > 0").collect())


def test_suffixes_and_common_prefixes():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 2, 400)
    w[200:300] = w[20:120]
    starts = np.arange(351)
    order, common = substrings.sorted_suffixes(w, starts, starts)
    levels = [tuple(substrings._ranks(w)[0][s:s + 50]) for s in starts]
    assert len(set(levels)) == len(set(tuple(w[s:s + 50]) for s in starts)) and sorted(order) == list(starts)
    for i in range(1, 351):
        a, b = w[order[i - 1]:][:50], w[order[i]:][:50]
        assert common[i] == next((k for k in range(50) if a[k] != b[k]), 50)
    assert Counter(np.flatnonzero(common == 50).tolist()) and (common == 50).sum() >= 51
    assert [len(x) for x in substrings.sorted_suffixes(w, starts[:0], starts[:0])] == [0, 0]


@pytest.mark.parametrize("group", [2, 20_000])
def test_repeated_passages(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    text = [" ".join(f"w{i}" for i in range(120)), "own " + " ".join(f"w{i}" for i in range(90)) + " end", " ".join(f"w{i}" for i in range(49)), "v " * 60, None]
    rows = [(i, t) for i, t in enumerate(text)] + [(None, text[0]), (0, text[0] + " more")]
    count = Counter(tuple(words(t)[a:a + 50]) for i, t in rows if i is not None for a in range(max(len(words(t)) - 49, 0)))
    want = Counter()
    for i, t in rows:
        n = [count[tuple(words(t)[a:a + 50])] for a in range(max(len(words(t)) - 49, 0))] if i is not None else []
        for a in range(len(n)):
            if n[a] > 1 and (a == 0 or n[a - 1] != n[a]):
                b = next((b for b in range(a, len(n)) if n[b] != n[a]), len(n))
                want[(i, a, b - a + 49, n[a])] += 1
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == want and (1, 1, 90, 3) in want and (3, 0, 60, 11) in want
    assert substrings.repeats(got.sparkSession.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_gradients():
    draw = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity.fresh_weights().items()}
    windows = [[f"w{draw.integers(50)}" for _ in range(n)] for n in (3, 32, 17)]
    known = toxicity.Vocabulary(windows)
    index, label = known.matrix(windows), np.array([0.0, 1.0, 0.0])

    def loss():
        logit = toxicity.window_logits(w, known.inputs(w), index)
        return np.mean(np.log1p(np.exp(-np.where(label > 0, 1, -1) * logit)))

    g = toxicity._gradients(w, known.inputs(w), index, label, np.ones((toxicity.WINDOW, 3, 2 * toxicity.DIM)))[0]
    for k, value in g.items():
        at = np.unravel_index(int(np.abs(value).argmax()), value.shape)
        old = w[k][at]
        w[k][at] = old + 0.02
        high = loss()
        w[k][at] = old - 0.02
        low = loss()
        w[k][at] = old
        assert abs((high - low) / 0.04 - value[at]) < 1e-3 + 0.02 * abs(value[at]), k


def test_toxicity_on_held_out_rows(spark, odd):
    dir_ = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{dir_}/documents.parquet"), spark.read.parquet(f"{dir_}/labels.parquet")
    weights = toxicity.fit_on_sample(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter(toxicity.held_out("doc_id")).collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in truth)
    got = toxicity.score_toxicity(docs.join(F.broadcast(labels.filter(toxicity.held_out("doc_id")).select("doc_id").limit(600)), "doc_id"), weights).collect()
    right = [r["predicted"] == truth[r["doc_id"]] for r in got]
    assert np.mean(right) > 0.9 and np.mean([r["predicted"] for r in got if truth[r["doc_id"]]]) > 0.9
    some = toxicity.score_toxicity(odd, weights).collect()
    assert len(some) == len(ROWS) and all(0 <= r["score"] <= 1 for r in some)
    assert all(r["predicted"] == 0 for r in some if r["doc_id"] in (3, 4, 5))


def test_sequences_keep_the_mix(spark):
    sizes = {"a": 2000, "b": 600, "c": 600}
    rows = [(f"{s}{i}", f"{s} {s}{s} only{s} " * 5 + str(i), "en", s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    mixed_docs = corpus_pipeline.mix_sources(spark, docs, SF)
    pieces = corpus_pipeline.pack_sequences(spark, mixed_docs, SF).filter("start = 0").orderBy("sequence_id", "offset").collect()
    assert Counter(p["doc_id"] for p in pieces) == Counter(r[0] for r in rows)
    total = sum(n ** 0.5 for n in sizes.values())
    for at in range(0, 2048, packing.STRETCH):
        seen = Counter(p["doc_id"][0] for p in pieces[: at + packing.STRETCH])
        assert all(abs(seen[s] - (at + packing.STRETCH) * n ** 0.5 / total) < mixing.BLOCK for s, n in sizes.items())


# --- all -------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, odd):
    empty = odd.limit(0)
    assert secrets.scan_secrets(empty).count() == 0 and secrets.redact(empty).count() == 0
    assert sharding.shard_rows(empty, 4).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert near_dups.near_duplicates(empty).count() == 0
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0
    assert quality.judge(empty).count() == 0
    assert mixing.mixed(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fresh_weights() | {"shift": np.zeros(1)}).count() == 0


def test_pipeline_stages(spark, odd):
    """Each stage against a plain version on its own input; the last against the tokens of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        odd_out = stage(spark, odd, SF)
        if name != "packing":
            assert out.columns == docs.columns and odd_out.columns == odd.columns
        odd_out.count()
        rows = out.collect()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in rows}
            assert kept <= set(before) and len(kept) > 0.7 * len(before)
            for i in set(before) - kept:
                n, _, symbols, _, repeats = plain_counts(before[i]["text"])
                assert n < 10 or 100 * repeats > 20 * n or symbols or repeats
        elif name == "near_duplicates":
            want = plain_components([(i, d["text"]) for i, d in before.items()], 5, 80)
            assert {r["doc_id"] for r in rows} == {i for i, (_, c) in want.items() if i == c}
        elif name == "secret_scan":
            assert len(rows) == len(before)
            for r in rows:
                assert plain_base(r["text"]) == "" and (plain_base(before[r["doc_id"]]["text"]) or r["text"] == before[r["doc_id"]]["text"])
        elif name == "mix_sources":
            assert Counter(rows) == Counter(before.values())
        else:
            coder = packing.Encoder(packing.tokenizer_path())
            assert sum(r["length"] for r in rows) == sum(len(coder.tokenizer.encode(d["text"], add_special_tokens=False).ids) + 1 for d in before.values())
        if name != "packing":
            docs = spark.createDataFrame(rows, docs.schema)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "packing"]'
