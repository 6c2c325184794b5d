"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Two plain rules first (too few words, too many words in repeated five-word windows). What passes them is judged by a
minimum-covariance-determinant estimate per language and source: the mean and covariance of the ``share`` of rows that
lie closest to the centre, found by concentration steps from two starts, the one with the smaller determinant winning. A row
is rejected when its squared Mahalanobis distance exceeds ``cutoff``.

A concentration step is one aggregate: rows are binned by the logarithm of their distance, every (group, bin) sums its
moments (map-side combined, so a source with a third of all rows is no hot spot), and a running sum over the bins gives the
moments of the closest rows, whole bins at a time. Features are whole numbers (thousandths), so sums are exact and do not depend
on the order of rows. Spread below ``FLOOR`` is treated as ``FLOOR``: a statistic that is zero in most rows has no spread of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dendrospark.llm.common import SPACES, table, words_of
from dendrospark.session import cut

MIN_WORDS, REPEAT_PERCENT, SPAN = 10, 20, 5

#: Features and the least spread of each, in thousandths.
FEATURES = ("f_length", "f_word", "f_symbol", "f_line", "f_repeat")
FLOOR = (600, 250, 60, 200, 400)
P = len(FEATURES)
BIN_LOW, BIN_HIGH, BIN_STEPS = -80, 400, 8

#: Makes the covariance of the closest three quarters of a five-dimensional normal sample that of the whole
#: (share / P(chi2 with 7 degrees <= 75 % point of chi2 with 5 degrees)).
CONSISTENCY = 1.41


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column) -> Column:
    """Words in windows of five that occur twice or more in the same text, the first included."""
    last = F.size(w) - SPAN
    gram = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SPAN)])

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def count(s: Column) -> Column:
            twin = F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"]))
            places = F.array_sort(F.transform(twin, lambda e: e["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct((a["n"] + p + SPAN - F.greatest(a["end"], p)).alias("n"), (p + SPAN).alias("end"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(by_hash, count))

    return F.when(last < 1, F.lit(0)).otherwise(_bound(F.transform(F.sequence(F.lit(0), last), gram), covered))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``_lang``, ``_source`` and the counts of every whole text. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        _repeat_words(w).cast("bigint").alias("n_repeat_words"))
    of_lines = lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    return docs.select(
        *dict.fromkeys(["doc_id", *keep]),
        F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"),
        _bound(words_of(text), of_words).alias("_of_words"), _bound(lines, of_lines).alias("_of_lines"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("bigint").alias("n_symbols"),
    ).select("*", "_of_words.*", "_of_lines.*").drop("_of_words", "_of_lines")


def _with_features(stats: DataFrame) -> DataFrame:
    """Transformed statistics in thousandths. Rates are drawn towards a usual value in short texts, where they are noisy."""
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    scaled = lambda x: F.round(1000 * x).cast("bigint")
    return stats.select(
        "*", failed.alias("base_failed"),
        scaled(F.log1p(n.cast("double"))).alias("f_length"),
        scaled((F.col("word_chars") + 250.0) / (n + 50.0)).alias("f_word"),
        scaled(F.log1p(20.0 * F.col("n_symbols") / (n + 50.0))).alias("f_symbol"),
        scaled(F.col("n_dup_lines") / (F.col("n_lines") + 4.0)).alias("f_line"),
        scaled(F.log1p(20.0 * F.col("n_repeat_words") / (n + 50.0))).alias("f_repeat"))


def _group_name(level: int, *parts: str) -> Column:
    return F.concat_ws("\x01", F.lit(str(level)), *[F.coalesce(F.col(c), F.lit("\x02")) for c in parts])


def _with_groups(rows: DataFrame, least: int) -> DataFrame:
    """``_group``: language and source; of the rest, those of a language together; of the rest, all. Null where even those are few.

    Worked out on the table of languages and sources, whose written size lets the planner join it without moving the rows.
    """
    fine = _group_name(2, "_lang", "_source")
    pairs = rows.filter("not base_failed").groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n")).withColumn("_fine", fine)
    small = F.when(F.col("_n") < least, F.col("_n"))
    of_lang = Window.partitionBy(_group_name(1, "_lang"))
    pairs = pairs.withColumn("_rest", F.sum(small).over(of_lang))
    last = F.when((F.col("_n") < least) & (F.col("_rest") < least), F.col("_n"))
    pairs = pairs.withColumn("_all", F.sum(last).over(Window.partitionBy(F.lit(0))))  # one row per language and source
    group = (F.when(F.col("_n") >= least, F.col("_fine")).when(F.col("_rest") >= least, _group_name(1, "_lang"))
             .when(F.col("_all") >= least, F.lit("0")))
    found = cut(pairs.select("_fine", group.alias("_group")))
    return (rows.withColumn("_fine", F.when(~F.col("base_failed"), fine)).join(found, "_fine", "left").drop("_fine"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    x = [F.col(f) for f in FEATURES]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
            *[F.sum((x[i] * x[j]).cast("decimal(38,0)")).alias(f"q{i}{j}") for i, j in _pairs()]]


def _shape(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean ``m``, Cholesky factor ``l`` of the covariance with floor, and ``logdet`` of each row of moments."""
    n = F.col("n").cast("double")
    out = moments.select(*keys, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)],
                         *[(F.col(f"q{i}{j}").cast("double") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n)
                            + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _pairs()])
    for j in range(P):
        done = reduce(lambda a, k: a - F.col(f"l{j}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{j}{j}"))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(done, F.lit(1.0))))
        for i in range(j + 1, P):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, b: a + b, [F.log(F.col(f"l{j}{j}")) for j in range(P)])
    return out.select(*keys, "n", logdet.alias("logdet"), *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()])


def _distance(rows: DataFrame) -> DataFrame:
    """``_d2``: squared Mahalanobis distance by forward substitution."""
    for i in range(P):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"_y{k}"), range(i), F.col(FEATURES[i]) - F.col(f"m{i}"))
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"l{i}{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)])
    return rows.withColumn("_d2", total).drop(*[f"_y{i}" for i in range(P)])


def robust_shapes(rows: DataFrame, share: float = 0.75, steps: int = 6) -> DataFrame:
    """``_group`` with the centre and factor of its minimum-covariance-determinant estimate."""
    known = rows.filter(F.col("_group").isNotNull()).select("_group", *FEATURES)
    classic = _shape(known.groupBy("_group").agg(*_moments()), ["_group"]).withColumn("_start", F.lit(0))
    # the other start: medians and median deviations, no correlation; features are bounded whole numbers, so exact counts stay small
    mid = known.groupBy("_group").agg(*[F.percentile(f, F.lit(0.5)).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    spread = known.join(mid, "_group").groupBy("_group").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
        *[(1.4826 * F.percentile(F.abs(F.col(f) - F.col(f"m{i}")), F.lit(0.5))).alias(f"d{i}") for i, f in enumerate(FEATURES)])
    plain = spread.select(
        "_group", "n", F.lit(0.0).alias("logdet"), *[f"m{i}" for i in range(P)],
        *[(F.sqrt(F.col(f"d{i}") * F.col(f"d{i}") + float(FLOOR[i] ** 2)) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _pairs()],
        F.lit(1).alias("_start"))
    shapes = cut(classic.unionByName(plain))
    names = [*[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _pairs()]]
    size = cut(classic.select("_group", F.ceil(F.lit(share) * F.col("n")).alias("_h")))
    upto = Window.partitionBy("_group", "_start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("_group", "_start").orderBy("_bin")
    for _ in range(steps):
        near = _distance(known.join(shapes.drop("n", "logdet"), "_group"))
        place = F.floor(BIN_STEPS * F.log2(F.greatest("_d2", F.lit(1e-9))))
        binned = near.withColumn("_bin", F.least(F.greatest(place, F.lit(BIN_LOW)), F.lit(BIN_HIGH)))
        sums = binned.groupBy("_group", "_start", "_bin").agg(*_moments())
        running = sums.select("_group", "_start", "_bin", *[F.sum(c).over(upto).alias(c) for c in ("n", *names)])
        closest = (running.join(size, "_group").filter(F.col("n") >= F.col("_h"))
                   .withColumn("_first", F.row_number().over(first)).filter("_first = 1"))
        shapes = cut(_shape(closest, ["_group", "_start"]))
    best = Window.partitionBy("_group").orderBy("logdet", "_start")
    return shapes.withColumn("_first", F.row_number().over(best)).filter("_first = 1").drop("_first", "_start", "n", "logdet")


def judge(docs: DataFrame, keep: tuple[str, ...] = (), cutoff: float = 60.0, share: float = 0.75, least: int = 50) -> DataFrame:
    """``doc_id``, the columns ``keep``, the counts, ``base_failed``, ``distance2`` (null where not judged) and ``kept``.

    One row per row of ``docs`` (``doc_id, text, lang, source``); null languages and sources form groups of their own.
    Groups of fewer than ``least`` rows are judged with the rest of their language, then with the rest of all; if these are few
    too, the plain rules decide alone. Ties have one distance and one verdict; repeated rows stay; empty tables give empty results.
    """
    rows = _with_groups(cut(_with_features(statistics(docs, keep))), least)
    found = rows.join(cut(robust_shapes(rows, share)), "_group", "left")
    d2 = F.col("_d2") / CONSISTENCY
    judged = _distance(found).withColumn("distance2", d2)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return judged.select(*dict.fromkeys(["doc_id", *keep]), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "distance2", kept.alias("kept"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge(table(spark, sf_dir, "documents"))
