"""Statistics of the recorded analyses, as grouped aggregates and closed forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.operators.ordering import global_rank, running_total
from dendrospark.session import cut


def chi2_2x2(df: DataFrame, group: Column, outcome: Column) -> DataFrame:
    """Pearson chi-square of a 2 x 2 table with both rates and their ratio."""
    c = df.agg(
        F.count_if(group & outcome).alias("a"), F.count_if(group & ~outcome).alias("b"),
        F.count_if(~group & outcome).alias("c"), F.count_if(~group & ~outcome).alias("d"))
    d = {k: F.col(k).cast("double") for k in "abcd"}
    n = d["a"] + d["b"] + d["c"] + d["d"]
    det = d["a"] * d["d"] - d["b"] * d["c"]
    out = c.withColumns({
        "chi2": F.try_divide(n * det * det, (d["a"] + d["b"]) * (d["c"] + d["d"]) * (d["a"] + d["c"]) * (d["b"] + d["d"])),
        "rate_in": F.try_divide(d["a"], d["a"] + d["b"]), "rate_out": F.try_divide(d["c"], d["c"] + d["d"])})
    return out.withColumn("ratio", F.try_divide("rate_in", "rate_out"))


def mcnemar(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """McNemar with continuity correction on paired outcomes."""
    c = df.agg(F.count_if(before & ~after).alias("b"), F.count_if(~before & after).alias("c"))
    diff = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double")
    return c.withColumn("statistic", F.try_divide(diff * diff, (F.col("b") + F.col("c")).cast("double")))


def mid_ranks(df: DataFrame, value: str, out: str = "mid_rank") -> DataFrame:
    """Average rank of equal values, from the counts of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts, [F.col(value)], "_n", "_upto")
    ranks = upto.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, value)


def mann_whitney(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """U of the positive group, with the sizes of both groups and the area under the ROC curve."""
    r = mid_ranks(df.select(F.col(value).cast("double").alias("_v"), positive.alias("_p")), "_v")
    out = r.agg(F.count_if("_p").alias("n_pos"), F.count_if(~F.col("_p")).alias("n_neg"),
                F.sum(F.when(F.col("_p"), F.col("mid_rank"))).alias("_s"))
    out = out.withColumn("u", F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0)
    return out.withColumn("auc", F.try_divide("u", (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("_s")


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    return mann_whitney(df, score, positive).select("n_pos", "n_neg", "auc")


def welch_t(df: DataFrame, value: str, positive: Column) -> DataFrame:
    v = F.col(value).cast("double")
    a, b = F.when(positive, v), F.when(~positive, v)
    m = df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
               F.count(a).alias("n_a"), F.count(b).alias("n_b"))
    sa, sb = F.col("va") / F.col("n_a"), F.col("vb") / F.col("n_b")
    return m.select("mean_a", "mean_b", "n_a", "n_b", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)).alias("t"),
                    F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)).alias("df"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a).cast("double") - F.col(b).cast("double")
    m = df.agg(F.avg(d).alias("mean_diff"), F.var_samp(d).alias("_v"), F.count(d).alias("n"))
    return m.select("mean_diff", "n", F.try_divide("mean_diff", F.sqrt(F.col("_v") / F.col("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (Pearson of mid-ranks). With a 0/1 column Pearson is the point-biserial correlation."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    r = mid_ranks(mid_ranks(d, "_x", "_rx"), "_y", "_ry")
    return r.agg(F.corr("_x", "_y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def rate_by_bin(df: DataFrame, value: str, width: float, positive: Column) -> DataFrame:
    """Share of positives (precision) and of negatives per bin of fixed width."""
    b = F.floor(F.col(value) / F.lit(width)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_pos")).withColumns({
        "precision": F.col("n_pos") / F.col("n"), "false_rate": (F.col("n") - F.col("n_pos")) / F.col("n")})


def bh_fdr(df: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """How many tests stay significant: raw, Bonferroni, Benjamini-Hochberg."""
    known = df.filter(F.col(p).isNotNull())
    ranked = global_rank(known, [F.col(p), F.col(tie)], "_k")
    ranked = cut(ranked)
    return ranked.withColumn("_m", F.lit(ranked.count())).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col(p) <= alpha).alias("n_raw"),
        F.count_if(F.col(p) <= F.lit(alpha) / F.col("_m")).alias("n_bonferroni"),
        F.coalesce(F.max(F.when(F.col(p) <= F.col("_k") * F.lit(alpha) / F.col("_m"), F.col("_k"))), F.lit(0)).alias("n_bh"))


def logit_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of a logistic regression with one feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[x], outputCol="features").transform(df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)))
    model = LogisticRegression(featuresCol="features", labelCol=y, maxIter=100, tol=1e-10).fit(data)
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


def alignment_by_gap(df: DataFrame, gap: str, alignment: str, width: float) -> DataFrame:
    """Mean alignment per gap bin."""
    return df.groupBy(F.floor(F.col(gap) / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(alignment).alias("mean_alignment"))


def decay_rate(binned: DataFrame, floor: float, width: float) -> DataFrame:
    """Exponential decay of the binned mean above a given floor: slope of ln(mean - floor) over the bin centre."""
    y = F.when(F.col("mean_alignment") > floor, F.log(F.col("mean_alignment") - F.lit(floor)))
    x = (F.col("bin") + 0.5) * F.lit(width)
    fit = binned.withColumns({"_x": x, "_y": y}).filter(F.col("_y").isNotNull())
    return fit.agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count(F.lit(1)).alias("n_bins"))


def zone_of_edge(edge_mid: DataFrame, landmarks: DataFrame, zone_um: float) -> DataFrame:
    """Edges (``edge_id, x, y, z``) within ``zone_um`` of a landmark node (branch or soma), with the distance where inside."""
    from dendrospark.operators.spatial import as_build, nearest

    hit = nearest(edge_mid, as_build(landmarks), probe_id="edge_id", build_id="b_id", radius=zone_um)
    return edge_mid.join(hit.select("edge_id", F.sqrt("d2").alias("distance")), "edge_id", "left").withColumn(
        "near", F.col("distance").isNotNull())
