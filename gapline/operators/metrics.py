"""Verification metrics as aggregates: contingency scores, thresholds, ranks, reliability, recall with chance controls, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import frames, windows


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def skill(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    pod, pofd, precision = ratio(tp, tp + fn), ratio(fp, fp + tn), ratio(tp, tp + fp)
    return {
        "accuracy": ratio(tp + tn, n), "pod": pod, "pofd": pofd, "far": ratio(fp, tp + fp), "csi": ratio(tp, tp + fp + fn), "tss": pod - pofd,
        "hss": ratio(2 * (tp * tn - fp * fn), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), "precision": precision, "f1": ratio(2 * tp, 2 * tp + fp + fn), "base_rate": ratio(tp + fn, n),
    }


def contingency(df: DataFrame, y: Column, hit: Column, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the scores from them, a row for each group. Rows with a null outcome or forecast don't count."""
    rows = df.withColumn("_y", y).withColumn("_p", hit).where("_y IS NOT NULL AND _p IS NOT NULL")
    n = lambda c: F.count(F.when(c, 1))
    four = rows.groupBy(*by).agg(n(F.col("_y") & F.col("_p")).alias("tp"), n(~F.col("_y") & F.col("_p")).alias("fp"), n(F.col("_y") & ~F.col("_p")).alias("fn"), n(~F.col("_y") & ~F.col("_p")).alias("tn"))
    return four.withColumns(skill(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def _by_threshold(df: DataFrame, y: str, p: str) -> DataFrame:
    """tp, fp, fn, tn at each threshold among the scores (scores at or above it are hits)."""
    counts = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.lit(0).alias("series"), F.col(p).cast("double").alias("threshold")).agg(F.sum(F.col(y).cast("int")).alias("_1"), F.count(F.lit(1)).alias("_n"))
    chunk = F.floor(F.col("threshold") * 65_536)
    below = frames.running(counts, [F.col("threshold")], F.col("_1"), "fn", chunk, strict=True)
    below = frames.running(below, [F.col("threshold")], F.col("_n") - F.col("_1"), "tn", chunk, strict=True)
    total = counts.groupBy("series").agg(F.sum("_1").alias("_p"), F.sum(F.col("_n") - F.col("_1")).alias("_q"))
    return below.join(total, "series").select("threshold", (F.col("_p") - F.col("fn")).alias("tp"), (F.col("_q") - F.col("tn")).alias("fp"), "fn", "tn")


def best_threshold(df: DataFrame, y: str, p: str, metric: str = "tss") -> DataFrame:
    """The threshold with the greatest `metric` (ties to the least threshold), with all its scores."""
    scored = _by_threshold(df, y, p).withColumns(skill(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))
    return scored.orderBy(F.desc(F.round(metric, 12)), "threshold").limit(1)


def brier(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Brier score, its value for the base rate, and the skill (null where that is 0)."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    yy = F.col(y).cast("double")
    out = rows.groupBy(*by).agg(F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("brier"), F.avg(yy).alias("_b"), F.count(F.lit(1)).alias("n"))
    ref = F.col("_b") * (1 - F.col("_b"))
    return out.withColumn("reference", ref).withColumn("skill", F.when(ref > 0, 1 - F.col("brier") / ref)).drop("_b")


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the curve by ranks with ties averaged; null with one class."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("int")).alias("_1"), F.count(F.lit(1)).alias("_n"))
    upto = frames.running(rows.withColumn("series", F.lit(0)), [F.col("p")], F.col("_n"), "_upto", F.floor(F.col("p") * 1024))
    ranked = upto.withColumn("_r", F.col("_upto") - (F.col("_n") - 1) / 2.0)
    s = ranked.agg(F.sum(F.col("_r") * F.col("_1")).alias("s"), F.sum("_1").cast("double").alias("a"), F.sum(F.col("_n") - F.col("_1")).cast("double").alias("b"))
    return s.select(F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("s") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))).alias("auc"), F.col("a").cast("long").alias("positives"), F.col("b").cast("long").alias("negatives"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Per bin of the score: centre, mean score, mean outcome, n; empty bins have no row."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(b.alias("bin"))
    return rows.agg(F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"), F.count(F.lit(1)).alias("n")).withColumn("centre", (F.col("bin") + 0.5) / bins)


def confusion(df: DataFrame, y: str, z: str) -> DataFrame:
    """Per class: true, predicted and right counts, precision, recall and f1; classes of either side."""
    rows = df.where(F.col(y).isNotNull() & F.col(z).isNotNull())
    long = rows.select(F.explode(F.array(F.struct(F.col(y).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(y) == F.col(z)).cast("int").alias("r")), F.struct(F.col(z).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("r")))).alias("v")).select("v.*")
    out = long.groupBy("cls").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum("r").alias("n_right"))
    a, b = ratio(F.col("n_right").cast("double"), F.col("n_pred").cast("double")), ratio(F.col("n_right").cast("double"), F.col("n_true").cast("double"))
    return out.withColumn("precision", a).withColumn("recall", b).withColumn("f1", ratio(2.0 * F.col("n_right"), (F.col("n_true") + F.col("n_pred")).cast("double")))


def regression(df: DataFrame, y: str, z: str, reference: str | None = None, by: list[str] = ()) -> DataFrame:
    """mae, rmse, bias, r2 and n over rows where all are known; with `reference`, skill = 1 - rmse / rmse of the reference."""
    known = F.col(y).isNotNull() & F.col(z).isNotNull()
    known = known & F.col(reference).isNotNull() if reference else known
    d = F.col(z) - F.col(y)
    ref = F.sqrt(F.avg((F.col(reference) - F.col(y)) * (F.col(reference) - F.col(y)))) if reference else F.lit(None).cast("double")
    out = df.where(known).groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.var_pop(y).alias("_v"), F.count(F.lit(1)).alias("n"), ref.alias("_ref"))
    out = out.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("rmse") * F.col("rmse") / F.col("_v"))).withColumn("skill", F.when(F.col("_ref") > 0, 1 - F.col("rmse") / F.col("_ref")))
    return out.drop("_v", "_ref") if reference else out.drop("_v", "_ref", "skill")


def interval_coverage(df: DataFrame, y: str, low: str, mid: str, high: str, by: list[str] = ()) -> DataFrame:
    """Share of outcomes within [low, high], correlation with the middle, and the ratio of their spreads."""
    rows = df.where(F.col(y).isNotNull() & F.col(mid).isNotNull())
    return rows.groupBy(*by).agg(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("inside"), F.corr(y, mid).alias("r"), ratio(F.stddev_pop(mid), F.stddev_pop(y)).alias("spread"), F.count(F.lit(1)).alias("n"))


def quantile_loss(df: DataFrame, y: str, quantiles: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Mean pinball loss of each quantile forecast, and the mean Huber loss of the first."""
    d = lambda c: F.col(y) - F.col(c)
    pinball = [F.avg(F.greatest(q * d(c), (q - 1) * d(c))).alias(f"pinball_{c}") for c, q in quantiles.items()]
    c = next(iter(quantiles))
    huber = F.avg(F.when(F.abs(d(c)) <= 1, 0.5 * d(c) * d(c)).otherwise(F.abs(d(c)) - 0.5)).alias("huber")
    return df.groupBy(*by).agg(*pinball, huber)


def recall_by_class(found: DataFrame, cls: str = "cls") -> DataFrame:
    """Per class and shift (0 is the truth, others chance): share of events found; the chance column is the mean of the others.

    `found` has the class, shift and found (boolean)."""
    out = found.groupBy(cls).agg(F.count(F.when(F.col("shift") == 0, 1)).alias("n"), F.avg(F.when(F.col("shift") == 0, F.col("found").cast("double"))).alias("recall"), F.avg(F.when(F.col("shift") != 0, F.col("found").cast("double"))).alias("chance"))
    return out.withColumn("above_chance", F.col("recall") - F.col("chance"))


def floors(df: DataFrame, x: str, edges: dict[str, float], value: Column) -> DataFrame:
    """Groups that overlap: for each floor the rows at or above it, their number and the mean of `value`."""
    at = F.filter(F.array(*[F.when(F.col(x) >= e, F.lit(n)) for n, e in edges.items()]), lambda c: c.isNotNull())
    return df.select(F.explode(at).alias("floor"), value.alias("_v")).groupBy("floor").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))


def monthly(df: DataFrame, t: str, by: list[str] = ()) -> DataFrame:
    """Counts by month (yyyy-MM) of seconds since 1970."""
    month = F.substring(F.date_from_unix_date(F.floor(F.col(t) / 86400).cast("int")).cast("string"), 1, 7)
    return df.groupBy(*by, month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: str = "series") -> DataFrame:
    """Rank correlation with averaged ties."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, x, y)
    ranked = windows.tied_ranks(windows.tied_ranks(rows, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, cls: str, least: float = 0.2, most: float = 10.0) -> DataFrame:
    """Inverse-frequency weights, n / (classes * n of the class), held within bounds."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy()  # one row a class
    raw = F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    return counts.withColumn("weight", F.least(F.greatest(raw, F.lit(least)), F.lit(most)))


def top_k(df: DataFrame, k: int, order: list[Column], by: str) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def cluster_bootstrap(df: DataFrame, value: str, group: str, draws: int = 200, level: float = 0.95, blocks: int = 16) -> DataFrame:
    """Mean of `value` with a percentile interval from resampling whole groups: estimate, low, high, groups.

    Only sums of groups travel. A group stands in a replicate a Poisson(1) number of times, drawn from a hash of group and
    replicate, so that no draw needs the list of groups and reruns agree.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    u = F.pmod(F.xxhash64(group, "rep"), F.lit(1 << 40)) / float(1 << 40)
    steps, total, p = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += p
        steps.append(total)
        p /= i + 1
    times = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    reps = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_m", times).where("_m > 0")
    means = reps.groupBy("rep").agg((F.sum(F.col("s") * F.col("_m")) / F.sum(F.col("n") * F.col("_m"))).alias("m"))
    a = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("estimate"), F.count(F.lit(1)).alias("groups")).join(ends)
