"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Counts come from whole texts in one pass without a shuffle: words, symbols, repeated lines and repeated five-word windows.
Per language and source a minimum-covariance-determinant estimate is then fitted to a transformed vector of the counts. The
counts of repeats are 0 in most documents, which would make any such determinant 0; so a fixed diagonal (the squares of
FLOORS, about one repeated line or symbol more or less) is added to every scatter, and the determinant of the sum is what is
minimised (a regularised minimum determinant, for which concentration steps never raise it either).

1. Equal vectors of a group become one row with their number, so a step reads no more rows than there are different vectors.
2. Three starts: the medians with the floors as scales; mean and covariance of all; the medians with the covariance of the
   directions seen from them (spatial signs).
3. A concentration step ranks a group's vectors by their distance under the present estimate and takes mean and scatter of
   the nearest three quarters. Ranks come from a histogram of fixed logarithmic buckets that holds the sums too; the bucket
   at the boundary counts with the share that is still to be filled. Steps go on as long as they lower the determinant, for
   each group and start by itself; of a group's starts the one of the least determinant is kept.
4. Distances are scaled so that the three-quarters quantile of a group is that of the chi-square distribution. Documents
   beyond its 0.999 quantile are outliers.

What a step gathers is sums of whole numbers, pre-aggregated before the shuffle, so no group meets in one task and reruns
agree. Null or empty text: no words, all counts 0, fails the base rule. Null lang or source: a group of its own. Repeated
rows are separate documents, and ties share a bucket. Very long texts are counted whole. An empty table gives an empty
result. Groups of fewer than `min_group` documents that pass the base rule are judged by the estimate of their language,
and where that has fewer too by that of all documents. Extra columns stay, but those named like a count, distance2 or kept
are replaced; names with a leading underscore are for the steps' own columns.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, staged

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = 4
#: Share of a group that the estimate rests on.
SUPPORT = 0.75
# Quantiles of the chi-square distribution with four degrees of freedom, 0.75 and 0.999.
CHI2_SUPPORT = 5.385
CUTOFF = 18.467
#: The consistency factor's upper end, as the floors lose their meaning where a group has hardly any scatter.
MOST_SCALE = 2.0
#: Least standard deviation of each component: mean word length, symbol share, repeated lines, repeated words (logs).
FLOORS = (0.12, 0.5, 0.7, 0.7)
#: Features are whole thousandths.
SCALE = 1000
#: Buckets of squared distance for each natural logarithm.
FINE = 64
#: A step that lowers the logarithm of the determinant by less than this is the last.
LEAST_FALL = 1e-3
#: Estimates are broadcast while there are no more of them than this (about 200 bytes each).
BROADCAST_GROUPS = 20_000


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, plus the counts and base_failed; `n_lines` counts lines that hold a word."""
    rest = [c for c in docs.columns if c != text and c not in (*COUNTS, "n_lines", "base_failed")]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)).alias("_lines"),
    )
    n = F.size("_words")
    two = one.select(
        *[F.col(f"`{c}`") for c in rest], "n_symbols", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("_words", i, 5))))
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    kept = [c for c in two.columns if c != "_windows"]
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    three = two.select(*[F.col(f"`{c}`") for c in kept], F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", pair))).otherwise(none).alias("_sorted"))
    twice = lambda s, j: (F.get("_sorted", j - 1)["h"] == s["h"]) | (F.get("_sorted", j + 1)["h"] == s["h"])
    four = three.select(*[F.col(f"`{c}`") for c in kept], F.sort_array(F.transform(F.filter("_sorted", lambda s, j: F.coalesce(twice(s, j), F.lit(False))), lambda s: s["i"])).alias("_at"))
    gaps = F.transform("_at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_at", j + 1) - p, F.lit(5))))
    five = four.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_at")
    return five.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features() -> list[Column]:
    """The transformed vector as whole thousandths."""
    share = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = [F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(x * SCALE).cast("long") for x in raw]


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_ESTIMATE = ["_group", "_start", *[f"m{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in _PAIRS], "_det"]


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre m0.., inverse scatter p00.. and logarithm of its determinant from the centre and the covariances c00.. ."""
    out = moments.select("_group", "_start", *[f"m{i}" for i in range(DIMS)], *[(F.col(f"c{i}{j}") + F.lit((FLOORS[i] * SCALE) ** 2 * (i == j))).alias(f"c{i}{j}") for i, j in _PAIRS])
    for i, j in _PAIRS:  # lower factor
        c = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    for i, j in sorted(_PAIRS, key=lambda x: x[0] - x[1]):  # its inverse
        c = reduce(add, [F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)], F.lit(0.0))
        out = out.withColumn(f"v{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else -c / F.col(f"l{i}{i}"))
    inverse = [reduce(add, [F.col(f"v{k}{i}") * F.col(f"v{k}{j}") for k in range(i, DIMS)]).alias(f"p{i}{j}") for i, j in _PAIRS]
    return out.select("_group", "_start", *[f"m{i}" for i in range(DIMS)], *inverse, (2 * reduce(add, [F.log(f"l{i}{i}") for i in range(DIMS)])).alias("_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under m0.., p00.. ."""
    away = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    return reduce(add, [F.col(f"p{i}{j}") * away[i] * away[j] * (1 if i == j else 2) for i, j in _PAIRS])


def _small(df: DataFrame, groups: int) -> DataFrame:
    """`df`, a table of a few rows for each of `groups`, broadcast while these are few; beyond that a plain join, of which skewed
    parts are split."""
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


def _written(df: DataFrame, groups: int, name: str) -> DataFrame:
    """A table of a few rows for each of `groups`, in few files."""
    return staged(df.repartition(1 + groups // BROADCAST_GROUPS), name)


def _histogram(fit: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """Number and sums of the vectors in each bucket of distance, with the share of the bucket that is among the nearest."""
    bucket = F.floor(F.log(F.greatest(_distance(), F.lit(1e-9))) * FINE).cast("int")
    s = [F.sum(F.col("_w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMS)]
    q = [F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]
    at = fit.join(_small(params, groups), "_group").withColumn("_bucket", bucket).groupBy("_group", "_start", "_bucket").agg(F.sum("_w").alias("_n"), *s, *q)
    w = W.partitionBy("_group", "_start")
    run = at.withColumn("_before", F.sum("_n").over(w.orderBy("_bucket")) - F.col("_n")).withColumn("_half", F.ceil(F.sum("_n").over(w) * SUPPORT))
    return run.withColumn("_share", F.least(F.greatest((F.col("_half") - F.col("_before")) / F.col("_n"), F.lit(0.0)), F.lit(1.0)))


def _step(fit: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """The estimates from the nearest vectors under `params`."""
    part = (F.col("_share") > 0) & (F.col("_share") < 1)
    # whole buckets as whole numbers and the one at the boundary by itself: the order of summation does not matter
    total = lambda c: F.coalesce(F.sum(F.when(F.col("_share") == 1, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(part, F.col("_share") * F.col(c))), F.lit(0.0))
    names = [*[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in _PAIRS]]
    sums = _histogram(fit, params, groups).groupBy("_group", "_start").agg(F.max("_half").alias("_half"), *[total(c).alias(c) for c in names])
    return _estimates(_moments(sums, "_half"))


def _moments(sums: DataFrame, n: str) -> DataFrame:
    mean = [F.col(f"s{i}") / F.col(n) for i in range(DIMS)]
    return sums.select("_group", "_start", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(F.col(f"q{i}{j}") / F.col(n) - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in _PAIRS])


def _starts(fit: DataFrame, groups: int) -> DataFrame:
    """The three first estimates of each group."""
    long = fit.select("_group", "_w", F.posexplode(F.array(*[f"x{i}" for i in range(DIMS)])).alias("_i", "_v")).groupBy("_group", "_i", "_v").agg(F.sum("_w").alias("_n"))
    w = W.partitionBy("_group", "_i")
    run = long.withColumn("_run", F.sum("_n").over(w.orderBy("_v"))).withColumn("_all", F.sum("_n").over(w))
    medians = run.where(2 * F.col("_run") >= F.col("_all")).groupBy("_group").agg(*[F.min(F.when(F.col("_i") == i, F.col("_v"))).cast("double").alias(f"m{i}") for i in range(DIMS)])
    medians = _written(medians, groups, "medians")
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i, j in _PAIRS]
    first = medians.select("_group", F.lit(0).alias("_start"), *[f"m{i}" for i in range(DIMS)], *zero)
    whole = fit.groupBy("_group").agg(F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])
    second = _moments(whole.withColumn("_start", F.lit(1)), "_n")
    away = [(F.col(f"x{i}") - F.col(f"m{i}")) / (FLOORS[i] * SCALE) for i in range(DIMS)]
    square = F.greatest(reduce(add, [x * x for x in away]), F.lit(1e-9))
    signs = fit.join(_small(medians, groups), "_group").groupBy("_group").agg(F.sum("_w").alias("_n"), *[F.max(f"m{i}").alias(f"m{i}") for i in range(DIMS)], *[F.sum(F.col("_w") * F.round(1e6 * away[i] * away[j] / square).cast("long")).alias(f"q{i}{j}") for i, j in _PAIRS])
    third = signs.select("_group", F.lit(2).alias("_start"), *[f"m{i}" for i in range(DIMS)], *[(F.col(f"q{i}{j}") / F.col("_n") * (DIMS * 1e-6 * FLOORS[i] * FLOORS[j] * SCALE**2)).alias(f"c{i}{j}") for i, j in _PAIRS])
    return _estimates(first.unionByName(second).unionByName(third)).withColumn("_det", F.lit(1e300))


def estimates(fit: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group, from rows of _group, x0.. and their number _w; staged."""
    groups = fit.select("_group").distinct().count()
    now, ended = _written(_starts(fit, groups), groups, "mcd"), None
    while True:
        new = _step(fit, now, groups).select("_group", "_start", *[F.col(c).alias(f"_new_{c}") for c in _ESTIMATE[2:]])
        both = now.join(new, ["_group", "_start"])
        falls = F.col("_new__det") < F.col("_det") - LEAST_FALL
        both = _written(both.select("_group", "_start", *[F.when(falls, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in _ESTIMATE[2:]], falls.alias("_falls")), groups, "mcd")
        over = both.where("NOT _falls").select(*_ESTIMATE)
        ended = over if ended is None else ended.union(over)
        now = both.where("_falls").select(*_ESTIMATE)
        if now.isEmpty():
            break
    best = ended.groupBy("_group").agg(F.min(F.struct("_det", "_start", *_ESTIMATE[2:-1])).alias("e"))
    return _written(best.select("_group", *[F.col(f"e.{c}").alias(c) for c in _ESTIMATE[1:]]), groups, "mcd")


def mcd_filter(counts: DataFrame, by: tuple[str, ...] = ("lang", "source"), min_group: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """`counts` (of base_counts) with distance2 (null where no document passes the base rule) and kept."""
    named = lambda n: F.concat(F.lit(f"{n}"), F.to_json(F.struct(F.lit(0).alias("g"), *[F.col(f"`{c}`").cast("string").alias(f"g{i}") for i, c in enumerate(by[:n])])))
    levels = [f"_level{n}" for n in range(len(by), -1, -1)]
    base = [c for c in counts.columns if c not in ("distance2", "kept")]
    stats = staged(counts.select(*[F.col(f"`{c}`") for c in base], *[named(len(by) - i).alias(c) for i, c in enumerate(levels)], *[x.alias(f"x{i}") for i, x in enumerate(features())]), "quality")
    # the finest group of each document that is large enough
    groups = stats.groupBy(*levels).agg(F.sum(F.when(~F.col("base_failed"), 1).otherwise(0)).alias("_n"))
    for c in levels[1:-1]:
        groups = groups.join(groups.groupBy(c).agg(F.sum("_n").alias(f"_n{c}")), c)
    large = [F.when(F.col("_n" if i == 0 else f"_n{c}") >= min_group, F.col(c)) for i, c in enumerate(levels[:-1])]
    groups = staged(groups.select(levels[0], F.coalesce(*large, F.col(levels[-1])).alias("_group")), "groups")
    xs = [f"x{i}" for i in range(DIMS)]
    once = stats.where(~F.col("base_failed")).groupBy(*levels, *xs).agg(F.count(F.lit(1)).alias("_w"))
    fit = once.select(F.explode(F.array(*levels)).alias("_group"), *xs, "_w").groupBy("_group", *xs).agg(F.sum("_w").alias("_w"))
    used = groups.select("_group").distinct()
    n, every = used.count(), groups.count()
    fit = staged(fit.join(_small(used, n), "_group", "left_semi"), "vectors")
    best = estimates(fit)
    cut = _histogram(fit, best, n).where("_share > 0").groupBy("_group").agg(F.max("_bucket").alias("_cut"))
    scale = F.lit(CHI2_SUPPORT) / F.greatest(F.exp((F.col("_cut") + 1) / float(FINE)), F.lit(CHI2_SUPPORT / MOST_SCALE))
    last = _written(best.join(cut, "_group").withColumn("_scale", scale), n, "mcd")
    # every document, those that fail the base rule included
    judged = stats.join(_small(groups, every), levels[0]).join(_small(last, n), "_group", "left")
    judged = judged.withColumn("distance2", F.round(_distance() * F.col("_scale"), 6)).drop(*last.columns, *xs, *levels)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """Counts, base rule and the robust outlier verdict for each document."""
    return mcd_filter(base_counts(docs.select("doc_id", "text", "lang", "source")), **options)
