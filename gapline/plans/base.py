"""What the queries share: the driver's tables as series, grids and events, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions import clocks
from gapline.operators import detect, grid
from gapline.sources.tables import table

#: Seconds of a grid step.
STEP = 600
#: Digits to which the queries round, as sums differ in their last bits by order.
DIGITS = 9


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as samples: series (the type), t (seconds), us, x, id, user."""
    e = table(spark, sf_dir, "events")
    us = clocks.micros(F.col("ts"))
    return e.select(F.col("event_type").alias("series"), F.floor(us / 1_000_000).alias("t"), us.alias("us"), F.col("value").alias("x"), F.col("event_id").alias("id"), F.col("user_id").alias("user"))


def binned(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    """series, k, x (mean), n on a dense grid of each series."""
    rows = samples(spark, sf_dir).groupBy("series", F.floor(F.col("t") / step).alias("k")).agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    return grid.spine(rows).fillna(0, ["n"])


def active(spark: SparkSession, sf_dir: str, least: float = 70.0) -> DataFrame:
    """Events: runs of hourly bins whose mean reaches `least`: series, event, start, stop, peak (hours), peak_value, magnitude."""
    hours = binned(spark, sf_dir, 3600).where(F.col("x") >= least)
    runs = detect.frames.runs(hours, "k", F.lit(True))
    out = runs.groupBy("series", "run").agg(F.min("k").alias("start"), F.max("k").alias("stop"), F.max_by("k", F.struct(F.round("x", 6), -F.col("k"))).alias("peak"), F.max("x").alias("peak_value"))
    return out.select("series", (F.col("start") * 1_000_000 + F.col("stop")).alias("event"), "start", "stop", "peak", "peak_value", (F.col("peak_value") / 50).alias("magnitude"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and label pairs: y (0 or 1), p in [0, 1] from the length of a document, and its source."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    p = F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    return lab.join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", p.alias("p"), "source", "lang", "n_chars")


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles rounded to DIGITS, negative zero made positive."""
    return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


# The same in SQL, as common table expressions.
E_SQL = "e AS (SELECT event_type AS series, epoch_us(ts) // 1000000 AS t, epoch_us(ts) AS us, value AS x, event_id AS id, user_id AS \"user\" FROM events)"


def b_sql(step: int = STEP, name: str = "b") -> str:
    return f"""{E_SQL}, {name}0 AS (SELECT series, t // {step} AS k, avg(x) AS x, count(x) AS n FROM e GROUP BY ALL),
{name} AS (SELECT s.series, s.k, {name}0.x, coalesce({name}0.n, 0) AS n
  FROM (SELECT series, unnest(range(min(k), max(k) + 1)) AS k FROM {name}0 GROUP BY series) s LEFT JOIN {name}0 ON {name}0.series = s.series AND {name}0.k = s.k)"""


def a_sql(least: float = 70.0) -> str:
    return f"""{b_sql(3600, 'h')}, ah AS (SELECT *, k - row_number() OVER (PARTITION BY series ORDER BY k) AS run FROM h WHERE x >= {least}),
a AS (SELECT series, min(k) * 1000000 + max(k) AS event, min(k) AS start, max(k) AS stop, arg_max(k, (round(x, 6), -k)) AS peak, max(x) AS peak_value, max(x) / 50 AS magnitude FROM ah GROUP BY series, run)"""


S_SQL = "s AS (SELECT l.doc_id, l.quality AS y, l.toxic, least(1.0, d.n_chars / 4000.0) AS p, d.source, d.lang, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def r_sql(*columns: str) -> str:
    """Rounded columns of a SELECT."""
    return ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in columns)
