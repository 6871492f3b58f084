"""Readers for plain formats and the incremental store of processed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line under a stated schema; rows that don't fit have nulls."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds one list of records."""
    return spark.read.json(path, multiLine=True)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size and modified of the files below `root`; the content is not read. Half-written files (.tmp_*, *.part) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~name.startswith(".tmp_") & ~name.endswith(".part"))


def cache_key(columns: list[str], settings: dict[str, object]) -> Column:
    """Key of a source's content and of the settings that change what is made of it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha1(F.concat_ws("|", *parts, *[F.lit(f"{k}={settings[k]}") for k in sorted(settings)]).cast("binary"))


def pending(sources: DataFrame, manifest: DataFrame, retry: bool = True) -> DataFrame:
    """Sources whose key the manifest (key, status) lacks, or holds as failed where `retry`."""
    done = manifest.where(F.col("status") != "failed") if retry else manifest
    return sources.join(done.select("key").distinct(), "key", "left_anti")


def store(df: DataFrame, path: str, key: str = "key") -> None:
    """Appends results to a Parquet store laid out by key, so that a later read of some keys prunes the rest."""
    df.write.mode("append").partitionBy(key).parquet(path)


def status(results: DataFrame, sources: DataFrame, key: str = "key") -> DataFrame:
    """key, status (ok, empty) and rows of each source after a run."""
    n = results.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return sources.select(key).distinct().join(n, key, "left").select(key, F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and state of each file of a manifest or a listing (path, size, crc): ok, missing, unknown, size or content differs."""
    m, f = manifest.select("path", F.col("size").alias("_ms"), F.col("crc").alias("_mc")), files.select("path", F.col("size").alias("_fs"), F.col("crc").alias("_fc"))
    state = F.when(F.col("_fs").isNull(), "missing").when(F.col("_ms").isNull(), "unknown").when(F.col("_ms") != F.col("_fs"), "size").when(F.col("_mc") != F.col("_fc"), "content").otherwise("ok")
    return m.join(f, "path", "full_outer").select("path", state.alias("state"))


def inventory(sources: DataFrame, done: DataFrame, month: Column) -> DataFrame:
    """Per month: sources, those done (by key) and those pending."""
    marked = sources.join(done.select("key").distinct().withColumn("_d", F.lit(1)), "key", "left")
    return marked.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("sources"), F.count("_d").alias("done"), F.count(F.when(F.col("_d").isNull(), 1)).alias("pending"))


def export(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    """`df` as csv (with a header), json or parquet files; the committer makes them visible all at once."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no such kind: {kind}")
    df.write.mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options).format(kind).save(path)
