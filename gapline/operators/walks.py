"""Rules with memory, walked along chunks of a long series in parallel and still exactly.

A rule is a machine: from a state (None: nothing is open) and a row it gives the next state and what it found. Every chunk of a
series is walked at once, as if nothing were open where it begins. A chunk is then walked anew where the state in which the
chunk before it ended is another one than it was walked from, and so on until no chunk is. The first chunk of a series is right
from the start, each round makes the next one right, and most states end within a chunk, so a few rounds over few chunks do.
Between the rounds stands a row for each chunk, never a series.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: (state, row) -> (state, found): a state is None or a list that JSON holds, a found event a tuple.
Machine = Callable[[list | None, tuple], tuple[list | None, Iterable[tuple]]]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder (spark.checkpoint.dir, or where it is unset and Spark runs on one machine one in the
    warehouse), read back: what outlives lost executors and cuts lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/gapline-shared"
    path = f"{base}/gapline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def walked(rows: DataFrame, machine: Machine, found: str, k: str = "k", by: str = "series", width: int = 4096) -> tuple[DataFrame, DataFrame]:
    """What `machine` finds along each series in the order of `k`, and the state in which each series ended (JSON; null: none).

    `rows` has by, k and the columns that the machine gets, in this order, k first. `found` names and types the columns of an
    event. Steps are dealt by chunks of `width` of k. A series and k stand together once.
    """
    kind = dict(rows.dtypes)[by]
    columns = [c for c in rows.columns if c != by]
    dealt = written(rows.select(by, F.floor(F.col(k) / width).alias("_chunk"), *columns), "steps")
    names = [c.split()[0] for c in found.split(", ")]
    schema = f"{by} {kind}, _chunk long, _found boolean, _state string, {found}"

    def walk(key, steps: pa.Table, entry: pa.Table) -> pa.Table:
        state = entry["_entry"][0].as_py() if entry.num_rows else None
        state = json.loads(state) if state else None
        steps = steps.sort_by(k)
        head = {by: key[0].as_py(), "_chunk": key[1].as_py()}
        out = []
        for row in zip(*(steps[c].to_pylist() for c in columns), strict=True):
            state, events = machine(state, row)
            out += [head | {"_found": True} | dict(zip(names, e, strict=True)) for e in events]
        out.append(head | {"_found": False, "_state": None if state is None else json.dumps(state)})
        return pa.Table.from_pylist(out, schema=target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    key = [by, "_chunk"]
    used = changed = written(dealt.select(*key).distinct().withColumn("_entry", F.lit(None).cast("string")), "entries")
    done = None
    ordered = W.partitionBy(by).orderBy("_chunk")
    while True:
        steps = dealt.join(changed.select(*key), key, "left_semi") if done else dealt
        new = steps.groupBy(*key).cogroup(changed.groupBy(*key)).applyInArrow(walk, schema)
        done = written(done.join(changed, key, "left_anti").union(new) if done else new, "walked")
        ends = done.where(~F.col("_found")).select(*key, "_state", F.lag("_state").over(ordered).alias("_wanted"))
        changed = written(ends.join(used, key).where(~F.col("_wanted").eqNullSafe(F.col("_entry"))).select(*key, F.col("_wanted").alias("_entry")), "changed")
        if changed.isEmpty():
            last = ends.withColumn("_later", F.lead("_chunk").over(ordered)).where(F.col("_later").isNull()).select(by, F.col("_state").alias("state"))
            return done.where("_found").select(by, *names), last
        used = written(used.join(changed, key, "left_anti").union(changed), "entries")
