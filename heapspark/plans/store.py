"""Written tables: where iterative work ends its lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Keys with more than 1 / HOT of all rows are hot; there can be no more than HOT of them.
HOT = 65_536
#: Keys of fewer rows are never hot.
LEAST_HOT = 64


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster, install it or pass --py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/heapspark-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a written table; instead_of, a written table that nothing else will read, goes once that is done."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    discard(instead_of)
    return out


def counted(df: DataFrame, name: str, instead_of: DataFrame | None = None, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialize(), with the number of rows (`rows`) and other aggregates, all gathered while writing."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()]), name, instead_of)
    return out, seen.get


def discard(*tables: DataFrame | None) -> None:
    """Remove written tables; others are left alone."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, spread: str | Column, how: str = "inner") -> DataFrame:
    """rows with the columns of keyed, which has one row a key and, in `count`, how many of the `total` rows that key has.

    Hot keys are at most HOT, so their rows of keyed are broadcast; the others meet by shuffle, where
    no key has more than 1 / HOT of the rows.  Rows of hot keys are dealt by `spread`.
    how: inner or left.
    """
    least = max(LEAST_HOT, total // HOT)
    others = [c for c in keyed.columns if c not in on]
    value, hot, cold, salt = (f"{x}__join" for x in ("value", "hot", "cold", "salt"))
    parts = F.struct(*others)
    left = rows.join(F.broadcast(keyed.where(F.col(count) > least).select(*on, parts.alias(hot))), on, "left")
    left = left.withColumn(salt, F.when(F.col(hot).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int") + 1))
    right = keyed.where(F.col(count) <= least).select(*on, F.lit(0).alias(salt), parts.alias(cold))
    met = left.join(right, [*on, salt], "left").withColumn(value, F.coalesce(hot, cold))
    if how == "inner":
        met = met.where(F.col(value).isNotNull())
    return met.select(*rows.columns, *[F.col(f"{value}.{c}").alias(c) for c in others])
