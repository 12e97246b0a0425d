"""Keyed writes to Parquet tables, which enforce no keys themselves.

Tables are paths. Appends read only the key columns of what is stored. Two writers at a time need a lock outside.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, empty if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under the session's checkpoint folder, else (tests) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="grainloom-"))
    return f"{sc.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def dedupe(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return dedupe(df, keys, F.desc(seq))


def anti_join(df: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored; a null key counts as a key."""
    on = None
    right = have.select(*[F.col(k).alias(f"_have_{k}") for k in keys]).distinct()
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"_have_{k}"))
        on = cond if on is None else on & cond
    return df.join(right, on, "left_anti")


def new_rows(df: DataFrame, have: DataFrame, keys: list[str], seq: str | None = None, policy: str = "first") -> DataFrame:
    """Rows to append: keys that are not stored; within the batch the first or the last row of a key by seq, or an error.

    Rows of a table have no order, so without seq only equal rows of a key are taken as one; others are an error.
    """
    if policy in ("first", "last") and not seq:
        df, policy = df.distinct(), "error"
    if policy == "error":
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"the batch has several rows for a key of {keys}")
        batch = df
    elif policy in ("first", "last"):
        batch = dedupe(df, keys, F.asc(seq) if policy == "first" else F.desc(seq))
    else:
        raise ValueError(f"no policy {policy!r}")
    return anti_join(batch, have, keys)


def append_first_wins(df: DataFrame, path: str, keys: list[str], seq: str | None = None) -> None:
    """Appends rows with new keys; stored rows never change, and the first of a batch wins. Loading twice equals once."""
    out = df.drop(seq) if seq else df
    new_rows(df, stored(df.sparkSession, path, out), keys, seq, "first").select(*out.columns).write.mode("append").parquet(path)


def append_new_only(df: DataFrame, path: str, keys: list[str], policy: str = "error", seq: str | None = None) -> None:
    out = df.drop(seq) if seq else df
    new_rows(df, stored(df.sparkSession, path, out), keys, seq, policy).select(*out.columns).write.mode("append").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_master(df: DataFrame, path: str, replace: bool = True) -> None:
    df.withColumn("date", F.date_format("date", "yyyy-MM-dd")).write.mode("overwrite" if replace else "append").partitionBy("series").parquet(path)


def log_decisions(df: DataFrame, path: str) -> None:
    """Appends recommendations with a generated id and empty actual columns."""
    empty = {"actual_action": "string", "quantity_actual_ton": "double", "reason_override": "string"}
    df.withColumns({"id": F.uuid(), "created_at": F.current_timestamp()} | {c: F.lit(None).cast(t) for c, t in empty.items()}).write.mode("append").parquet(path)


def with_actuals(log: DataFrame, updates: DataFrame) -> DataFrame:
    """The log with what was done. updates: (id, actual_action, quantity_actual_ton, reason_override); null keeps."""
    cols = ["actual_action", "quantity_actual_ton", "reason_override"]
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    return log.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*log.columns)


def record_actual(spark: SparkSession, path: str, updates: DataFrame, into: str) -> None:
    """Writes the updated log to another path, as Parquet can't be overwritten while it is read."""
    with_actuals(spark.read.parquet(path), updates).write.mode("overwrite").parquet(into)


def rekey_supply(df: DataFrame, year: str = "marketing_year", release: str = "release_date", seq: str | None = None) -> DataFrame:
    """Rows under the composite key (release, year): a blank year becomes `legacy`; the first row of a key stays."""
    name = F.trim(F.coalesce(F.col(year), F.lit("")))
    out = df.withColumn(year, F.when(name == "", "legacy").otherwise(name))
    return dedupe(out, [release, year], *([F.asc(seq)] if seq else [F.col(c) for c in out.columns]))


def write_records(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Validation folds or bias records as CSV or JSON."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)
