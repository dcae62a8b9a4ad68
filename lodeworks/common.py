"""Shared helpers: reading tables, counting rows, instants, durable lineage cuts.

Nothing here keeps state that is tied to one executor: intermediate results go to
the shared folder named by ``spark.checkpoint.dir`` so that a lost executor only
costs a re-read.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a private folder serves a local master. On a cluster that would be
    another folder on every machine, so there it must be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="lodeworks-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        shared_dir.made = made
    return f"file://{made}"


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; all intermediate tables lie in it."""
    return f"{shared_dir(spark)}/lodeworks/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. To be called when the results that read them are written."""
    remove_path(spark, session_dir(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The returned frame carries its folder in ``cut_path`` so that loops can
    drop the table of the previous round with :func:`drop_cut`; the others go with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "lz4")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    path = getattr(df, "cut_path", None)
    if path:
        remove_path(df.sparkSession, path)


def utc_micros(col: Column | str, dtype: T.DataType) -> Column:
    """Microseconds since the epoch of a timestamp column, whatever the session's zone.

    Strings are ISO instants with ``T`` or a space and ``Z``, an offset, or
    nothing (then UTC); unreadable strings give null. Timestamps without zone
    count as UTC.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    s = F.trim(c.cast("string"))
    if isinstance(dtype, T.StringType):
        zoned = s.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & (F.length(s) > 10)
        s = F.when(zoned, F.upper(s)).otherwise(F.concat(s, F.lit("Z")))
    else:
        s = F.concat(s, F.lit("Z"))
    return F.unix_micros(F.try_to_timestamp(s))


def micros_of(df: DataFrame, name: str) -> Column:
    return utc_micros(name, df.schema[name].dataType)


def counting_rows(df: DataFrame, key: str, time: Column, **columns: Column) -> DataFrame:
    """One row per key: the given columns of the row with the latest time.

    Each column is its own ``max_by``, so fixed-width columns stay in a hash
    aggregate with map-side combine and repeated rows never meet in one group
    in memory. Rows of equal key and equal time are identical by contract; a
    null time loses to any other. Null keys form no row.
    """
    order = F.coalesce(time, F.lit(-(1 << 62)))
    base = df.select(F.col(key).alias("_key"), order.alias("_at"), *[c.alias(n) for n, c in columns.items()])
    return (
        base.where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(*[F.max_by(n, "_at").alias(n) for n in columns], F.max("_at").alias("_at"))
        .withColumnRenamed("_key", key)
        .withColumn("_at", F.when(F.col("_at") > -(1 << 62), F.col("_at")))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def utc_month(micros: Column) -> Column:
    """``YYYY-MM`` in UTC of microseconds since the epoch, without the session's zone."""
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
