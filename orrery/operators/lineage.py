"""Cutting lineage between the rounds of an iteration, and tables that are written once for a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that may be broadcast; larger ones are merged.
SMALL_ROWS = 200_000
#: A key with more than this share of all rows, and more than this number of them, is hot.
HOT, LEAST_HOT = 1024, 10_000
_kept: dict[tuple[str, str], str] = {}


def new_path(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder; a temporary folder only where none is set on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/round-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written once for each application and name; made again if its folder has gone."""
    key = (spark.sparkContext.applicationId, name)
    if key in _kept:
        try:
            return spark.read.parquet(_kept[key])
        except AnalysisException:
            del _kept[key]
    path = new_path(spark)
    made = make()
    made.write.parquet(path)
    _kept[key] = path
    return spark.read.schema(made.schema).parquet(path)


def forget() -> None:
    """From now on ``kept`` makes its tables anew."""
    _kept.clear()


def looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row that ``values`` has for their ``key``, by an inner join. ``values`` has a column ``_n``, the number of
    rows of each key: keys of more than one in ``HOT`` of all rows, at most ``HOT`` of them, are broadcast, the others merged."""
    held = cut(values)
    total = held.agg(F.sum("_n")).first()[0] or 0
    hot = held.where((F.col("_n") > total / HOT) & (F.col("_n") > LEAST_HOT)).drop("_n")
    cold = rows
    if not hot.isEmpty():
        cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    out = cold.join(held.drop("_n").hint("merge"), key)
    return out if cold is rows else out.unionByName(rows.join(F.broadcast(hot), key))


def by_block(rows: DataFrame, block: str, n: int) -> DataFrame:
    """``rows`` dealt by their ``n`` block numbers evenly over tasks, however few bytes they have: a block is much work."""
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartitionByRange(min(n, most), block)


def dealt_evenly(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to a number of tasks that does not fall with their bytes: each is much work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most SMALL_ROWS rows, else merged."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df.hint("merge")
