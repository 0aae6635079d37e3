"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys that hold at least 1/HOT_SHARE of all rows are "hot"; by counting there are at most
# HOT_SHARE of them, so a table of hot keys may always be broadcast.
HOT_SHARE = 4096

_written: list[tuple[SparkSession, str]] = []
_made: list[tuple[SparkSession, str]] = []
_kept: dict[tuple[str, str, str], tuple[SparkSession, str]] = {}


def session(app: str = "tessera", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the session is made by the submitter; no operator depends on this function.
    """
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this machine where that is unset and the master is local.

    On a cluster without the setting it raises RuntimeError, as the executors couldn't see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        _made.append((spark, path))
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str = "t") -> str:
    """A new place in the shared folder; release() removes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of any executor, keeps column
    pruning and gives the planner a true size. Column names must be unique.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, label: str, source: str, build: Callable[[str], None]) -> str:
    """The folder of something made once in a session from ``source``, such as a stored index or graph, by ``build(folder)``.

    It stays until the process ends, whatever release() removes in between.
    """
    key = (spark.sparkContext.applicationId, label, source)
    if key not in _kept:
        folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        build(folder)
        _kept[key] = (spark, folder)
    return _kept[key][1]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may be gone already
        pass


def release(spark: SparkSession) -> None:
    """Delete the tables written by materialize() in this session."""
    for owner, path in [x for x in _written if x[0] is spark]:
        _remove(owner, path)
        _written.remove((owner, path))


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        release(spark)
    for spark, path in [*_kept.values(), *_made]:
        _remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    Inputs that come in enough parts, as all large ones do, stay as they are; few small files are dealt out evenly.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_small(df: DataFrame, rows: int = HOT_SHARE) -> DataFrame:
    """``df`` with a hint to broadcast it, if a count finds at most ``rows`` rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blocked_lists(rows: DataFrame, keys: list[str], value: str, name: str, size: int = 10_000) -> DataFrame:
    """(keys, block, name): the distinct values of each key as sorted arrays of about ``size`` at most.

    A key with more values has several blocks, numbered from 0, by a hash of the value: no row and no task holds all values
    of a hot key. Null values are left out.
    """
    rows = rows.where(F.col(value).isNotNull())
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    many = broadcast_small(materialize(many.select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_parts")), "many"))
    parted = rows.join(many, keys, "left")
    block = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.col("_parts"))).cast("int")
    return parted.groupBy(*keys, block.alias("block")).agg(F.array_sort(F.collect_set(value)).alias(name))


def ranged(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with _p, written in ranges of (group, order): the rows of a group have rising _p in their order.

    Work that goes through a group in order can be done within (group, _p), of which none holds a hot group, and then be carried over
    from range to range, of which a group has no more than there are partitions.
    """
    return materialize(rows.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "ranged")


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group up to each, in order (which must be unique within a group).

    Null groups are one group. No task holds a hot group, see ranged().
    """
    parts = ranged(rows.withColumn("_v", value), group, order)
    sums = parts.groupBy(*group, "_p").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_p"]]
    both = parts.alias("a").join(sums.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", "b._o")
    within = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.col("_o") + F.sum("_v").over(within)).drop("_v", "_p", "_o")


def keyed_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique ``key``), safe for keys that hold a large share of ``left``.

    ``right[weight]`` is the number of rows of ``left`` that have the key and ``total`` the number of all rows of
    ``left``. Keys with weight >= total / HOT_SHARE (at most HOT_SHARE of them) are joined by broadcast, the rest by
    a shuffle whose largest key is then at most 1/HOT_SHARE of the rows. Null keys match nothing. Below 200,000 rows, which
    any one task can take, a plain join gives the same.
    """
    limit = max(1, total // HOT_SHARE)
    if total < 200_000:
        return left.join(right, key)
    hot = F.broadcast(right.where(F.col(weight) >= limit))
    few = F.broadcast(right.where(F.col(weight) >= limit).select(key))
    return left.join(hot, key).unionByName(
        left.join(few, key, "left_anti").join(right.where(F.col(weight) < limit), key)
    )
