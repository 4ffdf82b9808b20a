"""Writing intermediate tables to the folder that all executors share, and connected components on top of it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores, where it has fewer splits than there are cores; a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Without one, a local session uses a folder of this machine; a cluster, whose executors don't share it, raises.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + os.path.join(tempfile.gettempdir(), "shaleview-checkpoint")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


_TABLES: list[str] = []  # tables written and not yet deleted


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when the write that made them ends


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a table in the shared folder and read it back; clear() and done() delete it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> int:
    """How many tables written() has made that aren't deleted."""
    return len(_TABLES)


def done(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the tables written since there were `since`, but for those of the names `keep`: nothing reads them any more."""
    stay = [p for p in _TABLES[since:] if p.rpartition("/")[2].rpartition("-")[0] in keep]
    for path in set(_TABLES[since:]) - set(stay):
        remove(spark, path)
    _TABLES[since:] = stay


def clear(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables that written() has made, once the results that read them are used up; how many.

    keep: the number of tables, from the first, that stay.
    """
    gone = _TABLES[keep:]
    del _TABLES[keep:]
    for path in gone:
        remove(spark, path)
    return len(gone)


@atexit.register
def _leave() -> None:
    """What is left goes with the process, if its session still answers."""
    try:
        if _TABLES and (spark := SparkSession.getActiveSession()):
            clear(spark)
    except Exception:  # the gateway is closed already
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), component the least node.

    Alternating large-star and small-star steps; every round is a grouped aggregation over the edge list,
    so no node's neighbourhood is held in one task, and the number of rounds grows with the
    logarithm of the longest chain. Null ends are ignored; self loops yield a component of one node.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    e = written(e, "cc")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    sums = [F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"), F.count("*").alias("n")]
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the least of the closed neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours are linked to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        last, e = len(_TABLES) - 1, written(small.select("p.*").where("u <> v").distinct(), "cc")
        if before is not None:  # the table of the round before isn't read any more
            remove(e.sparkSession, _TABLES.pop(last))
        now = e.agg(*sums).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("v")), F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("v", "node").alias("component"))
