"""Intermediate tables in the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset, as in tests on one
machine, a temporary folder of this session is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="melodyspark-"))
    return base.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on at most ``rows`` rows go to Python at a time in this session: whole texts make batches large on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the session has cores: a file of few row groups is dealt out once, larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote in this session; frames that still read them must have been written elsewhere."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """``make()`` written as a table, and its path. Tables that were written on the way to it are deleted; others stay."""
    app = spark.sparkContext.applicationId
    before = _written.pop(app, [])
    try:
        out = materialize(make(), name)
        path = _written[app].pop()
        _delete(spark, _written[app])
        _written[app] = [path]
    finally:
        _written[app] = before + _written.get(app, [])
    return out, path


def release(spark: SparkSession, path: str) -> None:
    """Delete one table that nothing reads any more."""
    _delete(spark, [path])
    known = _written.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def same_row(id_col: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes, equal for rows that agree in id and text; a null is a value of its own."""
    parts = id_col.isNull(), id_col.cast("string"), text.isNull(), text
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose keys (k1, k2) are in ``gone``: broadcast up to ``max_broadcast`` keys, shuffled beyond."""
    gone = materialize(gone.select(F.col("k1").alias("_gone1"), F.col("k2").alias("_gone2")).distinct(), "gone")
    k1, k2 = same_row(docs[f"`{id_col}`"], docs[f"`{text_col}`"].cast("string"))
    few = gone.count() <= max_broadcast
    # by the frame, not by name: docs may have columns of these names
    return docs.join(F.broadcast(gone) if few else gone, (k1 == gone["_gone1"]) & (k2 == gone["_gone2"]), "left_anti")


def big_keys(sizes: DataFrame, key: str, size_col: str, most: int = 1000) -> DataFrame | None:
    """_key and _parts of the keys with more than ``most`` rows, at most one in ``most`` of all rows; None if there are none."""
    big = sizes.where(F.col(size_col) > most).select(F.col(key).alias("_key"), F.ceil(F.col(size_col) / F.lit(most)).cast("int").alias("_parts"))
    big = materialize(big, "big-keys")
    return None if big.isEmpty() else big


def spread_join(rows: DataFrame, table: DataFrame, key: str, big: DataFrame | None, other: Column, max_broadcast: int = 1_000_000) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key; rows of ``big`` keys are dealt over several tasks by ``other``.

    The big keys are broadcast up to ``max_broadcast`` of them.
    """
    if big is None:
        return rows.join(table, key)
    big = F.broadcast(big) if big.count() <= max_broadcast else big
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(big, F.col(key) == F.col("_key"), "left").withColumn("_part", F.pmod(F.xxhash64(other), parts)).drop("_key", "_parts")
    copies = table.join(big, F.col(key) == F.col("_key"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("_key", "_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")
