"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no spark.checkpoint.dir (tests, a local shell).
LOCAL_FALLBACK = "/tmp/checkpoints/stratum"

_KNOWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. On a cluster it must be set: a folder of
    the driver's machine alone would be lost to the executors."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or LOCAL_FALLBACK).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's own folder of intermediate tables; it goes when the application ends."""
    path = f"{shared_dir(spark)}/stratum-{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # they outlive a stopped session
        atexit.register(lambda: _delete(jvm, conf, path))
    return path


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may be gone: what is left is a temporary folder
        pass


#: Of a session for layers that are dealt out by text: a join by text and span needs no exchange where both sides lie by text;
#: all branches read the same exchange, since neither inferred filters nor pruned fields make it another one; and layers of
#: tokens are never broadcast, whatever their estimated size.
_BY_TEXT = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.constraintPropagation.enabled": "false", "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def by_text_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of ``spark`` and those of ``_BY_TEXT``; ``spark`` keeps its own."""
    own = spark.newSession()
    for k, v in ({k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and spark.conf.isModifiable(k)} | _BY_TEXT).items():
        own.conf.set(k, v)
    return own


def by_text(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out by text_id: what is made from them row by row stays where its text is. There are four times as many
    parts as in other exchanges, since rows of tokens take more memory than their text and several sorts hold them at once."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text_id")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these; no later table may read them."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), df._written_to)
