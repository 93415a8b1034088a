"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}  # of each application, in the order of writing


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a temporary one is taken on a local master
    (tests); on a cluster that would scatter tables over its machines, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor costs no recomputation beyond it.

    Columns and rows are those of df; the name only labels the folder. Used instead of localCheckpoint, and instead of
    checkpoint() because Parquet is compressed and lets later reads prune columns. The table stays until release() or
    discard(), or until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables this application has written so far, for release()."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int, *keep: DataFrame) -> int:
    """Delete the tables written since a mark, but those that `keep` reads; how many went. No other DataFrame may read them."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    held = _read_by(paths[since:], keep)
    gone = [p for p in paths[since:] if p not in held]
    _delete(spark, gone)
    paths[since:] = held
    return len(gone)


def discard(gone: DataFrame, *keep: DataFrame) -> int:
    """Delete the written tables that `gone` reads and none of `keep` does; how many went. No other DataFrame may read them."""
    spark = gone.sparkSession
    paths = _written.get(spark.sparkContext.applicationId, [])
    held = _read_by(paths, keep)
    out = [p for p in _read_by(paths, [gone]) if p not in held]
    _delete(spark, out)
    for p in out:
        paths.remove(p)
    return len(out)


def _read_by(paths: list[str], dfs: Iterable[DataFrame]) -> list[str]:
    read = {m[1] for df in dfs for f in df.inputFiles() if (m := re.search("/tables/([^/]+)/[^/]+$", f))}
    return [p for p in paths if p.rpartition("/tables/")[2] in read]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
