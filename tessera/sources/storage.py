"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from posixpath import dirname

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a temporary folder will do on one
    machine; on a cluster that is an error, since executors don't share it."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_turn(parts: Iterable[DataFrame]) -> DataFrame | None:
    """One table of all parts; each is written before the next is asked for, so that what it holds can go."""
    path = found = None
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
        found = df
    return found.sparkSession.read.schema(found.schema).parquet(path) if found else None


def discard(*tables: DataFrame) -> None:
    """Empty the files of tables from stored() which nothing reads any more."""
    for df in tables:
        for path in {dirname(f) for f in df.inputFiles()}:
            if "/tessera-" in path:
                df.sparkSession.range(0).write.mode("overwrite").parquet(path)
