"""Tables that are kept by what they were made of."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_of(df: DataFrame) -> str:
    """A name for df's rows: its plan's semantic hash, its columns, and the paths, sizes and times of its input files.

    The plan's hash doesn't tell everything (a Python function's body, say): pass a version to reused() where that matters.
    """
    files = df.inputFiles()
    told = "none"
    if files:
        every = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")  # no content
        n, a, b = every.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.sum(F.xxhash64("length", "modificationTime", "path").bitwiseAND(0xFFFFFFFF))).first()
        told = f"{n}-{a & (2**64 - 1):x}-{b:x}"
    columns = uuid.uuid5(uuid.NAMESPACE_OID, df.schema.json()).hex[:12]
    return f"{df.semanticHash() & (2**32 - 1):08x}-{columns}-{told}"


def reused(df: DataFrame, folder: str, version: str = "") -> DataFrame:
    """df's rows from the folder, written there first if the plan, its input files or the version are new.

    A table is written under a name of its own; a row of the index, written last, gives it its key. Of two writers at the same
    time both are right, and readers take the one with the smaller name; one that broke off leaves nothing that is read.
    """
    spark, key = df.sparkSession, f"{key_of(df)}-{version}"
    own = lambda: index(spark, folder).filter(F.col("key") == key).agg(F.min("name")).first()[0]
    name = own()
    if name is None:
        name = uuid.uuid4().hex
        df.write.parquet(f"{folder}/tables/{name}")
        spark.createDataFrame([(key, name)], "key string, name string").coalesce(1).write.mode("append").parquet(f"{folder}/index")
        name = own()
    return spark.read.schema(df.schema).parquet(f"{folder}/tables/{name}")


def index(spark, folder: str) -> DataFrame:
    """key, name: a row a table."""
    try:
        return spark.read.schema("key string, name string").parquet(f"{folder}/index")
    except AnalysisException:
        return spark.createDataFrame([], "key string, name string")
