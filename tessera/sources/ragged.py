"""A growing table of images of different sizes, laid end to end: every append goes on with the numbers and offsets of those before.

An append has a name. Its images are written below data/append=<name> first, and a row of the manifest last, which says how many
images and values there are up to it. Images without such a row don't count, so that an append that broke off is made again as a whole,
and one that is repeated does nothing. There is one writer at a time; two whose rows overlap are an error when the table is read.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranking import running

MANIFEST = "name string, images long, values long, images_before long, values_before long"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, images, values, images_before, values_before: a row an append, a small table."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/*")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def appended(images: DataFrame, folder: str, name: str, key: str = "row", px: str = "px", per_file: int = 10_000) -> bool:
    """Append images (key, px, and others), in the order of the key; False if an append of this name is there already.

    The key is distinct within an append. per_file: images in one file at most, which bounds what a writer holds.
    """
    if not re.fullmatch(r"[\w.-]+", name):
        raise ValueError("a name has letters, digits, dots, dashes and underscores")
    if taken := {"number", "start", "stop", "append"} & set(images.columns):
        raise ValueError(f"{sorted(taken)} are columns of the table")
    spark = images.sparkSession
    known = checked(spark, folder)
    if any(r["name"] == name for r in known):
        return False
    first, begin = (known[-1]["images_before"] + known[-1]["images"], known[-1]["values_before"] + known[-1]["values"]) if known else (0, 0)
    sizes = images.select(key, F.size(px).cast("long").alias("_n"), F.lit(1).cast("long").alias("_one"))
    placed = running(sizes, [F.col(key)], {"number": "_one", "stop": "_n"})
    places = placed.select(key, (F.col("number") - 1 + first).alias("number"), (F.col("stop") - F.col("_n") + begin).alias("start"), (F.col("stop") + begin).alias("stop"))
    seen = Observation()
    rows = images.join(places, key).observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.size(px)), F.lit(0)).cast("long").alias("values"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(f"{folder}/data/append={name}")
    row = [(name, seen.get["n"], seen.get["values"], first, begin)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{name}")
    return True


def checked(spark: SparkSession, folder: str) -> list:
    """The manifest's rows, in order; an error where they don't follow one another. One row an append."""
    rows = sorted(manifest(spark, folder).collect(), key=lambda r: (r["images_before"], r["values_before"], r["images"], r["name"]))
    images = values = 0
    for r in rows:
        if (r["images_before"], r["values_before"]) != (images, values):
            raise ValueError(f"append {r['name']} doesn't follow the others in {folder}")
        images, values = images + r["images"], values + r["values"]
    return rows


def read_ragged(spark: SparkSession, folder: str) -> DataFrame | None:
    """append, number, start, stop and the images of all whole appends; None without any."""
    names = [r["name"] for r in checked(spark, folder)]
    if not names:
        return None
    return spark.read.option("basePath", f"{folder}/data").option("mergeSchema", True).parquet(*(f"{folder}/data/append={n}" for n in names))
