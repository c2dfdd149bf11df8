"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from os.path import abspath

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

VARIANTS = ("crop", "downscale", "binary")


def readable(spark: SparkSession, path: str) -> bool:
    return status_of(spark, path) == "processed"


def status_of(spark: SparkSession, path: str) -> str:
    """processed, missing, or failed: there, but not readable as Parquet."""
    try:
        return "processed" if spark.read.parquet(path).schema.fields else "failed"
    except AnalysisException as e:
        return "missing" if "PATH_NOT_FOUND" in (e.getCondition() or str(e)) else "failed"
    except Exception:  # what a broken footer raises has no class of its own
        return "failed"


def first_readable(spark: SparkSession, candidates: Iterable[str]) -> str:
    """The first candidate that is there, so that a notebook finds its tables from any folder."""
    candidates = list(candidates)
    for path in candidates:
        if readable(spark, path):
            return path
    raise FileNotFoundError(", ".join(candidates))


def read_files(spark: SparkSession, paths: Iterable[str], missing: str = "skip") -> tuple[DataFrame | None, DataFrame]:
    """All readable files (or folders of files) in one scan, with file_id (place among the readable) and file; and a table
    of file, status: processed, missing or failed.

    missing: skip, or error to fail on the first that can't be read. Paths are looked at one by one only if the scan of
    all of them can't be planned.
    """
    paths = list(paths)
    read = spark.read.option("mergeSchema", True)
    try:
        rows, status = (read.parquet(*paths) if paths else None), ["processed"] * len(paths)
    except Exception:
        status = [status_of(spark, p) for p in paths]
        bad = [p for p, x in zip(paths, status, strict=True) if x != "processed"]
        if missing == "error" and bad:
            raise FileNotFoundError(bad[0]) from None
        there = [p for p, x in zip(paths, status, strict=True) if x == "processed"]
        rows = read.parquet(*there) if there else None
    told = spark.createDataFrame(list(zip(paths, status, strict=True)), "file string, status string")
    if rows is None:
        return None, told
    there = [p for p, x in zip(paths, status, strict=True) if x == "processed"]
    plain = lambda p: re.sub(r"^[a-z0-9]+:/+", "/", p if ":" in p else abspath(p)).rstrip("/")
    places = F.broadcast(spark.createDataFrame([(plain(p), k, p) for k, p in enumerate(there)], "_path string, file_id int, file string"))  # a row a file
    # the scan's own paths are URL-encoded, all but their plus signs
    here = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")
    rows = rows.select("*", here.alias("_here")).withColumn("_folder", F.regexp_replace("_here", "/[^/]*$", ""))
    own = rows.join(places.withColumnsRenamed({"file_id": "_i", "file": "_n"}), F.col("_here") == F.col("_path"), "left").drop("_path")
    own = own.join(places, F.col("_folder") == F.col("_path"), "left").drop("_path", "_here", "_folder")
    return own.withColumns({"file_id": F.coalesce("_i", "file_id"), "file": F.coalesce("_n", "file")}).drop("_i", "_n"), told


def events(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of events low .. high - 1; the range reaches the scan's row groups."""
    out = df if low is None else df.filter(F.col("event_id") >= low)
    return out if high is None else out.filter(F.col("event_id") < high)


def open_variant(df: DataFrame, variant: str) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"one of {', '.join(VARIANTS)}, not {variant}")
    return df.filter(F.col("variant") == variant)


def check_size(df: DataFrame, px: str, n: int) -> DataFrame:
    """df, with an error on the first image that hasn't n pixels."""
    wrong = F.concat(F.lit("pixels in an image: "), F.size(px).cast("string"))
    return df.withColumn(px, F.when(F.size(px) == n, F.col(px)).otherwise(F.raise_error(wrong).cast(df.schema[px].dataType)))


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there. It isn't made again when its inputs change: see cache.reused()."""
    if not readable(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, by: Iterable[str] = (), force: bool = False, rows_per_file: int = 0) -> None:
    """Parquet, in folders by `by`; what is there is kept unless force. rows_per_file: the most in one file, 0 for any."""
    df.write.mode("overwrite" if force else "ignore").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def write_checked(df: DataFrame, path: str, rows: int, by: Iterable[str] = ()) -> None:
    """write(), and an error unless so many rows were written; they are counted as they go by."""
    seen = Observation()
    write(df.observe(seen, F.count("*").alias("n")), path, by, force=True)
    if (n := seen.get["n"]) != rows:
        raise AssertionError(f"{path} has {n} rows, not {rows}")


def write_parts(df: DataFrame, path: str, by: str, values: Iterable, rows: dict | None = None, force: bool = False) -> dict:
    """One folder for each of the values of `by`, all written by one pass over df, and the number of rows by value.

    rows: how many some values must have; other numbers, and rows of other values, are an error, after writing. What is there is an
    error unless force.
    """
    values, seen = list(values), Observation()
    counts = [F.count_if(F.col(by).eqNullSafe(F.lit(v))).alias(f"n{k}") for k, v in enumerate(values)]
    df.observe(seen, F.count("*").alias("n"), *counts).write.mode("overwrite" if force else "error").partitionBy(by).parquet(path)
    found = {v: seen.get[f"n{k}"] for k, v in enumerate(values)}
    if (others := seen.get["n"] - sum(found.values())) or any(found.get(v, 0) != n for v, n in (rows or {}).items()):
        raise AssertionError(f"{path} has the rows {found} and {others} others, not {rows}")
    return found


def write_each(frames: dict[str, DataFrame], root: str, rows: dict[str, int] | None = None) -> None:
    """One table by name below root; none is written if any is there. rows: how many each must have."""
    for name, df in frames.items():
        if readable(df.sparkSession, f"{root}/{name}"):
            raise FileExistsError(f"{root}/{name}")
    for name, df in frames.items():
        if rows and name in rows:
            write_checked(df, f"{root}/{name}", rows[name])
        else:
            df.write.parquet(f"{root}/{name}")


def dense_bytes(images: int, pixels: int, item: int = 4) -> int:
    """Size of a dense export, before it is made."""
    return images * pixels * item


def shortest(v: Column) -> Column:
    """A number with six significant digits and no zeros at its end, as printf's %.6g gives it; null stays null."""
    v = v.cast("double")
    wide = F.format_string("%.5e", v)
    power = F.regexp_extract(wide, "e(.*)$", 1).try_cast("int")
    plain = wide.try_cast("double").try_cast("decimal(20,10)").cast("string")
    fixed = F.regexp_replace(F.when(plain.contains("."), F.regexp_replace(plain, "0+$", "")).otherwise(plain), r"\.$", "")
    fixed = F.when(fixed == "0", F.when(F.format_string("%s", v) == "-0.0", "-0").otherwise("0")).otherwise(fixed)
    odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(odd, F.when(power.between(-4, 5), fixed).otherwise(F.regexp_replace(wide, r"\.?0+e", "e"))))


def write_csv(df: DataFrame, path: str) -> None:
    """Floats with six significant digits; nulls are empty."""
    shown = [shortest(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def data_dictionary(df: DataFrame, notes: dict[str, str] | None = None) -> str:
    """A markdown table of the columns."""
    lines = ["| column | type | note |", "|-|-|-|"]
    return "\n".join([*lines, *(f"| {f.name} | {f.dataType.simpleString()} | {(notes or {}).get(f.name, '')} |" for f in df.schema.fields)]) + "\n"


def weights_table(spark: SparkSession, weights: dict) -> DataFrame:
    """name, shape, values of a model's arrays."""
    rows = [(k, [int(n) for n in v.shape], [float(x) for x in v.ravel()]) for k, v in weights.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")


def load_weights(df: DataFrame) -> dict:
    return {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in df.collect()}
