"""What Python workers hold at once, and what they keep from task to task."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import by_size, map_rows
from tessera.operators.graph import connected_components
from tessera.sources.storage import stored


def test_a_range_has_few_texts():
    """Tables of a row for each text (language counts: 16 KB a row) are bounded for short and empty texts too."""
    texts = [""] * 5000 + ["x" * 600_000] * 3 + ["y"] * 2000
    found = list(by_size(texts))
    assert max(b - a for a, b in found) <= 1024 and max(sum(map(len, texts[a:b])) for a, b in found) <= 1_000_000
    assert [k for a, b in found for k in range(a, b)] == list(range(len(texts)))


def test_other_work_drops_a_tokenizer(spark):
    """The tables of a worker's tokenizer are gone once it has a task of another operator."""
    ranks = {bytes([b]): b for b in range(256)} | {b"so": 256}
    docs = spark.createDataFrame([(k, "some words") for k in range(8)], "doc_id long, text string").repartition(1)
    assert bpe.encode(docs, ranks, r" ?\p{L}+").select(F.size("ids")).distinct().collect() == [(9,)]

    def make():
        import gc

        n = sum(isinstance(x, bpe.Tokenizer) for x in gc.get_objects())
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows)], ["n"])

    assert map_rows(docs, "n long", make).distinct().collect() == [(0,)]


@pytest.mark.parametrize("chain", [2, 12])
def test_rounds_write_few_files(spark, chain):
    """A round's tables are in a file for each core at most where they have few rows, however many partitions a shuffle has."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in held}, []

    def keep(df):
        out = stored(df)
        files.append(len(out.inputFiles()))
        return out

    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(chain).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = connected_components(edges, keep).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["component"] for r in found} == dict.fromkeys(range(chain + 1), 0)
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism
