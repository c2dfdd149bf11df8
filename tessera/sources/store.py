"""An event store: tables bucketed and sorted by event, so that whatever is grouped or joined by event, or by event and more,
needs no exchange; and events as single rows with arrays of what they hold.

Where events are few and large, the store is told of a second column that cuts them into slices: its buckets, and what a task
holds, are then as small as the slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.storage import shared_dir

#: Joins by event and other keys use the buckets too.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.enabled": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
#: Rows of a bucket, about, of a table that new_store() is told the size of.
ROWS = 250_000


@dataclass
class EventStore:
    """Tables of one number of buckets. They are opened in a session of their own, which has SETTINGS; frames of other sessions
    can't be joined with them, but can be added."""

    spark: SparkSession
    folder: str
    buckets: int
    event: list[str]
    names: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, dealt: bool = False, by: Iterable[str] | None = None) -> DataFrame:
        """Write df as the table `name`, and return that. dealt: df comes from the store's tables by steps that keep their
        partitions; others are dealt to the buckets first, an exchange that is then never needed again. by: the columns of
        this table's buckets, if they aren't the store's."""
        if name in self.names:
            raise ValueError(f"there is a table {name}")
        keys = list(by or self.event)
        rows = df if dealt else df.repartition(self.buckets, *keys)
        table = f"tessera_{name}_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.names[name] = table
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def nested(self, *names: str, where: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
        """One row an event that any of the tables has: event, and for each table an array of its rows (structs of its other
        columns, in the order of their values; empty where the event has none). where: rows that count, by table.

        An event's rows must fit in memory. With `most`, they need not: an event (or its slice, in a store of slices) has as many
        rows, numbered by `part` from 0, as it takes for no array to be longer; each of its rows is in one of them.
        """
        out, keys = None, [*self.event, "part"] if most else self.event
        for name in names:
            rows = self[name] if not where or name not in where else self[name].filter(where[name])
            others = [c for c in rows.columns if c not in self.event]
            if most:
                place = F.row_number().over(Window.partitionBy(*self.event).orderBy(*others))
                rows = rows.withColumn("part", F.floor((place - 1) / most))
            held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*others))).alias(name))
            out = held if out is None else out.join(held, keys, "full_outer")
        if out is None:
            raise ValueError("no table is named")
        kinds = dict(out.dtypes)
        return out.select(*keys, *(F.coalesce(n, F.array().cast(kinds[n])).alias(n) for n in names))

    def drop(self) -> None:
        """Take the tables out of the catalogue; their files stay."""
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names.clear()


def new_store(spark: SparkSession, buckets: int = 0, event: Iterable[str] = ("event_id",), folder: str | None = None, rows: int = 0) -> EventStore:
    """An empty store; by default with as many buckets as there are shuffle partitions, in the shared folder. rows: of the largest
    table; the buckets (and the shuffle partitions of the store's session) are then as many as it takes for ROWS a bucket."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    folder = folder or f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    if (found := spark.conf.get("spark.checkpoint.dir", None)) is not None and own.conf.get("spark.checkpoint.dir", None) != found:
        own.conf.set("spark.checkpoint.dir", found)
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(dealt, ceil(rows / ROWS))
    own.conf.set("spark.sql.shuffle.partitions", str(max(dealt, buckets)))
    return EventStore(own, folder, buckets, list(event))
