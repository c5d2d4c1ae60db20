"""Keyed sums of a stream as mergeable partial states, and the state store for keyed streams.

A micro-batch writes only the sums of its own rows, as one run of level 0. When ``fan``
runs of a level are there, they become one run of the next level, so a row is
merged once per level: work per batch follows the batch (and the logarithm of the number of batches),
never the history. Sums are exact whatever order rows come in, so no row is ever too late.

Which runs hold the state after n batches follows from the digits of n to base ``fan``.
A run's folder is named by level and last batch, so a batch that is repeated after a failure
writes the same folders again. Runs that were merged are deleted by the next batch, when
the merging batch cannot be repeated any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.sources.folders import children, remove

FAN = 8
ROCKS_DB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their keyed state on disk (RocksDB) and save what changed per batch; settings are put back."""
    before = {key: spark.conf.get(key, None) for key in ROCKS_DB}
    for key, value in ROCKS_DB.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of every other column per key, in the column's own type."""
    sums = [f for f in rows.schema.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(*(F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums))


def live_runs(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, last batch) of the runs that hold the state after ``batches`` batches."""
    out, done, level = [], 0, 0
    while fan ** (level + 1) <= batches:
        level += 1
    for at in range(level, -1, -1):
        while done + fan**at <= batches:
            done += fan**at
            out.append((at, done - 1))
    return out


def merges(batch: int, fan: int = FAN) -> list[tuple[int, list[int]]]:
    """(level, last batches of the runs one level below) that are merged after ``batch``, lowest level first."""
    out, level = [], 1
    while (batch + 1) % fan**level == 0:
        step = fan ** (level - 1)
        out.append((level, [batch - step * k for k in range(fan - 1, -1, -1)]))
        level += 1
    return out


def _run(folder: str, level: int, batch: int) -> str:
    return f"{folder}/level={level}/last={batch}"


class Partials:
    """The partial sums below ``folder``: columns ``keys`` and the sums of ``schema``."""

    def __init__(self, folder: str, keys: Sequence[str], schema: T.StructType, fan: int = FAN) -> None:
        self.folder, self.keys, self.schema, self.fan = folder, list(keys), schema, fan

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take over the rows of one batch: ``keys`` and the values to sum. Batches count from 0 without gaps."""
        spark = rows.sparkSession
        if batch > 0:
            for level, parts in merges(batch - 1, self.fan):
                for part in parts:
                    remove(spark, _run(self.folder, level - 1, part))
        own = merged(rows, self.keys).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        own.write.mode("overwrite").parquet(_run(self.folder, 0, batch))
        for level, parts in merges(batch, self.fan):
            below = spark.read.schema(self.schema).parquet(*(_run(self.folder, level - 1, part) for part in parts))
            merged(below, self.keys).write.mode("overwrite").parquet(_run(self.folder, level, batch))

    def runs(self, batches: int) -> list[str]:
        return [_run(self.folder, *run) for run in live_runs(batches, self.fan)]

    def state(self, spark: SparkSession, batches: int, where: Column | None = None) -> DataFrame:
        """The sums per key after ``batches`` batches; ``where`` filters keys in the scan."""
        paths = self.runs(batches)
        if not paths:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(*paths)
        return merged(rows if where is None else rows.where(where), self.keys)


def batches_done(spark: SparkSession, checkpoint: str) -> int:
    """Batches that a stream has committed to its checkpoint."""
    return max((int(n) + 1 for n in children(spark, f"{checkpoint}/commits") if n.isdigit()), default=0)


def run_partials(stream: DataFrame, folder: str, keys: Sequence[str], fan: int = FAN) -> tuple[Partials, int]:
    """Sum everything available of a stream (``keys`` and values); returns the partials and how many batches they took.

    A later call with the same folder goes on where this one ended.
    """
    fields = [f if f.name in keys else T.StructField(f.name, _summed(f.dataType)) for f in stream.schema.fields]
    partials = Partials(f"{folder}/runs", keys, T.StructType(fields), fan)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: partials.add(rows, batch))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return partials, batches_done(stream.sparkSession, f"{folder}/checkpoint")


def _summed(kind: T.DataType) -> T.DataType:
    """Room for sums: long for whole numbers, 38 digits for decimals."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()
