"""Surrogate keys that stay: a registry of natural keys with blocks of numbers per task.

A natural key gets its number once; loads, rebuilds and late members read it back. New
natural keys are numbered without a sort and without a single task: task p of P takes
the blocks p, p + P, p + 2P, ... of ``block`` numbers above all numbers given so far, so numbers are
unique by construction and have gaps. A task sorts its own new keys, so one that is run again gives the same numbers. The numbers are written before anybody reads them.

The registry is a folder of generations, each split by a hash of the natural key. A generation counts
once its mark is there, whose name holds the highest number it may have used; one that failed halfway
has no mark, is not read, and its numbers are given again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.session import stash
from shelfline.sources.folders import children, mark

BLOCK = 1024
BUCKETS = 64
_POSITION = (1 << 33) - 1


class KeyRegistry:
    """Numbers in column ``key`` for the natural key ``ids``, kept below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, ids: T.StructType, key: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
        self.spark, self.folder, self.ids, self.key, self.buckets, self.block = spark, folder, ids.names, key, buckets, block
        self.schema = T.StructType([*ids.fields, T.StructField(key, T.LongType()), T.StructField("bucket", T.IntegerType())])

    def _generations(self) -> list[tuple[int, int]]:
        """(number, highest key) of the finished generations."""
        names = [n.split("-") for n in children(self.spark, f"{self.folder}/marks")]
        return sorted((int(n), int(top)) for n, top in names)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.ids), F.lit(self.buckets)).cast("int").alias("bucket")

    def known(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All natural keys with their numbers, or those of some buckets only."""
        paths = [f"{self.folder}/rows/generation={n}" for n, _ in self._generations()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).option("basePath", p).parquet(p) for p in paths]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def register(self, df: DataFrame) -> int:
        """Give numbers to natural keys of ``df`` that have none; returns how many. Rows with a null in the natural key get none."""
        complete = F.lit(True)
        for name in self.ids:
            complete = complete & F.col(name).isNotNull()
        asked = df.select(*self.ids).where(complete).distinct().withColumn("bucket", self.bucket())
        fresh = stash(asked.join(self.known().select(*self.ids, "bucket"), [*self.ids, "bucket"], "left_anti"), "new-keys")
        number = fresh.count()
        if number:
            done = self._generations()
            start, generation = (done[-1][1], done[-1][0] + 1) if done else (0, 0)
            tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
            at = F.monotonically_increasing_id()
            task, position = F.shiftright(at, 33), at.bitwiseAND(_POSITION)
            round_, within = F.floor(position / self.block), position % self.block
            dealt = fresh.repartition(tasks, "bucket", *self.ids).sortWithinPartitions(*self.ids)  # a task that is run again numbers alike
            numbered = dealt.select(*self.ids, "bucket", (F.lit(start) + (round_ * tasks + task) * self.block + within + 1).cast("long").alias(self.key))
            path = f"{self.folder}/rows/generation={generation}"
            numbered.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            top = self.spark.read.schema(self.schema).parquet(path).agg(F.max(self.key)).first()[0]
            span = tasks * self.block
            mark(self.spark, f"{self.folder}/marks/{generation}-{start + -(-(top - start) // span) * span}")
        return number

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with its numbers, after giving new ones where needed; null where the natural key holds a null."""
        self.register(df)
        return df.join(self.known().drop("bucket"), self.ids, "left")
