"""Type-2 history from snapshots in any order, rewritten only in the hash buckets that change.

A snapshot says how its customers were at its time. Versions are the runs of equal tracked
columns (NULL equals '') between snapshots that name the customer; other columns are as the first snapshot of a run
had them. A late snapshot splits the version it falls into, moves a start back, or changes
nothing; the history is the same whatever order snapshots arrive in.

Layout below ``folder``: ``snapshots/at=.../bucket=...`` keeps every snapshot, and
``rows/generation=.../bucket=...`` the history. Applying a snapshot compares it with the
versions at its time, then writes a new generation of the touched buckets only; files of other buckets stay as
they are. Older snapshots are read only for a late one, and only in touched buckets. A generation
counts once its mark is there, whose name holds its buckets, so a failed step leaves the
history as it was and can be run again.

A snapshot applied twice changes nothing; another one of the same time replaces it. Rows without a customer_id are left out; of several rows
of a customer in one snapshot the first by city, name, email and phone counts. Version keys come from a
registry over (customer_id, valid_from), so they survive later versions and repeated loads.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from shelfline.functions import exprs as X
from shelfline.operators.dims import CUSTOMER_COLUMNS
from shelfline.operators.registry import KeyRegistry
from shelfline.operators.scd2 import latest_per_customer
from shelfline.session import stash
from shelfline.sources.folders import children, mark

VALUES = ["name", "email", "phone", "city"]
BUCKETS = 64
_STAMP = "%Y%m%dT%H%M%S%f"

def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_PERSON = {"customer_id": T.StringType(), **{name: T.StringType() for name in VALUES}}
_SPAN = {"valid_from": T.TimestampNTZType(), "valid_to": T.TimestampNTZType(), "is_current": T.BooleanType(), "version": T.IntegerType()}
_ROW = _schema(customer_key=T.LongType(), **_PERSON, **_SPAN, bucket=T.IntegerType())
_SEEN = _schema(**_PERSON, bucket=T.IntegerType())


def versions(seen: DataFrame, track: Sequence[str] = ("city",)) -> DataFrame:
    """Version rows from what was seen: customer_id, ``VALUES``, ``seen_at``, bucket."""
    own = Window.partitionBy("customer_id").orderBy("seen_at")
    new = F.row_number().over(own) == 1
    for c in track:
        new = new | (X.blank_null(c) != F.lag(X.blank_null(c)).over(own))
    starts = seen.dropDuplicates(["customer_id", "seen_at"]).withColumn("_new", new).where("_new")
    return starts.select(
        "customer_id", *VALUES, F.col("seen_at").alias("valid_from"), F.lead("seen_at").over(own).alias("valid_to"),
        F.lead("seen_at").over(own).isNull().alias("is_current"), F.row_number().over(own).cast("int").alias("version"), "bucket",
    )


class History:
    """Customer history kept below ``folder``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, track: Sequence[str] = ("city",), buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.track, self.buckets = spark, folder, list(track), buckets
        ids = _schema(customer_id=T.StringType(), valid_from=T.TimestampNTZType())
        self.keys = KeyRegistry(spark, f"{folder}/keys", ids, "customer_key")

    def _current(self) -> dict[int, int]:
        """Generation that holds each bucket."""
        out: dict[int, int] = {}
        for name in sorted(children(self.spark, f"{self.folder}/marks"), key=lambda n: int(n.split("-")[0])):
            generation, bits = name.split("-")
            out |= {b: int(generation) for b in range(self.buckets) if int(bits, 16) >> b & 1}
        return out

    def _rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        by_generation: dict[int, list[int]] = {}
        for bucket, generation in self._current().items():
            if buckets is None or bucket in buckets:
                by_generation.setdefault(generation, []).append(bucket)
        out = self.spark.createDataFrame([], _ROW)
        for generation, own in by_generation.items():
            base = f"{self.folder}/rows/generation={generation}"
            out = out.unionByName(self.spark.read.schema(_ROW).option("basePath", base).parquet(*(f"{base}/bucket={b}" for b in own)))
        return out

    def table(self) -> DataFrame:
        """The history with the columns of the customer dimension."""
        return self._rows().select(*CUSTOMER_COLUMNS)

    def times(self) -> list[datetime]:
        """Times of the snapshots taken over."""
        return [datetime.strptime(n.removeprefix("at="), _STAMP) for n in children(self.spark, f"{self.folder}/snapshots")]

    def _seen_after(self, at: datetime, buckets: Sequence[int]) -> DataFrame:
        """What later snapshots say of some buckets."""
        out = self.spark.createDataFrame([], _schema(**_PERSON, bucket=T.IntegerType(), seen_at=T.TimestampNTZType()))
        for time in self.times():
            if time > at:
                rows = self.spark.read.schema(_SEEN).parquet(f"{self.folder}/snapshots/at={time.strftime(_STAMP)}").where(F.col("bucket").isin(list(buckets)))
                out = out.unionByName(rows.withColumn("seen_at", F.lit(time).cast("timestamp_ntz")))
        return out

    def apply(self, snapshot: DataFrame, at: datetime) -> list[int]:
        """Take over a snapshot of time ``at``; returns the buckets that were rewritten."""
        late = any(time > at for time in self.times())
        bucket = F.pmod(F.xxhash64("customer_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        rows = latest_per_customer(snapshot.where(F.col("customer_id").isNotNull())).select("customer_id", *VALUES, bucket)
        kept = f"{self.folder}/snapshots/at={at.strftime(_STAMP)}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(kept)
        rows = self.spark.read.schema(_SEEN).parquet(kept)

        now = F.lit(at).cast("timestamp_ntz")
        then = self._rows().where((F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (now < F.col("valid_to"))))
        was = then.select("customer_id", F.lit(True).alias("_known"), *(F.col(c).alias(f"_was_{c}") for c in self.track))
        differs = F.col("_known").isNull()
        for c in self.track:
            differs = differs | (X.blank_null(c) != X.blank_null(f"_was_{c}"))
        changed = stash(rows.join(was, "customer_id", "left").where(differs).select(*rows.columns), "history-changed")
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []

        old = self._rows(touched)
        ids = changed.select("customer_id")
        seen = old.join(ids, "customer_id", "left_semi").select("customer_id", *VALUES, "bucket", F.col("valid_from").alias("seen_at"))
        seen = seen.where(F.col("seen_at") != now).unionByName(changed.withColumn("seen_at", now))
        if late:  # the version that is split goes on with the next snapshot that names the customer
            after = self._seen_after(at, touched).join(ids, "customer_id", "left_semi")
            first = Window.partitionBy("customer_id").orderBy("seen_at")
            seen = seen.unionByName(after.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
        made = stash(versions(seen, self.track), "history-versions")
        same = old.join(ids, "customer_id", "left_anti")
        written = same.unionByName(self.keys.assign(made).select(*same.columns))

        done = [int(n.split("-")[0]) for n in children(self.spark, f"{self.folder}/marks")]
        generation, bits = max(done, default=-1) + 1, sum(1 << b for b in touched)
        written.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/generation={generation}")
        mark(self.spark, f"{self.folder}/marks/{generation}-{bits:x}")
        return touched
