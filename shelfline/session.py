"""Session helpers: a local builder for tests and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shelfline-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}  # work folder of each local application without the setting
_SCOPES: list[list[str]] = []
ON_RELEASE: list[Callable[[SparkSession], None]] = []  # called when all written copies of an application go


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, named by ``spark.checkpoint.dir``.

    Without the setting only a master of one process (``local`` or ``local[...]``) gets
    a folder of its own; several executors do not see each other's local folders. The
    session given is never changed.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="shelfline-")
    return _OWN[context.applicationId]


def fresh_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path under the shared folder; never reused, so nothing is overwritten.

    It goes with the ``scratch`` scope it was made in, unless it is to be kept.
    """
    path = f"{shared_dir(spark)}/shelfline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return path


def stash(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Runs when called. Cuts lineage durably (an executor loss re-reads files instead of
    recomputing), keeps column pruning and gives later joins a real size to plan with.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate copies made inside are deleted at the end; consume results before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def release(spark: SparkSession, path: str | None = None) -> bool:
    """Delete a stashed path, or all that this application stashed; frames over it become unusable.

    With everything gone, cached warehouses are forgotten too and built anew on next use.
    """
    own = f"{shared_dir(spark)}/shelfline/{spark.sparkContext.applicationId}"
    target = path or own
    if not (target + "/").startswith(own + "/"):
        raise ValueError(f"not written by this application: {target}")
    if target == own:
        for forget in ON_RELEASE:
            forget(spark)
    return _delete(spark, target)


def _delete(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True))
