"""Schema-drift governance: score new columns, decide, log, queue, resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from shelfline.functions import exprs as X
from shelfline.operators.rows import dense_keys, top_k
from shelfline.schemas import TableSchema

# --- fixed values ---------------------------------------------------------
THRESHOLD = 0.75
MAX_LOW = 5
MAX_AUTO = 3
N_SAMPLES = 5
# --------------------------------------------------------------------------

SCORE_SCHEMA = (
    "table_name string, column_name string, data_type string, null_ratio double, "
    "distinct_ratio double, confidence double, sample_values array<string>"
)
LOG_SCHEMA = (
    "change_id bigint, table_name string, change_type string, column_name string, old_value string, "
    "new_value string, confidence_score double, status string, detected_at timestamp_ntz, "
    "approved_at timestamp_ntz, approved_by string, affected_rows int, sample_data string, queue_id bigint"
)


def new_columns(df: DataFrame, schema: TableSchema | None) -> list[str]:
    """Columns the registry does not know; a table without an entry has none."""
    return [] if schema is None else sorted(set(df.columns) - set(schema.known))


def missing_columns(df: DataFrame, schema: TableSchema | None) -> list[str]:
    return [] if schema is None else sorted(set(schema.required) - set(df.columns))


def _as_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), F.when(c == 0, F.lit(0.0)).otherwise(c))
    return c.cast("string")


def score_new_columns(df: DataFrame, schema: TableSchema | None, table: str | None = None) -> DataFrame:
    """One row per new column with null ratio, distinct ratio, confidence and samples.

    All columns are scored in one scan: values are unpivoted and counted per
    (column, value) first, with map-side partial counts, so a value held by a
    third of the rows does not weigh on any single task.
    """
    spark = df.sparkSession
    table = table or (schema.name if schema else "")
    names = new_columns(df, schema)
    if not names:
        return spark.createDataFrame([], SCORE_SCHEMA)
    fields = {f.name: f for f in df.schema.fields if f.name in names}
    texts = df.select(*[_as_text(fields[n]).alias(n) for n in names])
    per_value = (
        texts.unpivot([], [F.col(f"`{n}`") for n in names], "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stats = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
    )
    first_values = Window.partitionBy("column_name").orderBy(F.asc_nulls_last("value"))
    # The first values per column; collecting them skips NULL. Reading n here, and
    # filtering after the window only, keeps the counting step the same in both
    # branches, so Spark runs it once.
    samples = (
        per_value.withColumn("_rn", F.row_number().over(first_values))
        .where((F.col("_rn") <= N_SAMPLES) & (F.col("n") > 0))
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    )
    types = [(n, fields[n].dataType.simpleString(), 0.2 if isinstance(fields[n].dataType, T.StringType) else 0.4) for n in names]
    # One row per new column: bounded by the width of the input.
    known = F.broadcast(spark.createDataFrame(types, "column_name string, data_type string, type_score double"))
    joined = known.join(stats, "column_name", "left").join(samples, "column_name", "left")
    null_ratio = X.ratio("n_null", "n_rows")
    distinct_ratio = X.ratio("n_distinct", "n_rows")
    varied = (distinct_ratio > 0.01) & (distinct_ratio < 0.99)
    score = (F.lit(1.0) - null_ratio) * 0.3 + F.when(varied, F.lit(0.3)).otherwise(F.lit(0.1)) + F.col("type_score")
    return joined.select(
        F.lit(table).alias("table_name"),
        "column_name",
        "data_type",
        null_ratio.alias("null_ratio"),
        distinct_ratio.alias("distinct_ratio"),
        F.when(F.col("n_rows") > 0, F.least(score, F.lit(1.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def sketched_scores(df: DataFrame, schema: TableSchema | None, table: str | None = None, error: float = 0.01, sigmas: int = 6) -> DataFrame:
    """(table_name, column_name, data_type, null_ratio, confidence, counted) of every new column, from one scan.

    Confidence needs to know only on which side of 1 % and 99 % the distinct values are. Mergeable
    sketches (HyperLogLog with the given relative standard ``error``) say so for all columns at
    once; columns whose bound of ``sigmas`` standard errors holds a limit are counted exactly (``counted``), and
    only these. Runs when called; the result has one row per column.
    """
    spark = df.sparkSession
    table = table or (schema.name if schema else "")
    names = new_columns(df, schema)
    spec = "table_name string, column_name string, data_type string, null_ratio double, confidence double, counted boolean"
    if not names:
        return spark.createDataFrame([], spec)
    fields = {f.name: f for f in df.schema.fields if f.name in names}
    texts = df.select(*[_as_text(fields[n]).alias(f"c{i}") for i, n in enumerate(names)])
    one = texts.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"c{i}").alias(f"v{i}") for i in range(len(names))],
        *[F.approx_count_distinct(f"c{i}", error).alias(f"d{i}") for i in range(len(names))],
    ).first()
    n, limits = one["n"], (0.01, 0.99)
    near = [i for i in range(len(names)) if n and any(abs(one[f"d{i}"] - t * n) <= max(sigmas * error * one[f"d{i}"], 1.0) for t in limits)]
    exact = texts.agg(*[F.countDistinct(f"c{i}").alias(f"d{i}") for i in near]).first() if near else None
    out = []
    for i, name in enumerate(names):
        kind = fields[name].dataType
        empty = (n - one[f"v{i}"]) / n if n else None
        ratio = (exact if i in near else one)[f"d{i}"] / n if n else 0.0
        score = (1.0 - empty) * 0.3 + (0.3 if limits[0] < ratio < limits[1] else 0.1) + (0.2 if isinstance(kind, T.StringType) else 0.4) if n else 0.0
        out.append((table, name, kind.simpleString(), empty, min(score, 1.0), i in near))
    return spark.createDataFrame(out, spec)


def decide(scores: DataFrame, threshold: float = THRESHOLD, max_low: int = MAX_LOW, max_auto: int = MAX_AUTO) -> DataFrame:
    """(table_name, action, reason, n_changes) per table that has changes."""
    low = F.col("n_low")
    action = (
        F.when(low > max_low, F.lit("quarantine_all"))
        .when((low == 0) & (F.col("n_changes") <= max_auto), F.lit("auto_approve"))
        .otherwise(F.lit("manual_review"))
    )
    reason = F.when(F.col("action") == "quarantine_all", F.lit("Mass low-confidence changes")).when(
        F.col("action") == "manual_review", F.lit("Requires review")
    )
    return (
        scores.groupBy("table_name")
        .agg(
            F.count(F.lit(1)).alias("n_changes"),
            F.count(F.when(F.col("confidence") < threshold, 1)).alias("n_low"),
        )
        .withColumn("action", action)
        .select("table_name", "action", F.coalesce(reason, F.lit("")).alias("reason"), "n_changes", "n_low")
    )


def verdict(df: DataFrame, schema: TableSchema | None, table: str | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(table_name, status, action, reason): what to do with the incoming batch.

    ``scores`` are those of its new columns, if they are known already.
    """
    spark = df.sparkSession
    table = table or (schema.name if schema else "")
    columns = "table_name string, status string, action string, reason string"
    missing = missing_columns(df, schema)
    if missing:
        reason = "Missing required columns: " + ", ".join(missing)
        return spark.createDataFrame([(table, "rejected", "quarantine", reason)], columns)
    if not new_columns(df, schema):
        return spark.createDataFrame([(table, "approved", "process", "")], columns)
    auto = F.col("action") == "auto_approve"
    known = score_new_columns(df, schema, table) if scores is None else scores
    return decide(known).select(
        "table_name",
        F.when(auto, F.lit("approved")).otherwise(F.lit("pending_approval")).alias("status"),
        F.when(auto, F.lit("process")).otherwise(F.lit("hold")).alias("action"),
        "reason",
    )


def queue(scores: DataFrame, decisions: DataFrame, as_of: Column, start: Column | int = 0) -> DataFrame:
    """A pending request per decision that needs a person; changes as JSON text."""
    # Bounded by the number of columns of one table, not by its rows.
    changes = scores.groupBy("table_name").agg(
        F.to_json(
            F.array_sort(
                F.collect_list(F.struct("column_name", "confidence", "data_type", "sample_values"))
            )
        ).alias("decision_json")
    )
    waiting = decisions.where("action <> 'auto_approve'").join(changes, "table_name")
    rows = waiting.select(
        "table_name",
        "action",
        "reason",
        "decision_json",
        F.lit("pending").alias("status"),
        as_of.alias("created_at"),
    )
    return dense_keys(rows, ["table_name"], "queue_id", start)


def change_log(scores: DataFrame, decisions: DataFrame, requests: DataFrame, as_of: Column, start: Column | int = 0) -> DataFrame:
    """One row per new column, status = the action decided, tied to its request if any."""
    rows = (
        scores.join(decisions.select("table_name", "action"), "table_name")
        .join(requests.select("table_name", "queue_id"), "table_name", "left")
        .select(
            "table_name",
            F.lit("new_column").alias("change_type"),
            "column_name",
            F.lit("").alias("old_value"),
            F.col("data_type").alias("new_value"),
            F.col("confidence").alias("confidence_score"),
            F.col("action").alias("status"),
            as_of.alias("detected_at"),
            F.lit(None).cast("timestamp_ntz").alias("approved_at"),
            F.lit(None).cast("string").alias("approved_by"),
            F.lit(0).alias("affected_rows"),
            F.to_json("sample_values").alias("sample_data"),
            "queue_id",
        )
    )
    return dense_keys(rows, ["table_name", "column_name"], "change_id", start)


def resolve(
    requests: DataFrame, log: DataFrame, queue_ids: DataFrame, decision: str, by: str, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Approve or reject requests: (queue, log) with only the rows of those requests changed."""
    if decision not in ("approved", "rejected"):
        raise ValueError("decision must be 'approved' or 'rejected'")
    picked = queue_ids.select("queue_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    new_queue = requests.join(picked, "queue_id", "left").withColumn(
        "status", F.when(hit, F.lit(decision)).otherwise(F.col("status"))
    )
    new_log = (
        log.join(picked, "queue_id", "left")
        .withColumn("status", F.when(hit, F.lit(decision)).otherwise(F.col("status")))
        .withColumn("approved_at", F.when(hit, as_of).otherwise(F.col("approved_at")))
        .withColumn("approved_by", F.when(hit, F.lit(by)).otherwise(F.col("approved_by")))
    )
    return new_queue.select(*requests.columns), new_log.select(*log.columns)


def pending(requests: DataFrame) -> DataFrame:
    """Open requests, newest first."""
    return requests.where("status = 'pending'").orderBy(F.desc_nulls_last("created_at"), F.asc_nulls_last("queue_id"))


def history(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Changes, newest first."""
    columns = ["change_id", "table_name", "change_type", "column_name", "confidence_score", "status", "detected_at"]
    return top_k(log.select(*columns), [F.desc_nulls_last("detected_at"), F.asc_nulls_last("change_id")], limit)


def status_counts(log: DataFrame) -> DataFrame:
    """Totals by the statuses that are really written."""
    return log.agg(
        F.count(F.lit(1)).alias("total_changes"),
        F.count(F.when(F.col("status").isin("manual_review", "quarantine_all"), 1)).alias("pending_changes"),
        F.count(F.when(F.col("status") == "auto_approve", 1)).alias("auto_approved"),
    )


def expand_changes(requests: DataFrame) -> DataFrame:
    """The JSON of each request back as one row per change."""
    item = "array<struct<column_name:string,confidence:double,data_type:string,sample_values:array<string>>>"
    return requests.select("queue_id", "table_name", F.explode(F.from_json("decision_json", item)).alias("change")).select(
        "queue_id", "table_name", "change.column_name", "change.confidence", "change.data_type"
    )
