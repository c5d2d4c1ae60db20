import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline import schemas as S
from shelfline.operators import drift

T = S.DRIFT_REGISTRY["transactions"]


@pytest.fixture(scope="module")
def normal(spark):
    return spark.createDataFrame(
        [(i, 10 + i, i, "2024-01-01", 1, 9.5) for i in range(1, 4)],
        "transaction_id int, product_id int, store_id int, timestamp string, quantity int, price double",
    )


def verdict(df, schema=T, table=None):
    return tuple(drift.verdict(df, schema, table).first())[1:3]


def test_known_columns_pass(normal):
    assert verdict(normal) == ("approved", "process")
    assert verdict(normal.withColumn("payment_method", F.lit("UPI"))) == ("approved", "process")
    assert verdict(normal.withColumn("anything", F.lit(1)), S.DRIFT_REGISTRY.get("stores"), "stores") == ("approved", "process")


def test_missing_required_column_is_rejected(normal):
    row = drift.verdict(normal.drop("price"), T).first()
    assert (row["status"], row["action"], row["reason"]) == ("rejected", "quarantine", "Missing required columns: price")


def test_six_noisy_columns_are_quarantined(spark, normal):
    noisy = normal
    for i in range(6):
        noisy = noisy.withColumn(f"random_{i}", F.element_at(F.array(F.lit("???"), F.lit("xxx"), F.lit("###")), F.col("transaction_id")))
    scores = drift.score_new_columns(noisy, T)
    assert {round(r["confidence"], 10) for r in scores.collect()} == {0.6}
    assert rows(drift.decide(scores), "action", "n_changes") == [("quarantine_all", 6)]
    assert verdict(noisy) == ("pending_approval", "hold")
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    queue = drift.queue(scores, drift.decide(scores), as_of)
    log = drift.change_log(scores, drift.decide(scores), queue, as_of)
    assert queue.count() == 1 and log.count() == 6
    assert drift.expand_changes(queue).count() == 6
    assert log.first()["sample_data"] == '["###","???","xxx"]'


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(1000).select(
        *[F.lit(1).alias(c) for c in T.required],
        *[(F.col("id") % 100).cast("double").alias(f"good_{i}") for i in range(4)],
        *[F.lit("x").alias(f"low_{i}") for i in range(6)],
    )


@pytest.mark.parametrize(
    "good, low, action", [(3, 0, "auto_approve"), (4, 0, "manual_review"), (2, 1, "manual_review"), (0, 5, "manual_review"), (0, 6, "quarantine_all"), (4, 6, "quarantine_all")]
)
def test_decisions(wide, good, low, action):
    df = wide.select(*T.required, *[f"good_{i}" for i in range(good)], *[f"low_{i}" for i in range(low)])
    assert drift.decide(drift.score_new_columns(df, T)).first()["action"] == action


def test_confidence_of_each_kind(spark):
    df = spark.range(200).select(
        *[F.lit(1).alias(c) for c in T.required],
        F.col("id").alias("unique_number"),
        (F.col("id") % 20).cast("string").alias("text_group"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 20).alias("half_empty"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("id") < 100, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zeros"),
    )
    got = {r["column_name"]: r for r in drift.score_new_columns(df, T).collect()}
    assert got["unique_number"]["confidence"] == pytest.approx(0.3 + 0.1 + 0.4)
    assert got["text_group"]["confidence"] == pytest.approx(0.3 + 0.3 + 0.2)
    assert got["half_empty"]["confidence"] == pytest.approx(0.15 + 0.3 + 0.4)
    assert got["empty"]["confidence"] == pytest.approx(0.0 + 0.1 + 0.4)
    assert got["empty"]["sample_values"] == []
    assert got["zeros"]["distinct_ratio"] == pytest.approx(1 / 200)
    assert got["text_group"]["sample_values"] == ["0", "1", "10", "11", "12"]


def test_empty_batch_scores_zero(wide):
    assert {r["confidence"] for r in drift.score_new_columns(wide.where("good_0 < 0"), T).collect()} == {0.0}


def test_resolving_one_request_leaves_the_others(spark, wide):
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    scores = drift.score_new_columns(wide, T, "a").unionByName(drift.score_new_columns(wide.drop("low_0"), T, "b"))
    decisions = drift.decide(scores)
    queue = drift.queue(scores, decisions, as_of)
    log = drift.change_log(scores, decisions, queue, as_of)
    picked = queue.where("table_name = 'a'")
    new_queue, new_log = drift.resolve(queue, log, picked, "approved", "admin", as_of)
    assert rows(new_queue, "table_name", "status") == [("a", "approved"), ("b", "pending")]
    assert {r["table_name"] for r in new_log.where("status = 'approved' and approved_by = 'admin'").collect()} == {"a"}
    assert new_log.where("table_name = 'b' and approved_at is not null").count() == 0
    assert [r["table_name"] for r in drift.pending(new_queue).collect()] == ["b"]
    assert drift.history(new_log, 3).count() == 3
    with pytest.raises(ValueError):
        drift.resolve(queue, log, picked, "maybe", "admin", as_of)


def test_sketches_give_the_exact_confidence(spark):
    """Columns on both sides of both limits, some so near that they are counted, in one scan without an unpivot."""
    n = 20_000
    made = {
        "few": F.col("id") % 3, "below": F.col("id") % 199, "at_low": F.col("id") % 200, "above": F.col("id") % 201, "half": F.col("id") % 10_000,
        "near_top": F.when(F.col("id") < 19_795, F.col("id")).otherwise(0), "all": F.col("id"), "text": (F.col("id") % 500).cast("string"),
        "empty": F.lit(None).cast("string"), "gaps": F.when(F.col("id") % 4 == 0, F.col("id")), "nan": F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")),
    }
    df = spark.range(n).select(F.col("id").alias("transaction_id"), *(c.alias(name) for name, c in made.items()))
    exact = {r.column_name: r for r in drift.score_new_columns(df, T).collect()}
    got = {r.column_name: r for r in drift.sketched_scores(df, T).collect()}
    assert set(got) == set(made)
    for name, r in got.items():
        assert (r.confidence, r.null_ratio, r.data_type) == (exact[name].confidence, exact[name].null_ratio, exact[name].data_type), name
    assert got["at_low"].counted and got["near_top"].counted
    assert not any(got[c].counted for c in ("few", "half", "text", "empty"))
    assert drift.sketched_scores(df.limit(0), T).where("confidence = 0").count() == len(made)
    assert drift.sketched_scores(df.select("transaction_id"), T).count() == 0
