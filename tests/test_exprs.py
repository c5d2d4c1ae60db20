from datetime import date, datetime

from conftest import rows
from pyspark.sql import functions as F

from shelfline.functions import exprs as X


def value(spark, column, **data):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in data.items())
    df = spark.createDataFrame([tuple(data.values())], schema) if data else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_round2_rounds_the_scaled_value(spark):
    assert value(spark, X.round2("x"), x=1.005) == 1.0
    assert value(spark, X.round2("x"), x=2.675001) == 2.68
    assert value(spark, X.round2("x"), x=-1.239) == -1.24


def test_ratio_guards_zero(spark):
    assert value(spark, X.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, X.growth_pct(F.lit(150.0), F.lit(100.0))) == 50.0
    assert value(spark, X.growth_pct(F.lit(150.0), F.lit(None).cast("double"))) is None


def test_region_and_tier(spark):
    cities = [(" mumbai ",), ("Delhi",), ("CHENNAI",), ("Kolkata",), ("Paris",), (None,)]
    df = spark.createDataFrame(cities, "city string")
    assert [r[0] for r in df.select(X.region("city")).collect()] == ["West", "North", "South", "East", "Unknown", "Unknown"]
    tiers = [r[0] for r in df.select(X.city_tier("city")).collect()]
    assert tiers == ["Tier-2", "Metro", "Tier-2", "Tier-2", "Tier-2", "Tier-2"]  # case and blanks matter here


def test_months(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = df.select(X.month_name("m"), X.season("m")).collect()
    assert got[0][0] == "January" and got[11][0] == "December"
    assert [g[1] for g in got] == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Monsoon"] * 3 + ["Winter"]


def test_ladders_at_their_bounds(spark):
    assert [value(spark, X.frequency_segment(F.lit(n))) for n in (1, 2, 5, 6, 15, 16)] == [
        "One-time", "Occasional", "Occasional", "Regular", "Regular", "Loyal"]
    assert [value(spark, X.value_segment(F.lit(n))) for n in (999.99, 1000, 4999, 5000, 20000)] == [
        "Low Value", "Medium Value", "Medium Value", "High Value", "Premium"]
    assert [value(spark, X.movement_category(F.lit(n))) for n in (10.0, 10.1, 2.0, 2.1)] == [
        "Medium Moving", "Fast Moving", "Slow Moving", "Medium Moving"]
    assert [value(spark, X.risk_level(F.lit(p))) for p in (0.81, 0.8, 0.6, 0.4)] == ["Critical", "High", "Medium", "Low"]
    assert [value(spark, X.risk_ordinal(F.lit(n))) for n in ("Low", "Medium", "High", "Critical")] == [0, 1, 2, 3]


def test_masks(spark):
    assert value(spark, X.mask_phone("p"), p="+91-9876543210") == "XXXXX-3210"
    assert value(spark, X.mask_phone("p"), p=None) == "XXXXX-"
    assert value(spark, X.mask_email("e"), e="john.doe@example.com") == "j***@example.com"
    assert value(spark, X.mask_email("e"), e="nobody") == "n***@"


def test_date_keys(spark):
    df = spark.createDataFrame([(date(2024, 3, 5),), (date(1999, 12, 31),)], "d date")
    got = df.select(X.date_key("d").alias("k")).select("k", X.key_to_date("k")).collect()
    assert [tuple(g) for g in got] == [(20240305, date(2024, 3, 5)), (19991231, date(1999, 12, 31))]


def test_age_label(spark):
    now = datetime(2024, 1, 10, 12, 0, 0)
    times = [datetime(2024, 1, 10, 11, 1), datetime(2024, 1, 10, 11, 0), datetime(2024, 1, 9, 12, 1), datetime(2024, 1, 7, 12, 0)]
    df = spark.createDataFrame([(t, now) for t in times], "ts timestamp_ntz, now timestamp_ntz")
    assert [r[0] for r in df.select(X.age_label("ts", "now")).collect()] == ["59m ago", "1h ago", "23h ago", "3d ago"]


def test_money_text_has_no_exponent(spark):
    assert value(spark, X.money_text(F.lit("12000000.005").cast("decimal(18,4)"))) == "12000000.01"


def test_edge_and_json(spark):
    df = spark.range(1).select(F.lit("1.5").cast("decimal(18,4)").alias("m"), F.lit(None).cast("string").alias("s"))
    assert X.edge(df).dtypes == [("m", "double"), ("s", "string")]
    assert rows(X.as_json(X.edge(df))) == [('{"m":1.5,"s":null}',)]


def test_normalise_nulls(spark):
    df = spark.createDataFrame([("NA", 1), (" null ", 2), ("x", 3)], "a string, b int")
    assert rows(X.normalise_nulls(df)) == sorted([(None, 1), (None, 2), ("x", 3)], key=str)
