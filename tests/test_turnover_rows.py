from pyspark.sql import functions as F

from shelfline.plans import kpi


def test_rows_per_day_hold_numbers_only(spark):
    products = spark.createDataFrame(
        [(1, "p", "x", "c", 2.0), (2, "p", "x", "c", 2.0), (3, "q", "x", None, 2.0)], "product_key long, product_id string, name string, category string, price double"
    )
    fact = spark.createDataFrame(
        [(1, 20240101, 3), (2, 20240101, 4), (2, 20240103, 1), (3, 20240102, 5), (9, 20240102, 5), (None, 20240102, 5)], "product_key long, date_key int, quantity int"
    ).withColumns({"sale_id": F.lit("s"), "revenue": F.lit(1).cast("decimal(18,4)")})
    got = kpi.turnover(fact, products)
    assert sorted((r.product_id, r.total_sold, r.days_sold, r.sales_span_true_days) for r in got.collect()) == [("p", 8, 2, 2), ("q", 5, 1, 0)]
    keys = [line.split("],")[0] for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    per_day = [k for k in keys if "date_key" in k]
    assert len(per_day) == 1 and "product_name" not in per_day[0] and "category" not in per_day[0]
