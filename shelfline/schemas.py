"""Table schemas, schema registry and the fixed business mappings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Money is stored as a decimal so that sums do not depend on row order, and
# handed out as double at the edge.
MONEY = T.DecimalType(18, 4)

# --- fixed values ---------------------------------------------------------
# Cities by region (upper case, compared after trimming).
REGION_CITIES = {
    "West": ["MUMBAI", "PUNE", "AHMEDABAD", "SURAT"],
    "North": ["DELHI", "JAIPUR"],
    "South": ["BANGALORE", "CHENNAI", "HYDERABAD"],
    "East": ["KOLKATA"],
}
UNKNOWN_REGION = "Unknown"
# Cities by tier (case-sensitive), everything else is the default tier.
TIER_CITIES = {
    "Metro": ["Mumbai", "Delhi", "Bangalore"],
    "Tier-1": ["Pune", "Hyderabad", "Chennai"],
}
DEFAULT_TIER = "Tier-2"
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
SEASON_MONTHS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8]}
DEFAULT_SEASON = "Monsoon"
# Upper bounds are inclusive for frequency and exclusive for value.
FREQUENCY_LADDER = [(1, "One-time"), (5, "Occasional"), (15, "Regular")]
FREQUENCY_TOP = "Loyal"
VALUE_LADDER = [(1000, "Low Value"), (5000, "Medium Value"), (20000, "High Value")]
VALUE_TOP = "Premium"
# Exclusive lower bounds, highest first.
MOVEMENT_LADDER = [(10, "Fast Moving"), (2, "Medium Moving")]
MOVEMENT_BOTTOM = "Slow Moving"
RISK_LADDER = [(0.8, "Critical"), (0.6, "High"), (0.4, "Medium")]
RISK_BOTTOM = "Low"
RISK_ORDINAL = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
DEFAULT_REORDER_POINT = 20
# Text that a CSV reader should take for a missing value.
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A"]
# Raw CSV inputs. Ids and phones stay text: type sniffing would turn 007 into 7.
# The header of the inventory file names the columns in another order than the
# data has them, so its schema is applied by position.
RAW_SPECS = {
    "stores": "store_id string, store_name string, city string, opened_date date",
    "customers": "customer_id string, name string, email string, phone string, city string, age int, registration_date date",
    "products": "product_id string, product_name string, category string, base_price double, cost_price double",
    "transactions": "transaction_id string, date timestamp_ntz, store_id string, customer_id string, product_id string, quantity int, price double, payment_method string",
    "inventory": "store_id string, product_id string, date date, stock_level int",
    "shipments": "shipment_id string, transaction_id string, ship_date timestamp_ntz, delivery_date timestamp_ntz, status string, courier string",
    "web_clickstream": "session_id string, timestamp timestamp_ntz, event_type string, product_id string, user_id string, device string",
}
# Warehouse contract: columns every consumer relies on.
WAREHOUSE_CONTRACT = {
    "fact_sales": ["sale_id", "date_key", "customer_key", "product_key", "store_key", "quantity", "revenue"],
    "dim_customer": ["customer_key", "name", "email", "phone", "city"],
    "dim_product": ["product_key", "name", "category", "price"],
    "dim_store": [],
    "dim_date": [],
}
# Columns that drift governance knows: (required, optional). Other tables are accepted as they are.
DRIFT_COLUMNS = {
    "transactions": (
        ["transaction_id", "product_id", "store_id", "timestamp", "quantity", "price"],
        ["discount", "payment_method", "customer_id"],
    )
}
# --------------------------------------------------------------------------


def raw_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(RAW_SPECS[table])


@dataclass(frozen=True)
class TableSchema:
    """Known columns of one incoming table."""

    name: str
    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)

    @property
    def known(self) -> list[str]:
        return self.required + self.optional


DRIFT_REGISTRY = {name: TableSchema(name, required, optional) for name, (required, optional) in DRIFT_COLUMNS.items()}

# Registry for batch ingest: by default nothing is required, every row is valid.
INGEST_REGISTRY = {name: TableSchema(name) for name in RAW_SPECS}
