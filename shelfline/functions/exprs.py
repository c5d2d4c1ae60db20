"""Column expressions shared by all operators. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import schemas as S

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers ----------------------------------------------------------------
def money(c: ColumnOrName) -> Column:
    """Exact money value; a no-op for columns already stored as money."""
    return _col(c).cast(S.MONEY)


def dbl(c: ColumnOrName) -> Column:
    return _col(c).cast("double")


def sum_money(c: ColumnOrName) -> Column:
    return F.sum(money(c))


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Double division that yields NULL instead of failing on zero."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def round2(c: ColumnOrName) -> Column:
    """Two decimals, rounded on the scaled value (ties as in plain float rounding)."""
    return F.round(dbl(c) * 100, 0) / 100


def share_pct(part: ColumnOrName, whole: ColumnOrName) -> Column:
    return round2(ratio(dbl(part) * 100.0, whole))


def growth_pct(current: ColumnOrName, previous: ColumnOrName) -> Column:
    return round2(ratio((dbl(current) - dbl(previous)) * 100.0, previous))


def money_text(c: ColumnOrName) -> Column:
    """Plain digits with two decimals; a double would print as 1.2E7."""
    return F.round(_col(c), 2).cast("decimal(38,2)").cast("string")


def edge(df: DataFrame) -> DataFrame:
    """Decimals to double, for results handed to a reader."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- dates ------------------------------------------------------------------
def date_key(c: ColumnOrName) -> Column:
    """``yyyymmdd`` as an integer."""
    d = F.to_date(_col(c))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def key_to_date(c: ColumnOrName) -> Column:
    k = _col(c)
    return F.make_date(F.floor(k / 10000).cast("int"), F.floor(k / 100).cast("int") % 100, k.cast("int") % 100)


def is_weekend(c: ColumnOrName) -> Column:
    return F.dayofweek(_col(c)).isin(1, 7)


def month_name(month: ColumnOrName) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in S.MONTH_NAMES]), _col(month).cast("int"))


def season(month: ColumnOrName) -> Column:
    return lookup(month, S.SEASON_MONTHS, S.DEFAULT_SEASON)


def age_label(ts: ColumnOrName, as_of: ColumnOrName) -> Column:
    """``12m ago`` / ``5h ago`` / ``3d ago``."""
    seconds = F.timestamp_diff("SECOND", _col(ts), _col(as_of))
    minutes, hours, days = (F.floor(seconds / n).cast("long") for n in (60, 3600, 86400))
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


# --- labels and ladders -----------------------------------------------------
def lookup(c: ColumnOrName, groups: Mapping[str, Sequence], default: str) -> Column:
    """Label of the first group that lists the value."""
    out = None
    for label, members in groups.items():
        hit = _col(c).isin(*members)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def region(city: ColumnOrName, mapping: Mapping[str, Sequence] = S.REGION_CITIES) -> Column:
    return lookup(F.upper(F.trim(_col(city))), mapping, S.UNKNOWN_REGION)


def city_tier(city: ColumnOrName, mapping: Mapping[str, Sequence] = S.TIER_CITIES) -> Column:
    return lookup(city, mapping, S.DEFAULT_TIER)


def ladder(c: ColumnOrName, steps: Sequence[tuple], last: str, op: str) -> Column:
    """First label whose bound satisfies ``value <op> bound`` (op is <, <= or >)."""
    tests = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__}
    out = None
    for bound, label in steps:
        hit = tests[op](_col(c), F.lit(bound))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(last))


def frequency_segment(n: ColumnOrName, steps=S.FREQUENCY_LADDER) -> Column:
    return ladder(n, steps, S.FREQUENCY_TOP, "<=")


def value_segment(amount: ColumnOrName, steps=S.VALUE_LADDER) -> Column:
    return ladder(amount, steps, S.VALUE_TOP, "<")


def movement_category(per_day: ColumnOrName, steps=S.MOVEMENT_LADDER) -> Column:
    return ladder(per_day, steps, S.MOVEMENT_BOTTOM, ">")


def risk_level(probability: ColumnOrName, steps=S.RISK_LADDER) -> Column:
    return ladder(probability, steps, S.RISK_BOTTOM, ">")


def risk_ordinal(label: ColumnOrName) -> Column:
    out = F.lit(None).cast("int")
    for name, n in S.RISK_ORDINAL.items():
        out = F.when(_col(label) == name, F.lit(n)).otherwise(out)
    return out


def flag_label(flag: ColumnOrName, yes: str, no: str) -> Column:
    return F.when(_col(flag), F.lit(yes)).otherwise(F.lit(no))


# --- text -------------------------------------------------------------------
def mask_phone(phone: ColumnOrName) -> Column:
    """Last four digits only; NULL keeps the bare prefix."""
    return F.concat_ws("", F.lit("XXXXX-"), F.right(_col(phone), F.lit(4)))


def mask_email(email: ColumnOrName) -> Column:
    e = _col(email)
    return F.concat_ws("", F.left(e, F.lit(1)), F.lit("***@"), F.split_part(e, F.lit("@"), F.lit(2)))


def blank_null(c: ColumnOrName) -> Column:
    """NULL and '' compare as equal."""
    return F.coalesce(_col(c), F.lit(""))


def as_json(df: DataFrame, alias: str = "record") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(alias))


def normalise_nulls(df: DataFrame, tokens: Sequence[str] = S.NULL_TOKENS) -> DataFrame:
    """Text such as ``NA`` or ``null`` in string columns becomes NULL."""
    return df.select(
        *[
            F.when(F.trim(F.col(f"`{f.name}`")).isin(*tokens), F.lit(None)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
