"""Bring sources with different columns to one event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.functions.scalar import flag, to_day, to_number
from risklattice.operators.ranking import ordered_numbers

EVENT_SCHEMA = {
    "date": "date", "state_raw": "string", "lga_raw": "string", "location": "string",
    "latitude": "double", "longitude": "double", "narrative": "string", "deaths": "double",
    "kidnapped": "double", "perpetrator": "string", "source_file": "string",
    "is_target": "boolean", "category": "string", "is_operation": "boolean",
}

# How each source names the event columns.
GENERAL_LOG = {
    "date": "Date of Incident", "state_raw": "State", "lga_raw": "Local Govt Area", "location": "Location",
    "latitude": "Latitude", "longitude": "Longitude", "narrative": "Details", "deaths": "Fatalities", "kidnapped": "Kidnap",
}
SPECIALIST_FILE = {
    "date": "Date", "state_raw": "State", "lga_raw": "LGA", "location": "Community (city,town, ward)",
    "latitude": "Latitude", "longitude": "Longitude", "narrative": "Title", "deaths": "Total Deaths",
    "kidnapped": "Kidnapee (V)", "perpetrator": "Kidnapper (P)",
}
TARGET_TYPES = ["banditry", "kidnap incident"]
OPERATION_TYPE = "gsf operation"
CATEGORY_REPAIRS = {"banditary": "banditry"}


def project(raw: DataFrame, mapping: dict[str, str], extra: dict[str, Column] = {}) -> DataFrame:
    """Select the event schema: mapped columns cast tolerantly, given expressions, null for the rest."""
    casts = {"double": to_number, "date": to_day}
    out = []
    for name, kind in EVENT_SCHEMA.items():
        if name in extra:
            value = extra[name].cast(kind)
        elif name in mapping:
            column = F.col(f"`{mapping[name]}`")
            value = casts[kind](column) if kind in casts else column.cast(kind)
        else:
            value = F.lit(None).cast(kind)
        out.append(value.alias(name))
    return raw.select(*out)


def tidy(c: str) -> Column:
    return F.lower(F.trim(F.col(f"`{c}`")))


def general_events(raw: DataFrame) -> DataFrame:
    """The general log: target from its second type, operation from its first."""
    first, second = tidy("Incident Type"), tidy("Incident Type 2")
    target = flag(second.isin(TARGET_TYPES))
    return project(raw, GENERAL_LOG, {
        "source_file": F.lit("main"), "is_target": target, "is_operation": flag(first == OPERATION_TYPE),
        "category": F.when(target, second).otherwise(F.lit("other")),
    })


def specialist_events(raw: DataFrame) -> DataFrame:
    """The specialist file: every row is a target; misspelt categories are repaired."""
    category = recode(tidy("Category"), CATEGORY_REPAIRS)
    return project(raw, SPECIALIST_FILE, {
        "source_file": F.lit("additional"), "is_target": F.lit(True), "is_operation": F.lit(False), "category": category,
    })


def recode(c: Column, repairs: dict[str, str]) -> Column:
    out = c
    for wrong, right in repairs.items():
        out = F.when(c == wrong, right).otherwise(out)
    return out


def add_row_id(df: DataFrame, order: list[Column | str], name: str = "row_id") -> DataFrame:
    """Row number from 0 in the given total order, without a single-task sort."""
    return ordered_numbers(df, [], order, name).withColumn(name, F.col(name) - 1)


def merge_sources(main: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two sources with differing columns."""
    return main.unionByName(other, allowMissingColumns=True)


def period_flags(events: DataFrame, model_start: str, date: str = "date", target: str = "is_target") -> DataFrame:
    """``in_model_period``: from the start to the last target event; ``is_burn_in``: before the start."""
    last = events.filter(flag(F.col(target))).select(F.max(date)).scalar()
    start = F.lit(model_start).cast("date")
    return events.withColumns({
        "in_model_period": flag(F.col(date).between(start, last)), "is_burn_in": flag(F.col(date) < start),
    })
