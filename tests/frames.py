"""Small hand-made tables."""

from datetime import datetime

from bedledger.schema import (
    HOSPITAL_SCHEMA,
    QUALITY_SCHEMA,
    WEEKLY_COLUMNS,
    WEEKLY_METRICS,
    WEEKLY_SCHEMA,
)
from bedledger.sources.tables import Tables
from pyspark.sql import types as T

NAN = float("nan")
ADULT, PED, ADULT_OCC, PED_OCC, _, _, COVID, _ = WEEKLY_METRICS

REPORT_SCHEMA = T.StructType([f for f in WEEKLY_SCHEMA.fields if f.name in WEEKLY_COLUMNS])


def report(pk, when, total=0.0, occupied=0.0, covid=0.0, **other):
    """One weekly row; `total` and `occupied` are the adult beds."""
    row = dict.fromkeys(WEEKLY_METRICS, 0.0)
    row.update({ADULT: total, ADULT_OCC: occupied, COVID: covid}, **other)
    stamp = datetime.fromisoformat(when)
    return (pk, stamp, *(row[c] for c in WEEKLY_METRICS))


def hospital(pk, state, fips="01001", name=None, city="City"):
    return (pk, name or f"Hospital {pk}", "Street", city, state, "00000", fips)


def rating(pk, stars, year):
    return (pk, "Name", "Type", "Owner", True, stars, year)


def tables(spark, hospitals, reports, ratings=()):
    return Tables(
        spark.createDataFrame(list(hospitals), HOSPITAL_SCHEMA),
        spark.createDataFrame(list(reports), REPORT_SCHEMA),
        spark.createDataFrame(list(ratings), QUALITY_SCHEMA),
    )
