"""Table shapes, column lists and fixed values shared by the whole library."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: column names of the feeds and tables -------------------

HOSPITAL_COLUMNS = [
    "hospital_pk",
    "hospital_name",
    "address",
    "city",
    "state",
    "zip",
    "fips_code",
]

WEEKLY_METRICS = [
    "all_adult_hospital_beds_7_day_avg",
    "all_pediatric_inpatient_beds_7_day_avg",
    "all_adult_hospital_inpatient_bed_occupied_7_day_avg",
    "all_pediatric_inpatient_bed_occupied_7_day_avg",
    "total_icu_beds_7_day_avg",
    "icu_beds_used_7_day_avg",
    "inpatient_beds_used_covid_7_day_avg",
    "staffed_icu_adult_patients_confirmed_covid_7_day_avg",
]

# Source header -> table column, in feed order.
QUALITY_RENAMES = {
    "Facility ID": "hospital_pk",
    "Facility Name": "facility_name",
    "Hospital Type": "type_of_hospital",
    "Hospital Ownership": "type_of_ownership",
    "Emergency Services": "emergency_services",
    "Hospital overall rating": "overall_quality_rating",
}

BED_COLUMNS = [
    "total_adult_beds",
    "occupied_adult_beds",
    "total_pediatric_beds",
    "occupied_pediatric_beds",
    "covid_beds",
]

# ---- Fixed values: codes, widths and the region map -----------------------

KEY_LENGTH = 6
SUPPRESSED = -999999
NO_RATING = "Not Available"

# Declared widths of the fixed-width text columns.
HOSPITAL_WIDTHS = {"hospital_pk": 6, "state": 2, "fips_code": 5}
QUALITY_WIDTHS = {
    "hospital_pk": 6,
    "type_of_hospital": 36,
    "type_of_ownership": 43,
    "overall_quality_rating": 13,
}

REGION_STATES = {
    "Northeast": ["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA"],
    "Midwest": ["OH", "MI", "IN", "IL", "WI", "MN", "IA", "MO", "ND", "SD", "NE", "KS"],
    "South": ["DE", "MD", "DC", "VA", "WV", "NC", "SC", "GA", "FL", "KY", "TN", "AL",
              "MS", "AR", "LA", "OK", "TX"],
    "West": ["MT", "ID", "WY", "CO", "NM", "AZ", "UT", "NV", "WA", "OR", "CA", "AK", "HI"],
}
OTHER_REGION = "Other"

# Texts a CSV reader takes as "missing" (the documented pandas.read_csv defaults).
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- Derived lists --------------------------------------------------------

HOSPITAL_KEY = ["hospital_pk"]
WEEKLY_KEY = ["hospital_pk", "collection_week"]
WEEKLY_COLUMNS = WEEKLY_KEY + WEEKLY_METRICS
HHS_COLUMNS = HOSPITAL_COLUMNS + ["collection_week"] + WEEKLY_METRICS

QUALITY_KEY = ["hospital_pk", "rating_year"]
QUALITY_COLUMNS = list(QUALITY_RENAMES.values()) + ["rating_year"]

# Arrival order of a feed row; present only between the reader and the upsert.
ARRIVAL = "arrival"
# Set on feed rows whose line does not have the fields of the header.
BROKEN_LINE = "broken_line"
# Partition column of the stored weekly table: the calendar day of collection_week.
WEEK = "week"

# ---- Stored schemas -------------------------------------------------------

HOSPITAL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in HOSPITAL_COLUMNS])

WEEKLY_SCHEMA = T.StructType(
    [
        T.StructField("hospital_pk", T.StringType()),
        T.StructField("collection_week", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in WEEKLY_METRICS],
        T.StructField(WEEK, T.DateType()),
    ]
)

QUALITY_SCHEMA = T.StructType(
    [
        T.StructField("hospital_pk", T.StringType()),
        T.StructField("facility_name", T.StringType()),
        T.StructField("type_of_hospital", T.StringType()),
        T.StructField("type_of_ownership", T.StringType()),
        T.StructField("emergency_services", T.BooleanType()),
        T.StructField("overall_quality_rating", T.StringType()),
        T.StructField("rating_year", T.IntegerType()),
    ]
)
