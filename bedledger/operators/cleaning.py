"""Load-time cleaning of the two feeds: project, conform, and say what does not fit.

Each function is a narrow projection or filter; a whole clean is one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedledger.functions.guards import (
    _col,
    missing_to_zero,
    number_or_zero,
    suppressed_to_null,
)
from bedledger.schema import (
    ARRIVAL,
    BROKEN_LINE,
    HHS_COLUMNS,
    HOSPITAL_WIDTHS,
    KEY_LENGTH,
    QUALITY_RENAMES,
    QUALITY_WIDTHS,
    WEEKLY_METRICS,
)

_YEAR_FIRST = r"^\s*\d{4}[-/]"
_MONTH_FIRST = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(\s+\d{1,2}:\d{2})?(:\d{2})?\s*$"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})\s*$"
_MONTH_NAME = r"^\s*[A-Za-z]{3} \d{1,2}, \d{4}\s*$"


def _feed_marks(df: DataFrame) -> list[str]:
    return [c for c in (BROKEN_LINE, ARRIVAL) if c in df.columns]


# ---- Expressions ----------------------------------------------------------


def has_valid_key(c: str | Column = "hospital_pk") -> Column:
    return F.length(_col(c)) == KEY_LENGTH


def week_from_text(c: str | Column) -> Column:
    """Text to timestamp without zone; unreadable text becomes NULL.

    Takes year-first dates and date-times with - or /, month-first ones, dates of eight digits, and dates
    such as `Dec 31, 2021`.
    """
    c = _col(c)
    seconds = F.when(F.regexp_extract(c, _MONTH_FIRST, 4) == "", "").when(
        F.regexp_extract(c, _MONTH_FIRST, 5) == "", ":00"
    )
    month_first = F.concat(
        F.regexp_replace(c, _MONTH_FIRST, "$3-$1-$2$4$5"), F.coalesce(seconds, F.lit(""))
    )
    named = F.when(c.rlike(_MONTH_NAME), F.try_to_date(F.trim(c), "MMM d, yyyy"))
    return F.coalesce(
        F.when(c.rlike(_YEAR_FIRST), F.replace(c, F.lit("/"), F.lit("-")))
        .when(c.rlike(_MONTH_FIRST), month_first)
        .when(c.rlike(_COMPACT), F.regexp_replace(c, _COMPACT, "$1-$2-$3"))
        .try_cast("timestamp_ntz"),
        named.cast("timestamp_ntz"),
    )


def yes_to_true(c: str | Column) -> Column:
    """'yes' in any case, with any white space around it, is true; all else is false."""
    word = F.lower(F.regexp_replace(_col(c), r"^\s+|\s+$", ""))
    return F.coalesce(word == "yes", F.lit(False))


def metric_from_text(c: str | Column) -> Column:
    """Metric text to double: blank or NaN is 0, a text that is no number stays NULL."""
    return number_or_zero(c)


# ---- Feed transforms ------------------------------------------------------


def valid_key(df: DataFrame) -> DataFrame:
    return df.withColumn("hospital_pk", F.col("hospital_pk").cast("string")).filter(has_valid_key())


def project_hhs(df: DataFrame) -> DataFrame:
    return df.select(*HHS_COLUMNS, *_feed_marks(df))


def sentinel_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: suppressed_to_null(c) for c in columns})


def fill_numeric_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: missing_to_zero(c) for c in columns})


def parse_week(df: DataFrame) -> DataFrame:
    return df.withColumn("collection_week", week_from_text("collection_week"))


TYPED = "typed_"
# Beside raw feed rows whose texts were read: the metrics in their order, and the week.
_NUMBERS, _MOMENT = "_numbers", "_moment"


def texts_read(df: DataFrame) -> DataFrame:
    """The raw weekly feed with its metric texts read as one array of numbers, and its week, each text once.

    One expression serves all metrics. Written out for each of them, the projection becomes a method so long that the
    JVM never compiles it and interprets it for every row.
    """
    if _NUMBERS in df.columns:
        return df
    numbers = F.transform(F.array(*WEEKLY_METRICS), metric_from_text)
    return df.withColumns({_NUMBERS: numbers, _MOMENT: week_from_text("collection_week")})


def _typed() -> dict[str, Column]:
    """Week and metrics of a row whose texts were read."""
    # zero came first: a suppressed value stays NULL
    metrics = {c: suppressed_to_null(F.col(_NUMBERS)[i]) for i, c in enumerate(WEEKLY_METRICS)}
    return {"collection_week": F.col(_MOMENT), **metrics}


def with_typed_columns(df: DataFrame) -> DataFrame:
    """The raw weekly feed, its metrics and week read from their texts beside them."""
    typed = {TYPED + c: value for c, value in _typed().items()}
    return texts_read(df).withColumns(typed).drop(_NUMBERS, _MOMENT)


def without_read_texts(df: DataFrame) -> DataFrame:
    """Rows that go on are used by their typed columns: of the others alone the texts behind them are kept."""
    stays = F.col("bad_key") | F.col("reject_reason").isNotNull()
    return df.withColumns({c: F.when(stays, F.col(c)) for c in ("collection_week", *WEEKLY_METRICS)})


def typed_rows(df: DataFrame) -> DataFrame:
    """What `transform_hhs_data` gives, from columns that were typed before."""
    typed = {c: F.col(TYPED + c) for c in ("collection_week", *WEEKLY_METRICS)}
    return df.transform(valid_key).withColumns(typed).transform(project_hhs)


def transform_hhs_data(df: DataFrame) -> DataFrame:
    """The weekly feed as table rows. A NULL collection_week marks a row that cannot load."""
    rows = df.transform(project_hhs).transform(valid_key)
    return rows.transform(texts_read).withColumns(_typed()).drop(_NUMBERS, _MOMENT)


def project_rename_quality(df: DataFrame) -> DataFrame:
    return df.select(
        *(F.col(f"`{source}`").alias(name) for source, name in QUALITY_RENAMES.items()),
        *_feed_marks(df),
    )


def add_rating_year(df: DataFrame, year: int) -> DataFrame:
    return df.withColumn("rating_year", F.lit(int(year)))


def conform_quality(df: DataFrame, year: int) -> DataFrame:
    """Renamed feed rows as table rows of one rating year."""
    return (
        df.transform(valid_key)
        .withColumn("emergency_services", yes_to_true("emergency_services"))
        .transform(add_rating_year, year)
    )


def transform_quality_data(df: DataFrame, year: int) -> DataFrame:
    """The quality feed of one rating year as table rows."""
    return df.transform(project_rename_quality).transform(conform_quality, year)


# ---- What does not fit ----------------------------------------------------


def _too_wide(widths: dict[str, int]) -> dict[str, Column]:
    return {
        f"{c} is longer than {n}": F.length(F.rtrim(F.col(c))) > n
        for c, n in widths.items()
        if c != "hospital_pk"
    }


def _with_reasons(df: DataFrame, problems: dict[str, Column]) -> DataFrame:
    """Add `bad_key` (row is dropped) and `reject_reason` (row fails the load), else NULL.

    A broken line always fails: what it holds in the key column is not its key.
    """
    broken = F.col(BROKEN_LINE) if BROKEN_LINE in df.columns else F.lit(False)
    problems = {"the line does not have the fields of the header": broken, **problems}
    # concat_ws leaves out the NULL of each problem that did not occur
    reasons = F.concat_ws("; ", *(F.when(test, F.lit(text)) for text, test in problems.items()))
    return df.withColumns(
        {
            "bad_key": ~broken & ~F.coalesce(has_valid_key(), F.lit(False)),
            "reject_reason": F.nullif(reasons, F.lit("")),
        }
    )


def explain_hhs_rows(df: DataFrame) -> DataFrame:
    """The raw weekly feed with the reasons why a row would not load."""
    problems = {"collection_week is not a date": F.col(_MOMENT).isNull()}
    problems |= _too_wide(HOSPITAL_WIDTHS)
    problems |= {f"{c} is not a number": F.col(_NUMBERS)[i].isNull() for i, c in enumerate(WEEKLY_METRICS)}
    explained = _with_reasons(texts_read(df), problems)
    # a caller that has read the texts before goes on with them
    return explained if _NUMBERS in df.columns else explained.drop(_NUMBERS, _MOMENT)


def explain_quality_rows(df: DataFrame) -> DataFrame:
    """The raw quality feed, renamed, with the reasons why a row would not load."""
    return _with_reasons(project_rename_quality(df), _too_wide(QUALITY_WIDTHS))


def reject_report(explained: DataFrame) -> DataFrame:
    """Rows that do not reach the table, with the reason."""
    bad_key = F.when(F.col("bad_key"), F.lit(f"hospital_pk does not have {KEY_LENGTH} characters"))
    reason = F.coalesce(bad_key, "reject_reason")
    columns = [c for c in explained.columns if c not in ("bad_key", "reject_reason")]
    # A filter on a computed column is pushed below it and computes it a second time for
    # every row; a filter on the output of explode is not.
    return explained.select(
        *columns, F.explode(F.array(reason)).alias("reject_reason")
    ).filter("reject_reason IS NOT NULL")
