"""Month keys, month sequences and timestamp texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shapes of accepted timestamp texts.  The second one also takes the ISO form,
# where seconds and fractions are optional.
_DATE, _MINUTES = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}"
SECONDS_SHAPE = f"^{_DATE} {_MINUTES}:[0-9]{{2}}$"
ANY_SHAPE = f"^{_DATE}( {_MINUTES}:[0-9]{{2}}|T{_MINUTES}(:[0-9]{{2}}([.][0-9]{{1,9}})?)?)$"


def year_month(ts: Column) -> Column:
    """``yyyy-MM`` text; its text order is its time order."""
    return F.date_format(ts, "yyyy-MM")


def month_number(ts: Column) -> Column:
    """``yyyymm`` as a number: cheaper to compute and to group by than the text."""
    return F.year(ts) * 100 + F.month(ts)


def month_of_number(number: Column) -> Column:
    """``yyyy-MM`` text of a month number."""
    return F.format_string("%04d-%02d", (number / 100).cast("int"), number % 100)


def month_text(year: int, month: int) -> str:
    return f"{year:04d}-{month:02d}"


def shift_month(text: str, months: int) -> str:
    """The ``yyyy-MM`` text some months later (or earlier)."""
    count = int(text[:4]) * 12 + int(text[5:7]) - 1 + months
    return month_text(count // 12, count % 12 + 1)


def months_between(first: str, last: str) -> Column:
    """Array of ``yyyy-MM`` texts, both ends included, empty when ``first > last``."""
    if first > last:
        return F.array().cast("array<string>")
    dates = F.sequence(
        F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("interval 1 month")
    )
    return F.transform(dates, lambda d: F.date_format(d, "yyyy-MM"))


def month_frame(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(months_between(first, last)).alias("year_month"))


def parse_timestamp(text: Column, shape: str = SECONDS_SHAPE) -> Column:
    """TIMESTAMP_NTZ of a text of the given shape; any other text gives NULL.

    The cast alone would also take bare dates and other forms.
    """
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def inferred_month(text: Column, fallback: str) -> Column:
    """Month of a timestamp text, or ``fallback`` when the text cannot be read."""
    return F.coalesce(year_month(parse_timestamp(text, ANY_SHAPE)), F.lit(fallback))


def iso_text(ts: Column) -> Column:
    """ISO local text at second resolution; zero seconds are left out."""
    seconds = F.when(F.second(ts) == 0, F.lit("")).otherwise(F.date_format(ts, ":ss"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), seconds)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp (the session time zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_between(earlier: Column, later: Column) -> Column:
    return epoch_micros(later) - epoch_micros(earlier)


def whole_seconds_between(earlier: Column, later: Column) -> Column:
    """Floor of the distance in seconds (negative distances round down)."""
    return F.floor(micros_between(earlier, later) / 1_000_000).cast("long")
