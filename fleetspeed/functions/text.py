"""CSV text: splitting quoted lines, lenient numbers, quoting and fixed decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A code point that is not a character, so no text contains it.
_CUT = "\uffff"
_BLANKS = " \t\n\r\f\v"


def split_fields(line: Column) -> Column:
    """Fields of one CSV line: commas inside quotes do not separate, ``""`` inside is a quote."""
    return F.when(F.instr(line, '"') == 0, F.split(line, ",", -1)).otherwise(_split_quoted(line))


def _split_quoted(line: Column) -> Column:
    # Cutting at every quote leaves the unquoted stretches at even places.  An empty one
    # between two quoted stretches is a doubled quote.
    stretches = F.split(line, '"', -1)
    last = F.size(stretches) - 1

    def rewrite(stretch: Column, place: Column) -> Column:
        outside = F.when(
            (stretch == "") & (place > 0) & (place < last), F.lit('"')
        ).otherwise(F.translate(stretch, ",", _CUT))
        return F.when(place % 2 == 0, outside).otherwise(stretch)

    return F.split(F.array_join(F.transform(stretches, rewrite), ""), _CUT, -1)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def to_int(text: Column) -> Column:
    """Strict integer (optional sign and digits), else NULL."""
    return text.try_cast("int")


def to_long_lenient(text: Column) -> Column:
    """Integer text, or any decimal text cut to its integer part, else NULL."""
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def quoted(value: Column) -> Column:
    """Always quoted, quotes doubled, NULL as an empty text."""
    safe = F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), safe, F.lit('"'))


def fixed(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", value)
