"""Column functions: names, identifiers, pairings, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in identifiers, whatever the locale.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int"))


def serial(n: Column, most: int = 10_000) -> Column:
    """Zero-padded to one digit more than ``most`` has; longer numbers stay whole."""
    return F.format_string(f"%0{len(str(most)) + 1}d", n.cast("long"))


def event_name(n: Column, start: Column) -> Column:
    """EV_{serial}_{month}_{year} of a start date."""
    return F.concat_ws("_", F.lit("EV"), serial(n), month_name(F.month(start)), F.year(start).cast("string"))


#: Sums of two numbers up to which their code stays below 2^53, so that a root gives them back exactly.
MOST_SUM = 94_906_264


def pair_code(a: Column, b: Column) -> Column:
    """Cantor's pairing of two whole numbers from 0 whose sum is at most MOST_SUM; an error beyond. Windowed labels are to be numbered anew first."""
    a, b = a.cast("long"), b.cast("long")
    fits = (a >= 0) & (b >= 0) & (a <= MOST_SUM) & (b <= MOST_SUM) & (a + b <= MOST_SUM)
    code = F.shiftright((a + b) * (a + b + 1), 1) + b
    return F.when(a.isNull() | b.isNull(), None).when(fits, code).otherwise(F.raise_error(F.lit("these numbers have no exact code")))


def pair_of_code(code: Column) -> tuple[Column, Column]:
    """The two numbers of a pairing; the root is corrected, so that it holds for all codes below 2^53."""
    w = F.floor((F.sqrt(8.0 * code + 1) - 1) / 2).cast("long")
    half = lambda x: F.shiftright(x * (x + 1), 1)
    w = F.when(half(w) > code, w - 1).when(half(w + 1) <= code, w + 1).otherwise(w)
    b = code - half(w)
    return w - b, b


#: What names of files are searched for.
YEAR_BEFORE_LAST, FIRST_SERIAL, FREE_YEAR = r"_(\d{4})_[\w-]+_", r"_(\d+)_", r"\b((?:19|20)\d{2})\b"


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(-1))


def year_in_name(name: Column) -> Column:
    """The four digits between underscores before the last part; -1 without any."""
    return _number(name, YEAR_BEFORE_LAST)


def serial_in_name(name: Column) -> Column:
    """The first digits between underscores; -1 without any."""
    return _number(name, FIRST_SERIAL)


def year_in_file_name(name: Column) -> Column:
    """The first free-standing year 19xx or 20xx; null without any. Underscores are part of a word."""
    found = F.regexp_extract(name, FREE_YEAR, 1)
    return F.when(found != "", found.cast("int"))


def base_name(path: Column) -> Column:
    """A path's last part without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def box_text(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Bounds in whole degrees (halves to even) with hemispheres, as 10°N to 80°N, 90°W to 70°E."""

    def one(x: Column, plus: str, minus: str) -> Column:
        return F.concat(F.format_string("%d", F.rint(F.abs(x)).cast("long")), F.lit("°"), F.when(x < 0, minus).otherwise(plus))

    return F.concat(one(lat_min, "N", "S"), F.lit(" to "), one(lat_max, "N", "S"), F.lit(", "), one(lon_min, "E", "W"), F.lit(" to "), one(lon_max, "E", "W"))


def shared_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """(first, last) day that two spans share, or null where they share one day or none."""
    first, last = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(first < last, F.struct(first.alias("first"), last.alias("last")))
