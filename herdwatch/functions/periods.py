"""Retention periods as column expressions.

A period is kept as a struct of numbers, since calendar intervals cannot be stored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = r"(?:([+-]?\d+)%s)?"
# ISO 8601 periods: years, months, weeks, days, then after T hours, minutes, seconds.
_ISO = (
    "^P(?=.)" + _N % "Y" + _N % "M" + _N % "W" + _N % "D" + "(?:T(?=.)" + _N % "H" + _N % "M"
    + r"(?:([+-]?\d+(?:\.\d+)?)S)?" + ")?$"
)
UNITS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")

# What a bare number means, per retention type, and the date pattern of the type.  Fixed values.
TYPE_UNITS = {"HOURLY": "hours", "DAILY": "days", "MONTHLY": "months", "YEARLY": "years"}
TYPE_PATTERNS = {"HOURLY": "YYYYMMddHH", "DAILY": "YYYYMMdd", "MONTHLY": "YYYYMM", "YEARLY": "YYYY"}


def parse_period(text: Column, retention_type: Column) -> Column:
    """Struct of ``UNITS`` from an ISO period or from a number of the type's unit; NULL if neither."""
    iso = F.regexp_like(text, F.lit(_ISO))

    def unit(position: int, name: str) -> Column:
        to = "decimal(18,6)" if name == "seconds" else "int"
        written = F.regexp_extract(text, _ISO, position)
        from_iso = F.when(written == "", F.lit(0)).otherwise(written.try_cast(to))
        number = text.try_cast("int")
        of_type = F.when(_unit_of(retention_type) == name, number).otherwise(F.lit(0))
        return F.when(iso, from_iso).otherwise(of_type).cast(to).alias(name)

    units = F.struct(*(unit(i + 1, name) for i, name in enumerate(UNITS)))
    good = iso | (text.rlike(r"^[+-]?\d+$") & text.try_cast("int").isNotNull() & _unit_of(retention_type).isNotNull())
    return F.when(good, units)


def _unit_of(retention_type: Column) -> Column:
    unit = F.lit(None).cast("string")
    for name, value in TYPE_UNITS.items():
        unit = F.when(retention_type == name, F.lit(value)).otherwise(unit)
    return unit


def type_pattern(retention_type: Column) -> Column:
    """The date pattern of a retention type; NULL for an unknown type."""
    pattern = F.lit(None).cast("string")
    for name, value in TYPE_PATTERNS.items():
        pattern = F.when(retention_type == name, F.lit(value)).otherwise(pattern)
    return pattern


def minus_period(ts: Column, period: Column) -> Column:
    """The time one period earlier: years first, then months, then the rest.

    Years and months are taken off one after the other, since each step ends on the last day
    of a shorter month.
    """
    zero = F.lit(0)
    years = F.make_interval(period["years"])
    months = F.make_interval(zero, period["months"])
    rest = F.make_interval(
        zero, zero, period["weeks"], period["days"], period["hours"], period["minutes"], period["seconds"]
    )
    return ts - years - months - rest
