"""Dates, periods and percents as text in several forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of months in the sources, in order.
MONTHS = ("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie")


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name, null for any other text."""
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.trim(name)))
    return F.when(place > 0, place.cast("int"))


def any_date(text: Column) -> Column:
    """The date of yyyy-mm-dd, dd.mm.yyyy, dd MONTH yyyy or ddmmyyyy; null for any other text or no such day."""
    t = F.trim(text)
    named = F.concat_ws("-", F.regexp_extract(t, "([0-9]{4})$", 1), F.lpad(month_number(F.regexp_extract(t, " (\\p{L}+) ", 1)).cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, "^([0-9]{1,2})", 1), 2, "0"))
    return (
        F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
        .when(t.rlike("^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$"), F.try_to_timestamp(t, F.lit("dd.MM.yyyy")))
        .when(t.rlike("^[0-9]{8}$"), F.try_to_timestamp(t, F.lit("ddMMyyyy")))
        .when(t.rlike("^[0-9]{1,2} \\p{L}+ [0-9]{4}$"), F.try_to_timestamp(named, F.lit("yyyy-MM-dd")))
        .cast("date")
    )


def period(text: Column) -> Column:
    """The struct (year, month) of a report's period, mm.yyyy or yyyy-mm; null for any other text."""
    dotted, iso = text.rlike("^[0-9]{1,2}\\.[0-9]{4}$"), text.rlike("^[0-9]{4}-[0-9]{1,2}$")
    year = F.when(dotted, F.regexp_extract(text, "([0-9]{4})$", 1)).when(iso, F.regexp_extract(text, "^([0-9]{4})", 1)).cast("int")
    month = F.when(dotted, F.regexp_extract(text, "^([0-9]{1,2})", 1)).when(iso, F.regexp_extract(text, "([0-9]{1,2})$", 1)).cast("int")
    return F.when(month.between(1, 12), F.struct(year.alias("year"), month.alias("month")))


def percent(text: Column) -> Column:
    """A percentage: a share from 0 to 1 counts times 100; a percent sign says that it is one already. Decimal commas pass."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "[% ]", ""), ",", ".").try_cast("double")
    return F.when(text.contains("%") | (plain > 1), plain).otherwise(plain * 100)


def wrapped_minutes(start: Column, end: Column) -> Column:
    """Minutes from one clock time to the next, past midnight where the second is earlier."""
    return F.pmod(end - start, F.lit(1440))
