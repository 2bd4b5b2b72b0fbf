"""Numbers, money, dates and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0 or null."""
    return F.when(b != 0, a / b)


def locale_number(text: Column) -> Column:
    """A number with blanks or dots between thousands and a decimal comma; a dash is 0, a blank is null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "[ .]", ""), ",", ".")
    return F.when(F.trim(text) == "-", 0.0).otherwise(plain.try_cast("double"))


def step_round(value: Column, step: float, mode: str) -> Column:
    """Legal rounding to a step: none, ceil, floor, halfUp or halfEven; a tiny tolerance keeps exact multiples in place."""
    x = value / step
    near = F.floor(x + 0.5)
    how = {"none": x, "ceil": F.ceil(x - 1e-9), "floor": F.floor(x + 1e-9), "halfUp": F.floor(x + 0.5 + 1e-9), "halfEven": F.when((F.abs(x - F.floor(x) - 0.5) < 1e-9) & (near % 2 != 0), near - 1).otherwise(near)}
    return how[mode] * step


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down also where end comes first."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000)


def band(value: Column, edges: list[float]) -> Column:
    """The number of the half-open band that holds the value; the last band is open, what lies below the first is null."""
    out = F.lit(None).cast("int")
    for k, low in enumerate(edges):
        out = F.when(value >= low, F.lit(k)).otherwise(out)
    return out


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of HH:MM or HH.MM; null for any other text."""
    part = lambda k: F.regexp_extract(text, "^([0-9]{1,2})[:.]([0-9]{2})", k).try_cast("int")
    return part(1) * 60 + part(2)


def square_metres(hectares: Column) -> Column:
    """Hectares in square metres."""
    return hectares * 10_000


def exchanged(amount: Column, rate: Column) -> Column:
    """An amount in another currency by units of the first for one of the second, to whole hundredths; null without a rate above 0."""
    return F.when(rate > 0, F.round(amount / rate, 2))
