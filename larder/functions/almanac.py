"""Days of festivals that follow moon and sun, as column expressions: for any year, without a table of dates.

Longitudes are sums of the greatest periodic terms, right to a few hundredths of a degree, which is some minutes of the moon's way. A
lunar day is 12 degrees of the moon's lead over the sun. Which day a festival falls on depends on the lunar day at a certain hour, in
the month that the sun's place among the stars names; customs of places differ, so a day may differ by one from a local calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean longitudes and anomalies, in degrees at noon of 1 January 2000 and degrees a century (J. Meeus, Astronomical Algorithms).
SUN, SUN_ANOMALY = (280.46646, 36000.76983), (357.52911, 35999.05029)
MOON, LEAD, MOON_ANOMALY, NODE = (218.3164477, 481267.88123421), (297.8501921, 445267.1114034), (134.9633964, 477198.8675055), (93.2720950, 483202.0175233)
# The same book's greatest terms of the moon's longitude: degrees, and multiples of lead, sun's anomaly, moon's anomaly and node.
MOON_TERMS = (
    (6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0), (-0.185116, 0, 1, 0, 0), (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0),
    (0.057066, 2, -1, -1, 0), (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0), (-0.040923, 0, 1, -1, 0), (-0.034720, 1, 0, 0, 0), (-0.030383, 0, 1, 1, 0), (0.015327, 2, 0, 0, -2),
    (-0.012528, 0, 0, 1, 2), (0.010980, 0, 0, 1, -2), (0.010675, 4, 0, -1, 0), (0.010034, 0, 0, 3, 0), (0.008548, 4, 0, -2, 0), (-0.007888, 2, 1, -1, 0), (-0.006766, 2, 1, 0, 0), (-0.005163, 1, 0, -1, 0),
)
# How far the first point of the stars' zodiac (Lahiri) lies from the equinox at the start of 2000, and degrees a century.
STARS = (23.853, 1.397)
# The civil tabular Hijri calendar: Julian day before its first year, days of a common year, leap years in 30.
HIJRI_START, HIJRI_YEAR = 1948439, 354


def _at(pair: tuple[float, float], t: Column) -> Column:
    return F.lit(pair[0]) + F.lit(pair[1]) * t


def _sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def centuries(day: Column, hour: Column) -> Column:
    """Julian centuries since noon of 1 January 2000 at an hour (UTC) of a day."""
    return (F.unix_date(day) - F.lit(10957) + hour / F.lit(24.0) - F.lit(0.5)) / F.lit(36525.0)


def _sun(t: Column) -> Column:
    m = _at(SUN_ANOMALY, t)
    return _at(SUN, t) + (F.lit(1.914602) - F.lit(0.004817) * t) * _sin(m) + F.lit(0.019993) * _sin(2 * m) + F.lit(0.000289) * _sin(3 * m)


def sun_among_stars(t: Column) -> Column:
    """The sun's longitude from the first point of the stars' zodiac, 0 to 360."""
    return F.pmod(_sun(t) - _at(STARS, t), F.lit(360.0))


def lead(t: Column) -> Column:
    """The moon's lead over the sun in degrees, 0 (new) to 360."""
    terms = F.expr("array(" + ", ".join(f"array({', '.join(f'{float(v)!r}D' for v in term)})" for term in MOON_TERMS) + ")")
    angle = lambda x: sum((x[i + 1] * _at(a, t) for i, a in enumerate((SUN_ANOMALY, MOON_ANOMALY, NODE), 1)), x[1] * _at(LEAD, t))
    moon = F.aggregate(terms, _at(MOON, t), lambda sum_, x: sum_ + x[0] * _sin(angle(x)))
    return F.pmod(moon - _sun(t), F.lit(360.0))


def hijri(year: Column, month: int, day: int) -> Column:
    """The day of a date of the tabular Hijri calendar."""
    days = F.lit(HIJRI_START + 29 * (month - 1) + month // 2 + day) + F.lit(HIJRI_YEAR) * (year - 1) + F.floor((11 * year + 3) / 30)
    return F.date_from_unix_date((days - F.lit(2440588)).cast("int"))


@dataclass(frozen=True)
class LunarRule:
    """The day on which, at ``hour`` (UTC), the moon's lead lies from ``low`` to 12 degrees on, while the sun is between ``sun_low`` and
    ``sun_high`` among the stars; the festival is ``later`` days after it."""

    hour: float
    low: float
    sun_low: float
    sun_high: float
    later: int = 0


# Hours are those of India: sunset 12.4, midnight 18.6, sunrise 0.4. The sun's range is that of the month's new or full moon.
LUNAR = {
    "diwali": LunarRule(12.4, 348, 179.5, 209.5), "maha_shivaratri": LunarRule(18.6, 336, 298.5, 328.5),
    "holi": LunarRule(12.6, 168, 314.5, 344.5, 1), "raksha_bandhan": LunarRule(0.4, 168, 104.5, 134.5),
}
#: Key: month and day of the Hijri calendar.
HIJRI = {"eid_al_fitr": (10, 1)}


def moving_days(years: DataFrame) -> DataFrame:
    """key and day of the festivals of moving date in each year of ``years`` (year); two Hijri years may begin in one."""
    days = years.select(F.col("year").cast("int").alias("year")).distinct()
    days = days.select("year", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date"))
    rules = F.expr("array(" + ", ".join(f"named_struct('key', '{k}', 'hour', {r.hour!r}D, 'low', {float(r.low)!r}D, 'sun_low', {r.sun_low!r}D, 'sun_high', {r.sun_high!r}D, 'later', {r.later})" for k, r in LUNAR.items()) + ")")
    at = days.select("year", "date", F.explode(rules).alias("r")).select("year", "date", "r.*").withColumn("t", centuries(F.col("date"), F.col("hour")))
    at = at.withColumn("sun", sun_among_stars(F.col("t"))).where((F.col("sun") >= F.col("sun_low") - 1) & (F.col("sun") < F.col("sun_high") + 1))
    since = lambda t: F.pmod(lead(t) - F.col("low"), F.lit(360.0))
    at = at.withColumns({"now": since(F.col("t")), "next": since(F.col("t") + F.lit(1 / 36525))})
    inside = (F.col("now") < 12) & (F.col("sun") >= F.col("sun_low")) & (F.col("sun") < F.col("sun_high"))
    # a lunar day that holds the hour twice belongs to the first; one that holds it on no day to the one on which it begins after it
    short = (F.col("now") > 340) & (F.col("next") >= 12) & (F.col("next") < 30)
    one = at.groupBy("key", "year", "later").agg(F.coalesce(F.min(F.when(inside, F.col("date"))), F.min(F.when(short, F.col("date")))).alias("date")).where("date is not null")
    found = [one.select("key", F.date_add("date", F.col("later")).alias("day"))]
    for key, (month, day) in HIJRI.items():
        about = F.floor((F.col("year") - 622) * F.lit(365.2425) / F.lit(354.36667))
        some = years.select(F.col("year").cast("int").alias("year")).distinct().withColumn("h", F.explode(F.sequence(about - 1, about + 2)))
        found.append(some.withColumn("day", hijri(F.col("h"), month, day)).where(F.year("day") == F.col("year")).select(F.lit(key).alias("key"), "day"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
