"""Festival days from moon and sun against public holiday lists."""

from datetime import date

from pyspark.sql import functions as F

from larder.functions import almanac
from larder.operators import service
from larder.plans.oracles import KNOWN_DAYS

# Days of later years, as public holiday lists of India give them.
LATER = {
    "diwali": ("2019-10-27", "2020-11-14", "2021-11-04", "2022-10-24", "2023-11-12", "2024-10-31", "2025-10-20"), "holi": ("2019-03-21", "2020-03-10", "2021-03-29", "2022-03-18", "2023-03-08", "2024-03-25", "2025-03-14"),
    "maha_shivaratri": ("2019-03-04", "2020-02-21", "2021-03-11", "2022-03-01", "2023-02-18", "2024-03-08", "2025-02-26"), "raksha_bandhan": ("2019-08-15", "2020-08-03", "2021-08-22", "2022-08-11", "2023-08-30", "2024-08-19", "2025-08-09"),
    "eid_al_fitr": ("2019-06-05", "2020-05-25", "2021-05-14", "2022-05-03", "2023-04-22", "2024-04-11", "2025-03-31"),
}


def days_of(spark, first, last):
    out = {}
    for r in almanac.moving_days(spark.range(first, last + 1).select(F.col("id").alias("year"))).collect():
        out.setdefault(r.key, []).append(r.day)
    return {k: sorted(v) for k, v in out.items()}


def test_years_of_the_data(spark):
    assert {k: [str(d) for d in v] for k, v in days_of(spark, 1995, 2001).items()} == {k: list(v) for k, v in KNOWN_DAYS.items()}


def test_later_years_differ_by_a_day_at_most(spark):
    found = days_of(spark, 2019, 2025)
    for key, days in LATER.items():
        far = [abs((a - date.fromisoformat(b)).days) for a, b in zip(found[key], days, strict=True)]
        assert max(far) <= 1 and sum(far) <= 3, (key, found[key])


def test_every_year_has_each_festival_in_its_season(spark):
    found = days_of(spark, 1900, 2100)
    season = {"diwali": (10, 11), "holi": (2, 4), "maha_shivaratri": (2, 3), "raksha_bandhan": (7, 9)}
    for key, (a, b) in season.items():
        assert [d.year for d in found[key]] == list(range(1900, 2101)) and all(a <= d.month <= b for d in found[key]), key
    eid = found["eid_al_fitr"]
    assert all((b - a).days in (354, 355) for a, b in zip(eid, eid[1:], strict=False)) and eid[0].year == 1900 and eid[-1].year == 2100


def test_festivals_of_the_united_states(spark):
    got = {(r.key, str(r.day)) for r in service.us_festivals(spark.range(2011, 2017).select(F.col("id").alias("year"))).collect()}
    thanks = ("2011-11-24", "2012-11-22", "2013-11-28", "2014-11-27", "2015-11-26", "2016-11-24")
    bowl = ("2011-02-06", "2012-02-05", "2013-02-03", "2014-02-02", "2015-02-01", "2016-02-07")
    assert got == {("thanksgiving", d) for d in thanks} | {("super_bowl", d) for d in bowl} | {("christmas", f"{y}-12-25") for y in range(2011, 2017)}
