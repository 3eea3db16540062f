"""Day-first dates in ISO form."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO, DAY_FIRST = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}$"


def parse_date(c: Column) -> Column:
    """yyyy-mm-dd, else d.m.yyyy or d/m/yyyy, as a date; null where the calendar has no such day or the year is below 1000."""
    t = F.trim(c)
    iso = F.when(t.rlike(ISO), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    day = F.when(t.rlike(DAY_FIRST), F.try_to_timestamp(F.replace(t, F.lit("."), F.lit("/")), F.lit("d/M/yyyy")))
    d = F.coalesce(iso, day).cast("date")
    return F.when(F.year(d).between(1000, 9999), d)
