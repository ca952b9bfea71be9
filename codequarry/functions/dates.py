"""Time stamps in UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours that a token lives.
LIFETIME_HOURS = 1


def now() -> Column:
    """The time of the query, the same for all its rows; a column's default on insert."""
    return F.current_timestamp()


def shown(c: Column) -> Column:
    """As messages show it: yyyy-MM-dd HH:mm."""
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def expiry(c: Column, hours: int = LIFETIME_HOURS) -> Column:
    return c + F.make_interval(hours=F.lit(hours))


def elapsed(start: Column, end: Column) -> Column:
    """Seconds from start to end, to two places."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000000, 2)
