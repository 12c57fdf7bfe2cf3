"""Wall-clock microseconds and days, independent of the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def wall_us(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of the wall clock that a timestamp shows."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (
        day * F.lit(DAY_US)
        + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(ts).cast("bigint") * F.lit(60_000_000)
        + second
    )


def floor_div(value: Column, by: int) -> Column:
    """Whole quotient, rounded down for negative values too."""
    by = F.lit(by).cast("bigint")
    rest = F.pmod(value, by)
    return F.call_function("div", value - rest, by)


def instant_us(ts: Column, ns: Column) -> Column:
    """The timestamp, or where it is NULL the epoch nanoseconds, as wall-clock microseconds."""
    return F.coalesce(wall_us(ts), floor_div(ns, 1000))


def day_of_us(us: Column) -> Column:
    """Days since 1970-01-01."""
    return floor_div(us, DAY_US)
