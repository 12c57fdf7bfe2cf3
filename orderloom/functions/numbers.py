"""Numbers without NaN and infinities, and guarded arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value as a double; NULL where it is no finite number."""
    d = c.cast("double")
    return F.when(F.abs(d) < float("inf"), d)  # NaN is greater than infinity in Spark


def log_positive(c: Column) -> Column:
    """Natural logarithm; NULL unless positive."""
    return F.when(c > 0, F.ln(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a, b)
