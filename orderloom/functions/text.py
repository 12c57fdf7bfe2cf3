"""Canonical writings of keys and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank at either end of a key.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u2003\u3000\ufeff"

# Labels of the two kinds of flow.
PROPRIETARY_LABELS = ("prop", "proprietary", "own", "own_account", "own account")
CLIENT_LABELS = ("client", "nonprop", "non-prop", "non_proprietary", "non-proprietary", "nonproprietary")


def trimmed(c: Column) -> Column:
    """Without blanks at either end; NULL where nothing is left."""
    t = F.btrim(c.cast("string"), F.lit(BLANKS))
    return F.when(t != "", t)


def canonical_isin(c: Column) -> Column:
    return F.upper(trimmed(c))


def canonical_id(c: Column) -> Column:
    """Ids that denote one number get one writing ("62.0", "00062" and "62" are "62"); others are trimmed."""
    t = trimmed(c)
    number = F.when(t.rlike(r"^[+-]?[0-9]{1,30}([.][0-9]{0,8})?$"), t.try_cast("decimal(38,8)"))
    whole = F.when(number == F.floor(number), number.cast("decimal(30,0)").cast("string"))
    return F.coalesce(whole, F.regexp_replace(number.cast("string"), "0+$", ""), t)


def flow_label(c: Column) -> Column:
    """"proprietary" or "client"; NULL for any other label."""
    t = F.lower(trimmed(c))
    return F.when(t.isin(*PROPRIETARY_LABELS), "proprietary").when(t.isin(*CLIENT_LABELS), "client")
