"""Small column helpers shared by the other function modules."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the separators that string splitting treats as blank.
BLANK = r"[\s\x1c-\x1f]"


def text(c: Column) -> Column:
    """Null-safe text."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def squeeze(c: Column) -> Column:
    """Collapse every blank run to one space and strip the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){BLANK}+", " "))


def filled(c: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(c, F.lit(""))


def not_blank(c: Column) -> Column:
    return strip(text(c)) != ""


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode word characters and boundaries."""
    return text(c).rlike("(?iU)" + pattern)


def contains_any(c: Column, phrases) -> Column:
    """True when an already lower-cased text holds one of the phrases."""
    return reduce(or_, [c.contains(p) for p in shortest(phrases)])


def shortest(phrases) -> list:
    """Drop phrases that contain another phrase: a hit on them is a hit on the shorter one."""
    unique = list(dict.fromkeys(phrases))
    return [p for p in unique if not any(q != p and q in p for q in unique)]


def first_filled(*cols: Column) -> Column:
    """First non-null, non-empty value."""
    return F.coalesce(*[filled(c) for c in cols])


def once(value: Column, use) -> Column:
    """Apply a function that names its argument several times, evaluating the argument once."""
    return F.transform(F.array(value), use)[0]


def midnight(c: Column) -> Column:
    return F.date_trunc("day", c)


def as_timestamp(value) -> Column:
    """A timestamp argument given as a column, a datetime or a string."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(value).cast("timestamp")


def arrival(owner: Column, pos: Column) -> Column:
    """One number that orders rows by (owner, pos), for any long and any int; wide enough that none collide."""
    return (owner.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")
