"""Posting dates.  Every result is a UTC timestamp; the clock is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import fixed_values as V
from vacantia.functions.exprs import as_timestamp, filled, first_filled, midnight, once, strip, text

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[^0-9]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?$"
)
_OFFSET = r"(?<=\d)(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2}(?:\.\d+)?)?)$"


def _extended(value: Column) -> Column:
    """Bring compact dates and odd separators to yyyy-MM-ddTHH:mm:ss form."""
    dashed = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    return F.regexp_replace(dashed, r"^(\d{4}-\d{2}-\d{2})[^0-9](?=\d{2})", "$1T")


def _first_parsed(values, parse) -> Column:
    parsed = F.transform(F.array(*values), parse)
    return F.try_element_at(F.filter(parsed, lambda d: d.isNotNull()), F.lit(1))


def iso_wall_clock(value: Column) -> Column:
    """ISO date or datetime with its offset dropped, not applied."""
    def read(iso):
        local = F.when(F.length(iso) > 10, F.regexp_replace(iso, _OFFSET, "")).otherwise(iso)
        # An hour alone is legal ISO but not a legal cast.
        local = F.regexp_replace(local, r"(T\d{2})$", "$1:00")
        return F.when(iso.rlike(_ISO), F.replace(local, F.lit(","), F.lit(".")).try_cast("timestamp"))
    return once(_extended(value), read)


def iso_utc(value: Column) -> Column:
    """ISO date or datetime with its offset applied; without one it is taken as UTC."""
    def read(iso):
        full = F.regexp_replace(iso, r"(T\d{2})(?=$|Z|[+-])", "$1:00")
        full = F.when(F.length(iso) > 10, F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(iso)
        return F.when(iso.rlike(_ISO), full.try_cast("timestamp"))
    return once(_extended(value), read)


def greenhouse_date(*values: Column, page_date: Column | None = None) -> Column:
    """First parseable of the date keys, else the date found in the page."""
    return _first_parsed(values if page_date is None else (*values, page_date), iso_wall_clock)


def lever_date(*values: Column) -> Column:
    """First usable key, epoch milliseconds or ISO text.

    The landed JSON is read with text dates, so a run of digits counts as a number.
    """
    def one(v):
        millis = F.when(v.rlike(r"^-?\d+(\.\d+)?$"), v.try_cast("double"))
        return F.coalesce(F.timestamp_micros((millis * 1000).cast("long")), iso_wall_clock(v))
    return _first_parsed(values, one)


def workday_date(*values: Column) -> Column:
    """First usable key, ISO text with its offset applied, else epoch seconds or milliseconds."""
    def one(v):
        number = F.when(v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(v).try_cast("double"))
        seconds = F.when(number > 1e12, number / 1000).otherwise(number)
        # Beyond year 9999 the epoch value is not a date.
        micros = F.when(F.abs(seconds) < 253402300800, F.round(seconds * 1000000).cast("long"))
        return F.coalesce(iso_utc(v), F.timestamp_micros(micros))
    return _first_parsed([filled(v) for v in values], one)


def ashby_date(*values: Column) -> Column:
    """Pick the first filled key, then parse it; a bad value is not retried with the next key."""
    return iso_wall_clock(first_filled(*values))


def page_posting_date(html: Column) -> Column:
    """Date text of the first JobPosting block of linked data in a page."""
    scripts = F.regexp_extract_all(
        text(html), F.lit(r'(?is)<script\b[^>]*\btype\s*=\s*["\']?application/ld\+json["\']?[^>]*>(.*?)</script>'), 1)
    layout = "array<struct<`@type`:string,datePosted:string,datePublished:string,dateCreated:string>>"
    blocks = F.flatten(F.transform(
        scripts, lambda s: F.coalesce(F.from_json(s, layout), F.array().cast(layout))))
    dates = F.transform(
        F.filter(blocks, lambda b: b["@type"].isin("JobPosting", "Posting")),
        lambda b: strip(first_filled(b["datePosted"], b["datePublished"], b["dateCreated"])))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull() & (d != "")), F.lit(1))


def _month_number(name: Column) -> Column:
    position = F.array_position(F.array(*map(F.lit, V.MONTHS)), F.substring(F.lower(name), 1, 3))
    return F.nullif(position, F.lit(0).cast("long")).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, zero, zero, zero.cast("decimal(8,6)"))


def _number(value: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(value, pattern, group).try_cast("int")


def _back(moment: Column, amount: Column, unit_days: int = 1) -> Column:
    days = F.when(amount <= 3650000 // unit_days, amount * unit_days)
    return moment - F.make_dt_interval(days)


def curated_date(value: Column, as_of) -> Column:
    """ISO day, "Mon D", "N days ago" or "Nd/Nw/Nh", as midnight.

    A "Mon D" more than 30 days ahead belongs to the previous year.
    """
    now = as_timestamp(as_of)
    iso, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"(?U)^(\w{3,})\s+(\d{1,2})$"
    ago, short = r"(?iU)^(\d+)\s*days?\s*ago$", r"(?iU)^(\d+)([dhw])$"

    def read(raw):
        month, day = _month_number(F.regexp_extract(raw, named, 1)), _number(raw, named, 2)
        this_year = _day(F.year(now), month, day)
        last_year = _day(F.year(now) - 1, month, day)
        amount = _number(raw, short, 1)
        unit = F.lower(F.regexp_extract(raw, short, 2))
        return (
            F.when(raw.rlike(iso), _day(_number(raw, iso, 1), _number(raw, iso, 2), _number(raw, iso, 3)))
            .when(raw.rlike(named),
                  F.when(this_year > now + F.expr("INTERVAL 30 DAYS"), last_year).otherwise(this_year))
            .when(raw.rlike(ago), midnight(_back(now, _number(raw, ago, 1))))
            .when(unit == "d", midnight(_back(now, amount)))
            .when(unit == "w", midnight(_back(now, amount, 7)))
            .when(unit == "h", midnight(now))
        )
    return once(strip(text(value)), read)


def date_in_text(page_text: Column, as_of) -> Column:
    """Posting date named in free text: ISO day, "Month D, YYYY", else "N days ago"."""
    now = as_timestamp(as_of)
    body = text(page_text)
    iso, month = "(?U)" + V.TEXT_ISO_DATE, "(?iU)" + V.TEXT_MONTH_DATE
    posted, ago = "(?iU)" + V.TEXT_POSTED_DAYS, "(?iU)" + V.TEXT_DAYS_AGO
    days = F.coalesce(_number(body, posted, 1), _number(body, ago, 1))
    return (
        F.when(body.rlike(iso), _day(_number(body, iso, 1), _number(body, iso, 2), _number(body, iso, 3)))
        .when(body.rlike(month), _day(_number(body, month, 3), _month_number(F.regexp_extract(body, month, 1)),
                                      _number(body, month, 2)))
        .otherwise(_back(now, days))
    )


def naive_utc(value: Column) -> Column:
    """Timestamp of an ISO text under UTC, its offset applied."""
    return iso_utc(filled(value))


def posted_days_ago(posted_at: Column, as_of) -> Column:
    """Whole days since posting, floored; negative for the future."""
    elapsed = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(posted_at.cast("timestamp"))
    return F.floor(elapsed / F.lit(86400000000)).cast("long")


def within_days(posted_at: Column, days: int, as_of) -> Column:
    """Posted at most ``days`` days before the clock; false for undated rows."""
    cutoff = as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    return F.coalesce(posted_at >= cutoff, F.lit(False))
