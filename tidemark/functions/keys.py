"""How identifiers and times of the ad-event tables are read. All results are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND
NO_CAMPAIGN = ("none", "pending", "nofill")

_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def plain_key(c: Column | str) -> Column:
    """Lower case, without surrounding blanks, tabs and line ends."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))


def request_key(c: Column | str) -> Column:
    """plain_key of a request id; null where it is no id: null, empty, `-`, or nothing but zeros after a prefix."""
    k = plain_key(c)
    return F.when(~k.rlike(r"^([a-z]*-)?0*$"), k)


def campaign_key(c: Column | str) -> Column:
    """plain_key of a campaign id; null for null, empty, `-` and the names that stand for no campaign."""
    k = plain_key(c)
    return F.when(~k.isin("", "-", *NO_CAMPAIGN), k)


def wall_us(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c) if isinstance(c, str) else c)


def wall_time(us: Column) -> Column:
    """The timestamp without zone of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def floor_to(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def arrival_us(c: Column | str) -> Column:
    """Microseconds since 1970 of an arrival time written as text; null where it is unreadable.

    Read are a date and a time with `T` or a blank between them, an optional fraction (cut to microseconds) and an
    optional offset (none means UTC), and digits alone as epoch milliseconds."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.when(c.rlike(r"\.\d{7}"), F.regexp_replace(c, r"(\.\d{6})\d+", "$1")).otherwise(c)
    zoned = F.when(cut.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & (F.length(cut) > 19), cut).otherwise(F.concat(cut, F.lit("Z")))
    return F.when(c.rlike(r"^\d+$"), F.try_multiply(c.try_cast("bigint"), F.lit(1000).cast("bigint"))).when(
        c.rlike(_STAMP), F.unix_micros(zoned.try_cast("timestamp"))
    )


def minute_key(c: Column | str) -> Column:
    """The minute of a timestamp as twelve digits."""
    return F.date_format(c, "yyyyMMddHHmm")


def click_url(base: str, campaign: Column, request: Column) -> Column:
    """Where a click of a request leads; null without campaign."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.url_encode(campaign), F.lit("?arid="), F.url_encode(F.coalesce(request, F.lit(""))))
