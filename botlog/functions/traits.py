"""Per-request trait expressions: status classes, keyword flags, user-agent
category and time buckets. All native expressions (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the reference's behaviour)
#
# User-agent keywords that flag automated clients (case-insensitive substring).
BOT_KEYWORDS = ("bot", "crawl", "spider", "python", "curl", "monitoring", "googlebot")
# Path keywords of login / API endpoints (case-insensitive substring).
LOGIN_API_KEYWORDS = ("/login", "/user", "/signin", "/api", "/search")
# User-agent categories, checked in this order after lower-casing:
KNOWN_BOT_KEYWORDS = ("bot", "crawl", "spider", "monitoring", "googlebot")
SCRIPT_KEYWORDS = ("python", "curl", "requests")
CATEGORY_UNKNOWN = "Unknown"
CATEGORY_KNOWN_BOT = "Known Bot"
CATEGORY_SCRIPT = "Suspicious Script"
CATEGORY_BROWSER = "Likely Browser"
# ---------------------------------------------------------------------------

TIME_BIN_SECONDS = 600


def contains_any(col: Column, keywords) -> Column:
    """Lower-cased substring test (``kw in ua.lower()``); null -> null."""
    low = F.lower(col)
    return reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])


def matches_any(col: Column, keywords) -> Column:
    """Case-insensitive keyword alternation as a regex search with Unicode
    case folding (``(?iu)``), the semantics of a case-insensitive
    ``str.contains`` on a joined pattern; null -> null."""
    return col.rlike("(?iu)" + "|".join(keywords))


def ua_bot_flag(user_agent: Column) -> Column:
    """1 when the user agent contains a bot keyword, 0 otherwise (null -> 0)."""
    return F.coalesce(matches_any(user_agent, BOT_KEYWORDS), F.lit(False)).cast("int")


def login_api_flag(path: Column) -> Column:
    """1 when the path contains a login/API keyword, 0 otherwise (null -> 0)."""
    return F.coalesce(matches_any(path, LOGIN_API_KEYWORDS), F.lit(False)).cast("int")


def _status_between(status: Column, lo: int, hi: int) -> Column:
    # A missing status compares false and still counts in the denominator.
    return F.coalesce((status >= lo) & (status < hi), F.lit(False))


def is_4xx(status: Column) -> Column:
    return _status_between(status, 400, 500)


def is_5xx(status: Column) -> Column:
    return _status_between(status, 500, 600)


def is_3xx(status: Column) -> Column:
    return _status_between(status, 300, 400)


def ua_category(user_agent: Column) -> Column:
    """Known Bot / Suspicious Script / Likely Browser; null -> Unknown."""
    return (
        F.when(user_agent.isNull(), F.lit(CATEGORY_UNKNOWN))
        .when(contains_any(user_agent, KNOWN_BOT_KEYWORDS), F.lit(CATEGORY_KNOWN_BOT))
        .when(contains_any(user_agent, SCRIPT_KEYWORDS), F.lit(CATEGORY_SCRIPT))
        .otherwise(F.lit(CATEGORY_BROWSER))
    )


def floor_seconds(ts: Column, width: int) -> Column:
    """Instant floored to a multiple of ``width`` seconds since the epoch
    (minute = 60, 10-minute bin = 600); UTC-aligned, tz-independent."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(width)))


def minute_bucket(ts: Column) -> Column:
    return floor_seconds(ts, 60)


def time_bin(ts: Column, width: int = TIME_BIN_SECONDS) -> Column:
    return floor_seconds(ts, width)


def offset_seconds(tz_offset: Column) -> Column:
    """``+hhmm`` -> seconds; anything else 0."""
    ok = tz_offset.rlike("^[+-][0-9]{4}$")
    size = F.substring(tz_offset, 2, 2).try_cast("long") * 3600 + F.substring(tz_offset, 4, 2).try_cast("long") * 60
    return F.when(ok, F.when(tz_offset.startswith("-"), -size).otherwise(size)).otherwise(F.lit(0).cast("long"))


def local_time_bin(ts: Column, tz_offset: Column, width: int = TIME_BIN_SECONDS) -> Column:
    """Start of the bin on the writer's wall clock, as an instant."""
    local = F.unix_seconds(ts) + offset_seconds(tz_offset)
    return F.timestamp_seconds(F.unix_seconds(ts) - F.pmod(local, F.lit(width)))


# File name extensions of resources that a browser loads with a page (fixed values).
RESOURCE_PATTERN = r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|webp|woff2?)([?#]|$)"


def is_resource(path: Column) -> Column:
    return F.coalesce(path.rlike(RESOURCE_PATTERN), F.lit(False))
