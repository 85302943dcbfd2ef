"""Numbers, dates and JSON: expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_DAYS = {"1m": 30, "3m": 90, "6m": 180, "1y": 365}
OPEN_END = "至今"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_n(x: Column, n: int) -> Column:
    """Half up on the double itself: the same operations in any engine give the same bits."""
    p = float(10**n)
    return F.floor(x * p + 0.5).cast("double") / p


def rate(a: Column | str, b: Column | str, digits: int | None = None, empty: float | None = None) -> Column:
    """a / b; ``empty`` (or null) where b is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    value = a / F.nullif(b, F.lit(0.0))
    value = value if digits is None else round_n(value, digits)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def truncating_percent(a: Column | str, b: Column | str) -> Column:
    """Whole percent, cut off, at most 100; 0 where b is 0."""
    return F.coalesce(F.least(F.lit(100), F.floor(col(a) / F.nullif(col(b).cast("double"), F.lit(0.0)) * 100)), F.lit(0)).cast("int")


def days_between(a: Column | str, b: Column | str) -> Column:
    """Whole days from a to b, rounded down (not calendar days)."""
    return F.floor((F.unix_micros(col(b)) - F.unix_micros(col(a))) / F.lit(86_400_000_000)).cast("long")


def range_start(as_of: Column, code: str) -> Column:
    """Start of a named time range that ends at ``as_of``."""
    return as_of - F.make_dt_interval(F.lit(RANGE_DAYS[code]))


def normalize_date(s: Column | str) -> Column:
    """Words for an open end become one; else the first year 20dd; else unchanged."""
    s = col(s)
    year = F.regexp_extract(s, r"20\d{2}", 0)
    return F.when(s.isin(OPEN_END, "Present", "现在", "Current"), F.lit(OPEN_END)).when(year != "", year).otherwise(s)


#: The date range patterns in the order in which they are tried.
DATE_RANGES = (
    r"(?i)(20\d{2})[.\-/年](\d{1,2})?\s*[\-–~]\s*(20\d{2})?[.\-/年]?(\d{1,2}|至今|Present)?",
    r"(?i)(20\d{2})\s*[\-–~]\s*(20\d{2}|至今|Present)",
    r"(20\d{2})年(?:\d{1,2}月)?\s*[\-–~]\s*(?:(20\d{2})年)?(?:至今)?",
)


def date_range(s: Column | str) -> Column:
    """Struct(start, end) of the first pattern that matches; an end that is no year and not open is ''."""
    s = F.coalesce(col(s), F.lit(""))
    group = lambda k, n: F.coalesce(F.regexp_extract(s, DATE_RANGES[k], n), F.lit(""))
    late = F.when(group(0, 4) != "", group(0, 4)).otherwise(group(0, 3))
    ends = [
        F.when(late.isin(OPEN_END, "Present"), F.lit(OPEN_END)).when(F.regexp_like(late, F.lit(r"^20\d{2}")), late).otherwise(F.lit("")),
        F.when(group(1, 2).isin(OPEN_END, "Present"), F.lit(OPEN_END)).otherwise(group(1, 2)),
        group(2, 2),
    ]
    start, end = F.lit(""), F.lit("")
    for k in (2, 1, 0):
        hit = F.regexp_like(s, F.lit(DATE_RANGES[k]))
        start, end = F.when(hit, group(k, 1)).otherwise(start), F.when(hit, ends[k]).otherwise(end)
    return F.struct(start.alias("start"), end.alias("end"))


def format_duration(start: Column | str, end: Column | str) -> Column:
    """``start - end``; an open end is shown as such, no start gives ''."""
    start, end = col(start), col(end)
    last = F.when(F.coalesce(end, F.lit("")) == "", F.lit(OPEN_END)).otherwise(end)
    return F.when(F.coalesce(start, F.lit("")) == "", F.lit("")).otherwise(F.concat(start, F.lit(" - "), last))


def is_valid_date(s: Column | str) -> Column:
    return F.coalesce(F.regexp_like(col(s), F.lit(r"^(20\d{2}|20\d{2}[.\-/年]\d{1,2}月?|至今|Present)$")), F.lit(False))


def falsy_text(x: Column | str, instead: str = "unknown") -> Column:
    """Null and '' become ``instead``."""
    return F.coalesce(F.nullif(col(x), F.lit("")), F.lit(instead))


def truthy(x: Column | str) -> Column:
    """Null and 0 become null."""
    return F.nullif(col(x), F.lit(0))
