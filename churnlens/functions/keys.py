"""Keys, marker cleaning, date parsing and date differences.

All functions return ``Column`` expressions built from Spark built-ins, so
they stay JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "pad_key", "present", "blank_to_null", "comma_decimal", "digits_only",
    "strip_dots", "parse_mixed_date", "yyyymm_to_date", "billing_system",
    "months_crossed", "months_full", "weeks_full", "weeks_crossed", "days_between",
    "safe_ratio", "round_half_up", "DEFAULT_MARKERS", "DUMMY_EMAILS",
    "DUMMY_EMAILS_DATED",
]

# Placeholder markers the source registers use for "no value".
DEFAULT_MARKERS = ("#N/D", "nan", "NULL", "")

# Dummy e-mail addresses excluded before e-mail matching.
DUMMY_EMAILS = (
    "NOTIENE@GMAIL.COM",
    "NorEPorTA@CABLETICA.COM",
    "NorEPorTACorREO@CABLETICA.COM",
    "NorEPorTA.@CABLETICA.COM",
    "NOTIENE@CABLETICA.COM",
    "NA@GMAIL.COM",
    "NOTIENE@NOTIENE.COM",
    "NorEPorTA@LIBERTY.COM",
    "NO@GMAIL.COM",
)

# The shorter list of the dated (BigQuery) match, in its spelling.
DUMMY_EMAILS_DATED = (
    "NOTIENE@GMAIL.COM",
    "NOREPORTA@CABLETICA.COM",
    "NOREPORTACORREO@CABLETICA.COM",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_key(c, width: int = 10) -> Column:
    """Left zero-pad to ``width`` and keep the LAST ``width`` characters.

    This is ``RIGHT(CONCAT('0000000000', x), 10)``; ``lpad`` would keep the
    first characters of a longer key instead.
    """
    s = _c(c).cast("string")
    return F.substring(F.concat(F.lit("0" * width), s), -width, width)


def present(c) -> Column:
    """A product is present when non-null and not the empty string."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def blank_to_null(c, markers: Iterable[str] = DEFAULT_MARKERS) -> Column:
    c = _c(c)
    return F.when(~c.isin(list(markers)), c)


def comma_decimal(c, bad_patterns: Sequence[str] = ("%#%", "%/%", "NULL")) -> Column:
    """Text amount with a comma decimal mark to double; markers become NULL."""
    c = _c(c)
    bad = None
    for p in bad_patterns:
        t = c.like(p)
        bad = t if bad is None else (bad | t)
    val = F.replace(F.coalesce(c, F.lit("0")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(bad, F.lit(None).cast("double")).otherwise(val) if bad is not None else val


def digits_only(c, keep_blank: bool = True) -> Column:
    return F.regexp_replace(_c(c), "[^0-9 ]" if keep_blank else "[^0-9]", "")


def strip_dots(c) -> Column:
    return F.replace(_c(c).cast("string"), F.lit("."), F.lit(""))


def parse_mixed_date(c, formats: Sequence[str] = ("MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd"),
                     prefix_len: int | None = 10, junk: Iterable[str] = ()) -> Column:
    """First format that parses wins; ``junk`` values (product names stored in
    a date column, ``#N/D``) give NULL. ``MM/dd`` before ``dd/MM`` means a day
    above 12 in the first field falls through to the swapped format."""
    c = _c(c)
    s = F.substring(c, 1, prefix_len) if prefix_len else c
    parsed = F.coalesce(*[F.try_to_date(s, f) for f in formats])
    junk = list(junk)
    if junk:
        return F.when(c.isin(junk), F.lit(None).cast("date")).otherwise(parsed)
    return parsed


def yyyymm_to_date(c) -> Column:
    """``yyyymm`` text month (or int) to the first day of that month."""
    return F.try_to_date(F.concat(_c(c).cast("string"), F.lit("01")), "yyyyMMdd")


def billing_system(c, short_len: int = 8, short_name: str = "CERILLION",
                   long_name: str = "LIBERATE") -> Column:
    """Source billing system from the key length."""
    return F.when(F.length(_c(c).cast("string")) == short_len, F.lit(short_name)).otherwise(F.lit(long_name))


def months_crossed(start, end) -> Column:
    """Month boundaries crossed (BigQuery ``DATE_DIFF(end, start, MONTH)``)."""
    s, e = _c(start), _c(end)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("int")


def months_full(start, end) -> Column:
    """Whole months elapsed (Presto ``date_diff('month', start, end)``)."""
    return F.timestamp_diff("MONTH", _c(start).cast("timestamp"), _c(end).cast("timestamp")).cast("int")


def days_between(start, end) -> Column:
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def weeks_full(start, end) -> Column:
    """Whole weeks (Presto ``date_diff('week', …)``): days / 7 truncated."""
    d = days_between(start, end)
    return (F.signum(d) * F.floor(F.abs(d) / 7)).cast("int")


def weeks_crossed(start, end) -> Column:
    """Sunday-start week boundaries crossed (BigQuery ``DATE_DIFF(…, WEEK)``)."""
    s, e = _c(start).cast("date"), _c(end).cast("date")
    ws = F.date_sub(s, F.dayofweek(s) - 1)
    we = F.date_sub(e, F.dayofweek(e) - 1)
    return (F.datediff(we, ws) / 7).cast("int")


def safe_ratio(num, den, digits: int | None = None) -> Column:
    """``SAFE_DIVIDE`` (NULL on a zero or NULL denominator), optional rounding."""
    r = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return F.round(r, digits) if digits is not None else r


def round_half_up(c, digits: int = 0) -> Column:
    return F.round(_c(c), digits)
