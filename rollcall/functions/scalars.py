"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from Spark's own functions, so it
stays inside whole-stage codegen; there is no Python UDF in this package.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_ntz(value: str) -> Column:
    """A TIMESTAMP_NTZ literal; the driver's parquet timestamps read as NTZ."""
    return F.lit(value).cast("timestamp_ntz")


def plus_days(ts, days) -> Column:
    """timestamp + n days, n an integer column or int."""
    d = col_of(days) if not isinstance(days, int) else F.lit(days)
    return col_of(ts) + F.make_dt_interval(days=d.cast("int"))


def plus_hours(ts, hours: int) -> Column:
    return col_of(ts) + F.make_dt_interval(hours=F.lit(hours))


def lpad_keep(value, width: int, pad: str = "0") -> Column:
    """Left-pad to ``width`` but never cut a longer value (LPAD would)."""
    s = col_of(value).cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit(pad))


def percent_2dp(part, whole) -> Column:
    """round(part / whole * 100, 2) with exact half-up decimal rounding, as a
    double; NULL when ``whole`` is 0. Integer arithmetic avoids both the
    decimal-vs-double split between engines and ANSI divide-by-zero."""
    k = col_of(part).cast("long")
    n = col_of(whole).cast("long")
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(
        F.floor((k * 20000 + n) / (n * 2)).cast("double") / 100)


def percent_whole(part, whole) -> Column:
    """Math.round(part / whole * 100) for non-negative counts; 0 when whole = 0."""
    k = col_of(part).cast("long")
    n = col_of(whole).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(
        F.floor((k * 200 + n) / (n * 2)).cast("long"))


def js_round(x) -> Column:
    """JavaScript Math.round: half rounds up (towards +inf)."""
    return F.floor(col_of(x) + F.lit(0.5))


def js_month_shift(ts, months) -> Column:
    """``new Date(y, m + months, d)`` with JavaScript's day overflow kept:
    31 Jan + 1 month is 2 or 3 March, not the clamped end of February.
    Result is midnight of that day as TIMESTAMP_NTZ."""
    d = F.to_date(col_of(ts))
    m = col_of(months) if not isinstance(months, int) else F.lit(months)
    first = F.add_months(F.trunc(d, "MM"), m.cast("int"))
    return F.date_add(first, F.dayofmonth(d) - 1).cast("timestamp_ntz")


# The reporting view's attendance labels, in its order:
#   checked in -> 'Hadir', confirmed -> 'Terkonfirmasi',
#   registered -> 'Terdaftar', cancelled -> 'Dibatalkan', else 'Tidak Hadir'
ATTENDANCE_LABELS = ("Hadir", "Terkonfirmasi", "Terdaftar", "Dibatalkan", "Tidak Hadir")


def attendance_status(checkin_time="checkin_time", status="status") -> Column:
    """Five-way label of the reporting view: a check-in time wins, then the
    visitor status; anything else is absent."""
    ct, st = col_of(checkin_time), col_of(status)
    attended, confirmed, registered, cancelled, absent = ATTENDANCE_LABELS
    return (F.when(ct.isNotNull(), attended)
            .when(st == "confirmed", confirmed)
            .when(st == "registered", registered)
            .when(st == "cancelled", cancelled)
            .otherwise(absent))


def ticket_checksum(visitor_id, code, email) -> Column:
    """First 8 hex chars of md5(id || code || email)."""
    return F.substring(F.md5(F.concat(col_of(visitor_id).cast("string"),
                                      col_of(code), col_of(email))), 1, 8)
