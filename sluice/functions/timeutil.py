"""Time arithmetic that agrees with the sensors' rules: boundaries, grids, RANGE frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries crossed from ``start`` to ``end``: 00:00:59 to 00:01:01 is one."""
    a, b = (F.date_trunc("minute", c).cast("timestamp_ntz") for c in (start, end))
    return F.timestamp_diff("MINUTE", a, b)


def floor_minutes(ts: Column | str, step: int) -> Column:
    """The start of the ``step``-minute slot of the hour that holds ``ts``."""
    minute = F.date_trunc("minute", ts).cast("timestamp_ntz")
    return minute - F.make_dt_interval(F.lit(0), F.lit(0), (F.minute(ts) % step).cast("int"))


def interval(hours: float = 0, minutes: float = 0, micros: int = 0) -> str:
    """A day-to-second literal: the two bounds of a RANGE frame must share this type."""
    total = round((hours * 3600 + minutes * 60) * 1_000_000) + micros
    sign, total = ("-", -total) if total < 0 else ("", total)
    days, rest = divmod(total, 86_400_000_000)
    h, rest = divmod(rest, 3_600_000_000)
    m, rest = divmod(rest, 60_000_000)
    return f"INTERVAL '{sign}{days} {h:02}:{m:02}:{rest // 1_000_000:02}.{rest % 1_000_000:06}' DAY TO SECOND"


#: Window partitions in which no year sees another.
YEARLY = "station_code, year(ts)"


def over(expression: str, frame: str, key: str = "station_code", order: str = "ts") -> Column:
    return F.expr(f"{expression} OVER (PARTITION BY {key} ORDER BY {order} {frame})")


def back(hours: float) -> str:
    """Closed trailing window of ``hours`` that ends at the row."""
    return f"RANGE BETWEEN {interval(hours)} PRECEDING AND CURRENT ROW"


def at(hours: float = 0, minutes: float = 0) -> str:
    """The reading exactly that long ago, or none."""
    return f"RANGE BETWEEN {interval(hours, minutes)} PRECEDING AND {interval(hours, minutes)} PRECEDING"


def ahead(hours: float, first_minutes: float = 0, first_micros: int = 0) -> str:
    """Forward window from the given offset up to ``hours`` after the row."""
    return f"RANGE BETWEEN {interval(minutes=first_minutes, micros=first_micros)} FOLLOWING AND {interval(hours)} FOLLOWING"
