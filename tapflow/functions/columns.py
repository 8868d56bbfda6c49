"""Scalar column functions (F1-F14). All return Spark Columns built from
built-in expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapflow.model import (OPERATIONAL_DAY_START_HOUR, ROUTE_DATE_FORMAT,
                           STOP_CODE_WIDTH, WEEKDAYS)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """surrounding white space removed."""
    return F.trim(_c(c))


def zero_pad(c: Column | str, width: int = STOP_CODE_WIDTH) -> Column:
    """left pad with zeros to ``width``; longer codes stay whole
    (plain ``lpad`` would truncate them)."""
    c = _c(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def parse_date(c: Column | str, fmt: str = ROUTE_DATE_FORMAT) -> Column:
    """string to date with a pattern; malformed input becomes null
    instead of failing the job under ANSI mode."""
    return F.try_to_date(_c(c), fmt)


def hms(c: Column | str) -> Column:
    """wall-clock time of a timestamp as 'HH:mm:ss' (fraction dropped)."""
    return F.date_format(_c(c), "HH:mm:ss")


def time_text(t: time | str) -> str:
    """a time-of-day bound as 'HH:MM:SS'."""
    return t if isinstance(t, str) else t.strftime("%H:%M:%S")


def operational_weekday(c: Column | str) -> Column:
    """weekday number (0 = Monday) of the operational day: a ride
    before 03:00 belongs to the day before."""
    shifted = _c(c) - F.expr(f"INTERVAL {OPERATIONAL_DAY_START_HOUR} HOURS")
    return F.weekday(shifted)


def operational_date(c: Column | str) -> Column:
    """The operational day of a timestamp (before 03:00: the day before)."""
    return F.to_date(_c(c) - F.expr(f"INTERVAL {OPERATIONAL_DAY_START_HOUR} HOURS"))


def weekday_numbers(days) -> list[int]:
    """Day names to weekday numbers (0 = Monday); unknown names raise."""
    lookup = {name.lower(): i for i, name in enumerate(WEEKDAYS)}
    return sorted({lookup[d.lower()] for d in days})


def in_band(c: Column | str, start: time | str, end: time | str) -> Column:
    """inclusive time-of-day band on whole seconds."""
    return hms(c).between(time_text(start), time_text(end))


def tagged(c: Column | str, suffix: str) -> Column:
    """F8: string suffix."""
    return F.concat(_c(c), F.lit(suffix))


def l2_norm(arr: Column | str) -> Column:
    """Euclidean norm of an array<double>."""
    return F.sqrt(F.aggregate(_c(arr), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(arr: Column | str) -> Column:
    """Divide every element by the vector's L2 norm; a zero vector stays zero."""
    norm = l2_norm(arr)
    return F.when(norm > 0, F.transform(_c(arr), lambda x: x / norm)).otherwise(_c(arr))


def divide_by_max(arr: Column | str) -> Column:
    """Divide every element by the array maximum (F12 ``array_max``)."""
    m = F.array_max(_c(arr))
    return F.transform(_c(arr), lambda x: x / m)


def linear_scale(v: Column, vmin: Column, vmax: Column, lo: float, hi: float) -> Column:
    """linear map of ``v`` from a domain to [lo, hi]. As in a linear chart
    scale, the domain is widened to include zero; a zero-width domain maps
    everything to the middle of the range."""
    d0 = F.least(vmin, F.lit(0.0))
    d1 = F.greatest(vmax, F.lit(0.0))
    frac = F.when(d1 > d0, (v - d0) / (d1 - d0)).otherwise(F.lit(0.5))
    return F.lit(lo) + frac * F.lit(hi - lo)


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """A10: bin index of ``x`` among ``bins`` equal bins over [lo, hi], last
    bin closed, matching a NumPy weighted histogram exactly: the first guess
    ``(x - lo) * (bins / (hi - lo))`` is corrected against the bin edges
    ``lo + i * step`` (last edge = hi). A zero-width range is widened by 0.5
    on each side."""
    first = F.when(hi > lo, lo).otherwise(lo - F.lit(0.5))
    last = F.when(hi > lo, hi).otherwise(hi + F.lit(0.5))
    step = (last - first) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i >= F.lit(bins), last).otherwise(i.cast("double") * step + first)

    guess = ((x - first) * (F.lit(float(bins)) / (last - first))).cast("int")
    guess = F.when(guess >= F.lit(bins), F.lit(bins - 1)).otherwise(guess)
    guess = F.when(x < edge(guess), guess - 1).otherwise(guess)
    return F.when((x >= edge(guess + 1)) & (guess != F.lit(bins - 1)), guess + 1).otherwise(guess)
