"""Integer-millisecond time arithmetic and clock text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame rate and margins of the edit timeline.
FRAMES_PER_SECOND = 24
CLIP_MARGIN_MS = 100
LINE_TOLERANCE_MS = 10


def ms(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def idiv(a: Column, b: Column | int) -> Column:
    """Whole-number division (operands are never negative here)."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def round10(value: Column) -> Column:
    """Half-up to 10 ms, the two decimals of a second."""
    return idiv(value + 5, 10) * 10


def midpoint10(a: Column, b: Column) -> Column:
    """Half-up midpoint of two times, in 10 ms steps."""
    return idiv(a + b + 10, 20) * 10


def frames_of(value: Column) -> Column:
    return idiv(value * FRAMES_PER_SECOND + 500, 1000)


def seconds_to_ms(text: Column) -> Column:
    """Decimal seconds as text to ms, null when it is no number."""
    return F.round(text.try_cast("double") * 1000).cast("bigint")


def clock_to_ms(text: Column) -> Column:
    """``h:m:s.f`` to ms, null when a part is no number."""
    parts = F.split(F.trim(text), ":")
    hours, minutes = F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
    return hours * 3_600_000 + minutes * 60_000 + seconds_to_ms(F.get(parts, F.lit(2)))


def lrc_tag(value: Column) -> Column:
    """``[mm:ss.cc]``, truncating."""
    return F.format_string(
        "[%02d:%02d.%02d]", idiv(value, 60_000), idiv(value % 60_000, 1000), idiv(value % 1000, 10)
    )


def player_clock(value: Column) -> Column:
    """``mm:ss.t``, truncating."""
    return F.format_string("%02d:%02d.%d", idiv(value, 60_000), idiv(value % 60_000, 1000), idiv(value % 1000, 100))


def clip_time(clip_start: Column, offset: Column, line_start: Column, now: Column) -> Column:
    """Position inside the source clip at song time ``now``."""
    return clip_start + (now - line_start - F.coalesce(offset, F.lit(0)))


def needs_resync(actual: Column, expected: Column, threshold_ms: int = 450) -> Column:
    return F.abs(actual - expected) > threshold_ms


def unit_volume(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
