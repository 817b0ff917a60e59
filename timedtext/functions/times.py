"""Column functions over times: timestamps are parsed to and printed from whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: str | Column) -> Column:
    """Milliseconds of ``H:M:S[,.]f``; 0 if the text is none."""
    part = lambda k: F.try_element_at(F.split(F.trim(_col(c)), ":"), F.lit(k))
    seconds = F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double")
    ms = (part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60) * 1000 + F.floor(seconds * 1000 + 0.5)
    return F.coalesce(F.when(F.size(F.split(_col(c), ":")) == 3, ms), F.lit(0)).cast("long")


def parse_clock(c: str | Column) -> Column:
    """Milliseconds of ``H:M:S`` or ``M:S``; null if the text is neither."""
    parts = F.transform(F.split(F.trim(_col(c)), ":"), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x)
    return F.when(F.size(parts).between(2, 3) & F.forall(parts, lambda x: x.isNotNull()), F.floor(total * 1000 + 0.5)).cast("long")


def format_timestamp(ms: str | Column, style: str = "srt") -> Column:
    """``srt`` HH:MM:SS,mmm, ``ass`` H:MM:SS.cc or ``clock`` HH:MM:SS; negative times print as 0."""
    t = F.greatest(_col(ms), F.lit(0)).cast("long")
    h, m, s, f = F.floor(t / 3600000).cast("long"), (F.floor(t / 60000) % 60).cast("long"), (F.floor(t / 1000) % 60).cast("long"), (t % 1000).cast("long")
    if style == "srt":
        return F.format_string("%02d:%02d:%02d,%03d", h, m, s, f)
    if style == "ass":
        return F.format_string("%d:%02d:%02d.%02d", h, m, s, F.floor(f / 10).cast("long"))
    return F.format_string("%02d:%02d:%02d", h, m, s)


def format_range(start_ms: str | Column, end_ms: str | Column) -> Column:
    """``HH:MM:SS-HH:MM:SS``; times before the beginning count as 0."""
    return F.concat(format_timestamp(start_ms, "clock"), F.lit("-"), format_timestamp(end_ms, "clock"))


def time_proximity(t_ms: str | Column, target_ms: str | Column, duration_ms: str | Column) -> Column:
    """exp(-(distance / sigma)^2), sigma the larger of 90 s and 0.18 of the duration; 0 without a duration."""
    sigma = F.greatest(F.lit(90000.0), _col(duration_ms) * 0.18)
    x = F.abs(_col(t_ms) - _col(target_ms)) / sigma
    return F.when(_col(duration_ms) > 0, F.exp(-x * x)).otherwise(F.lit(0.0))
