"""Column functions over scores and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The criteria with their weights and pass marks, and how far a judge moves each baseline.
CRITERIA = ("content_fidelity", "translation_accuracy", "av_subtitle_sync", "narrative_coherence", "technical_quality", "safety_compliance")
WEIGHTS = (25.0, 15.0, 20.0, 15.0, 15.0, 10.0)
PASS_MARKS = (75.0, 70.0, 75.0, 70.0, 70.0, 80.0)
INFLUENCE = {"review": (0.65, 0.75, 0.20, 0.65, 0.25, 1.0), "dubbing": (0.75, 0.85, 0.15, 0.65, 0.20, 1.0)}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: str | Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(c)))


def micro(c: str | Column) -> Column:
    """A score as whole millionths, for comparison across engines."""
    return F.floor(_col(c) * 1000000 + 0.5).cast("long")


def by_criterion(key: str | Column, values: tuple[float, ...]) -> Column:
    """The value of a criterion, as an expression over its key."""
    out = F.lit(None).cast("double")
    for name, v in zip(CRITERIA, values):
        out = F.when(_col(key) == name, F.lit(v)).otherwise(out)
    return out


def to_number(c: str | Column) -> Column:
    """First number inside a text, with a decimal comma allowed; null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(_col(c), "-?[0-9]+(?:[.,][0-9]+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def to_confidence(c: str | Column) -> Column:
    """A share in 0..1; values over 1 are percent; missing is 0."""
    n = F.coalesce(to_number(c), F.lit(0.0))
    return clamp(F.when(n > 1, n / 100).otherwise(n), 0.0, 1.0)


def to_bool(c: str | Column) -> Column:
    return F.lower(F.trim(_col(c))).isin("true", "1", "yes")


def duration_adherence(actual_s: str | Column, minutes: str | Column) -> tuple[Column, Column]:
    """Score and verdict of a measured duration against wanted minutes (1..30): within 10 percent passes."""
    target = F.greatest(F.lit(1), F.least(F.lit(30), _col(minutes))) * 60.0
    error = F.abs(_col(actual_s) - target) / target
    bad = F.coalesce(_col(actual_s) <= 0, F.lit(True))
    return F.when(bad, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), 100 - error * 250), 2)), F.when(bad, False).otherwise(error <= 0.10)


def tempo_factor(actual_s: str | Column, minutes: str | Column) -> Column:
    """Measured over wanted duration where a tempo change of 0.90..1.15 repairs it; else null."""
    factor = _col(actual_s) / (F.greatest(F.lit(1), F.least(F.lit(30), _col(minutes))) * 60.0)
    return F.when((_col(actual_s) > 0) & factor.between(0.90, 1.15), F.bround(factor, 6))


def drift_score(a_s: str | Column, b_s: str | Column, free: float, slope: float, missing: float) -> Column:
    """100 less ``slope`` a second beyond ``free`` seconds of difference; ``missing`` unless both are positive."""
    gap = F.abs(_col(a_s) - _col(b_s))
    return F.when((_col(a_s) > 0) & (_col(b_s) > 0), clamp(100 - F.greatest(F.lit(0.0), gap - free) * slope)).otherwise(F.lit(missing))


def fingerprint(*cols: str) -> Column:
    """SHA-256 of the canonical JSON of some columns, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
