"""Point bands: ordered thresholds with the points they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-9


def _chain(tests: list[tuple[Column, float]], default: float) -> Column:
    out = F.when(tests[0][0], F.lit(tests[0][1]))
    for test, points in tests[1:]:
        out = out.when(test, F.lit(points))
    return out.otherwise(F.lit(default))


def up_to(value: Column, bands: Sequence[tuple[float, float]], default: float = 0.0) -> Column:
    """Points of the first threshold that the value doesn't exceed."""
    return _chain([(value <= t + SLACK, float(p)) for t, p in bands], float(default))


def below(value: Column, bands: Sequence[tuple[float, float]], default: float) -> Column:
    """Points of the first threshold that the value is under."""
    return _chain([(value < t - SLACK, float(p)) for t, p in bands], float(default))


def points_of(value: Column, table: dict[str, float], default: float = 0.0) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(float(default)))
