"""Health scores as column expressions. Column arguments, column results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# fixed values: weights and caps of the published formula
def health(cyc: Column, cog: Column, mi: Column) -> Column:
    raw = F.lit(0.3) * (100.0 - clamp(cyc / 30.0 * 100.0)) + F.lit(0.3) * (100.0 - clamp(cog / 50.0 * 100.0)) + F.lit(0.4) * clamp(mi)
    return F.round(clamp(raw)).cast("int")
