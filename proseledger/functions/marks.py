"""Column functions for classes and chips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CLASSES


def chip(score: Column) -> Column:
    """A score as the short text of a chip: .00 to .99, then 1.0."""
    hundredths = F.floor(score * 100 + 0.5)
    return F.when(hundredths >= 100, "1.0").otherwise(F.concat(F.lit("."), F.lpad(hundredths.cast("string"), 2, "0")))


def class_by_score(score: Column, cuts: tuple[float, float, float] = (0.25, 0.5, 0.75)) -> Column:
    """0 to 3: how many cuts the score reaches."""
    return sum(((score >= c).cast("int") for c in cuts[1:]), (score >= cuts[0]).cast("int"))


def class_by_breakdown(breakdown: Column) -> Column:
    """0 to 3: the class with the largest part; of equal ones the lower class."""
    parts = [breakdown[k] for k in ("human", "light", "heavy", "ai")]
    most = F.greatest(*parts)
    out = F.lit(3)
    for k in (2, 1, 0):
        out = F.when(parts[k] == most, k).otherwise(out)
    return out


def class_name(klass: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), klass + 1)
