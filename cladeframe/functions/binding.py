"""Keep costly expressions from being copied by the optimiser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinned(value: Column) -> Column:
    """``value``, evaluated where it is written and nowhere else.

    Filters on a computed column (also those Spark derives from joins and
    explodes) are pushed below the projection by copying its definition, which
    multiplies with every step of a chain of array expressions. A row number
    that is never negative marks the projection as one that filters stay above.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
