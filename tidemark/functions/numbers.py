"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    """Thousandths, halves upwards, also where a half is off by binary noise; so every engine agrees."""
    return F.floor(x * 1000 + 0.500001) / F.lit(1000.0)
