"""Scalar functions of numbers on built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column | str, digits: int) -> Column:
    """A double rounded by scaling it, as SQL's ``round_even`` and NumPy do: what scaling makes a tie goes to the even digit.

    ``bround`` rounds the shortest decimal instead: 0.028874999999999998 is a tie here, which goes to 0.02888, and none there (0.02887).
    """
    scale = 10.0**digits
    return F.rint((F.col(value) if isinstance(value, str) else value) * scale) / scale
