"""Pipelines of steps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def run_pipeline(lines: DataFrame, steps: list[Step]) -> DataFrame:
    """Steps applied in order; any DataFrame -> DataFrame function is a step."""
    return reduce(DataFrame.transform, steps, lines)
