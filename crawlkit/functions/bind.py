"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Used where ``body`` mentions it several times: Catalyst would paste a costly
    expression, such as a regex over a page, into every branch.
    """
    return F.transform(F.array(value), body)[0]
