"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    A lambda of a higher-order function evaluates what it mentions anew for each
    element, so anything costly that it needs is bound to a variable first.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]
