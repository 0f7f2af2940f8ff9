"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    An expression that refers to a sub-expression several times (or from
    inside a higher-order function's lambda) evaluates it each time; when
    Catalyst substitutes aliases into one expression (e.g. a filter pushed
    towards the scan) that repeats at every level. Binding the value as the
    single element of an array keeps it to one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
