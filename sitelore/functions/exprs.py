"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``.

    Catalyst substitutes column aliases into every reference when it collapses projections or
    pushes filters, so an expensive value referenced N times is evaluated N times. Binding it
    to a lambda variable of a one-element ``transform`` keeps a single evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
