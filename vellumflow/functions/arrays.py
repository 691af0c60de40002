"""Array expressions: what keeps a page's or a document's rows inside one row, so that nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value reckoned once, however often ``made`` uses it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def runs_of(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Arrays of neighbours for which ``same(before, after)`` holds, of an array in order; null for an empty one."""

    def parts(v):
        i, starts = v["i"], v["s"]
        return F.transform(starts, lambda b, k: F.slice(i, b + 1, F.coalesce(F.get(starts, k + 1), F.size(i)) - b))

    def opens(i):
        return F.filter(F.sequence(F.lit(0), F.size(i) - 1), lambda k: (k == 0) | ~same(F.get(i, k - 1), F.get(i, k)))

    return once(items, lambda i: F.when(F.size(i) > 0, once(F.struct(i.alias("i"), opens(i).alias("s")), parts)))
