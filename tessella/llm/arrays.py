"""Array expressions whose cost stays linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a block of running sums.
RUN = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each value the associative ``add`` of all before it.  By blocks, since an array
    that grows by one is copied each time."""

    def grown(own: Column, first: Column) -> Column:
        return F.aggregate(own, F.array(first), lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), x))))

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda own: F.aggregate(own, zero, add))
        return bound(grown(totals, zero), lambda firsts: F.flatten(F.transform(blocks, lambda own, k: F.slice(grown(own, F.get(firsts, k)), F.lit(1), F.size(own)))))

    def cut(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), lambda k: F.slice(own, k * RUN + 1, F.lit(RUN)))

    return bound(values, lambda own: F.when(F.size(own) == 0, own).otherwise(bound(cut(own), by_blocks)))
