"""Expressions over arrays whose work grows with the length of the array only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are added up in one go.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it.

    Blocks are added up, and blocks of blocks, so that an element adds fewer than
    ``3 * BLOCK`` numbers up to ``BLOCK ** 3`` elements.
    """

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK).cast("int"), F.lit(0)))
        return F.transform(starts, lambda b: added(v, b * BLOCK, F.lit(BLOCK)))

    def added(v: Column, start: Column, count: Column) -> Column:
        return F.aggregate(F.slice(v, start + 1, count), F.lit(0), lambda n, x: n + x)

    def inside(v: Column, above: Column) -> Column:
        return F.transform(v, lambda _, i: F.get(above, F.floor(i / BLOCK).cast("int")) + added(v, i - i % BLOCK, i % BLOCK))

    def placed(one: Column, two: Column) -> Column:
        return let(F.transform(two, lambda _, i: added(two, F.lit(0), i)), lambda top: let(inside(one, top), lambda middle: inside(values, middle)))

    return let(blocks(values), lambda one: let(blocks(one), lambda two: placed(one, two)))
