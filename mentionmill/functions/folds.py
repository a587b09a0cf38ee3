"""Folds over long arrays inside a row.

A fold copies its whole state at every step, so one that gathers its result in the state takes time with the square
of the array. ``scan`` cuts the array into blocks. A first pass carries the bare state to the start of each block; a
second one goes through each block from its start and gathers what it finds there, which is never more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What the states after each item have in their field ``found``, in order, without nulls; ``kind`` is its type.

    ``step(state, item)`` gives the next state, of the type of ``start``.
    """

    def kept(state: Column) -> Column:
        found = state["now"]["found"]
        return F.when(found.isNotNull(), F.concat(state["out"], F.array(found))).otherwise(state["out"])

    def through(block: Column, first: Column) -> Column:
        # what an item gave is gathered one step later, so that the step is computed once
        begin = F.struct(first.withField("found", F.lit(None).cast(kind)).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, begin, lambda s, x: F.struct(step(s["now"], x).alias("now"), kept(s).alias("out")), kept)

    def all_blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def passes(blocks: Column) -> Column:
        starts = F.aggregate(
            F.slice(blocks, F.lit(1), F.size(blocks) - 1),
            F.array(start),
            lambda known, block: F.concat(known, F.array(F.aggregate(block, F.element_at(known, -1), step))),
        )
        return F.flatten(F.zip_with(blocks, starts, through))

    return bound(items, lambda xs: bound(all_blocks(xs), passes))
