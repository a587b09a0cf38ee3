"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the cuts fit.

Rows are ordered by a 120-bit key: 60 bits of a hash of the group (equal texts), then 60 bits of a hash of the
row's identity. Each round counts bytes and rows per 12-bit digit below the still open cuts only, so a round
returns at most (cuts x 4096) counts to the driver, whatever the table's size. Most rounds end early; a huge group
of equal texts is opened up by its rows' own hash. One exchange then deals the rows out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionmill.llm.tables import Table

DIGIT = 12
DIGITS_PER_KEY = 5
KEY_BITS = DIGIT * DIGITS_PER_KEY
#: A shard's end may miss its target by this share of a shard while whole groups are kept together.
GROUP_TOLERANCE = 0.03
#: Within a digit, refining stops when a boundary is this near to its target.
EXACT_TOLERANCE = 0.001


@dataclass
class Cut:
    """A shard's lower end: rows with a key of at least ``edge`` lie above it."""

    target: int
    prefix: int = 0
    below: int = 0
    edge: int | None = None


def _key(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def with_keys(df: DataFrame, group: Column, row: Column) -> DataFrame:
    return df.withColumns({"_k1": _key(group), "_k2": _key(row, group)})


def _prefixes(depth: int) -> tuple[Column, Column]:
    """Both halves of the key down to its first ``depth`` digits."""
    first, second = min(depth, DIGITS_PER_KEY), max(0, depth - DIGITS_PER_KEY)
    return (
        F.shiftright("_k1", KEY_BITS - DIGIT * first) if first else F.lit(0).cast("long"),
        F.shiftright("_k2", KEY_BITS - DIGIT * second) if second else F.lit(0).cast("long"),
    )


def _halves(prefix: int, depth: int) -> tuple[int, int]:
    low = DIGIT * max(0, depth - DIGITS_PER_KEY)
    return prefix >> low, prefix & ((1 << low) - 1)


def _histogram(keys: DataFrame, prefixes: set[int], depth: int) -> dict[int, tuple[int, int]]:
    """Bytes and rows by prefix of ``depth`` + 1 digits, below the given prefixes of ``depth`` digits."""
    if depth:
        a, b = _prefixes(depth)
        keys = keys.filter(reduce(Column.__or__, ((a == x) & (b == y) for x, y in (_halves(p, depth) for p in sorted(prefixes)))))
    a, b = _prefixes(depth + 1)
    low = DIGIT * max(0, depth + 1 - DIGITS_PER_KEY)
    rows = keys.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).collect()
    return {(r["a"] << low) + r["b"]: (r["bytes"], r["n"]) for r in rows}


def splitters(keys: DataFrame, shards: int) -> list[int]:
    """The lower ends of shards 1 and up as 120-bit keys."""
    depths = 2 * DIGITS_PER_KEY
    counts = _histogram(keys, set(), 0)
    total = sum(b for b, _ in counts.values())
    cuts = [Cut(total * i // shards) for i in range(1, shards)]
    near, group_near = total / shards * EXACT_TOLERANCE, total / shards * GROUP_TOLERANCE
    for depth in range(depths):
        waiting = [c for c in cuts if c.edge is None]
        if not waiting:
            break
        if depth:
            counts = _histogram(keys, {c.prefix for c in waiting}, depth)
        shift = DIGIT * (depths - depth - 1)
        bins = sorted(counts)
        for cut in waiting:
            below = cut.below
            for p in (p for p in bins if depth == 0 or p >> DIGIT == cut.prefix):
                size, rows = counts[p]
                if below + size >= cut.target:
                    break
                below += size
            else:  # an empty table, or nothing but ties
                cut.edge = 0
                continue
            left, right = cut.target - below, below + size - cut.target
            whole_groups = depth + 1 >= DIGITS_PER_KEY
            if rows == 1 or depth == depths - 1 or min(left, right) <= (group_near if whole_groups else near):
                cut.edge = (p if left <= right else p + 1) << shift
            else:
                cut.prefix, cut.below = p, below
    return sorted(c.edge for c in cuts)


def histogram_shards(
    df: DataFrame,
    group: Column,
    row: Column,
    size: Column,
    shards: int,
    rows_per_bucket: int = 2000,
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1, near equal sums of ``size``) and ``slot`` (gapless from 0 in it).

    Rows of one ``group`` stay in one shard while that keeps each shard's end within three hundredths of a shard of
    its target; a larger group is cut by row. ``row`` tells rows of a group apart; rows equal in both may lie on
    either side of no cut, so repeats of one row stay together. A null group or row is a value like any other. An
    empty table gives no rows. Columns of ``df`` named shard or slot are replaced; those that start with an
    underscore must not be _k1, _k2, _size, _bucket.
    """
    keyed = with_keys(df, group, row)
    keys = Table(keyed.select("_k1", "_k2", size.cast("long").alias("_size")))
    edges = [(e >> KEY_BITS, e & ((1 << KEY_BITS) - 1)) for e in splitters(keys.df, shards)]
    count = keys.df.count()
    keys.drop()
    lower_ends = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in edges))
    key = F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b"))
    shard = F.size(F.filter(lower_ends, lambda end: end <= key)) if edges else F.lit(0)
    bits = max(0, (count // shards // rows_per_bucket)).bit_length()
    dealt = keyed.drop("shard", "slot").withColumns(
        {"shard": shard, "_bucket": F.shiftright("_k2", KEY_BITS - bits) if bits else F.lit(0).cast("long")}
    )
    # The bucket comes from the row's own hash, so a shard full of one text is numbered by many tasks.
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_k2", "_k1"))
    return (
        dealt.withColumn("_place", place)
        .join(starts, ["shard", "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_place") - 1)
        .drop("_k1", "_k2", "_bucket", "_place", "_start")
    )
