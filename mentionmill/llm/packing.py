"""Packing documents into fixed windows by minimum bin slack.

Every document is cut into full windows and one rest. How the rests share windows is planned on the histogram of
their lengths alone (fewer entries than a window has tokens, whatever the corpus): a bitset subset-sum programme
picks, beside the longest rest left, the multiset of lengths that fills the window closest to capacity; its
counts are backtracked, and the pattern is used as often as the histogram allows. Rests then look up their place by
length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionmill.llm.tables import Table
from mentionmill.llm.tokens import encoder

PIECES_PER_BUCKET = 2000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths and their numbers, within ``counts``, whose sum comes closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            n = min(part, left)
            steps.append((length, n, reached))
            reached |= (reached << (length * n)) & mask
            left -= n
            part *= 2
        if reached >> room:
            break
    best, chosen = reached.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + n
            best -= length * n
    return chosen


@dataclass(frozen=True)
class Place:
    """Where the rests of one length with ranks ``first`` up to ``first + need * copies`` go in one pattern."""

    length: int
    first: int
    need: int
    copies: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], window: int) -> list[Place]:
    """Patterns for all of ``counts``; each use empties a length or leaves it less than the pattern needs."""
    left = {k: v for k, v in counts.items() if v}
    taken = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items()}
        pattern = fill({k: v for k, v in rest.items() if v}, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        copies = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            need = pattern[length]
            out.append(Place(length, taken[length], need, copies, sequence, offset))
            offset += length * need
            taken[length] += need * copies
            left[length] -= need * copies
            if not left[length]:
                del left[length]
        sequence += copies
    return out


def cut_pieces(df: DataFrame, doc: str, text: str, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, ids if asked for): each document's full windows and its rest."""
    doc_field = df.schema[doc]
    extra = ", ids array<int>" if with_ids else ""
    schema = f"`{doc}` {doc_field.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long{extra}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                found = np.append(encode(value.as_py()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(found), window):
                    piece = found[start : start + window]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(found))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            names = [doc, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(doc), F.col(text)).mapInArrow(cut, schema)


def pack(
    df: DataFrame, doc: str, text: str, path: str, window: int = 1024, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece with its sequence and its offset there, gapless from 0; with the ids themselves if asked for.

    A null or empty text is its end id alone. Rows are packed one by one, repeats and null ids too. Only columns
    ``doc`` and ``text`` are read. An empty table gives no rows.
    """
    pieces = Table(cut_pieces(df, doc, text, path, window, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = [(x.length, x.first, x.need, x.copies, x.sequence, x.offset) for x in plan(histogram, window)]
    # At most 45 different lengths share a window of 1024 and each pattern uses up a length, so this stays small.
    # From Arrow, as rows would be read by Python workers of another kind, which stay beside those of the operators.
    columns = ["_l", "_first", "_need", "_copies", "_sequence", "_offset"]
    numbers = np.array(places, dtype=np.int64).reshape(-1, len(columns))
    planned = df.sparkSession.createDataFrame(pa.table([pa.array(x) for x in numbers.T], names=columns))
    buckets = max(1, max(histogram.values(), default=0) // PIECES_PER_BUCKET)
    dealt = pieces.df.withColumn("_bucket", F.pmod(F.xxhash64(doc, "start", "ids_crc32"), F.lit(buckets)))
    # Ranks are counted per bucket of a length and shifted, so that a length with a third of all rows is no one task.
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    order = Window.partitionBy("length", "_bucket").orderBy(doc, "start", "ids_crc32")
    ranked = (
        dealt.withColumn("_place", F.row_number().over(order))
        .join(shifts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_shift") + F.col("_place") - 1)
    )
    met = ranked.join(
        F.broadcast(planned),
        (F.col("length") == F.col("_l"))
        & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_first") + F.col("_need") * F.col("_copies")),
    )
    within = F.col("_rank") - F.col("_first")
    return met.select(
        *pieces.df.columns,
        (F.col("_sequence") + F.pmod(within, F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + F.floor(within / F.col("_copies")).cast("long") * F.col("length")).alias("offset"),
    )
