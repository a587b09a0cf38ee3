"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are sets of word shingles with positions. A window lies in a document only if all its shingles
do, so its rarest one is prefix enough. One scan of the corpus finds the places of shingles that some window has
(by a bitmap of fixed size; what it lets through wrongly falls out in the join) together with the words around
them. The rarity of each shingle is counted from these places, each window is joined by its rarest shingle, bounded
by position and length, and verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionmill.llm.arrays import LETTERED, LOWER, ranges, run_hashes, span_hashes, text_slices, word_spans
from mentionmill.llm.tables import Table

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Bits of the bitmap that is sent to all tasks: 1 MB, whatever the benchmark's size.
BITMAP_BITS = 23
#: Bytes of text scanned at once: the words around each place take many times the room of the text.
SLICE = 500_000

_WINDOW = "item string, words array<string>, shingles array<bigint>"


def _shingles(words: np.ndarray, length: int) -> np.ndarray:
    return run_hashes(words, length, seed=length).view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every item with its words and shingles."""
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1)):
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, LETTERED)
            hashes, raw = span_hashes(data, starts, ends), data.tobytes()
            names = batch.column(0).slice(row, len(offsets) - 1).to_pylist()
            items, texts, shingles = [], [], []
            for i, item in enumerate(names):
                lo, hi = int(first[i]), int(first[i + 1])
                words = [raw[s:e].decode("utf-8") for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                size = min(WINDOW_WORDS, hi - lo)
                own = _shingles(hashes[lo:hi], min(SHINGLE_WORDS, size)) if size else []
                for at in range(hi - lo - size + 1 if size else 0):
                    items.append(item)
                    texts.append(words[at : at + size])
                    shingles.append(own[at : at + max(1, size - SHINGLE_WORDS + 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(shingles, pa.list_(pa.int64()))],
                names=["item", "words", "shingles"],
            )


def bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit per hash of the column ``h``, as numbers of 64 bits; gathered as at most 2^17 of them."""
    slot = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bit = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
    rows = hashes.select(F.shiftright(slot, 6).alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for r in rows:
        out[r["i"]] = r["b"]
    return out.view(np.uint64)


def _met(known: np.ndarray, hashes: np.ndarray, lengths: list[int], first: np.ndarray, last: np.ndarray):
    """Places whose shingle is in the bitmap, by document: their word, document and shingle."""
    mask, parts = np.uint64((1 << BITMAP_BITS) - 1), []
    for length in lengths:
        found = _shingles(hashes, length).view(np.uint64)
        slot = found & mask
        at = np.flatnonzero((known[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
        at = at[at + length <= last[at]]
        parts.append((at, found[at]))
    at = np.concatenate([p[0] for p in parts] or [np.zeros(0, dtype=np.int64)])
    grams = np.concatenate([p[1] for p in parts] or [np.zeros(0, dtype=np.uint64)])
    order = np.argsort(at, kind="stable")
    at = at[order]
    return at, np.searchsorted(first, at, side="right") - 1, grams[order]


_PLACE = "struct<at:bigint,h:bigint,start:bigint,words:array<string>>"


def _scan(lengths: list[int], bits):
    """Counts words and finds the places of shingles in the bitmap, with the words around each."""
    kind = pa.struct([("at", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(0), SLICE):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, LETTERED)
                hashes, raw = span_hashes(data, starts, ends), data.tobytes()
                last = np.repeat(first[1:], np.diff(first))  # the end of each word's document
                at, doc, grams = _met(known, hashes, lengths, first, last)
                base = first[doc]
                lo = np.maximum(base, at - WINDOW_WORDS + 1)
                count = np.minimum(first[doc + 1], at + WINDOW_WORDS) - lo
                around = ranges(lo, count)
                words = pa.array([raw[s:e] for s, e in zip(starts[around], ends[around], strict=True)], pa.binary())
                places = pa.StructArray.from_arrays(
                    [
                        pa.array(at - base),
                        pa.array(grams.view(np.int64)),
                        pa.array(lo - base),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), words.cast(pa.string())),
                    ],
                    fields=list(kind),
                )
                bounds = np.searchsorted(doc, np.arange(len(offsets)))
                kept = [batch.column(c).slice(row, len(offsets) - 1) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), places), *kept],
                    names=["n_words", "places", *batch.schema.names[1:]],
                )

    return scan


def contamination(df: DataFrame, text: str, keep: list[str], items: DataFrame, item: str, item_text: str) -> DataFrame:
    """The columns ``keep`` with n_words, n_hit, items (sorted ids as strings) and spans (start, end of hit words).

    A null or empty text, of a document or an item, has no words. An item with a null id has the id ``null``;
    items that share an id are one. Repeated rows of ``df`` are judged one by one; either table may be empty.
    """
    named = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("t"))
    windows = Table(named.mapInArrow(_windows, _WINDOW)).df
    shingles = windows.select(F.explode("shingles").alias("h")).distinct()
    sizes = windows.select(F.least(F.size("words"), F.lit(SHINGLE_WORDS)).alias("n")).distinct()
    lengths = sorted(r["n"] for r in sizes.collect())  # at most five
    spark = df.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(shingles))
    source = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    fields = ", ".join(["n_words bigint", f"places array<{_PLACE}>", *(f"{n} {t}" for n, t in source.dtypes[1:])])
    docs = Table(source.mapInArrow(_scan(lengths, bits), fields).withColumn("_row", F.monotonically_increasing_id())).df
    places = docs.select("_row", F.explode("places").alias("p")).select("_row", "p.*")
    rarity = places.groupBy("h").agg(F.count("*").alias("n"))
    # The rarest shingle of each distinct window; a window with a shingle that occurs nowhere cannot occur.
    distinct = windows.select("words", "shingles").distinct()
    ranked = (
        distinct.select("words", F.size("shingles").alias("_all"), F.posexplode("shingles").alias("offset", "h"))
        .join(rarity, "h")
        .groupBy("words").agg(F.min(F.struct("n", "h", "offset")).alias("least"), F.count("*").alias("_met"), F.first("_all").alias("_all"))
        .filter("_met = _all")
        .select("words", "least.h", "least.offset")
    )
    begin = F.col("at") - F.col("offset")
    near = places.withColumnRenamed("words", "around").join(ranked, "h").withColumn("begin", begin)
    from_around = F.col("begin") - F.col("start")
    found = near.filter(
        (F.col("begin") >= F.col("start"))
        & (from_around + F.size("words") <= F.size("around"))
        & (F.slice("around", F.greatest(from_around, F.lit(0)).cast("int") + 1, F.size("words")) == F.col("words"))
    ).select("_row", "words", "begin", (F.col("begin") + F.size("words")).alias("end"))
    found = Table(found.distinct()).df
    held = (
        found.select("_row", "words").distinct()
        .join(windows.select("words", "item").distinct(), "words")
        .groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    before = Window.partitionBy("_row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        found.select("_row", "begin", "end").distinct()
        .withColumn("_reach", F.greatest(F.coalesce(F.max("end").over(before), F.lit(0)), F.col("begin")))
        .groupBy("_row")
        .agg(
            F.sum(F.greatest(F.col("end") - F.col("_reach"), F.lit(0))).alias("n_hit"),
            F.array_sort(F.collect_list(F.struct(F.col("begin").alias("start"), "end"))).alias("spans"),
        )
    )
    out = docs.drop("places").join(spans, "_row", "left").join(held, "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        "spans",
    )
