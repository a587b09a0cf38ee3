"""Quality rules: per-document counts and cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space between words made one space) and hashed to 128 bits. For every
host the documents that hold a line are counted, copies of one text once; lines in too many of them are
boilerplate. A document that loses nearly all its words with those lines is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionmill.functions.folds import bound
from mentionmill.llm.arrays import LOWER, SPACED, covered, mix, run_hashes, span_hashes, text_slices, word_spans
from mentionmill.llm.tables import Table

#: A line may stand in so many documents of a host, whatever its size, and in a host with few documents in no more than
#: half of them, from so many on.
LINE_DOCUMENTS = 50
LEAST_DOCUMENTS = 5
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
LEAST_WORDS = 50

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Counts by row, and the rows' lines that hold a word: hashes, words, bounds by row."""
    starts, ends, first = word_spans(data, offsets, SPACED)
    rows = len(offsets) - 1
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = {"n_words": np.diff(first), "word_chars": _sums(lead[ends] - lead[starts], first), "n_symbols": _sums(_SYMBOL[data], offsets)}
    # Three-word windows that occur twice in one text.
    words = span_hashes(data, starts, ends)
    three = run_hashes(words, 3)
    at = np.flatnonzero(row_of_word[: len(three)] == row_of_word[2:]) if len(three) else np.zeros(0, dtype=np.int64)
    twice = at[_repeated(three[at] ^ mix(row_of_word[at].astype(np.uint64)))]
    out["n_repeat_words"] = _sums(covered(len(words), twice, twice + 3).astype(np.int64), first)
    # Lines: bounded by the rows' ends and by \n.
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_row = np.searchsorted(offsets[1:], line_starts, side="right")
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = line_ends - ((line_ends > line_starts) & np.isin(line_ends - 1, breaks))
    bounds = np.append(np.searchsorted(starts, line_starts), len(starts))
    with_word = np.diff(bounds) > 0
    line_words = np.diff(bounds)[with_word]
    own, own_row = np.flatnonzero(with_word), line_row[with_word]
    exact = span_hashes(data, line_starts[own], line_ends[own]) ^ mix(own_row.astype(np.uint64))
    order = np.argsort(exact, kind="stable")
    again = np.zeros(len(own), dtype=np.int64)
    again[order[1:]] = exact[order[1:]] == exact[order[:-1]]
    by_row = np.searchsorted(own_row, np.arange(rows + 1))
    out["n_dup_lines"] = _sums(again, by_row)
    lower = LOWER[data]
    place = (np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64) * _ODD
    lines = {"words": line_words, "rows": by_row}
    edges = np.append(bounds[:-1][own], len(starts))
    for name, seed in (("h1", 1), ("h2", 2)):
        lines[name] = mix(_sums(mix(span_hashes(lower, starts, ends, seed) + place), edges)).view(np.int64)
    return out, lines


_MEASURES = ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<struct<h1:bigint,h2:bigint,words:bigint>>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int64())])
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(0)):
            counts, lines = _measure(data, offsets)
            values = pa.StructArray.from_arrays([pa.array(lines[c], pa.int64()) for c in ("h1", "h2", "words")], fields=list(kind))
            listed = pa.ListArray.from_arrays(pa.array(lines["rows"], pa.int32()), values)
            kept = [batch.column(i).slice(row, len(offsets) - 1) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(counts[c], pa.int64()) for c in _COUNTS), listed, *kept],
                names=[*_COUNTS, "lines", *batch.schema.names[1:]],
            )


def line_rules(df: DataFrame, text: str, host: str, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep`` with the counts of each text, n_frequent_words, base_failed, depleted and kept.

    With ``with_text`` there is also clean_text: the text without its frequent lines. A null text counts as empty
    and fails the base rules; rows with a null host are one host; repeated rows are judged one by one, but count as
    one document of their host. An empty table gives no rows. ``keep`` may hold any columns but those added here.
    """
    wanted = dict.fromkeys([*keep, *([text] if with_text else [])])
    source = df.select(
        F.col(text).alias("_text"),
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(wanted)),
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_host"),
        F.xxhash64(F.col(text)).alias("_t1"),
        F.xxhash64(F.lit(1), F.col(text)).alias("_t2"),
    )
    fields = ", ".join(f"{n} {t}" for n, t in source.dtypes[1:])
    measured = source.mapInArrow(_measured, f"{_MEASURES}, {fields}").withColumn("_row", F.monotonically_increasing_id())
    docs = Table(measured).df
    lines = docs.select("_row", "_host", "_t1", "_t2", F.posexplode("lines").alias("_at", "_line"))
    lines = lines.select("_row", "_host", "_t1", "_t2", "_at", "_line.*")
    per_host = docs.select("_host", "_t1", "_t2").distinct().groupBy("_host").agg(F.count("*").alias("_texts"))
    over = (F.col("_n") > LINE_DOCUMENTS) | (2 * F.col("_n") > F.col("_texts"))
    frequent = (
        lines.select("_host", "h1", "h2", "_t1", "_t2").distinct()
        .groupBy("_host", "h1", "h2").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= LEAST_DOCUMENTS)
        .join(per_host, "_host")
        .filter(over)
        .select("_host", "h1", "h2")
    )
    lost = (
        lines.join(frequent, ["_host", "h1", "h2"], "left_semi")
        .groupBy("_row").agg(F.sum("words").alias("_lost"), F.collect_set("_at").alias("_lost_lines"))
    )
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_frequent_words")
    out = (
        docs.join(lost, "_row", "left")
        .withColumns({"n_frequent_words": F.coalesce("_lost", F.lit(0)), "base_failed": base_failed})
        .withColumn("depleted", left < LEAST_LEFT * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
    names = list(wanted)
    columns = [F.col(f"_k{names.index(c)}").alias(c) for c in keep]
    columns += [*_COUNTS, "n_frequent_words", "base_failed", "depleted", "kept"]
    if with_text:
        columns.append(_without_lines(F.col(f"_k{names.index(text)}"), F.col("_lost_lines")).alias("clean_text"))
    return out.select(*columns)


def _without_lines(text, lost):
    """The text without the lines of these numbers among its lines that hold a word."""

    def left(lines):
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        with_word = F.filter(places, lambda i: F.get(lines, i).rlike("[^\\x20\\x09-\\x0D]"))
        gone = bound(with_word, lambda at: F.transform(lost, lambda n: F.get(at, n)))
        return F.array_join(F.transform(F.array_except(places, gone), lambda i: F.get(lines, i)), "\n")

    return F.when(lost.isNull(), text).otherwise(bound(F.split(text, "\n"), left))
