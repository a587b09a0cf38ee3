"""Finding every place covered by a repeated window, without pairing documents with each other.

Common ground of the two substring operators. From each window of fixed length a position inside it is chosen by
the window's content (the least k-gram hash), so equal windows choose the same place: their anchor. Neighbouring
windows mostly share an anchor, and an anchor with the stretch of text its windows reach over is one row:

    doc, fp      the document (its id and a hash of its text, so that repeated and null ids do not meet)
    start, more  the first window of the anchor, and how many follow it
    seed, reach  hash of the anchor's k-gram; hash of the whole stretch and the anchor's place in it

Anchors whose seed is unique repeat nowhere. Of the others, those with an equal stretch are a class: all windows of
a class with two members repeat. Only where one seed has several classes are single windows compared, one member
for each class. So a group of n copies costs n rows at every step, never n squared. A task compares its windows
first; what repeats there is found, and one window of each kind goes on, packed by buckets of window hashes, however
often one occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionmill.llm.arrays import (
    SPACED,
    chunks8,
    least_positions,
    mix,
    ranges,
    run_hashes,
    span_hashes,
    text_slices,
    word_spans,
)
from mentionmill.llm.tables import Table


@dataclass(frozen=True)
class Alphabet:
    """What a place is (a word or a byte), the window's length and the k-gram's, in places."""

    kind: str
    window: int
    gram: int

    @property
    def slice_bytes(self) -> int:
        return 400_000 if self.kind == "byte" else 2_000_000

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """A number for each place, the rows' bounds in places, and how many places a number speaks for."""
        if self.kind == "byte":
            return chunks8(data), offsets, 8
        starts, ends, first = word_spans(data, offsets, SPACED)
        return span_hashes(data, starts, ends), first, 1

    def cut(
        self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where the places ``start`` to ``end`` of rows lie in bytes."""
        if self.kind == "byte":
            return offsets[row] + start, offsets[row] + end
        starts, ends, first = word_spans(data, offsets, SPACED)
        return starts[first[row] + start], ends[first[row] + end - 1]


WORDS_35 = Alphabet("word", 35, 8)
BYTES_200 = Alphabet("byte", 200, 64)

#: Windows that a task compares at once, and windows to a bucket on average.
WINDOWS_AT_ONCE = 500_000
BUCKET_WINDOWS = 500_000

_ODD = np.uint64(0xD6E8FEB86659FD93)


def identified(df: DataFrame, doc: str, text: str, *others: str) -> DataFrame:
    """doc, fp and text, the key and the body of every step here."""
    return df.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("fp"), *others, F.col(text).alias("text"))


def anchors(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """One row per anchor of ``docs`` (doc, fp, further columns, text last)."""
    heads = docs.columns[:-1]
    kinds = dict(docs.dtypes)
    length, gram = alphabet.window, alphabet.gram

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(len(heads)), alphabet.slice_bytes):
                symbols, bounds, unit = alphabet.symbols(data, offsets)
                seeds = run_hashes(symbols, gram, 1, unit)
                whole = run_hashes(symbols, length, 2, unit)
                per_row = np.maximum(np.diff(bounds) - length + 1, 0)
                windows = ranges(bounds[:-1], per_row)
                if not len(windows):
                    continue
                chosen = least_positions(seeds, length - gram + 1)[windows]
                first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
                last = np.append(first[1:], len(chosen)) - 1
                start, end, at = windows[first], windows[last], chosen[first]
                place = ((end - start) * length + at - start).astype(np.uint64)
                reach = mix(whole[start] * _ODD + whole[end]) ^ mix(place + _ODD)
                owner = np.searchsorted(bounds, start, side="right") - 1
                columns = [batch.column(i).take(pa.array(owner + row)) for i in range(len(heads))]
                columns += [
                    pa.array((start - bounds[owner]).astype(np.int64)),
                    pa.array((end - start).astype(np.int16)),
                    pa.array(seeds[at].view(np.int64)),
                    pa.array(reach.view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*heads, "start", "more", "seed", "reach"])

    fields = ", ".join(f"`{h}` {kinds[h]}" for h in heads)
    return docs.mapInArrow(scan, f"{fields}, start bigint, more smallint, seed bigint, reach bigint")


def _stretches(alphabet: Alphabet):
    """Rows (doc, fp, start, seed, body) from (doc, fp, stretches, text): the stretches with their own part of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for row, data, offsets in text_slices(batch.column(3), alphabet.slice_bytes):
                part = lists.slice(row, len(offsets) - 1)
                owner = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = part.flatten()
                start, more, seed = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "more", "seed"))
                begin, end = alphabet.cut(data, offsets, owner, start, start + more + alphabet.window)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner + row)),
                        batch.column(1).take(pa.array(owner + row)),
                        *(pa.array(x) for x in (start, seed)),
                        pa.array([raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc", "fp", "start", "seed", "body"],
                )

    return scan


def _windows_of(bodies: pa.Array, alphabet: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of stretches: the stretch of each window, its place there and its hash."""
    for row, data, offsets in text_slices(bodies, alphabet.slice_bytes):
        symbols, bounds, unit = alphabet.symbols(data, offsets)
        hashes = run_hashes(symbols, alphabet.window, 3, unit)
        count = np.maximum(np.diff(bounds) - alphabet.window + 1, 0)
        at = ranges(bounds[:-1], count)
        owner = np.repeat(np.arange(len(count)), count)
        yield owner + row, at - bounds[owner], hashes[at]


def _twice(seed: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur more than once, and which are the first of their kind."""
    order = np.lexsort((window, seed))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (window[order[1:]] == window[order[:-1]]) & (seed[order[1:]] == seed[order[:-1]])
    twice, first = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    twice[order[again]] = True
    twice[order[np.flatnonzero(again) - 1]] = True
    first[order[~again]] = True
    return twice, first


_PACKED = ("doc", "fp", "start", "end", "seed", "window")
_SPAN = _PACKED[:4]


def _packed(alphabet: Alphabet, buckets: int):
    """Rows of lists: windows that repeat inside the task as spans, which have no seed and window and are done, and one
    window of each kind, which has no end, in the bucket of its hash."""

    def lists(bucket: int, columns: list[pa.Array]) -> pa.RecordBatch:
        values = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *values], names=["bucket", *_PACKED])

    def compared(parts: list[list]) -> Iterator[pa.RecordBatch]:
        doc, fp = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
        start, seed, window, stretch = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4, 5))
        twice, first = _twice(seed, window)
        # neighbouring windows of a stretch make one span
        own = np.flatnonzero(twice)
        new = np.append(True, (stretch[own[1:]] != stretch[own[:-1]]) | (start[own[1:]] != start[own[:-1]] + 1))[: len(own)]
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(own))[: len(begin)] - 1
        none = np.zeros(0, dtype=np.int64)

        def columns(own: np.ndarray, *numbers: np.ndarray) -> list[pa.Array]:
            index = pa.array(own)
            return [doc.take(index), fp.take(index), *(pa.array(x.view(np.int64)) for x in (start[own], *numbers))]

        if len(own):
            yield lists(int(window[own[0]] % np.uint64(buckets)), columns(own[begin], start[own[last]] + alphabet.window, none, none))
        for bucket, own in _by_value(np.where(first, (window % np.uint64(buckets)).astype(np.int64), -1)):
            yield lists(bucket, columns(own, none, seed[own], window[own]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, stretches = [], 0, 0
        for batch in batches:
            start, seed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for owner, place, window in _windows_of(batch.column(4), alphabet):
                index = pa.array(owner)
                parts.append(
                    [batch.column(0).take(index), batch.column(1).take(index), start[owner] + place, seed[owner], window, owner + stretches]
                )
                held += len(owner)
                if held >= WINDOWS_AT_ONCE:
                    yield from compared(parts)
                    parts, held = [], 0
            stretches += batch.num_rows
        if held:
            yield from compared(parts)

    return scan


def _by_value(goal: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value of ``goal`` from 0 on, in the order of the values."""
    order = np.argsort(goal, kind="stable")
    values, first = np.unique(goal[order], return_index=True)
    for value, own in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        if value >= 0:
            yield value, own


def _met_in_bucket(alphabet: Alphabet):
    """The spans of a bucket, and its windows that came from several tasks."""

    def meet(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        is_done = pc.greater(pc.list_value_length(bucket.column("end")), 0)
        done, left = bucket.filter(is_done), bucket.filter(pc.invert(is_done))
        spans = [pa.concat_arrays(done.column(c).chunks or [bucket.column(c).combine_chunks().slice(0, 0)]).flatten() for c in _SPAN]
        columns = {c: pa.concat_arrays(left.column(c).chunks or [bucket.column(c).combine_chunks().slice(0, 0)]).flatten() for c in _PACKED}
        twice, _ = _twice(*(columns[c].to_numpy(zero_copy_only=False) for c in ("seed", "window")))
        index = pa.array(np.flatnonzero(twice))
        found = [columns[c].take(index) for c in ("doc", "fp", "start")]
        found.append(pc.add(found[2], alphabet.window))
        return pa.table([pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(spans, found, strict=True)], names=list(_SPAN))

    return meet


def same_document(a: str, b: str):
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.fp") == F.col(f"{b}.fp"))


def extended(
    candidates: DataFrame, docs: DataFrame, alphabet: Alphabet, release: Callable[[], None] = lambda: None
) -> DataFrame:
    """(doc, fp, spans): for each document the places that lie in a repeated window, as spans (start, end).

    ``candidates`` are the anchors whose seed is not unique; they are read twice and should be a written table, which
    ``release`` drops as soon as it is of no more use.
    """
    length = alphabet.window
    written = Table(
        candidates.groupBy("seed", "reach").agg(F.count("*").alias("n"), F.min(F.struct("doc", "fp", "start", "more")).alias("one"))
    )
    classes = written.df
    # Written by document before the windows are compared, so that candidates and what their join has shuffled go first.
    whole = Table(
        candidates.join(classes.filter("n > 1").select("seed", "reach"), ["seed", "reach"], "left_semi")
        .groupBy("doc", "fp")
        .agg(F.collect_list(F.struct("start", (F.col("start") + F.col("more") + length).alias("end"))).alias("spans"))
    )
    release()
    several = Table(classes.groupBy("seed").agg(F.count("*").alias("classes")).filter("classes > 1"))
    open_classes = classes.join(several.df, "seed").select("one.*", "seed")
    count = open_classes.agg(F.sum(F.col("more").cast("long") + 1)).first()[0] or 0
    open_stretches = (
        open_classes.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "more", "seed")).alias("stretches"))
    )
    listed = docs.alias("d").join(open_stretches.alias("o"), same_document("d", "o")).select("d.doc", "d.fp", "o.stretches", "d.text")
    # A repeated row gives its stretches twice. That is right: its windows do occur again, in the repetition.
    # One pass, as each step of its own would hold another Python worker for every core.
    cut_out, pack = _stretches(alphabet), _packed(alphabet, 1 + count // BUCKET_WINDOWS)
    kind = dict(docs.dtypes)["doc"]
    packed = listed.mapInArrow(
        lambda batches: pack(cut_out(batches)),
        f"bucket bigint, doc array<{kind}>, fp array<bigint>, start array<bigint>, end array<bigint>, seed array<bigint>, window array<bigint>",
    )
    near = packed.groupBy("bucket").applyInArrow(_met_in_bucket(alphabet), f"doc {kind}, fp bigint, start bigint, end bigint")
    spans = whole.df.union(near.select("doc", "fp", F.array(F.struct("start", "end"))))
    # Written before it meets the texts again, so that what this job has shuffled goes first.
    found = Table(spans.groupBy("doc", "fp").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    for t in (written, whole, several):
        t.drop()
    return found.df


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All of ``docs``, those without a repeated window with null spans."""
    others = [c for c in docs.columns if c not in ("doc", "fp", "text")]
    return (
        docs.alias("d").join(spans.alias("s"), same_document("d", "s"), "left")
        .select("d.doc", *(f"d.{c}" for c in others), "s.spans", "d.text")
    )
