"""Substring dedup with a logarithmic family of suffix indexes.

A batch's index is its sparse suffix array: the suffixes that start at the batch's anchors, in the order of the
fingerprint of their first 64 bytes. Suffixes that share these bytes are neighbours, and any 200 shared bytes hold
such an anchor, so scanning two arrays side by side meets every long match. Each new batch is scanned against
itself and against every level; then it becomes a level, and levels of one size merge into one of twice the size,
so that n batches leave at most log2(n) + 1 levels and every suffix is rewritten as often at most. Suffixes that
met another are extended to whole matches at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionmill.llm.arrays import covered
from mentionmill.llm.repeats import BYTES_200, Alphabet, anchors, extended, identified, with_spans
from mentionmill.llm.tables import Table


class IndexFamily:
    """Levels of suffix arrays; level i covers 2^i batches."""

    def __init__(self) -> None:
        self.levels: dict[int, Table] = {}
        self.met: list[Table] = []

    @staticmethod
    def _array(suffixes: DataFrame) -> Table:
        return Table(suffixes.repartitionByRange("seed", "reach").sortWithinPartitions("seed", "reach"))

    def add(self, suffixes: DataFrame) -> None:
        """Scan a batch against itself and all levels, then take it in."""
        new = self._array(suffixes)
        counted = new.df.groupBy("seed").agg(F.count("*").alias("n"))
        found = [counted.filter("n > 1").select("seed")]
        seeds = new.df.select("seed")
        found += [seeds.join(level.df.select("seed"), "seed", "left_semi") for level in self.levels.values()]
        self.met.append(Table(reduce(DataFrame.union, found).distinct()))
        size = 0
        while size in self.levels:
            old = self.levels.pop(size)
            merged = self._array(old.df.union(new.df))
            old.drop()
            new.drop()
            new, size = merged, size + 1
        self.levels[size] = new

    def matched(self) -> Table:
        """All suffixes that share their first bytes with another one."""
        # Written before the join, so that adaptive execution can split the rows of a hot seed.
        seeds = Table(reduce(DataFrame.union, (t.df for t in self.met)).distinct())
        everything = reduce(DataFrame.union, (t.df for t in self.levels.values()))
        out = Table(everything.join(seeds.df, "seed", "left_semi"))
        for t in [seeds, *self.met, *self.levels.values()]:
            t.drop()
        return out


def _kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, counts = lists.flatten(), lists.value_lengths().fill_null(0).to_pylist()
        starts = flat.field("start").to_numpy(zero_copy_only=False)
        ends = flat.field("end").to_numpy(zero_copy_only=False)
        at, size, removed, spans, digests = 0, [], [], [], []
        for n, value in zip(counts, batch.column(2), strict=True):
            body = (value.as_py() or "").encode()
            kept, runs = body, 0
            if n:
                gone = covered(len(body), starts[at : at + n], ends[at : at + n])
                at += n
                kept = np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            size.append(len(body))
            removed.append(len(body) - len(kept))
            spans.append(runs)
            digests.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digests, pa.string())],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_bytes(docs: DataFrame, batches: int, alphabet: Alphabet = BYTES_200) -> DataFrame:
    """(doc, fp, spans) of the bytes to remove from ``docs`` (doc, fp, text), fed to an index family in batches."""
    dealt = docs.select("doc", "fp", F.pmod(F.xxhash64("fp", "doc"), F.lit(batches)).cast("int").alias("batch"), "text")
    suffixes = Table(anchors(dealt, alphabet))
    family = IndexFamily()
    for i in range(batches):
        family.add(suffixes.df.filter(F.col("batch") == i).drop("batch"))
    suffixes.drop()
    matched = family.matched()
    return extended(matched.df, docs, alphabet, matched.drop)


def without_repeated_bytes(df: DataFrame, doc: str, text: str, batches: int = 4) -> DataFrame:
    """doc with n_bytes, n_removed, n_spans and kept_sha256 of its text's UTF-8 bytes.

    Removed is each byte covered by a 200-byte string that also starts anywhere else, in the same document too;
    matches never cross documents. A null text counts as empty, shorter texts lose nothing, repeated rows repeat
    each other, and an empty table gives no rows. The result does not depend on ``batches``.
    """
    docs = identified(df, doc, text)
    found = with_spans(docs, repeated_bytes(docs, batches))
    kind = dict(docs.dtypes)["doc"]
    out = found.mapInArrow(_kept_bytes, f"doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("doc", doc)
