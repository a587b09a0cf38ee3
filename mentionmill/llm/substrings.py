"""Substring dedup by seed and extend: winnowed anchors join documents, and matches are extended both ways.

A seed is the least 8-word gram of a 35-word window, so any two texts that share 35 words share a seed in it.
Extension goes to the ends of the stretch that the seed's windows reach over (``repeats.extended``), and the union
of what repeats is the set of maximal repeats of at least 35 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionmill.llm.arrays import covered
from mentionmill.llm.repeats import WORDS_35, Alphabet, anchors, extended, identified, with_spans
from mentionmill.llm.tables import Table


def _kept_words(with_text: bool, others: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1 + others)
            flat, bounds = lists.flatten(), lists.value_lengths().fill_null(0).to_pylist()
            starts = flat.field("start").to_numpy(zero_copy_only=False)
            ends = flat.field("end").to_numpy(zero_copy_only=False)
            at, words_out, removed, digests, texts = 0, [], [], [], []
            for n, value in zip(bounds, batch.column(2 + others), strict=True):
                words = (value.as_py() or "").encode().split()  # splits at the six ASCII spaces
                total = len(words)
                if n:
                    gone = covered(total, starts[at : at + n], ends[at : at + n])
                    words = list(compress(words, ~gone))
                    at += n
                kept = b" ".join(words)
                words_out.append(total)
                removed.append(total - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode() if n else value.as_py())
            columns = [batch.column(i) for i in range(1 + others)]
            columns += [pa.array(words_out, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = [*batch.schema.names[: 1 + others], "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return finish


def without_repeats(
    df: DataFrame, doc: str, text: str, keep: tuple[str, ...] = (), alphabet: Alphabet = WORDS_35, with_text: bool = False
) -> DataFrame:
    """doc and the columns ``keep`` with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Removed is each word covered by a window whose words also start anywhere else, in the same document too. A null
    text has no words; kept_text is the text itself where nothing is removed; texts with fewer words than a window lose none; repeated rows and rows with one id are
    documents of their own and repeat each other. An empty table gives no rows.
    """
    renamed = {c: f"_k{i}" for i, c in enumerate(keep)}
    docs = identified(df.withColumns({n: F.col(c) for c, n in renamed.items()}), doc, text, *renamed.values())
    keyed = docs.select("doc", "fp", "text")
    seeds = Table(anchors(keyed, alphabet))
    # Written before the join, so that adaptive execution can split the rows of a hot seed.
    again = Table(seeds.df.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"))
    candidates = Table(seeds.df.join(again.df, "seed", "left_semi"))
    seeds.drop()
    again.drop()
    spans = extended(candidates.df, keyed, alphabet, candidates.drop)
    found = with_spans(docs, spans)
    fields = ", ".join(f"{n} {t}" for n, t in found.dtypes[: 1 + len(keep)])
    schema = f"{fields}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    out = found.mapInArrow(_kept_words(with_text, len(keep)), schema)
    return out.select(
        F.col("doc").alias(doc), *(F.col(n).alias(c) for c, n in renamed.items()), "n_words", "n_removed", "kept_sha256",
        *(["kept_text"] * with_text),
    )
