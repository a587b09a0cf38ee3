"""Phrase collocations from an FM-index per shard over word ids.

A task cuts what it reads into shards of bounded size, each of one language: the distinct words with their counts,
and the text as word numbers with a break wherever a piece or a text ends. Words that are frequent over all shards
get one id each; the rest become breaks, as no candidate can hold them.

Every level then takes the phrases of one word less that are frequent over all shards, finds their intervals in the
shard's index and extends them. The index is bidirectional: the Burrows-Wheeler transforms of the text and of its
reverse, with the intervals of both kept in step, so that a phrase's right extensions are read off the one and its
left extensions off the other. Suffixes are ordered by as many words as the longest phrase has; intervals of
phrases up to that depth need no more. Counts are summed across shards, and what stays frequent is the next level's
start. A shard gives one row for each phrase, however often it occurs there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionmill.llm.arrays import LOWER, ranges, text_slices, word_spans
from mentionmill.llm.tables import Table

#: Bytes of words in a shard; a single longer text is a shard of its own.
SHARD_BYTES = 8_000_000
#: Shards that a task fills at once, in units of SHARD_BYTES over all languages.
OPEN_SHARDS = 4
#: Ids are dealt in so many buckets.
ID_BUCKETS = 4096

_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[_BREAKS] = True
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, *_BREAKS]] = False


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of a slice, whether a break precedes each, and the rows' first words."""
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets, _IS_WORD)
    breaks = np.concatenate([[0], np.cumsum(_IS_BREAK[data])])
    broken = np.zeros(len(starts), dtype=bool)
    broken[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
    broken[first[:-1][np.diff(first) > 0]] = True
    letters = lower[_IS_WORD[data]] if len(data) else lower
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters.tobytes())]
    )
    return words, broken, first


@dataclass
class _Open:
    """A shard that is being filled."""

    words: list[pa.Array]
    broken: list[np.ndarray]
    size: int = 0

    def row(self, lang: str) -> pa.RecordBatch:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int32)
        broken = np.concatenate(self.broken)
        # a number stands behind the break before it
        body = np.insert(numbers, np.flatnonzero(broken), -1)
        strings = coded.dictionary.cast(pa.large_string()).cast(pa.string())
        bounds = pa.array([0, len(strings)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang], pa.string()),
                pa.array([len(numbers)], pa.int64()),
                pa.ListArray.from_arrays(bounds, strings),
                pa.ListArray.from_arrays(bounds, pa.array(np.bincount(numbers, minlength=len(strings)), pa.int64())),
                pa.array([body.tobytes()], pa.binary()),
            ],
            names=["lang", "n_words", "words", "counts", "body"],
        )


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard, from rows (lang, text)."""
    filling: dict[str, _Open] = {}

    def close(langs: list[str]) -> Iterator[pa.RecordBatch]:
        for lang in langs:
            yield filling.pop(lang).row(lang)

    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1)):
            words, broken, first = _words_of(data, offsets)
            if not len(words):
                continue
            coded = batch.column(0).slice(row, len(offsets) - 1).dictionary_encode()
            of_word = np.repeat(coded.indices.to_numpy(), np.diff(first))
            for code, lang in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(of_word == code)
                if not len(own):
                    continue
                part = words.take(pa.array(own))
                shard = filling.setdefault(lang, _Open([], []))
                shard.words.append(part)
                shard.broken.append(broken[own])
                shard.size += part.nbytes
                if shard.size >= SHARD_BYTES:
                    yield from close([lang])
            if sum(x.size for x in filling.values()) >= OPEN_SHARDS * SHARD_BYTES:
                yield from close(list(filling))
    yield from close(list(filling))


class FMIndex:
    """A bidirectional index over symbols 1, 2, ...; 0 is a break, which no phrase holds.

    ``depth`` is the length up to which phrases may be asked for.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.n = len(text)
        self.base = int(text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.base))])
        self.left = self._transform(text, depth)
        self.right = self._transform(text[::-1], depth)
        self.left_breaks = np.concatenate([[0], np.cumsum(self.left == 0)])
        self.right_breaks = np.concatenate([[0], np.cumsum(self.right == 0)])
        # where each symbol occurs in the reverse text's transform: a rank is a search in this list
        order = np.argsort(self.right, kind="stable")
        self.places = self.right[order] * np.int64(self.n) + order

    def _transform(self, text: np.ndarray, depth: int) -> np.ndarray:
        """The symbols before the suffixes, which are in the order of their first ``depth`` symbols."""
        key, size = text.astype(np.int64), self.base
        for i in range(1, depth):
            if size * self.base >= 1 << 62:
                _, key = np.unique(key, return_inverse=True)
                size = self.n
            further = np.zeros(self.n, dtype=np.int64)
            further[: self.n - i] = text[i:]
            key, size = key * self.base + further, size * self.base
        return text[np.argsort(key, kind="stable") - 1].astype(np.int64)

    def roots(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place in the text's order, in the reverse's, size) of the intervals of single symbols."""
        first = self.before[symbols]
        return first, first.copy(), self.before[symbols + 1] - first

    def extended(self, first: np.ndarray, reverse: np.ndarray, size: np.ndarray):
        """All right extensions by one symbol: (which interval, symbol, and the new interval)."""
        owner = np.repeat(np.arange(len(size)), size)
        symbol = self.right[ranges(reverse, size)]
        key, count = np.unique(owner * np.int64(self.base) + symbol, return_counts=True)
        owner, symbol = np.divmod(key, self.base)
        # extensions by smaller symbols come first in the text's order
        total = np.cumsum(count) - count
        smaller = total - total[np.searchsorted(owner, owner)]
        rank = np.searchsorted(self.places, symbol * np.int64(self.n) + reverse[owner]) - self.before[symbol]
        word = symbol > 0
        owner, symbol, count = owner[word], symbol[word], count[word]
        return owner, symbol, (first[owner] + smaller[word], self.before[symbol] + rank[word], count)

    def extensions(self, first: np.ndarray, reverse: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences have a word before them, and how many one behind."""
        before = size - (self.left_breaks[first + size] - self.left_breaks[first])
        behind = size - (self.right_breaks[reverse + size] - self.right_breaks[reverse])
        return before, behind


class _Phrases:
    """Phrases of one length as a trie, one sorted list of keys per depth."""

    def __init__(self, symbols: np.ndarray, base: int) -> None:
        self.base, self.levels = np.int64(base), []
        node = np.zeros(len(symbols), dtype=np.int64)
        for column in symbols.T:
            keys, node = np.unique(node * self.base + column, return_inverse=True)
            self.levels.append(keys)
        #: which given phrase each leaf is
        self.given = np.empty(len(self.levels[-1]), dtype=np.int64)
        self.given[node] = np.arange(len(symbols))

    def step(self, depth: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each node by a symbol, -1 where there is none."""
        keys, wanted = self.levels[depth], node * self.base + symbol
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((node >= 0) & (keys[at] == wanted), at, -1)


def longer_phrases(text: np.ndarray, grams: np.ndarray, symbols: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Extensions of the phrases ``symbols`` (one row each, named ``grams``) whose last words are such a phrase too.

    Gives the names of the two, the count, and how many occurrences have a word before and behind them.
    """
    index = FMIndex(text, depth)
    known = _Phrases(symbols, index.base)
    node = np.arange(len(known.levels[0]))
    place = index.roots(known.levels[0])
    for i in range(1, symbols.shape[1]):
        owner, symbol, after = index.extended(*place)
        child = known.step(i, node[owner], symbol)
        good = child >= 0
        node, place = child[good], tuple(x[good] for x in after)
    owner, symbol, after = index.extended(*place)
    left = known.given[node[owner]]
    tail = np.zeros(len(owner), dtype=np.int64)
    for i in range(1, symbols.shape[1]):
        tail = known.step(i - 1, tail, symbols[left, i])
    tail = known.step(symbols.shape[1] - 1, tail, symbol)
    good = tail >= 0
    before, behind = index.extensions(*after)
    return grams[left[good]], grams[known.given[tail[good]]], after[2][good], before[good], behind[good]


_LEVEL = "shard long, left long, right long, n long, before long, behind long"


def _level_rows(shard: int, body: np.ndarray, grams: np.ndarray, ids: np.ndarray, depth: int) -> pa.Table:
    """One level in one shard: ``body`` and ``ids`` hold word ids, -1 in the body is a break."""
    names = ["shard", "left", "right", "n", "before", "behind"]
    words = np.unique(ids)
    at = np.minimum(np.searchsorted(words, body), max(len(words) - 1, 0))
    text = np.where(words[at] == body, at + 1, 0) if len(words) else np.zeros(len(body), dtype=np.int64)
    if not text.any():
        return pa.table([pa.array([], pa.int64())] * len(names), names=names)
    found = longer_phrases(np.append(text, 0), grams, np.searchsorted(words, ids) + 1, depth)
    return pa.table([pa.array(np.full(len(found[0]), shard)), *map(pa.array, found)], names=names)


def _pairs(depth: int):
    """The phrases of two words of each shard (shard, body): every word of a body is frequent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = np.frombuffer(value.as_buffer(), dtype=np.int32).astype(np.int64)
                ids = np.unique(body[body >= 0])
                if len(ids):
                    yield from _level_rows(shard, body, ids, ids[:, None], depth).to_batches()

    return scan


def _further(depth: int):
    """The phrases of one word more of a shard: its body, and its frequent phrases (gram, ids)."""

    def scan(key: tuple, bodies: pa.Table, phrases: pa.Table) -> pa.Table:
        body = np.frombuffer(bodies.column("body")[0].as_buffer(), dtype=np.int32).astype(np.int64) if len(bodies) else np.zeros(0, np.int64)
        grams = phrases.column("gram").combine_chunks().to_numpy(zero_copy_only=False)
        ids = phrases.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return _level_rows(key[0].as_py(), body, grams, ids.reshape(len(grams), -1) if len(grams) else ids.reshape(0, 1), depth)

    return scan


def _recoded(key: tuple, bodies: pa.Table, words: pa.Table) -> pa.Table:
    """A shard's text in word ids; words without an id are breaks, and runs of breaks are one."""
    out = []
    for value in bodies.column("body").combine_chunks():
        body = np.frombuffer(value.as_buffer(), dtype=np.int32)
        ids = np.full(int(body.max(initial=-1)) + 2, -1, dtype=np.int32)
        ids[words.column("local").combine_chunks().to_numpy(zero_copy_only=False)] = words.column("gram").combine_chunks().to_numpy(zero_copy_only=False)
        body = ids[body]  # a break, -1, takes the last entry
        body = body[np.append(True, (body[1:] >= 0) | (body[:-1] >= 0))] if len(body) else body
        out.append(body.tobytes())
    return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["shard", "body"])


def _numbered(df: DataFrame, *key: str) -> DataFrame:
    """``df`` with a column gram: small whole numbers, one for each row, dealt inside buckets of equal hash."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(ID_BUCKETS))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key))
    return df.withColumn("_bucket", bucket).withColumn("gram", F.col("_bucket") + ID_BUCKETS * (inside - 1)).drop("_bucket")


def frequent_phrases(df: DataFrame, lang: str, text: str, max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """Every phrase of up to ``max_words`` words that occurs ``min_count`` times in its language; and (lang, n) of all words.

    Columns: lang, size (words), phrase (words joined by one space), a (occurrences), heads and tails (occurrences of
    its first 1, 2, ... and of its last 1, 2, ... words), before and behind (occurrences with a frequent word before
    and behind them in their piece; null for single words), left, right (the phrases without the last and the first
    word, named by gram), gram, ids. A null lang is ``und``, a null or empty text has no words, rows count as often as
    they are repeated, and an empty table gives no rows. A text of any length is read whole.
    """
    source = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    rows = source.mapInArrow(_sharded, "lang string, n_words long, words array<string>, counts array<long>, body binary")
    shards = Table(rows.withColumn("shard", F.monotonically_increasing_id()))
    totals = Table(shards.df.groupBy("lang").agg(F.sum("n_words").alias("n")))
    entries = shards.df.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "e")).select(
        "lang", "shard", "local", F.col("e.words").alias("phrase"), F.col("e.counts").alias("a")
    )
    counted = entries.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)
    no_counts, no_number = F.array().cast("array<long>"), F.lit(None).cast("long")
    level = Table(
        _numbered(counted, "lang", "phrase").select(
            "lang", F.lit(1).alias("size"), "phrase", "a", no_counts.alias("heads"), no_counts.alias("tails"),
            no_number.alias("before"), no_number.alias("behind"), no_number.alias("left"), no_number.alias("right"),
            "gram", F.array("gram").alias("ids"),
        )
    )
    levels = [level]
    mapped = entries.join(level.df.select("lang", "phrase", "gram"), ["lang", "phrase"]).select("shard", "local", "gram")
    bodies = Table(
        shards.df.select("shard", "body").groupBy("shard").cogroup(mapped.groupBy("shard")).applyInArrow(_recoded, "shard long, body binary")
    )
    shards.drop()
    by_shard: Table | None = None
    for size in range(2, max_words + 1):
        if by_shard is None:
            found = bodies.df.mapInArrow(_pairs(size), _LEVEL)
        else:
            found = bodies.df.groupBy("shard").cogroup(by_shard.df.groupBy("shard")).applyInArrow(_further(size), _LEVEL)
        # a phrase has one row for each shard that holds it
        everywhere = Window.partitionBy("left", "right")
        sums = {c: F.sum(c).over(everywhere) for c in ("n", "before", "behind")}
        summed = Table(found.withColumns(sums).filter(F.col("n") >= min_count))
        if by_shard is not None:
            by_shard.drop()
        level = Table(_longer_level(summed.df, level.df, size))
        levels.append(level)
        if size < max_words:
            named = summed.df.select("shard", "left", "right").join(level.df.select("left", "right", "gram", "ids"), ["left", "right"])
            by_shard = Table(named.select("shard", "gram", "ids"))
        summed.drop()
    bodies.drop()
    out = levels[0].df
    for further in levels[1:]:
        out = out.union(further.df)
    return out, totals.df


def _longer_level(summed: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """The level's phrases with what they inherit: heads from the phrase without the last word, tails from the other."""
    found = summed.groupBy("left", "right").agg(*(F.any_value(c).alias(c) for c in ("n", "before", "behind")))
    first = shorter.select(
        F.col("gram").alias("left"), "lang", "phrase", "ids", F.array_append("heads", F.col("a")).alias("heads")
    )
    last = shorter.select(
        F.col("gram").alias("right"), F.array_append("tails", F.col("a")).alias("tails"), F.element_at("ids", -1).alias("last"),
        F.substring_index("phrase", " ", -1).alias("word"),
    )
    whole = found.join(first, "left").join(last, "right")
    return _numbered(whole, "left", "right").select(
        "lang", F.lit(size).alias("size"), F.concat_ws(" ", "phrase", "word").alias("phrase"), F.col("n").alias("a"),
        "heads", "tails", "before", "behind", "left", "right", "gram", F.array_append("ids", F.col("last")).alias("ids"),
    )


def _exact(value: Column) -> Column:
    return value.cast("decimal(18,0)")


def collocations(
    df: DataFrame, lang: str, text: str, max_words: int = 3, min_count: int = 10, best: int = 2000, share: int = 50
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of two words or more.

    The score is the least, over all cuts in two, of 1,000,000 a a / (l r), rounded down, where l and r count the
    parts; of equal cuts the first counts. A phrase goes if a longer one that holds it has ``share`` hundredths of
    its occurrences or more: if any has, one with a single word more has. Products are decimals of 38 digits, exact
    for counts below 10^15. See ``frequent_phrases`` for nulls, empty texts, repeated rows and empty tables; ties in
    score and count go by the phrase's bytes.
    """
    phrases, totals = frequent_phrases(df, lang, text, max_words, min_count)
    several = phrases.filter("size > 1")
    around = several.filter("size > 2").select(
        (F.col("size") - 1).alias("size"), F.explode(F.array("left", "right")).alias("gram"), F.col("a").alias("longer")
    )
    around = around.groupBy("size", "gram").agg(F.max("longer").alias("longer"))

    def cut(k: Column) -> Column:
        l, r = F.get("heads", k - 1), F.get("tails", F.col("size") - k - 1)
        square = _exact(F.col("a")) * _exact(F.col("a"))
        # a quotient of whole decimals, rounded down
        score = F.call_function("div", square * F.lit(1_000_000).cast("decimal(7,0)"), _exact(l) * _exact(r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    scored = (
        several.join(around, ["size", "gram"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        .withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= best)
    )
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
