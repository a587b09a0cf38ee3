"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact checks and connected components.

A document is the multiset of its five-word shingles. BagMinHash lays a Poisson process over every shingle's weight
axis, in intervals [0,1), [1,2), [2,4), [4,8) ... of growing width; a point counts if it lies below the shingle's
weight, and each register keeps the earliest point dealt to it. Two registers agree with the probability of the
weighted Jaccard similarity, and a large weight costs its logarithm.

Documents with one bag are one node from the start. Nodes that agree in a whole band meet in a bucket, where all are
checked against two centres (the node that meets most others, and one by hash), so a bucket of n costs 2n checks.
Nodes of buckets that still hold several components are met by their rarest shingles as well, as many as any link
must share one of, and pairs of different components are checked unless their signatures differ too often. Every check
that counts is exact: the overlap of both multisets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mentionmill.llm.arrays import LETTERED, LOWER, mix, ranges, run_hashes, span_hashes, text_slices, word_spans
from mentionmill.llm.components import components
from mentionmill.llm.repeats import identified, same_document
from mentionmill.llm.tables import Table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 25 bands of 5: a pair of similarity 0.8 shares a band but for one in 20,000.
BANDS, ROWS_PER_BAND = 25, 5
REGISTERS = BANDS * ROWS_PER_BAND
#: Pairs whose signatures agree in fewer registers (four deviations below 0.8) are not worth an exact check; so few
#: have one pair of similarity 0.8 in 40,000.
LEAST_AGREEING = 81
#: Numbers of 64 bits that hold the octets of a signature, one for each register.
WORDS = -(-REGISTERS // 8)
#: Sizes of a class differ by this factor at most.
SIZE_STEP = 1.1
#: Nodes under one shingle and pair of size classes that one part of a join meets.
LIST_ROWS = 500
#: Documents to a file of the tables of nodes, their bands and texts, at least.
DOCUMENTS_PER_FILE = 2000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MARK = {1: np.uint64(0xA0761D6478BD642F), 2: np.uint64(0xE7037ED1A0B428DB)}


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), sorted; a text of fewer than five words, but not none, is one shingle."""
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets, LETTERED)
    words, count = span_hashes(lower, starts, ends), np.diff(first)
    rows, keys = [], []
    for length in range(1, SHINGLE_WORDS + 1):
        fit = (count >= length) if length == SHINGLE_WORDS else (count == length)
        if not fit.any():
            continue
        number = np.where(fit, count - length + 1, 0)
        at = ranges(first[:-1], number)
        rows.append(np.repeat(np.arange(len(count)), number))
        keys.append(run_hashes(words, length, length)[at])
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
    return row[new], key[new], np.diff(np.append(new, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers over 0 up to 1 from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740993.0


def signatures(rows: int, row: np.ndarray, key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The earliest point of each register, one line of registers per row; infinite without shingles."""
    out = np.full((rows, REGISTERS), np.inf)
    total = np.bincount(row, weights=weight, minlength=rows)
    due = total > 0
    # By this time all registers have met a point but for one row in about fifty, which goes on.
    limit = REGISTERS * (np.log(REGISTERS) + 4) / np.maximum(total, 1)
    while due.any():
        own = np.flatnonzero(due[row])
        levels = 1 + np.ceil(np.log2(weight[own])).astype(np.int64)
        at = np.repeat(own, levels)
        level = ranges(np.zeros(len(own), dtype=np.int64), levels)
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        width = np.maximum(low, 1)
        state = mix(key[at] + level.astype(np.uint64) * _A + _B)
        time = np.zeros(len(at))
        flat = np.full(rows * REGISTERS, np.inf)
        while len(at):
            state = mix(state + _A)
            time = time - np.log(_uniform(state)) / width
            alive = time <= limit[row[at]]
            at, low, width, state, time = at[alive], low[alive], width[alive], state[alive], time[alive]
            place = mix(state ^ _B)
            inside = low + (place >> np.uint64(32)).astype(np.int64) % width < weight[at]
            register = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % REGISTERS
            np.minimum.at(flat, row[at[inside]] * REGISTERS + register[inside], time[inside])
        found = flat.reshape(rows, REGISTERS)
        full = due & np.isfinite(found).all(axis=1)
        out[full] = found[full]
        due &= ~full
        limit = limit * 2
    return out


def _hex(a: np.ndarray, b: np.ndarray) -> list[str]:
    return [f"{x:016x}{y:016x}" for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node (128 bits that stand for the bag), size, bands and one byte for each register."""
    for batch in batches:
        for start, data, offsets in text_slices(batch.column(2)):
            n = len(offsets) - 1
            row, key, weight = bags(data, offsets)
            signature = signatures(n, row, key, weight)
            size = np.bincount(row, weights=weight, minlength=n).astype(np.int64)
            marks = []
            for seed in (1, 2):
                mark = np.zeros(n, dtype=np.uint64)
                np.add.at(mark, row, mix(key + _MARK[seed]) * mix(weight.astype(np.uint64) + _A))
                alone = span_hashes(data, offsets[:-1], offsets[1:], seed)
                marks.append(np.where(size > 0, mark, alone))
            bits = signature.view(np.uint64)
            bands = np.zeros((n, BANDS), dtype=np.uint64)
            for i in range(ROWS_PER_BAND):
                bands = mix(bands * _A + bits[:, i * BANDS : (i + 1) * BANDS] + np.arange(BANDS, dtype=np.uint64))
            ends = np.where(size > 0, BANDS, 0).cumsum()
            listed = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends), pa.int32()), pa.array(bands[size > 0].ravel().view(np.int64))
            )
            octets = (mix(bits) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, n),
                    batch.column(1).slice(start, n),
                    pa.array(_hex(*marks)),
                    pa.array(size),
                    listed,
                    pa.array([x.tobytes() for x in octets], pa.binary()),
                ],
                names=["doc", "fp", "node", "size", "bands", "octets"],
            )


def _in_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The octets of each node as numbers of 64 bits."""
    for batch in batches:
        octets = np.zeros((batch.num_rows, 8 * WORDS), dtype=np.uint8)
        octets[:, :REGISTERS] = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)
        bounds = pa.array(np.arange(len(octets) + 1) * WORDS, pa.int32())
        listed = pa.ListArray.from_arrays(bounds, pa.array(octets.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["node", "words"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of each node's text."""
    for batch in batches:
        for start, data, offsets in text_slices(batch.column(2)):
            row, key, weight = bags(data, offsets)
            index = pa.array(row + start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(key.view(np.int64)), pa.array(weight)],
                names=["node", "component", "shingle", "weight"],
            )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
        good = pa.array((a == b).sum(axis=1) >= LEAST_AGREEING)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(good)


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose multisets overlap by the similarity asked for."""
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            texts = [(batch.column(c)[i].as_py() or "").encode() for c in (2, 3)]
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            row, key, weight = bags(data, np.array([0, len(texts[0]), len(data)]))
            cut = int(np.searchsorted(row, 1))
            _, left, right = np.intersect1d(key[:cut], key[cut:], assume_unique=True, return_indices=True)
            common = np.minimum(weight[:cut][left], weight[cut:][right]).sum()
            good[i] = common > 0 and common >= SIMILARITY * (weight.sum() - common) - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))


class Links:
    """Exact links between nodes, and which pairs are still worth a check."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, files: int) -> None:
        self.nodes, self.docs, self.files = nodes, docs, files
        self.found: list[Table] = []
        self.component: Table | None = None

    def check(self, pairs: DataFrame) -> None:
        """Keep those of ``pairs`` (u, v) that are links."""
        facts = self.nodes.select("node", "octets", "one")
        met = (
            pairs.join(facts.select(F.col("node").alias("u"), F.col("octets").alias("a")), "u")
            .join(facts.select(F.col("node").alias("v"), F.col("octets").alias("b")), "v")
            .select("u", "v", "a", "b")
        )
        likely = Table(met.mapInArrow(_agreeing, "u string, v string"))
        ends = likely.df.select(F.col("u").alias("node")).union(likely.df.select(F.col("v").alias("node"))).distinct()
        wanted = facts.join(ends, "node").select("node", "one.doc", "one.fp")
        bodies = Table(
            self.docs.alias("d").join(wanted.alias("w"), same_document("d", "w"))
            .groupBy("w.node").agg(F.any_value("d.text").alias("text")),
            self.files,
        )
        texts = (
            likely.df.join(bodies.df.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
            .join(bodies.df.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
            .select("u", "v", "a", "b")
        )
        self.found.append(Table(texts.mapInArrow(_overlapping, "u string, v string")))
        likely.drop()
        bodies.drop()

    def connect(self) -> None:
        links = self.found[0].df
        for more in self.found[1:]:
            links = links.union(more.df)
        if self.component:
            self.component.drop()
        self.component = components(links)

    def with_component(self, members: DataFrame) -> DataFrame:
        """``members`` (band, node, ...) of buckets that still hold several components."""
        c = self.component.df
        named = members.join(c, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        return named.join(mixed.select("band"), "band", "left_semi")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _differing(a: str, b: str) -> Column:
    """In how many octets two lists of WORDS numbers differ."""
    counts = []
    for i in range(WORDS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in (4, 2, 1):  # the lowest bit of each octet becomes the disjunction of all its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        counts.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return functools.reduce(Column.__add__, counts)


def _left_pairs(meeting: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components among the nodes of ``meeting`` (band, node, component) that may be links.

    Prefix filter: shingles are ordered by rarity among these nodes, those of one component alone first. What comes
    before the first shingle that two nodes share is in neither's overlap, so that shingle lies early in both: where
    the rest still holds as much as a link of these sizes needs. Each node is listed under its early shingles, once
    for each class of sizes that a partner can have, and pairs meet there. The bound is exact, and what many nodes
    have in common, such as boilerplate, comes late and proposes nothing. In each list the commonest component meets
    the others and these meet one another, so that a list costs twice its pairs of different components at most.
    """
    wanted = meeting.select("node", "component").distinct().join(nodes.select("node", "one"), "node")
    texts = (
        docs.alias("d").join(wanted.select("node", "component", "one.doc", "one.fp").alias("w"), same_document("d", "w"))
        .groupBy("w.node", "w.component").agg(F.any_value("d.text").alias("text"))
    )
    shingles = Table(texts.mapInArrow(_shingled, "node string, component string, shingle bigint, weight bigint"))
    held = shingles.df.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")
    ).filter("least <> most").select("shingle", "n")
    words = nodes.select("node", "octets").mapInArrow(_in_words, "node string, words array<bigint>")
    facts = nodes.select("node", "size").join(wanted.select("node", "component"), "node").join(words, "node")
    rest = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        shingles.df.select("node", "shingle", "weight").join(held, "shingle")
        .withColumn("rest", F.sum("weight").over(rest))
        .join(facts, "node").filter(F.col("rest") >= SIMILARITY * F.col("size"))
    )
    steps = math.log(SIZE_STEP)
    around = F.sequence(*(
        F.floor(F.log(F.col("size") * at) / steps + slack).cast("int") for at, slack in ((SIMILARITY, -1e-9), (1 / SIMILARITY, 1e-9))
    ))
    smallest = F.greatest(F.pow(F.lit(SIZE_STEP), F.col("other")) * (1 - 1e-9), SIMILARITY * F.col("size"))
    own = F.floor(F.log("size") / steps).cast("int")
    listed = Table(
        placed.withColumn("other", F.explode(around)).filter(F.col("rest") >= _least_overlap(F.col("size"), smallest))
        .withColumn("own", own)
        .select("node", "component", "size", "words", "rest", "own", "shingle",
                F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    shingles.drop()
    key = ["shingle", "lo", "hi"]
    lists = (
        listed.df.groupBy(*key, "component").agg(F.count("*").alias("n"))
        .groupBy(*key).agg(F.max_by("component", F.struct("n", "component")).alias("commonest"),
                           F.sum("n").alias("n"), F.count("*").alias("components"))
        .filter("components > 1")
        .select(*key, "commonest", (1 + F.floor(F.col("n") / LIST_ROWS)).cast("int").alias("parts"))
    )
    met = Table(listed.df.join(lists, key))
    listed.drop()
    is_commonest = F.col("component") == F.col("commonest")
    left = (
        met.df.filter("own = lo")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("side", F.explode(F.when(is_commonest, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
        .select(*key, "part", "side", "node", "component", "size", "words", "rest")
    )
    right = (
        met.df.filter("own = hi")
        .withColumn("side", F.explode(F.when(is_commonest, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("parts") - 1).cast("bigint"))))
        .select(*key, "part", "side", F.col("node").alias("w"), F.col("component").alias("c"), F.col("size").alias("s"),
                F.col("words").alias("others"), F.col("rest").alias("r"))
    )
    return (
        left.join(right, [*key, "part", "side"])
        .filter(F.col("component") != F.col("c"))
        .filter(F.least("rest", "r") >= _least_overlap(F.col("size"), F.col("s")))
        .filter(_differing("words", "others") <= REGISTERS - LEAST_AGREEING)
        .select(*_pair(F.col("node"), F.col("w"))).distinct()
    )


def _least_overlap(size: Column, other: Column) -> Column:
    """What two multisets of these sizes share at least if they are a link."""
    return (size + other) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6


def near_duplicate_classes(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, fp, copies, class_id, kept) for each distinct pair of id and text of ``df``.

    class_id is the least id of the class; kept is true for one pair of each class, that with the least id; copies
    counts the rows that share id and text. Texts without a word are alike only if they are equal; null counts as
    empty. Null ids are allowed, come last and only name a class that has no other id. An empty table gives no rows.
    """
    docs = identified(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), doc, text)
    kind = dict(docs.dtypes)["doc"]
    signed = docs.mapInArrow(
        _signed, f"doc {kind}, fp bigint, node string, size bigint, bands array<bigint>, octets binary"
    )
    seen = Observation()
    rows = Table(signed.observe(seen, F.count("*").alias("n")))
    files = 1 + seen.get["n"] // DOCUMENTS_PER_FILE
    ids = rows.df.groupBy("node", "doc", "fp").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "fp")
    nodes = Table(
        rows.df.groupBy("node").agg(
            F.min(first).alias("one"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"),
            F.any_value("octets").alias("octets"),
        ),
        files,
    ).df
    spread = nodes.select("node", "one", "size", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = Table(spread.join(shared, "band").select("band", "node", "one", "size", "n"), files)
    meets = members.df.groupBy("node").agg(F.sum("n").alias("meets"))
    fits = F.least("size", "s") >= SIMILARITY * F.greatest("size", "s")
    links = Links(nodes, docs, files)
    met = Table(members.df.drop("n").join(meets, "node"), files)
    members.drop()
    centre = F.struct("node", "size")
    centres = met.df.groupBy("band").agg(
        F.min_by(centre, F.struct(-F.col("meets"), "one")).alias("a"), F.min_by(centre, F.xxhash64("node")).alias("b")
    ).select("band", F.explode(F.array("a", "b")).alias("c"))
    pairs = (
        met.df.join(centres.select("band", F.col("c.node").alias("centre"), F.col("c.size").alias("s")), "band")
        .filter((F.col("node") != F.col("centre")) & fits)
        .select(*_pair(F.col("node"), F.col("centre"))).distinct()
    )
    links.check(pairs)
    links.connect()
    mixed = Table(links.with_component(met.df).select("band", "node", "component"), files)
    if not mixed.df.isEmpty():
        links.check(_left_pairs(mixed.df, nodes, docs))
        links.connect()
    met.drop()
    mixed.drop()
    named = ids.join(links.component.df, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(F.min(first).alias("best"))
    is_best = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("fp") == F.col("best.fp"))
    return named.join(best, "component").select("doc", "fp", "copies", F.col("best.doc").alias("class_id"), is_best.alias("kept"))


def deduplicated(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``df`` with one row of each class of near duplicates."""
    kept = near_duplicate_classes(df.select(doc, text), doc, text).filter("kept").select(
        F.col("doc").alias("_kept_doc"), F.col("fp").alias("_kept_fp"), F.col("copies").alias("_kept_copies")
    )
    marked = df.withColumn("_text_fp", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = marked.join(kept, marked[doc].eqNullSafe(kept["_kept_doc"]) & (F.col("_text_fp") == F.col("_kept_fp")))
    once = met.filter("_kept_copies = 1")
    repeated = met.filter("_kept_copies > 1").dropDuplicates(["_kept_doc", "_kept_fp"])
    return once.union(repeated).select(*(F.col(f"`{c}`") for c in df.columns))
