"""Dealt operators on whole texts against brute force, on rows that hold every awkward case at once."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionmill.llm import near_duplicates, repeats
from mentionmill.llm.arrays import least_positions, run_hashes
from mentionmill.llm.components import components
from mentionmill.llm.decontaminate import contamination
from mentionmill.llm.near_duplicates import deduplicated, near_duplicate_classes, signatures
from mentionmill.llm.quality import line_rules
from mentionmill.llm.substrings import without_repeats
from mentionmill.llm.suffix_index import without_repeated_bytes
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, seed string, doc string"


def prose(rng, n):
    return [rng.choice(["the", "Of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}é"[: rng.randrange(3, 8)] for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, repeated rows, null and repeated ids, null, empty and very long texts."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    base = prose(rng, 300)
    out = []
    for i in range(60):
        words = prose(rng, rng.randrange(1, 200))
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage
        out.append((i, " ".join(words[:50]) + "\n" + "  ".join(words[50:])))
    for i in range(60, 90):
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        out.append((i, " ".join(words)))
    out += [out[5]] * 3 + [(None, out[6][1]), (None, None), (91, None), (92, ""), (92, "\t \n"), (93, "###"), (94, "###"), (1, "one")]
    out += [(95, "a " * 3000), (96, "ab" * 2000), (97, " ".join(prose(rng, 20000))), (98, "one two three four"), (99, "One, two three four.")]
    return [(d, t, None if i % 7 == 0 else f"s{i % 2}", "x", "y") for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


def few_windows(monkeypatch, windows):
    """So many windows to a task's comparison and to a bucket."""
    monkeypatch.setattr(repeats, "WINDOWS_AT_ONCE", windows)
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", windows)


@pytest.mark.parametrize("windows", [500_000, 60])
def test_substrings(docs, rows, windows, monkeypatch):
    few_windows(monkeypatch, windows)
    found = without_repeats(docs, "doc_id", "text").collect()
    same(found, [(r[0], *x) for r, x in zip(rows, brute.substrings([r[1] for r in rows]), strict=True)])


def test_substrings_keep_columns_and_untouched_texts(docs, rows):
    found = without_repeats(docs, "doc_id", "text", keep=("seed", "doc"), with_text=True)
    assert found.columns == ["doc_id", "seed", "doc", "n_words", "n_removed", "kept_sha256", "kept_text"]
    texts = {r[1] for r in rows}
    for r in found.collect():
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        else:
            assert r["kept_text"] in texts


@pytest.mark.parametrize(("windows", "batches"), [(500_000, 4), (300, 3), (500_000, 1)])
def test_byte_strings(docs, rows, windows, batches, monkeypatch):
    few_windows(monkeypatch, windows)
    found = without_repeated_bytes(docs, "doc_id", "text", batches).collect()
    same(found, [(r[0], *x) for r, x in zip(rows, brute.byte_strings([r[1] for r in rows]), strict=True)])


def test_contamination(spark, docs, rows):
    words = (rows[0][1] or "").split()
    items = [
        (1, " ".join(words[:25])), (2, " ".join(words[3:14]).upper()), (3, "one two three"), (4, "ab" * 2000), (5, None), (6, ""),
        (None, "two, three"), (7, " ".join(words[:9]) + " never"), (7, " ".join(words[20:30])), (8, "nowhere to be found"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = contamination(docs, "text", ["doc_id"], bench, "item_id", "text").collect()
    named = [("null" if i is None else i, t) for i, t in items]
    expected = [(r[0], *x) for r, x in zip(rows, brute.contamination([r[1] for r in rows], named), strict=True)]
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found], expected)


def test_contamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, "text", ["doc_id"], none, "item_id", "text").count() == 0
    assert contamination(docs, "text", ["doc_id"], none, "item_id", "text").filter("n_hit > 0").count() == 0


def test_line_rules_counts(docs, rows):
    found = line_rules(docs, "text", "source", ["doc_id"]).collect()
    fields = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same([[r[f] for f in fields] for r in found], [(r[0], *brute.quality_counts(r[1])) for r in rows])


def test_line_frequency(spark):
    rng = random.Random(3)
    common = "Read more about our cookie rules here"
    rows = []
    for i in range(200):
        lines = [" ".join(prose(rng, 60)), common.upper() if i % 2 else f"  {common} ", " ".join(prose(rng, 5))]
        rows.append((i, "\n".join(lines), "a", "x", "y"))
    depleted = "\n".join(f"line {j} " + "word " * 9 for j in range(20))
    rows += [(1000 + i, depleted + f"\nown {i}", None, "x", "y") for i in range(60)]
    rows += [(2000 + i, rows[0][1], "b", "x", "y") for i in range(100)]  # copies of one text are one document
    judged = line_rules(spark.createDataFrame(rows, SCHEMA), "text", "source", ["doc_id"], with_text=True)
    by_id = {r["doc_id"]: r for r in judged.collect()}
    assert all(by_id[i]["n_frequent_words"] == 7 and by_id[i]["kept"] for i in range(200))
    assert all(by_id[i]["clean_text"] == "\n".join(rows[i][1].split("\n")[::2]) for i in range(200))
    assert all(not by_id[1000 + i]["kept"] and by_id[1000 + i]["depleted"] for i in range(60))
    assert all(by_id[2000 + i]["kept"] and by_id[2000 + i]["clean_text"] == rows[0][1] for i in range(100))


def test_lines_of_long_texts(spark):
    """Texts of 40,000 lines, every second one in all of them, beside rows without a text, a host or a word."""
    rows = [(i, "\n".join(f"common {j}\nown {i} {j}" for j in range(20_000)), "a", "x", "y") for i in range(6)]
    rows += [(6, None, None, "x", "y"), (7, "", "a", "x", "y"), (8, "\n \n", None, "x", "y")]
    judged = line_rules(spark.createDataFrame(rows, SCHEMA), "text", "source", ["doc_id"], with_text=True)
    by_id = {r["doc_id"]: r for r in judged.collect()}
    assert all(by_id[i]["clean_text"] == "\n".join(f"own {i} {j}" for j in range(20_000)) for i in range(6))
    assert [by_id[i]["clean_text"] for i in (6, 7, 8)] == [None, "", "\n \n"]


def test_a_lines_verdict_does_not_move_with_the_host(spark):
    """A line of 51 documents goes from a host of 60 as from one of 600, a line of half a small host too, one of 4 stays."""
    rng = random.Random(4)
    rows = []
    for host, size, line_documents in (("small", 60, 51), ("large", 600, 51), ("few", 9, 5), ("even", 10, 5), ("tiny", 4, 4)):
        for i in range(size):
            lines = [" ".join(prose(rng, 60)), *["The line of the house"] * (i < line_documents)]
            rows.append((len(rows), "\n".join(lines), host, "x", "y"))
    judged = line_rules(spark.createDataFrame(rows, SCHEMA), "text", "source", ["doc_id", "source"])
    frequent = {r[0]: r[1] for r in judged.groupBy("source").agg({"n_frequent_words": "sum"}).collect()}
    assert frequent == {"small": 5 * 51, "large": 5 * 51, "few": 5 * 5, "even": 0, "tiny": 0}


def test_one_passage_in_many_surroundings(spark):
    """30 shared words in n documents repeat no window of 35; lists of windows are passed on, not a row for each."""
    rng = random.Random(6)
    passage = " ".join(prose(rng, 30))
    rows = [(i, " ".join([*(f"a{i}-{j}" for j in range(50)), passage, *(f"b{i}-{j}" for j in range(50))])) for i in range(2500)]
    docs = repeats.identified(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").repartition(4)
    anchors = repeats.Table(repeats.anchors(docs, repeats.WORDS_35))
    again = anchors.df.groupBy("seed").count().filter("count > 1").select("seed")
    candidates = repeats.Table(anchors.df.join(again, "seed", "left_semi"))
    assert candidates.df.count() >= 2500
    assert repeats.extended(candidates.df, docs, repeats.WORDS_35).count() == 0
    stretches = candidates.df.groupBy("doc", "fp").agg(F.collect_list(F.struct("start", "more", "seed")).alias("stretches"))
    listed = docs.alias("d").join(stretches.alias("s"), repeats.same_document("d", "s")).select("d.doc", "d.fp", "s.stretches", "d.text")
    bodies = repeats._stretches(listed.coalesce(4), repeats.WORDS_35).select("doc", "fp", "start", "seed", "body")
    lists = "bucket bigint, doc array<bigint>, fp array<bigint>, start array<bigint>, end array<bigint>, seed array<bigint>, window array<bigint>"
    packed = bodies.mapInArrow(repeats._packed(repeats.WORDS_35, 3), lists)
    made = packed.agg(F.count("*").alias("rows"), F.sum(F.size("window")).alias("windows")).first()
    assert made["rows"] <= 4 * 3 and made["windows"] > 20_000


def test_near_duplicates(docs, rows):
    found = near_duplicate_classes(docs, "doc_id", "text").collect()
    classes = brute.near_duplicate_classes([(r[0], r[1]) for r in rows])
    expected = {(r[0], r[1] or ""): c for r, (c, _) in zip(rows, classes, strict=True)}
    assert len(found) == len(expected) and sum(r["copies"] for r in found) == len(rows)
    same([(r["doc"], r["class_id"]) for r in found], [(d, c) for (d, _), c in expected.items()])
    assert sum(r["kept"] for r in found) == len({root for _, root in classes})


def test_deduplicated_keeps_one_whole_row(docs, rows):
    out = deduplicated(docs, "doc_id", "text")
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len({root for _, root in brute.near_duplicate_classes([(r[0], r[1]) for r in rows])})
    assert {tuple(r) for r in kept} <= set(rows)


def test_empty_tables(empty):
    assert without_repeats(empty, "doc_id", "text").count() == 0
    assert without_repeated_bytes(empty, "doc_id", "text").count() == 0
    assert line_rules(empty, "text", "source", ["doc_id"]).count() == 0
    assert near_duplicate_classes(empty, "doc_id", "text").count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(150):
        keys = rng.integers(1, 2**62, 24)
        a = {int(k): int(rng.integers(1, 20)) for k in keys[:18]}
        b = {int(k): int(rng.integers(1, 20)) for k in keys[4:]} | {k: a[k] for k in list(a)[6:14]}
        both = []
        for x in (a, b):
            ks = sorted(x)
            both.append(signatures(1, np.zeros(len(ks), dtype=int), np.array(ks, dtype=np.uint64), np.array([x[k] for k in ks]))[0])
        common = sum(min(a[k], b[k]) for k in a if k in b)
        errors.append((both[0] == both[1]).mean() - common / (sum(a.values()) + sum(b.values()) - common))
    assert abs(np.mean(errors)) < 0.012
    assert np.std(errors) < 0.06


def test_large_group_of_near_copies(spark):
    """Every copy is near the original; most are not near each other."""
    rng = random.Random(11)
    base = prose(rng, 200)
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        for at in rng.sample(range(5, 195), 3):
            words[at] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    expected = [c for c, _ in brute.near_duplicate_classes(rows)]
    assert {r["doc"]: r["class_id"] for r in found.collect()} == dict(zip(range(300), expected, strict=True))


#: Families whose pairs agree in 81 registers or more, but in none of 100 draws of 12, and in no band without the others.
FAMILIES = [
    1, 274, 335, 379, 442, 517, 546, 712, 781, 881, 981, 1347, 1416, 1449, 1520, 1584, 1607, 1665, 1793, 1892, 1898, 1967, 2070,
    2301, 2530, 2616, 2748, 2801, 2805, 3119, 3180, 3216, 3253, 3325, 3491, 3590, 3610, 3653, 3678, 3753, 3794, 3815, 3863, 4131,
]


def test_pairs_at_the_limit_among_alike_documents(spark):
    """Pairs of similarity 0.802 that meet only in large buckets, as all documents share boilerplate (similarity 0.77)."""
    rows = []
    for i in [*FAMILIES, *range(10_000, 10_030)]:
        words = [f"b{j}" for j in range(400)] + [f"o{i}x{j}" for j in range(60)]
        rows.append((2 * i, " ".join(words)))
        for at in range(404, 454, 5):
            words[at] = f"z{i}x{at}"
        rows.append((2 * i + 1, " ".join(words)))
    found = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    expected = [c for c, _ in brute.near_duplicate_classes(rows)]
    assert expected == [d - d % 2 for d, _ in rows]
    assert {r["doc"]: r["class_id"] for r in found.collect()} == {d: c for (d, _), c in zip(rows, expected, strict=True)}


def test_left_pairs_hold_all_links_and_no_boilerplate(spark):
    """Every document a component of its own: all links come up, documents that only share boilerplate never."""
    rng = random.Random(3)
    base, rows = [f"b{j}" for j in range(300)], []
    for i in range(60):
        rows.append((len(rows), " ".join(base + [f"o{i}x{j}" for j in range(70)])))
    for i in range(40):
        words = prose(rng, rng.randrange(20, 160)) * (1 + i % 3)
        for _ in range(4):
            near = list(words)
            for at in rng.sample(range(len(near)), max(1, len(near) // rng.randrange(60, 200))):
                near[at] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near[: len(near) - rng.randrange(len(near) // 10 + 1)])))
    docs = near_duplicates.identified(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    fields = "doc long, fp long, node string, size long, bands array<bigint>, octets binary"
    nodes = docs.mapInArrow(near_duplicates._signed, fields).select("node", "size", "octets", F.struct("doc", "fp").alias("one")).cache()
    meeting = nodes.select(F.lit(1).alias("band"), "node", F.col("node").alias("component"))
    place = {r["node"]: r["one"]["doc"] for r in nodes.collect()}
    octets = {r["one"]["doc"]: np.frombuffer(r["octets"], dtype=np.uint8) for r in nodes.collect()}
    pairs = {frozenset((place[r["u"]], place[r["v"]])) for r in near_duplicates._left_pairs(meeting, nodes, docs).collect()}
    bags = [brute.bag(text) for _, text in rows]
    links = set()
    for i in range(len(rows)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            alike = common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common) - 1e-9
            if alike and (octets[i] == octets[j]).sum() >= near_duplicates.LEAST_AGREEING:
                links.add(frozenset((i, j)))
    assert len(links) > 60 and links <= pairs
    assert not any(min(p) < 60 for p in pairs)


def test_differing_octets(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (200, near_duplicates.REGISTERS), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < rng.random((200, 1)), a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    octets = spark.createDataFrame([(str(i), x.tobytes()) for i, x in enumerate([*a, *b])], "node string, octets binary")
    words = {r["node"]: r["words"] for r in octets.mapInArrow(near_duplicates._in_words, "node string, words array<bigint>").collect()}
    pairs = [(words[str(i)], words[str(200 + i)], int((a[i] != b[i]).sum())) for i in range(200)]
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>, n int")
    assert df.filter(near_duplicates._differing("a", "b") != F.col("n")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    found = components(spark.createDataFrame([*edges, (None, 3), (7, None)], "u long, v long")).df.collect()
    expected = brute.components([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in found} == expected and len(found) == len(expected)


def test_least_positions_follow_content():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 500).astype(np.uint64) << np.uint64(40)
    found = least_positions(hashes, 9)
    assert found.tolist() == [i + int(np.argmin(hashes[i : i + 9])) for i in range(492)]


def test_run_hashes_tell_runs_apart():
    x = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], dtype=np.uint64)
    h = run_hashes(x, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert len(run_hashes(x, 10)) == 0


def test_queries_read_all_rows(spark):
    from mentionmill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_contamination", "op5_line_rules", "op6_substrings", "op10_suffix_index", "op3_near_duplicates"):
        assert QUERIES[name](spark, sf).agg(F.countDistinct("doc_id")).first()[0] == n
