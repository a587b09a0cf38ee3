"""Collocations, filter audit and binary records against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mentionmill.llm import collocations as mining
from mentionmill.llm.filter_audit import filter_audit
from mentionmill.llm.records import MASK_DELTA, frame, masked_checksum, read_records, unframed, write_records
from mentionmill.llm.tokens import word_encoder
from pyspark.sql import functions as F

# The table's own columns clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, mask int, shard string, doc string, digest long, a int"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    words = ["The", "cat", "sat", "naïve", "x", "on", "mat", "rot", "#1", "日本"]
    out = [None, "", "   ", ".,;", "one", "A" * 3000, "mat. " * 400, "the cat sat on the mat\n" * 30, "cat sat, " * 50]
    out += [" ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(1, 300))) for _ in range(60)]
    out += [out[-1]] * 5 + [re.sub(" ", rng.choice([". ", "\t", "  "]), t) for t in out[-8:]]
    return out


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "de", None, "und"]
    out = [(i, t, langs[i % 4] if i % 3 else "en", 1, "s", "d", 2, 3) for i, t in enumerate(texts())]
    return out + [out[20], (None, "the cat sat", "de", 1, "s", "d", 2, 3), (None, "the cat sat", "de", 1, "s", "d", 2, 3), (7, "cat", "en", 1, "s", "d", 2, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def brute_phrases(rows, longest):
    """Occurrences of every phrase by language, and of all words."""
    found, total = Counter(), Counter()
    for r in rows:
        lang, text = r[2] or "und", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                found.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    return found, total


def brute_collocations(rows, longest=3, least=10, share=50, best=2000):
    f, n = brute_phrases(rows, longest)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in candidates.items():
        m = len(words)
        inside = any(
            100 * b >= share * a and q[0] == lang and len(q) - 1 > m and any(list(q[1 + i : 1 + i + m]) == words for i in range(len(q) - m))
            for q, b in candidates.items()
        )
        if not inside:
            cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, m)]
            score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    result = []
    for lang, group in itertools.groupby(sorted(out), key=lambda x: x[0]):
        for rank, (_, score, a, phrase, left, right) in enumerate(group, 1):
            if rank <= best:
                result.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


@pytest.mark.parametrize(("longest", "size", "best"), [(3, 8_000_000, 2000), (3, 2000, 7), (4, 5000, 2000), (2, 1, 2000)])
def test_collocations(docs, rows, longest, size, best, monkeypatch):
    monkeypatch.setattr(mining, "SHARD_BYTES", size)
    got = mining.collocations(docs, "lang", "text", max_words=longest, best=best)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, longest, best=best)


def test_phrases_and_their_extensions(docs, rows):
    """With every word frequent, extensions count all neighbours in the piece."""
    f, _ = brute_phrases(rows, 3)
    phrases, _ = mining.frequent_phrases(docs, "lang", "text", max_words=3, min_count=1)
    got = {(r["lang"], *r["phrase"].split(" ")): r for r in phrases.collect()}
    assert {k: r["a"] for k, r in got.items()} == dict(f)
    behind, before = Counter(), Counter()
    for p, n in f.items():
        if len(p) == 4:
            behind[p[:-1]] += n
            before[(p[0], *p[2:])] += n
    pairs = {k: r for k, r in got.items() if len(k) == 3}
    assert all((r["before"], r["behind"]) == (before[k], behind[k]) for k, r in pairs.items())


def test_index_counts_every_pattern():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 400)
    index = mining.FMIndex(np.append(text, 0), 3)
    symbols = np.array([1, 2, 3])
    place, known = index.roots(symbols), [(s,) for s in symbols.tolist()]
    for length in (2, 3):
        owner, symbol, place = index.extended(*place)
        known = [(*known[o], s) for o, s in zip(owner.tolist(), symbol.tolist(), strict=True)]
        words = text.tolist()
        want = Counter(tuple(words[i : i + length]) for i in range(len(words) - length + 1) if 0 not in words[i : i + length])
        assert dict(zip(known, place[2].tolist(), strict=True)) == dict(want)
        before, behind = index.extensions(*place)
        for pattern, b, e in zip(known, before.tolist(), behind.tolist(), strict=True):
            at = [i for i in range(len(words)) if tuple(words[i : i + length]) == pattern]
            assert b == sum(i > 0 and words[i - 1] > 0 for i in at) and e == sum(i + length < len(words) and words[i + length] > 0 for i in at)


def brute_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    docs = []
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (r[0] is not None and r[0] > first[t])
        marks = [x for x in labels if x[0] is not None and x[0] == r[0]]
        docs.append((r[2] or "", fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        steps = {}
        for order in itertools.permutations("ABCDE"):
            for i, x in enumerate(order):
                alive = [d for d in own if not set(order[:i]) & set(d[1])]
                here = [d for d in alive if x in d[1]]
                steps["".join(order), i + 1] = (
                    len(alive) - len(here), len(here), sum(x in d[1] for d in own) - len(here), sum(d[1] == x for d in own),
                    sum(d[2] for d in here), sum(d[3] for d in here),
                )
        shapley = Counter()
        for (order, step), values in steps.items():
            shapley[order[step - 1]] += values[1]
        out += [(part, order, step, *values, shapley[order[step - 1]]) for (order, step), values in steps.items()]
    return sorted(out)


def test_filter_audit(spark, docs, rows):
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 90, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(docs, "doc_id", "text", "lang", table)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert mining.collocations(empty, "lang", "text").count() == 0
    assert filter_audit(empty, "doc_id", "text", "lang", spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    written = write_records(empty, "doc_id", "text", WORD_BPE, 2, str(tmp_path / "records"))
    assert read_records(spark, written).count() == 0


def test_pieces_are_merged_as_the_library_does():
    """Latin letters, single characters of many scripts, special strings and control characters, alone and mixed."""
    library, own = Tokenizer.from_file(WORD_BPE), word_encoder(WORD_BPE)
    assert own.merged is not None
    rng = random.Random(2)
    letters = [chr(c) for c in range(1, 0x250)] + list("İı\u0307\u0308Σσςẞ中😀<|>'sré ") + list("etaoin é") * 20
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(8000)]
    texts += [chr(c) + tail for c in range(1, 0x2000) for tail in ("", "É1")]
    texts += ["<|endoftext|>É<|startoftext|>é", "é" * 300, "ab" * 200]
    found = library.encode_batch(texts, add_special_tokens=False)
    assert not [t for t, e in zip(texts, found, strict=True) if own.ids(t).tolist() != e.ids]


def test_runs_of_a_text_give_the_ids_of_the_whole():
    library, own = Tokenizer.from_file(WORD_BPE), word_encoder(WORD_BPE)
    rng = random.Random(2)
    letters = "abÉ'st 12\t\n\r\x0b\x0c\x1c\x85\xa0 ́Åẛ̣ΣςİßK日🙂<|endoftext|>.,#"
    samples = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "é ́e", "don't DON'T", "x" * 5000, " " * 300_000 + "a"]
    samples += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(4000)]
    plain = "abST'd m.,!#12 \x01\x1c\x7f<|>"
    samples += ["".join(rng.choices(plain, k=rng.randint(1, 40))) for _ in range(4000)] + ["\"'s ''s 's's don'tve I'LL'd a1b22'r'e <|ENDOFTEXT|>"]
    samples += [f"{chr(c)}a {chr(c)} b{chr(c)}" for c in range(0x21, 0x3000)]
    for text in samples:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_frames():
    assert masked_checksum(b"") == MASK_DELTA
    ids = np.array([1, 70, 2], dtype="<u2")
    data = frame(5, ids) + frame(None, ids[:1]) + frame(-7, ids[:0])
    at, found = 0, []
    while at < len(data):
        key, got, at = unframed(memoryview(data), at, "<u2")
        found.append((key, got.tolist()))
    assert found == [(5, [1, 70, 2]), (None, [1]), (-7, [])]
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            at = 0
            while at < len(data):
                _, _, at = unframed(memoryview(bytes(bad)), at, "<u2")
    with pytest.raises(ValueError):
        unframed(memoryview(data[:20]), 0, "<u2")


@pytest.mark.parametrize("file_bytes", [64_000_000, 500])
def test_records_round_trip(spark, docs, rows, file_bytes, monkeypatch, tmp_path):
    import mentionmill.llm.records as records

    monkeypatch.setattr(records, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(records, "BLOCK_FILES", 2)
    written = write_records(docs, "doc_id", "text", WORD_BPE, 2, f"file://{tmp_path}/records")
    got = [tuple(r) for r in read_records(spark, written).orderBy("start").collect()]
    library = Tokenizer.from_file(WORD_BPE)
    ids = {i: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for i, r in enumerate(rows)}
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert Counter((k, n, c) for k, _, n, c in got) == Counter((rows[i][0], len(x), crc(x)) for i, x in ids.items())
    keys = [k for k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))
    assert [s for _, s, _, _ in got] == [0, *itertools.accumulate(n for _, _, n, _ in got)][:-1]
    if file_bytes == 500:
        assert written.manifest.df.count() > 10


def test_damaged_file_is_an_error(spark, docs, tmp_path):
    written = write_records(docs.filter(F.col("doc_id") < 30), "doc_id", "text", WORD_BPE, 2, str(tmp_path / "records"))
    file = max((tmp_path / "records").glob("*.rec"), key=lambda p: p.stat().st_size)
    body = bytearray(file.read_bytes())
    body[len(body) // 2] ^= 1
    file.write_bytes(bytes(body))
    with pytest.raises(Exception, match="damaged|not as long"):
        read_records(spark, written).collect()
