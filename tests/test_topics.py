"""Topics by blocks of articles against a plain model."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from mentionmill.operators import topics as module

K = 3
TEXTS = ["rot rot blau", "Rot gelb 7", None, "", "blau gelb gelb grün", "einmal rot", "blau", "gelb grün rot", "nie-mals blau"]
ROWS = [(f"/{i}", TEXTS[i % 9]) for i in range(40)] + [("/1", "grün grün"), (None, "rot blau blau"), (None, "gelb"), ("/nothing", "1 2")]


def modelled():
    """Scores and topic of each article."""
    articles = defaultdict(Counter)
    for key, text in ROWS:
        articles[key] += Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
    counts = {key: words for key, words in articles.items() if words}
    name = lambda key: module.WHITESPACE if key is None else key
    own = {key: int(hashlib.md5(name(key).encode()).hexdigest()[:8], 16) % K for key in counts}
    for _ in range(module.PASSES):
        used, sizes = defaultdict(lambda: [0] * K), [0] * K
        for key, words in counts.items():
            for word, n in words.items():
                used[word][own[key]] += n
                sizes[own[key]] += n
        scores = {}
        for key, words in counts.items():
            scores[key] = [0] * K
            for word, n in words.items():
                elsewhere = sum(used[word]) - n
                for t in range(K):
                    others = used[word][t] - (n if own[key] == t else 0)
                    if used[word][t] > 0 and elsewhere > 0:
                        scores[key][t] += n * math.floor(others * module.PULL / elsewhere * (sum(sizes) * 1.0 / sizes[t]))
        own = {key: scores[key].index(max(scores[key])) if max(scores[key]) > 0 else own[key] for key in counts}
    return {key: own.get(key) for key in articles}, {name(key): scores[key] for key in counts}


@pytest.mark.parametrize("chars", [1 << 23, 60])
def test_topics_do_not_depend_on_blocks(spark, monkeypatch, chars):
    monkeypatch.setattr(module, "BLOCK_CHARS", chars, raising=False)
    fitted = module.fit_topics(spark.createDataFrame(ROWS, "url string, fulltext string"), k=K)
    own, scores = modelled()
    assert sorted(map(str, ((r["key"], r["topic"]) for r in fitted.assigned.collect()))) == sorted(map(str, own.items()))
    assert {r["id"]: r["scores"] for r in fitted.scores.collect()} == scores


def test_a_word_has_one_row_in_a_block(spark):
    """Not one row for each article that has it."""
    articles = spark.createDataFrame([(f"/{i}", "rot blau gelb") for i in range(200)], "url string, fulltext string")
    words = module.fit_topics(articles, k=4, passes=1).words
    assert words.count() == 3
    assert words.selectExpr("sum(size(numbers))").first()[0] == 600
