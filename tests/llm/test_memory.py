"""How many Python workers a task holds, and how many files small tables between steps take."""

import random
import re

import pytest

from mentionmill.llm.components import components
from mentionmill.llm.packing import pack
from mentionmill.llm.queries import tokenizer_path
from mentionmill.llm.substrings import without_repeats
from mentionmill.llm.tables import Table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nested(text):
    """Whether a Python step takes its rows from another one in the same stage."""
    below = False
    for line in text.splitlines():
        if re.search(r"MapInArrow", line):
            if below:
                return True
            below = True
        elif re.search(r"Exchange|Scan|Join|Union", line):
            below = False
    return False


def files(spark, table):
    return len(spark.read.parquet(table.path).inputFiles())


@pytest.fixture()
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_task_of_substrings_holds_one_python_worker(spark, monkeypatch):
    written, init = [], Table.__init__

    def seen(self, df, *more):
        written.append(plan(df))
        init(self, df, *more)

    monkeypatch.setattr(Table, "__init__", seen)
    rng = random.Random(3)
    shared = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    rows = [(i, f"a{i} {shared} b{i} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(20 + i))) for i in range(12)]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r["n_removed"] for r in out.collect()} == {60}
    assert any("MapInArrow" in p for p in written)
    assert not any(map(nested, [*written, plan(out)]))


def test_the_plan_of_packing_needs_no_python_rows(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(30)], "doc_id long, text string")
    packed = pack(docs, "doc_id", "text", tokenizer_path(), 16)
    assert "ExistingRDD" not in plan(packed)
    assert packed.count() == 30


def test_packing_of_an_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", tokenizer_path()).collect() == []


def test_a_table_keeps_to_the_files_asked_for(spark):
    table = Table(spark.range(0, 200, 1, 40), 3)
    assert files(spark, table) == 3
    assert sorted(r["id"] for r in table.df.collect()) == list(range(200))


def test_components_of_few_edges_take_one_file(spark, many_partitions):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 10], "u long, v long")
    table = components(edges)
    assert files(spark, table) == 1
    assert {(r["node"], r["component"]) for r in table.df.collect()} == {(i, (i - 1) // 10 * 10 + 1) for i in range(1, 201)}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).df.collect() == []
