"""Time the headline queries and print one JSON line.

Each query runs whole and in full (every row and column is produced) once to warm up and three times
for the median. Tables of a cluster lie in many files, the given ones in one file of one row group, which one core
reads. So the tables are first written in several files, and those are timed; ``queries_one_file`` has one run of each
query over the tables as given, after the others.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import tempfile
import time

from mentionmill.session import build_session
from suite.queries import QUERIES

HEADLINE = [
    "mentions_per_week",
    "mentions_per_section_per_week",
    "mentions_per_section_per_sentiment_per_week",
    "mentions_per_week_years",
    "mentions_per_week_enriched",
    "merge_facts",
    "merge_facts_counts",
    "merge_sentiment",
    "dedupe_mentions",
    "catalog_ids",
    "page_links",
    "page_text",
    "section_carry",
    "full_view",
    "token_context",
    "lexicon_hits",
    "sentiment_compound",
    "evaluation",
    "mean_sentence_score",
    "link_entities",
    "linked_mentions_per_week",
    "batch_score",
    "scoring_input",
    "topics",
    "topic_summary",
    "attach_by_text",
    "membership_count",
    "many_to_one",
]


FILE_BYTES = 1 << 20


def in_several_files(spark, sf_dir: str, most: int) -> str:
    """A folder with the same tables, those over a megabyte in up to ``most`` files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in pathlib.Path(sf_dir).glob("*.parquet"):
        files = min(most, 1 + table.stat().st_size // FILE_BYTES)
        spark.read.parquet(str(table)).repartition(files).write.parquet(f"{folder}/{table.name}")
    return folder


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]", app_name="bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("OFF")
    spread = in_several_files(spark, sf_dir, int(cpus))
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        taken = [timed(spark, name, spread) for _ in range(runs + 1)]
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    one_file = {name: round(timed(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")),
                "value_one_file": round(sum(one_file.values()), 3),
                "queries_one_file": one_file,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
