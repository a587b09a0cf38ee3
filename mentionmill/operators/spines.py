"""Date and issue sequences to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Issues per year and the address of an issue.
ISSUES_PER_YEAR = 55
ISSUE_URL = "https://www.zeit.de/%d/%02d/index"


def date_spine(spans: DataFrame, start: str = "start_date", end: str = "end_date", name: str = "day") -> DataFrame:
    """Days after ``start`` up to and including ``end``, one row each."""
    days = F.when(
        F.col(start) < F.col(end), F.sequence(F.date_add(F.col(start), 1), F.col(end), F.expr("INTERVAL 1 DAY"))
    )
    rest = [c for c in spans.columns if c not in (start, end)]
    return spans.select(*rest, F.explode(days).alias(name))


def issue_spine(spans: DataFrame, url_format: str = ISSUE_URL) -> DataFrame:
    """Issues from ``(start_year, start_issue)`` to ``(end_year, end_issue)``, one row each."""

    def ordinal(year: str, issue: str):
        return F.col(year).cast("bigint") * ISSUES_PER_YEAR + F.col(issue) - 1

    first, last = ordinal("start_year", "start_issue"), ordinal("end_year", "end_issue")
    bounds = ("start_year", "start_issue", "end_year", "end_issue")
    rest = [c for c in spans.columns if c not in bounds]
    year = F.floor(F.col("_n") / ISSUES_PER_YEAR).cast("bigint")
    issue = (F.pmod("_n", F.lit(ISSUES_PER_YEAR)) + 1).cast("bigint")
    return spans.select(*rest, F.explode(F.when(first <= last, F.sequence(first, last))).alias("_n")).select(
        *rest, year.alias("year"), issue.alias("issue"), F.format_string(url_format, year, issue).alias("url")
    )
