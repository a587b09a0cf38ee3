"""How filters interact: what each removes at each place of each order, and its Shapley share.

Documents are first reduced to mask cells: counts for each part and each set of failed filters. A recursive query then
extends the empty prefix by filters not used yet; each of its rows is a prefix with one mask and carries the bits
applied so far, so one level of the recursion holds the facts of one step. The recursion runs over masks alone
(at most 2^n of them for n filters), never over documents or parts, so its size is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionmill.llm.tables import Table


@dataclass(frozen=True)
class Filter:
    """A letter and the condition under which a document fails."""

    letter: str
    fails: Column


def text_filters(text: Column) -> list[Filter]:
    """A: under 100 words. B: distinct words under 80 % of all. C: capitals A-Z over 10 % of the code points. D: a symbol."""
    # one mark for all white space, so that the split needs no pattern
    blank = F.translate(text, "\t\n\x0b\f\r", "     ")
    words = F.array_remove(F.split(blank, " "), "")
    n_capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        Filter("A", F.size(words) < 100),
        Filter("B", 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
        Filter("C", 100 * n_capitals > 10 * F.length(text)),
        Filter("D", text.rlike("[#$%&*|]")),
    ]


def failed_masks(df: DataFrame, doc: str, text: str, part: str, letters: str, filters: list[Filter]) -> DataFrame:
    """(doc, part, mask): bit i of the mask is set if filter i fails; the last letter is the copy filter.

    That one fails a document whose text a smaller id has, wherever in the table. Copies meet as one aggregate row
    for each text and join back by text and id, so a text that a third of all rows hold is split by their ids.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    source = df.select(F.col(doc).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    own = {f.letter: f for f in filters}
    bits = [F.when(own[x].fails, F.lit(1 << i)).otherwise(0) for i, x in enumerate(letters[:-1])]
    mask = sum(bits[1:], bits[0])
    rows = source.select("doc", "part", mask.cast("int").alias("mask"), F.md5("text").alias("digest"))
    first = rows.filter("doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    is_copy = F.col("doc").isNotNull() & F.col("first").isNull()
    copy = F.when(is_copy, F.lit(1 << (len(letters) - 1))).otherwise(0)
    return rows.join(first, ["digest", "doc"], "left").select("doc", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """(part, mask, docs, good, toxic): documents, and those that ``labels`` (doc, quality, toxic) call good or toxic."""
    marks = labels.groupBy(F.col(doc).alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    return masks.join(marks.filter("doc IS NOT NULL"), "doc", "left").groupBy("part", "mask").agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def step_facts(spark: SparkSession, cells: DataFrame, letters: str) -> DataFrame:
    """For each prefix of each order and each mask: step, letter, and whether the mask is kept, removed or redundant there."""
    n = len(letters)
    unused = ", ".join(
        f"({applied}, '{x}', {1 << i}, {applied | 1 << i})"
        for applied in range(1 << n)
        for i, x in enumerate(letters)
        if not applied >> i & 1
    )
    return spark.sql(
        f"""
        WITH RECURSIVE
          unused(applied, letter, bit, after) AS (VALUES {unused}),
          masks AS (SELECT DISTINCT mask FROM {{cells}}),
          walk(prefix, letter, step, applied, mask, kept, removed, redundant) AS (
            SELECT '', '', 0, 0, mask, true, false, false FROM masks
            UNION ALL
            SELECT concat(w.prefix, u.letter), u.letter, w.step + 1, u.after, m.mask,
                   m.mask & u.after = 0,
                   w.kept AND m.mask & u.bit <> 0,
                   NOT w.kept AND m.mask & u.bit <> 0
            FROM walk w JOIN unused u ON w.applied = u.applied JOIN masks m ON w.mask = m.mask
          )
        SELECT * FROM walk WHERE step > 0
        """,
        cells=cells,
    )


def filter_audit(
    df: DataFrame, doc: str, text: str, part: str, labels: DataFrame, filters: list[Filter] | None = None
) -> DataFrame:
    """One row for each part, order of the filters and step, with what happens at that step; zeros included.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. The
    filters are ``filters`` (by default the four of ``text_filters``) and, as the last letter, the copy filter. A null
    text is empty, a null part the empty string; a row with a null id is no copy and makes none, and has no label.
    Repeated rows count one by one and are no copies of each other, as their ids are equal; of several labels for an
    id any 1 counts. Texts of any length are judged whole. An empty table gives no rows. Columns of the table do not
    clash, as only the named ones are read.
    """
    filters = text_filters(F.col("text")) if filters is None else filters
    letters = "".join(f.letter for f in filters)
    letters += next(x for x in "EFGHIJKLMNOPQRSTUVWXYZABCD" if x not in letters)
    n = len(letters)
    cells = Table(mask_cells(failed_masks(df, doc, text, part, letters, filters), labels, doc))
    facts = step_facts(df.sparkSession, cells.df, letters)
    here = {c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)) for c in ("kept", "removed", "redundant")}
    lost = {f"{c}_lost": F.sum(F.when(F.col("removed"), F.col(c)).otherwise(0)) for c in ("good", "toxic")}
    only = F.element_at(F.create_map(*(F.lit(v) for i, x in enumerate(letters) for v in (x, 1 << i))), F.col("letter"))
    steps = Table(
        cells.df.join(facts, "mask").groupBy("part", "prefix", "letter", "step").agg(
            *(v.alias(k) for k, v in (here | lost).items()),
            F.sum(F.when(F.col("mask") == only, F.col("docs")).otherwise(0)).alias("unique_fails"),
        )
    )
    # as many whole orders begin with a prefix as the filters left can be arranged
    orders = F.element_at(F.array(*(F.lit(factorial(n - s)) for s in range(1, n + 1))), F.col("step"))
    shapley = steps.df.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = steps.df.filter(F.col("step") == n).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    )
    reached = whole.withColumn("prefix", F.col("filter_order").substr(F.lit(1), F.col("step")))
    return reached.join(steps.df.drop("step"), ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
    )
