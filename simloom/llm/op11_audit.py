"""Filter interaction audit: what each filter removes at each place of each order of the filters.

Long-form window evaluation. Documents become mask cells, one row for each part
and set of failed filters with its counts. Cells are unpivoted against the
steps of every order; a running bit-or window over the steps before tells
whether a cell was removed earlier, conditional sums over the cells of a step
give its counts, and a window over all steps of a filter its total over orders.

A copy fails by its text: rows are counted by id first, then by text and part,
so that a text, a source or an id that holds a third of all rows is a few rows
wherever its key meets. Only counts leave that point: 2^filters cells a part.

Defined results: a null text is empty, a null source is the part of the empty
string. Rows with a null doc_id have no labels, are never a copy of a smaller
one and make no other row one. Repeated rows count each; those of one doc_id
aren't copies of each other. A document is good or toxic if any of its label
rows says 1. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails: too short, repetitive, shouting, with markup signs."""
    words = F.array_remove(F.split(text, BLANK), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by source and failed filters.

    Bit i of the mask is the i-th of ``failures``, conditions on column text; the
    bit after them says that a smaller doc_id has the same text.
    """
    failures = text_failures(F.col("text")) if failures is None else failures
    copy = 1 << len(failures)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures.values())), F.lit(0))
    told = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same"), mask.alias("mask"))
    counted = told.groupBy("doc_id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("docs"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("marked")).agg(says("quality").alias("is_good"), says("toxic").alias("is_toxic"))
    # rows without an id go anywhere: they have no labels
    known = counted.withColumn("at", F.coalesce("doc_id", F.xxhash64("same"))).join(marks, F.col("at") == F.col("marked"), "left")
    number = lambda c: F.when(F.col("doc_id").isNotNull() & F.col(c), F.col("docs")).otherwise(F.lit(0).cast("long"))
    known = known.select("doc_id", "part", "same", "mask", "docs", number("is_good").alias("good"), number("is_toxic").alias("toxic"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS)))
    texts = known.groupBy("same", "part", "mask").agg(first.alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("docs"))), F.lit(0)).alias("nameless"), *(F.sum(c).alias(c) for c in COUNTS))
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("same")))  # a row for each part that has the text
    leads = F.col("first.doc_id") == F.col("least")
    kept = {c: F.when(leads, F.col(f"first.{c}")).otherwise(F.lit(0).cast("long")) + (F.col("nameless") if c == "docs" else 0) for c in COUNTS}
    both = F.array(F.struct("mask", *(kept[c].alias(c) for c in COUNTS)), F.struct((F.col("mask") + copy).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in COUNTS)))
    return texts.select("part", F.inline(both)).where("docs > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(cells: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    ``cells`` is as :func:`mask_cells` gives it; ``filters`` has a letter for each bit.
    """
    orders = ["".join(p) for p in permutations(filters)]
    steps = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.substr(F.col("filter_order"), F.col("step"), F.lit(1)))
    bit = F.get(F.array(*(F.lit(1 << i) for i in range(len(filters)))), F.instr(F.lit(filters), F.col("filter")) - 1)
    steps = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("gone", F.coalesce(F.bit_or("fails").over(before), F.lit(0)) != 0)
    met = F.col("fails") != 0
    some = lambda when, c="docs": F.sum(F.when(when, F.col(c)).otherwise(F.lit(0).cast("long")))
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        some(~F.col("gone") & ~met).alias("kept"),
        some(~F.col("gone") & met).alias("removed"),
        some(F.col("gone") & met).alias("redundant"),
        some(F.col("mask") == F.col("bit")).alias("unique_fails"),
        some(~F.col("gone") & met, "good").alias("good_lost"),
        some(~F.col("gone") & met, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over every document, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(mask_cells(docs, labels), "ABCDE")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM words LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, f, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM docs GROUP BY part, f
), orders AS (
  SELECT x AS o FROM unnest(string_split('A,B,C,D,E', ',')) t(x)
  UNION ALL
  SELECT o || x FROM orders, unnest(string_split('A,B,C,D,E', ',')) t(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o AS filter_order, s::INT AS step, o[s] AS filter, ascii(o[s]) - 64 AS i, list_transform(string_split(o[1:s-1], ''), lambda c: ascii(c) - 64) AS earlier FROM orders, range(1, 6) t(s) WHERE length(o) = 5
), long AS (
  SELECT *, f[i] AS met, step > 1 AND len(list_filter(earlier, lambda e: f[e])) > 0 AS gone FROM cells, steps
), told AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT met), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND met), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND met), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (met AND len(list_filter(f, lambda x: x)) = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND met), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND met), 0)::BIGINT AS toxic_lost
  FROM long GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told
"""
