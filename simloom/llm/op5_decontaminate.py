"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside documents of any length. Items are
partitioned by the number of their distinct 5-word shingles. An item of q
shingles is represented by its bottom-s MinHash sketch, the s smallest shingle
hashes with s = q - ceil(0.75 q) + 1: a document that holds three quarters of
the item's shingles must hold one of any s of them, so no containment is missed
whatever the document's length (a fixed number of MinHash functions over whole
documents would miss short items in long ones). Each size partition has its own
hash bound, above which none of its sketches has a value; a document of too few
shingles for a partition doesn't enter it. Candidate pairs are then verified by
exact shingle containment over whole texts.

Words are runs between white space [\\x20\\x09-\\x0D] of the lower-cased text.
Native: DataFrame functions only. Broadcast are the sketches and the candidate
ids only when counted and found below ``BROADCAST_ROWS``; beyond that the joins
shuffle.

Defined results: null or empty texts, on either side, match nothing. A text of
one to four words has its whole sequence as its only shingle, so such an item
is found only in a document of these words alone. Repeated rows count once,
other columns are ignored, empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.plans import durable

WORDS, CONTAINED, BROADCAST_ROWS = 5, 0.75, 200_000
BLANK = "[\\x20\\x09-\\x0D]+"


def with_shingles(df: DataFrame, text: str = "text", out: str = "shingles") -> DataFrame:
    """``df`` with the distinct shingle hashes of whole texts instead of the texts."""
    words = F.filter(F.split(F.lower(F.col(text)), BLANK), lambda w: w != "")
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w))).where(F.size("_words") > 0).drop(text)
    w = F.col("_words")
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0)))

    def one(i: Column) -> Column:
        return F.xxhash64(*(F.coalesce(F.get(w, i + k), F.lit(0)) for k in range(WORDS)))

    return hashed.withColumn(out, F.array_distinct(F.transform(at, one))).drop("_words")


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_id, part, n_item, h): the bottom sketch of each item and its size partition."""
    sized = items.withColumn("n_item", F.size("shingles"))
    s = F.col("n_item") - F.ceil(F.col("n_item") * CONTAINED) + 1
    low = F.slice(F.array_sort("shingles"), 1, s.cast("int"))
    return sized.select("item_id", F.floor(F.log2("n_item")).cast("int").alias("part"), "n_item", F.explode(low).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document and item that it holds.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), "text").where("doc_id is not null")
    bench = durable.table(with_shingles(items.select("item_id", "text").where("item_id is not null")).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_set("shingles"))).alias("shingles")), "items")
    sketches = durable.table(item_sketches(bench), "sketches")
    parts = sketches.groupBy("part").agg(F.min("n_item").alias("least"), F.max("h").alias("top"), F.count(F.lit(1)).alias("rows")).collect()  # one row for each power of two
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared int, n_item int, containment double")
    small = sum(r["rows"] for r in parts) <= BROADCAST_ROWS
    # the hash bound of the partitions that a document is long enough for
    n = F.size("shingles")
    bound = F.greatest(*(F.when(n >= max(1, int(r["least"] * CONTAINED)), F.lit(r["top"])) for r in parts), F.lit(-(2**63)))
    probes = with_shingles(docs).withColumn("_bound", bound)
    probes = probes.select("doc_id", n.alias("n_doc"), F.explode(F.filter("shingles", lambda h: h <= F.col("_bound"))).alias("h"))
    met = probes.join(F.broadcast(sketches) if small else sketches, "h").where(F.col("n_doc") >= F.ceil(F.col("n_item") * CONTAINED))
    found = durable.table(met.select("doc_id", "item_id").distinct(), "met")
    ids = found.select("doc_id").distinct()
    held = docs.join(F.broadcast(ids) if found.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    shared = F.size(F.array_intersect("shingles", "_item"))
    checked = (
        with_shingles(held)
        .join(found, "doc_id")
        .join((F.broadcast if small else lambda x: x)(bench.withColumnRenamed("shingles", "_item")), "item_id")
        .select("doc_id", "item_id", shared.alias("n_shared"), F.size("_item").alias("n_item"))
    )
    whole = checked.where(F.col("n_shared") >= F.ceil(F.col("n_item") * CONTAINED)).distinct()
    return whole.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, whole and unchanged, whatever other columns there are; rows with a null doc_id stay."""
    leak = "_leak"
    while leak.lower() in {c.lower() for c in docs.columns}:
        leak = f"_{leak}"
    leaks = contained_items(docs, items).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks[leak], "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every leak."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], chr(1)))) AS g FROM words WHERE len(w) > 0
), items AS (
  SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE kind = 1
)
SELECT d.id AS doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item, count(*) / n_item AS containment
FROM items JOIN grams d ON d.kind = 0 AND d.g = items.g
GROUP BY d.id, item_id, n_item HAVING count(*) >= ceil(0.75 * n_item)
"""
