"""URL filters: rules by host and path, and a learned verdict on names for the urls that no rule fits.

Host word segmentation: names written together (cheappillsonline) are split by
a Viterbi search under a unigram model of words; multinomial naive Bayes over
the words of host and path, learned from the urls that rules judge, then
allows or blocks the others.

The unigram model is a table of word counts, of any size: a name asks for all
its substrings of up to ``WORD`` letters, and only the words found travel to it.
A letter string of n letters that is no word counts 10 / (N 10^n) of N words.
Names of more than ``NAME`` letters, which no host has, are split piece by piece.
Tokens are runs of letters, split into words, and runs of digits, all of which are one token.
Joins on substrings, names and words give the keys that hold more than a
``HOT``-th of the rows, at most ``HOT`` of them, ``SALTS`` places each.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged by the prior odds alone. Of several rules that fit the longest
wins, of equally long ones the first. Odds of 0 or less allow, so
without any labelled url all are allowed. Repeated rows get one verdict each and
weigh each in learning; a null page_id is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm import kernels
from simloom.plans import durable

WORD, NAME, HOT, SALTS = 24, 63, 1000, 64
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule for the host or a domain above it whose path begins the url's; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has a row a key; keys of many rows are spread over ``SALTS`` places."""
    counts = durable.table(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") * HOT > total).select(F.col(key).alias("_key")))  # HOT rows at most
    salt = F.when(F.col("_key").isNotNull(), F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_salt", salt).drop("_key")
    places = F.when(F.col("_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(places)).drop("_key")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def words_of_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of the text between the tags of all pages, in lower case."""
    text = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^<>]*>|&#?[A-Za-z0-9]+;", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("\\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.length("word") <= WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(n: int, found: list[tuple[int, int, float]], unknown: float) -> list[int]:
    """Ends of the words of the likeliest split of ``n`` letters; of equal ones that with the longer last word.

    ``found`` has (start, end, log probability); n unknown letters together count unknown - n log 10.
    """
    known = {(i, j): p for i, j, p in found}
    best, back = [0.0], [0]
    for j in range(1, n + 1):
        told = [(best[i] + known.get((i, j), unknown - (j - i) * np.log(10)), -i) for i in range(max(0, j - WORD), j)]
        p, i = max((round(p, 9), i) for p, i in told)
        best.append(p)
        back.append(-i)
    out, j = [], n
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct ``names`` under the unigram model ``counts`` (word, n)."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    pieces = names.select("name").distinct().withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((F.length("name") - 1) / NAME).cast("int"))))
    pieces = durable.table(pieces.withColumn("piece", F.substr("name", F.col("_at") * NAME + 1, F.lit(NAME))), "pieces")
    parts = pieces.select("piece").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)))
    parts = parts.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + WORD, F.length("piece")))))
    parts = parts.withColumn("word", F.substr("piece", F.col("i") + 1, F.col("j") - F.col("i")))
    found = looked_up(parts, counts.select("word", F.log(F.col("n") / total).alias("p")), "word")
    held = found.groupBy("piece").agg(F.collect_list(F.struct("i", "j", "p")).alias("found"))  # NAME x WORD at most
    asked = pieces.select("piece").distinct().join(held, "piece", "left")
    unknown = float(np.log(10 / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece, held in zip(batch.column("piece").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ends = best_split(len(piece), [(f["i"], f["j"], f["p"]) for f in held or []], unknown)
                out.append([piece[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(out, pa.list_(pa.string()))], ["piece", "words"])

    split = asked.mapInArrow(run, "piece string, words array<string>")
    whole = pieces.join(split, "piece").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_at", "words"))).alias("w"))
    return whole.select("name", F.flatten(F.transform("w", lambda x: x["words"])).alias("words"))


def url_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(url_key, word): the words of host and path of ``urls`` (url_key, host, path), repeated ones too."""
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("\\p{L}+|\\p{N}+"), F.lit(0))
    tokens = urls.select("url_key", F.explode(F.concat(runs(F.col("host")), runs(F.col("path")))).alias("name"))
    tokens = durable.table(tokens.withColumn("name", F.when(F.col("name").rlike("^\\p{N}"), F.lit("0")).otherwise(F.col("name"))), "tokens")
    split = segmented(tokens.where("name <> '0'"), counts).unionByName(urls.sparkSession.createDataFrame([("0", ["0"])], "name string, words array<string>"))
    return looked_up(tokens, split, "name").select("url_key", F.explode("words").alias("word"))


def train(words: DataFrame, labelled: DataFrame) -> tuple[DataFrame, float, float]:
    """Weights (word, weight), the weight of other words, and the prior log odds of block against allow.

    ``words`` is as :func:`url_words` gives it, ``labelled`` (url_key, verdict, n) says how often each url counts.
    """
    per = words.groupBy("url_key", "word").agg(F.count(F.lit(1)).alias("k")).join(labelled, "url_key")
    side = lambda v, x: F.sum(F.when(F.col("verdict") == v, x).otherwise(F.lit(0).cast("long")))
    counts = durable.table(per.groupBy("word").agg(*(side(v, F.col("k") * F.col("n")).alias(v) for v in ("allow", "block"))), "weights")
    sums = counts.agg(F.count(F.lit(1)), F.sum("allow"), F.sum("block")).first()
    size, allow, block = sums[0] + 1, sums[1] or 0, sums[2] or 0
    other = float(np.log((allow + size) / (block + size)))
    prior = labelled.agg(side("allow", F.col("n")), side("block", F.col("n"))).first()
    return counts.select("word", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + other).alias("weight")), other, float(np.log(((prior[1] or 0) + 1) / ((prior[0] or 0) + 1)))


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]], counts: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict, and the log odds of block for those without a rule.

    ``counts`` (word, n) is the unigram model. Columns of these names are replaced.
    """
    taken = {"host", "path", "rule", "verdict", "odds"}
    names = [c for c in pages.columns if c.lower() not in taken]
    fits, at_host, at_path = (kernels.unused(c, names) for c in ("_rule", "_host", "_path"))
    told = pages.select(*(F.col(f"`{c}`") for c in names), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    told = told.withColumn(fits, rule_of(F.col("host"), F.col("path"), rules))
    urls = told.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.first(f"{fits}.verdict").alias("verdict"))
    urls = durable.table(urls.withColumn("url_key", F.monotonically_increasing_id()), "urls")
    words = durable.table(url_words(urls.select("url_key", "host", "path"), counts), "words")
    weights, other, prior = train(words, urls.where("verdict is not null").select("url_key", "verdict", "n"))
    asked = urls.where("verdict is null").select("url_key", F.col("host").alias(at_host), F.col("path").alias(at_path))
    per = looked_up(words.join(asked.select("url_key"), "url_key", "left_semi"), weights, "word", "left")
    odds = per.groupBy("url_key").agg(F.sum(F.coalesce("weight", F.lit(other))).alias("odds"))
    odds = durable.table(asked.join(odds, "url_key", "left").select(at_host, at_path, F.round(F.coalesce("odds", F.lit(0.0)) + prior, 6).alias("odds")), "odds")
    both = told.join(odds, F.col(fits).isNull() & (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left")
    learned = F.when(F.col("odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return both.select(*(F.col(f"`{c}`") for c in names), "host", "path", F.col(f"{fits}.rule").alias("rule"), F.coalesce(f"{fits}.verdict", learned).alias("verdict"), "odds")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; words are counted in the pages' own texts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    counts = durable.table(words_of_html(pages), "counts")
    return filtered(pages.select("page_id", "url"), RULES, counts).select("page_id", "host", "path", "rule", "verdict", "odds")
