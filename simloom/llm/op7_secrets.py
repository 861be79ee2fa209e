"""Secret scans: fixed patterns, and a randomness test battery for the rest.

The patterns give the base spans, found leftmost and without overlap for each
kind. The battery looks at all other runs of 20 or more characters of
[A-Za-z0-9+/_-]. Each is read in the smallest encoding that holds it (decimal,
hex, one or two cases of letters, base32, base36, base62, base64) and gets three
tests of the hypothesis that its symbols are drawn at random: chi-squared
uniformity over the alphabet (symbols pooled so that each cell expects five,
hence as fine as the length allows), the runs test about the alphabet's middle,
and lag-one serial correlation, combined by Fisher's method. A fourth, serial,
test takes the opposite hypothesis, that the token is ordinary: by how much pairs of
neighbouring letters and digits are likelier when drawn at random than in the
corpus' own words of up to 19 characters. A likelihood ratio of r has a p-value
of 1/r at most, whatever the length.

Among the tokens of each length band (powers of two) Benjamini-Hochberg at level
``FDR`` rejects the ordinary, so of the tokens reported at most that share is
expected to be ordinary; and it rejects the random among the three other tests,
which dismisses patterns. Reported are, as ``random_<encoding>``, tokens for
which the first is rejected and the second is not.

Native: DataFrame functions only. A text is cut at a pattern's matches, so
positions are sums of lengths of pieces, in code points. Broadcast are limits of
one row for each length band; the driver holds the counts of 36 x 37 pairs.

Defined results: a null text is an empty one, without spans. Added spans that
touch a base span are left out. Where the corpus has no words, all pairs are
equally likely and nothing is reported beyond the base spans. Repeated rows give repeated results and a null
doc_id is kept. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.plans import durable

# The base patterns, and the alphabets of the encodings.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"  # the runs AKIA[A-Z0-9]+ of 16 or more
HEX = "[0-9a-f]{32,}"  # the runs [0-9a-f]+ of 32 or more
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ENCODINGS = {  # pattern, alphabet, whether case doesn't count, letters and digits when it doesn't
    "base10": ("^[0-9]+$", "0123456789", False, 10),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", True, 16),
    "base26": ("^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", True, 26),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", False, 32),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", True, 36),
    "base52": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", False, 26),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", False, 36),
    "base64": ("^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False, 36),
}
SYMBOLS, LONGEST, FLOOR, PRIOR = "0123456789abcdefghijklmnopqrstuvwxyz", 19, 0.1, 0.1  # of the model of ordinary pairs
FDR, GRID = 0.05, 64  # GRID cells for each factor e of the p-value

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _matches(text: Column, pattern: str, kind: Column | str, rank: int, guard: Column, keep=None) -> Column:
    """The spans of a pattern's matches as structs (start, rank, end, kind)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("piece"), found.alias("match"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
        one = F.array(span).cast(SPAN)
        kept = one if keep is None else F.when(keep(x["match"]), one).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(acc["spans"], kept).alias("spans"))

    return F.when(guard, F.aggregate(steps, empty, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, lowered: Column) -> dict[str, Column]:
    """The base spans of each kind."""
    keyword = lowered.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        keyword |= lowered.contains(k)
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    return {
        "assign": _matches(text, ASSIGN, "assign", 0, keyword, long_value),
        "access": _matches(text, ACCESS, "access", 1, text.contains("AKIA")),
        "hex": _matches(text, HEX, "hex", 2, text.rlike(HEX)),
    }


def _tail(z: Column) -> Column:
    """Two-sided normal tail, by the logistic approximation."""
    a = F.abs(z)
    return F.greatest(F.lit(1e-300), 2 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * a + 0.07056 * a * a * a))))


def with_randomness(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with the encoding and the combined p-value of randomness of column ``token``."""
    t = F.col(token)
    encoding, alphabet, shown = F.lit("base64"), F.lit(ENCODINGS["base64"][1]), F.translate(t, "-_", "+/")
    for name in list(ENCODINGS)[-2::-1]:
        pattern, letters, fold, _ = ENCODINGS[name]
        encoding = F.when(t.rlike(pattern), F.lit(name)).otherwise(encoding)
        alphabet = F.when(t.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        shown = F.when(t.rlike(pattern), F.lower(t) if fold else t).otherwise(shown)
    df = tokens.withColumn("encoding", encoding).withColumn("_abc", alphabet).withColumn("_shown", shown)
    chars = F.filter(F.split("_shown", ""), lambda c: c != "")
    df = df.withColumn("_x", F.transform(chars, lambda c: (F.instr(F.col("_abc"), c) - 1).cast("double")))
    df = df.withColumn("_k", F.length("_abc").cast("double")).withColumn("_n", F.size("_x").cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    x, k, n = F.col("_x"), F.col("_k"), F.col("_n")
    df = df.withColumn("_cells", F.least(k, F.greatest(F.lit(2.0), F.floor(n / 5).cast("double"))))
    df = df.withColumn("_cell", F.transform("_x", lambda v: F.floor(v * F.col("_cells") / F.col("_k"))))
    df = df.withColumn("_counts", F.transform(F.sequence(F.lit(0).cast("long"), F.col("_cells").cast("long") - 1), lambda c: F.size(F.filter("_cell", lambda v: v == c)).cast("double")))
    df = df.withColumn("_wide", F.transform(F.sequence(F.lit(0).cast("long"), F.col("_cells").cast("long") - 1), lambda c: F.ceil((c + 1) * k / F.col("_cells")) - F.ceil(c * k / F.col("_cells"))))
    chi = total(F.transform(F.arrays_zip("_counts", "_wide"), lambda v: F.pow(v["_counts"] - n * v["_wide"] / k, 2) / (n * v["_wide"] / k)))
    dof = F.col("_cells") - 1
    wilson = (F.pow(chi / dof, 1 / 3) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    df = df.withColumn("_z1", F.greatest(F.lit(0.0), wilson))
    high = F.transform(x, lambda v: (v >= k / 2).cast("int"))
    df = df.withColumn("_high", high)
    n1 = total(F.transform("_high", lambda v: v.cast("double")))
    n0 = n - n1
    runs = 1 + total(F.transform(F.arrays_zip(F.slice("_high", 1, F.size("_high") - 1).alias("a"), F.slice("_high", 2, F.size("_high") - 1).alias("b")), lambda v: (v["a"] != v["b"]).cast("double")))
    mean = 2 * n1 * n0 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    df = df.withColumn("_z2", F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.lit(40.0)))
    df = df.withColumn("_m", total(x) / n)
    spread = total(F.transform("_x", lambda v: F.pow(v - F.col("_m"), 2)))
    lag = total(F.transform(F.arrays_zip(F.slice("_x", 1, F.size("_x") - 1).alias("a"), F.slice("_x", 2, F.size("_x") - 1).alias("b")), lambda v: (v["a"] - F.col("_m")) * (v["b"] - F.col("_m"))))
    df = df.withColumn("_z3", F.when(spread > 0, (lag / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0)))
    half = -(F.log(_tail(F.col("_z1"))) + F.log(_tail(F.col("_z2"))) + F.log(_tail(F.col("_z3"))))
    df = df.withColumn("_half", half)
    h = F.col("_half")
    df = df.withColumn("log_p", F.least(F.lit(0.0), -h + F.log(1 + h + h * h / 2)))
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def ordinary_pairs(texts: DataFrame) -> list[float]:
    """Log likelihood of each pair of SYMBOLS in the words of column ``text``, after the first of them, row by row.

    Words may go on in one another, as in names, so the end of a word counts only
    after a digit: longer numbers are less likely. A share FLOOR is uniform.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).where(F.length("word").between(2, LONGEST))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    at = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("word"))))
    pairs = at.groupBy(F.substr("word", F.col("i"), F.lit(1)).alias("a"), F.substr("word", F.col("i") + 1, F.lit(1)).alias("b")).agg(F.sum("n").alias("n"))
    n = {(r["a"], r["b"]): r["n"] for r in pairs.collect()}  # 36 x 37 rows at most
    out = []
    for a in SYMBOLS:
        told = {b: n.get((a, b), 0) + PRIOR for b in SYMBOLS}
        total = sum(told.values()) + (n.get((a, ""), 0) if a.isdigit() else 0)
        out += [math.log((1 - FLOOR) * told[b] / total + FLOOR / len(SYMBOLS)) for b in SYMBOLS]
    return out


def with_ordinariness(tokens: DataFrame, pairs: list[float], token: str = "token") -> DataFrame:
    """``tokens`` (with encoding) with log_ordinary: the log p-value of the token under the model of ordinary ``pairs``."""
    chars = F.filter(F.split(F.lower(F.col(token)), ""), lambda c: c != "")
    df = tokens.withColumn("_x", F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1))
    both = F.arrays_zip(F.slice("_x", 1, F.size("_x") - 1).alias("a"), F.slice("_x", 2, F.size("_x") - 1).alias("b"))
    size = F.lit(0.0)
    for name, (*_, k) in ENCODINGS.items():
        size = F.when(F.col("encoding") == name, F.lit(math.log(k))).otherwise(size)
    table = F.array(*map(F.lit, pairs))
    one = lambda v: F.when((v["a"] >= 0) & (v["b"] >= 0), F.get(table, v["a"] * len(SYMBOLS) + v["b"]) + F.col("_k")).otherwise(F.lit(0.0))
    ratio = F.aggregate(F.transform(both, one), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("_k", size).withColumn("log_ordinary", F.least(F.lit(0.0), ratio)).drop("_x", "_k")


def _rejected(tokens: DataFrame, log_p: str, fdr: float) -> DataFrame:
    """(band, limit): the cell of the p-value grid from which on Benjamini-Hochberg rejects in each band; null if nowhere."""
    counts = tokens.groupBy("band", _cell(log_p).alias("cell")).count()
    w = Window.partitionBy("band")
    below = F.sum("count").over(w.orderBy(F.desc("cell")))  # tokens with a p-value no larger
    ranked = counts.withColumn("met", F.exp(-F.col("cell") / GRID) <= fdr * below / F.sum("count").over(w))
    return ranked.groupBy("band").agg(F.min(F.when(F.col("met"), F.col("cell"))).alias("limit"))


def _cell(log_p: str) -> Column:
    return F.least(F.floor(-F.col(log_p) * GRID).cast("long"), F.lit(700 * GRID))


def random_tokens(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """The rows of ``tokens`` (with log_p, log_ordinary and token) that are not ordinary, but may be random."""
    banded = tokens.withColumn("band", F.floor(F.log2(F.length("token"))).cast("int"))
    odd, patterned = (_rejected(banded, c, fdr).withColumnRenamed("limit", c2) for c, c2 in (("log_ordinary", "_odd"), ("log_p", "_patterned")))
    both = banded.join(F.broadcast(odd), "band").join(F.broadcast(patterned), "band")
    kept = (_cell("log_ordinary") >= F.col("_odd")) & (F.col("_patterned").isNull() | (_cell("log_p") < F.col("_patterned")))
    return both.where(kept).drop("band", "_odd", "_patterned")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` of every row with its base spans by kind, and all ``spans`` in order."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    same = F.xxhash64("text")
    cut = rows.where(F.col("text").rlike(TOKEN)).select("doc_id", same.alias("text_key"), "text", F.explode(_matches(F.col("text"), TOKEN, "", 3, F.lit(True))).alias("_s"))
    cut = cut.select("doc_id", "text_key", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.substring(F.col("text"), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("token")).distinct()
    tested = durable.table(with_ordinariness(with_randomness(cut), ordinary_pairs(rows.select("text"))), "tokens")
    added = random_tokens(tested).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(F.col("start"), F.lit(3).alias("rank"), F.col("end"), F.concat(F.lit("random_"), F.col("encoding")).alias("kind"))).alias("_added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "_added")
    folded = rows.withColumn("lowered", F.lower("text"))  # a step of its own, so that it is worked out once
    base = folded.select("doc_id", same.alias("text_key"), *(c.alias(k) for k, c in base_spans(F.col("text"), F.col("lowered")).items()))
    both = base.join(added, base["doc_id"].eqNullSafe(added["_id"]) & (base["text_key"] == added["_text"]), "left")
    both = both.withColumn("_base", F.array_sort(F.concat("assign", "access", "hex")))
    free = F.filter(F.coalesce("_added", F.array().cast(SPAN)), lambda a: ~F.exists("_base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return both.select("doc_id", "assign", "access", "hex", F.col("_base").alias("base"), F.array_sort(F.concat("_base", free.cast(SPAN))).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, numbers of base spans, their digest, and all spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
