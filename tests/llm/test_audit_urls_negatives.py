"""The filter audit, the URL filters and the hard negatives against plain loops."""

import collections
import functools
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import op11_audit, op12_urls, op13_negatives

RNG = np.random.default_rng(11)
ROWS = "doc_id long, text string, source string, removed string, part string, mask int"


def audit_rows():
    some = ["word%d" % i for i in range(90)]
    long = " ".join(some[:70])
    texts = [None, "", " \n\t", "one two", long, f"{long} # more", "A B C " * 30, "a " * 60, long.upper(), f"{long}\u3000x", "x" * 200_000, " ".join(some)]
    rows = [(i, texts[int(t)], [None, "", "s", "t"][int(s)]) for i, (t, s) in enumerate(zip(RNG.integers(0, len(texts), 90), RNG.integers(0, 4, 90), strict=True))]
    return [*rows, (3, long, "s"), (3, long, "t"), (None, long, "t"), (None, None, None), rows[5], rows[5]]


def brute_audit(rows, labels):
    space = re.compile("[\x20\x09-\x0d]+")
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in space.split(t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((s or "", fails, any(l[0] == i and l[1] == 1 for l in labels if i is not None), any(l[0] == i and l[2] == 1 for l in labels if i is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [d for d in own if not any(d[1][x] for x in order[:k])]
                gone = [d for d in own if any(d[1][x] for x in order[:k])]
                hit = [d for d in left if d[1][f]]
                shapley[f] += len(hit)
                out[part, order, k + 1, f] = [len(left) - len(hit), len(hit), sum(d[1][f] for d in gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit)]
        for key in [x for x in out if x[0] == part]:
            out[key].append(shapley[key[3]])
    return out


def test_audit(spark):
    """Nulls, empty and long texts, repeated rows and ids, rows without ids, repeated labels, clashing columns."""
    rows = audit_rows()
    labels = [(1, 1, 0), (1, 0, None), (2, None, 1), (3, 1, 1), (3, 1, 1), (None, 1, 1), (4, 0, 0), (1000, 1, 1), *((i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(10, 80))]
    docs = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], ROWS)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, docs string")
    got = op11_audit.audit(op11_audit.mask_cells(docs, marks), "ABCDE").collect()
    assert {tuple(r)[:4]: list(r)[4:] for r in got} == brute_audit(rows, labels) and len(got) == 3 * 600
    assert op11_audit.audit(op11_audit.mask_cells(docs.limit(0), marks), "ABCDE").count() == 0
    none = op11_audit.audit(op11_audit.mask_cells(docs, marks.limit(0)), "ABCDE").agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0]
    assert none == 0


def test_audit_sql(spark):
    """The SQL of the query on the same rows, those with an id."""
    rows = [r for r in audit_rows() if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE labels AS SELECT range AS doc_id, (range % 2)::INT AS quality, (range % 3 = 0)::INT AS toxic FROM range(20, 60)")
    want = con.execute(f"SELECT part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({op11_audit.ORACLE})").fetchall()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(20, 60)]
    assert {r[:4]: list(r[4:]) for r in want} == brute_audit(rows, labels)


def test_host_and_path(spark):
    urls = [None, "", "example.com/en/", "http://A.Example.COM/En/x?y=/z#t", "https://x.net", "https://x.net?a=/es/", "ftp://u@h:80/a/b#c?d", "a://b://c/d", "x\n://Net/es/1", "http:///es/", "http://É.com/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(op12_urls.host_of(F.col("u")).alias("h"), op12_urls.path_of(F.col("u")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/En/x"), ("x.net", ""), ("x.net", ""), ("u@h:80", "/a/b"), ("b:", "//c/d"), ("net", "/es/1"), ("", "/es/"), ("É.com", "/")]


def test_rules(spark):
    """The longest rule that fits, the first of equally long ones; hosts and domains above them only."""
    rules = [*op12_urls.RULES, ("block", "tie.org", "/a"), ("allow", "tie.org", "/a")]
    cases = [("com", "/", "com/"), ("x.com", "/y", "com/"), ("xcom", "/y", None), ("example.com", "/en/1", "example.com/en/"), ("example.com", "/en", "com/"), ("a.www.example.com", "/en/", "www.example.com/en/"), ("wwwexample.com", "/en/", "com/"), ("a.example.net", "/es/", "net/es/"), ("net", "/ES/", None), ("x.com", "", None), ("x.com:80", "/", None), ("", "", None)]
    frame = spark.createDataFrame([*cases, ("tie.org", "/ab", "tie.org/a")], "host string, path string, want string")
    got = frame.select(op12_urls.rule_of(F.col("host"), F.col("path"), rules).alias("r"), "want").collect()
    assert [r["r"] and r["r"]["rule"] for r in got] == [r["want"] for r in got]
    assert got[-1]["r"]["verdict"] == "block" and got[5]["r"]["verdict"] == "allow"


def brute_split(name, counts):
    """All splits of a short name, the likeliest; of equal ones that with the longer last word, as often as it is asked."""
    total = sum(counts.values())

    @functools.cache
    def best(j):
        if not j:
            return 0.0, ()
        told = []
        for i in range(max(0, j - op12_urls.WORD), j):
            w = name[i:j]
            p = math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
            told.append((round(best(i)[0] + p, 9), -i, (*best(i)[1], w)))
        p, _, words = max(told, key=lambda t: t[:2])
        return p, words

    return list(best(len(name))[1])


def test_urls(spark):
    """Segmentation, weights and verdicts as by plain loops; null urls, repeated rows, long names, clashing columns, no rows."""
    counts = {"cheap": 50, "pills": 40, "online": 60, "the": 500, "news": 80, "free": 70, "bets": 30, "bet": 5, "s": 2, "on": 300, "line": 100, "example": 20, "org": 3, "daily": 9}
    hosts = ["cheappillsonline.org", "www.dailynews.org", "freebets.org", "thenews.example.net", "pills4.example.com", "bets-online.com", "zqxfreebets.org", "n" * 130 + ".org", "ünïnews.org"]
    paths = ["/en/cheap/12", "/fr/news-the_line", "/es/FreeBets/99", "", "/", "/de/x?en"]
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 17 == 0 else f"https://{hosts[int(a)]}{paths[int(b)]}") for i, (a, b) in enumerate(zip(rng.integers(0, len(hosts), 120), rng.integers(0, len(paths), 120), strict=True))]
    rows += [rows[1], rows[1], (None, rows[2][1]), (200, "no address"), (201, "http://com/")]
    pages = spark.createDataFrame([(*r, "h", 1, "w") for r in rows], "page_id long, url string, _host string, odds int, word string")
    model = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = op12_urls.filtered(pages, op12_urls.RULES, model).collect()

    def words(host, path):
        out = []
        for t in [t for part in (host, path) for t in re.findall(r"[^\W\d_]+|\d+", part.lower())]:
            out += ["0"] if t[0].isdigit() else [w for k in range(0, len(t), op12_urls.NAME) for w in brute_split(t[k : k + op12_urls.NAME], counts)]
        return out

    seen = {(r["host"], r["path"]): words(r["host"], r["path"]) for r in got}
    tally = {"allow": collections.Counter(), "block": collections.Counter()}
    n = collections.Counter(r["verdict"] for r in got if r["rule"])
    for r in got:
        if r["rule"]:
            tally[r["verdict"]].update(seen[r["host"], r["path"]])
    size = len(tally["allow"] | tally["block"]) + 1
    a, b = (sum(tally[v].values()) + size for v in ("allow", "block"))
    assert len(got) == len(rows) and sorted(map(str, (r["page_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    for r in got:
        odds = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(math.log((tally["block"][w] + 1) / b * a / (tally["allow"][w] + 1)) for w in seen[r["host"], r["path"]])
        if r["rule"] is None:
            assert abs(r["odds"] - odds) < 1e-5 and r["verdict"] == ("block" if odds > 1e-6 else "allow")
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
    split = {r["name"]: r["words"] for r in op12_urls.segmented(spark.createDataFrame([("cheappillsonline",), ("freebets",), ("zqxfreebets",)], "name string"), model).collect()}
    assert split["cheappillsonline"] == ["cheap", "pills", "online"] and split["freebets"] == ["free", "bets"] and split["zqxfreebets"][-2:] == ["free", "bets"]
    assert op12_urls.filtered(pages.limit(0), op12_urls.RULES, model).count() == 0
    bare = op12_urls.filtered(pages.select("page_id", "url"), [], model.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in bare} == {(None, "allow")}
    html = spark.createDataFrame([("<p class=x>The news&nbsp;The</p>",), (None,), ("",), ("<" * 3000 + "a < b",)], "html string")
    assert {r["word"]: r["n"] for r in op12_urls.words_of_html(html).collect()} == {"the": 2, "news": 1, "a": 1, "b": 1}


def brute_negatives(rows):
    vecs = {}
    for i, v, l in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], [math.floor(256 * x) for x in r[1]], r[2])):
        vecs.setdefault(i, ([math.floor(256 * x) for x in v], (l + 1) % 10 if i % 7 == 0 else l))
    out = set()
    for a, (q, label) in vecs.items():
        if a % 100:
            continue
        told = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, (v, l) in vecs.items() if i != a)
        for s, p, _ in [t for t in told if t[2] == label][:5]:
            inside = [t for t in told if t[2] != label and -80 * s <= -100 * t[0] <= -100 * s][:5]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(inside)}
    return out


@pytest.mark.parametrize("cells", [256, 3])
def test_negatives(spark, monkeypatch, cells):
    """Ties, equal vectors under one and several labels, scores of 0 and below, odd values; few cells give the same rows."""
    monkeypatch.setattr(op13_negatives, "CELLS", cells)
    monkeypatch.setattr(op13_negatives, "BLOCK_ROWS", 128)
    monkeypatch.setattr(op13_negatives, "ANCHOR_ROWS", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[::3] = x[0]  # a third of all rows
    x[1::50] = 0
    x[5::40] = np.round(x[5::40])
    rows = [(i, [float(c) for c in v], int(l)) for i, (v, l) in enumerate(zip(x, rng.integers(0, 3, 700), strict=True))]
    rows += [rows[100], (200, [9.0] * 6, 1), (701, None, 1), (702, [1.0] * 6, None), (703, [1.0, None, *[1.0] * 4], 1), (800, [1.0, float("nan"), *[1.0] * 4], 1), (900, [1.0, float("inf"), *[1.0] * 4], 1), (None, [1.0] * 6, 1)]
    frame = spark.createDataFrame([(*r, "u", 5) for r in rows], "vec_id long, embedding array<float>, label int, unit string, top int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = op13_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, label)
    told = [tuple(r) for r in got.collect()]
    assert len(told) == len(set(told)) > 100 and set(told) == brute_negatives(rows)
    assert op13_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0, label).schema.simpleString() == got.schema.simpleString()
    assert op13_negatives.hard_negatives(frame, F.lit(False), label).count() == 0
    odd = spark.createDataFrame([(100, [1e30, 1.0], 1), (101, [1.0, 1.0], 1), (102, [1.0], 1), (200, [1.0, 1.0], 1), (201, [1.0, 0.9], 2)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in op13_negatives.hard_negatives(odd, F.col("vec_id") % 100 == 0, F.col("label")).collect()] == [(200, 101, 1, 201, 131072, 124416)]
