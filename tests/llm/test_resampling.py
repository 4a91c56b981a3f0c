"""Importance resampling against plain dictionaries and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changelens.llm import resampling
from changelens.llm.common import numbered
from changelens.llm.queries import queries
from tests.conftest import rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, target, share=10, min_words=20, run=1, buckets=10_000):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""

    def features(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1))

    of = [(d, *features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in of:
        s.update(c)
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for d, n, c in of:
        weight = sum(k * math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    some = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    places = Counter()
    ranks = {}
    for i, x in enumerate(some[: len(some) * share // 100]):
        ranks[x, places[x]] = i + 1
        places[x] += 1
    seen = Counter()
    result = []
    for x in out:
        result.append((x[0], *x[2:], ranks.get((x, seen[x]))))
        seen[x] += 1
    return result


def key(row):
    return tuple((v is None, v or 0) for v in row)


def same(got, want):
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def edge(spark):
    texts = ["the cat sat " * 9, "the cat sat " * 9, None, "", "Ünïcode WORDS Ünïcode " * 10, "zeta " * 70_000, " \x00!\n", "a b c d e f g h i j k l m n o p q r s t", "x y"]
    ids = [1, 1, 2, 3, None, 5, 6, 7, 8]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for c in ("block", "bucket", "score", "rank", "words", "laid__", "part__", "ids", "weights"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_query_equals_sql_and_brute_force(spark, sf, duck):
    got = queries()["op11_resample_postings"](spark, sf)
    assert rows(got) == rows(duck.sql(resampling.OP11_SQL).df())
    want = brute(duck.sql("select doc_id, text from documents").fetchall(), [r[0] for r in duck.sql("select text from benchmark").fetchall()])
    same(got.collect(), want)
    assert any(r[4] for r in want)


@pytest.mark.parametrize("run", [1, 3])
def test_edges(spark, edge, monkeypatch, run):
    target = spark.createDataFrame([("the cat", "clash"), (None, ""), ("Zeta i j", "")], "text string, bucket string")
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    want = brute(docs, ["the cat", None, "Zeta i j"], share=60, run=run)
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    for size in (1 << 20, 20):  # one block, and a block for almost every document
        monkeypatch.setattr(resampling, "BLOCK_FEATURES", size)
        same(resampling.ranked(edge, target, share=60, run=run).select(cols).collect(), want)
    monkeypatch.setattr(resampling, "BLOCKS_PER_SALT", 1)
    same(resampling.ranked(edge, target, share=60, run=run).select(cols).collect(), want)


def test_empty_tables_and_rows(spark, edge):
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    none = edge.limit(0)
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    assert resampling.ranked(none, none).collect() == []
    same(resampling.ranked(edge, none, share=50).select(cols).collect(), brute(docs, [], share=50))
    drawn = resampling.resample(edge, edge, share=100)
    assert drawn.columns == edge.columns and Counter(r["doc_id"] for r in drawn.collect()) == Counter([1, 1, 5, 7])


def test_numbered_over_many_ranges(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(7)))
    got = numbered(df.repartition(13), [F.desc("v"), F.asc("id")], "n").collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == want and {r["n"] for r in got} == set(range(5000))
