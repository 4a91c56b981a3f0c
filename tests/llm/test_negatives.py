"""Hard negatives against SQL and plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from changelens.llm import negatives
from changelens.llm.queries import queries
from tests.conftest import rows

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(data, positives=5, negatives_=10, low=30, high=90):
    """Rows of COLS of (id, label, vector, is_anchor) rows."""
    data = [(i, *r) for i, r in enumerate(data) if r[1] is not None and r[2] is not None]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    order = lambda x: (-x[0], math.inf if x[1] is None else x[1])
    out = []
    for i, vid, label, v, anchor in data:
        if not anchor:
            continue
        near = sorted(((dot(v, r[3]), r[1]) for r in data if r[2] == label and r[0] != i), key=order)[:positives]
        other = sorted(((dot(v, r[3]), r[1]) for r in data if r[2] != label), key=order)
        for p, pid in near:
            hits = [x for x in other if low * p <= 100 * x[0] <= high * p][:negatives_]
            out += [(vid, pid, n, nid, p, s) for n, (s, nid) in enumerate(hits, 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def same(got, want):
    assert sorted((tuple(r) for r in got.select(COLS).collect()), key=key) == sorted(want, key=key)


def test_query_equals_sql(spark, sf, duck):
    got = queries()["op13_negatives_summa"](spark, sf)
    assert rows(got) == rows(duck.sql(negatives.OP13_SQL).df()) and got.count() > 0


@pytest.mark.parametrize("size", [512, 7])
def test_blocks_ties_nulls_and_repeats(spark, monkeypatch, size):
    for name, n in (("ROWS", size), ("ANCHORS", max(2, size // 4)), ("TOGETHER", 2), ("DIMS", 3)):
        monkeypatch.setattr(negatives, name, n)
    data = [(i, i % 3 if i % 4 else 9, [(i * 7 + k * k) % 5 - 1 for k in range(5 if i % 6 else 7)], i % 10 == 0) for i in range(90)]
    data += [(3, 1, [1, 2, 3], True), (3, 1, [1, 2, 3], True), (None, 2, [4, 0, 1], True), (None, 1, [4, 0, 1], False), (200, None, [1], True), (201, 1, None, True), (202, 1, [], True), (203, 50, [2, 2, 2], True), (204, 51, [10, 0, 0], True), (205, 51, [10, 0, 0], False)]
    df = spark.createDataFrame(data, "id long, label int, vector array<long>, is_anchor boolean")
    for c in ("block", "place", "nth", "score", "rank", "a", "r"):
        df = df.withColumn(c, F.lit("clash"))
    want = brute(data)
    assert len(want) > 50 and any(r[3] is None for r in want)
    same(negatives.hard_negatives(df), want)


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(1, 1, [1], True), (2, 1, [1], False)], "id long, label int, vector array<long>, is_anchor boolean")
    assert negatives.hard_negatives(df.limit(0)).collect() == []
    assert negatives.hard_negatives(df.where("not is_anchor")).collect() == []
    assert negatives.hard_negatives(df).collect() == []
    assert negatives.hard_negatives(df.withColumn("vector", F.array().cast("array<long>"))).collect() == []


def test_usable_vectors(spark):
    data = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [math.nan]), (5, [math.inf]), (6, [-math.inf, 1.0]), (7, [-0.1, 0.1, 3e38])]
    df = spark.createDataFrame(data, "id long, v array<float>")
    assert {r["id"] for r in df.where(negatives.usable(F.col("v"))).collect()} == {1, 7}
    assert df.where("id = 7").select(F.slice(negatives.quantized(F.col("v")), 1, 2).alias("q")).first()["q"] == [-26, 25]
