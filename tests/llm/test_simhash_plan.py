"""What the driver holds while texts are linked."""

import pytest
from pyspark.sql import functions as F

from changelens.llm import simhash


@pytest.mark.parametrize("step", ["link", "similar_texts"])
def test_exploded_keys_are_not_broadcast(spark, monkeypatch, step):
    plans, write = [], simhash.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(simhash, "written", noted)
    nodes = spark.range(40).select(F.col("id").alias("hash"), F.concat(F.lit("one two three four five six seven eight "), F.col("id") % 4).alias("text"))
    if step == "link":
        got = simhash.link(nodes.select((F.col("hash") * 3).alias("fp")))
    else:
        got = simhash.similar_texts(nodes)
    assert got.count()
    exploded = [p for p in plans if "posexplode" in p]
    assert exploded and not any("BroadcastHashJoin" in p for p in exploded)
