"""T-12, C-04: cycles of a directed graph, as Spark jobs.

Edges that no cycle can have are trimmed from both sides. Then the smallest node
that reaches a node colors it, and what goes back to that node within its color
is a strongly connected part; the rest is colored again. Steps are tables in the
shared folder. The rounds follow the length of paths and the depth of parts
behind one another, no task holds more than its rows, and nothing is collected:
the joins of a round are merged, as a broadcast would pass a table through the
driver in each of them, and what rounds find is added to one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.storage import kept, shared_path

#: Rounds of trimming before colors are given; it only saves work.
TRIMS = 2


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast."""
    return df.hint("merge")


class _Added:
    """A table in the shared folder that grows by the rows of each round."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark, self.schema, self.path = rows.sparkSession, rows.schema, shared_path(rows.sparkSession)
        self.add(rows)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def trimmed(edges: DataFrame, rounds: int = TRIMS) -> DataFrame:
    """``edges`` (a, b) without those into nodes that nothing leaves, or out of nodes that nothing enters."""
    for _ in range(rounds):
        edges = edges.join(_merged(edges.select(F.col("a").alias("b")).distinct()), "b", "left_semi").join(_merged(edges.select(F.col("b").alias("a")).distinct()), "a", "left_semi").select("a", "b")
    return kept(edges)


def _colors(edges: DataFrame) -> DataFrame:
    """node, color: the smallest node that reaches a node, itself included."""
    colors = kept(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("color", F.col("node")))
    while True:
        told = edges.join(_merged(colors), F.col("a") == F.col("node")).groupBy("b").agg(F.min("color").alias("told"))
        joined = colors.join(_merged(told), F.col("node") == F.col("b"), "left")
        after = kept(joined.select("node", F.least("color", "told").alias("color"), F.coalesce(F.col("told") < F.col("color"), F.lit(False)).alias("moved")))
        colors = after.select("node", "color")
        if after.where("moved").isEmpty():
            return colors


def strong_parts(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node on a cycle of ``edges`` (a, b)."""
    edges = kept(edges.select("a", "b").distinct())
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    rest, parts = trimmed(edges), []
    while not rest.isEmpty():
        colors = _colors(rest)
        own = colors.withColumnRenamed("node", "a").withColumnRenamed("color", "ca")
        inner = kept(rest.join(_merged(own), "a").join(_merged(own.toDF("b", "cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("color")))
        frontier = kept(colors.where("node = color"))
        found = _Added(frontier)
        while True:
            back = inner.join(_merged(frontier.select(F.col("node").alias("b"), "color")), ["b", "color"]).select(F.col("a").alias("node"), "color").distinct()
            frontier = kept(back.join(_merged(found.rows()), ["node", "color"], "left_anti"))
            if frontier.isEmpty():
                break
            found.add(frontier)
        reached = found.rows()
        parts.append(reached)
        done = reached.select("node")
        left = rest.join(_merged(done.withColumnRenamed("node", "a")), "a", "left_anti").join(_merged(done.withColumnRenamed("node", "b")), "b", "left_anti")
        rest = trimmed(left.select("a", "b"))
    if not parts:
        return loops.select("node", F.col("node").alias("component"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    real = out.groupBy("color").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("color")
    several = out.join(_merged(real), "color", "left_semi")
    alone = loops.join(_merged(several.select("node")), "node", "left_anti").withColumn("color", F.col("node"))
    return several.select("node", F.col("color").alias("component")).unionByName(alone.select("node", F.col("color").alias("component")))


def cycles(edges: DataFrame) -> DataFrame:
    """component, size, cycle: each strongly connected part with a shortest cycle through its smallest node, as a path; of several the first by text."""
    edges = kept(edges.select("a", "b").distinct())
    parts = kept(strong_parts(edges))
    inside = parts.withColumnRenamed("node", "a")
    inner = kept(edges.join(_merged(inside), "a").join(_merged(inside.toDF("b", "component_b")), "b").where("component = component_b").select("component", "a", "b"))
    frontier = kept(parts.select("component").distinct().select("component", F.col("component").alias("node"), F.col("component").cast("string").alias("path")))
    seen = _Added(frontier.select("component", "node"))
    found = _Added(frontier.limit(0).select("component", "node", "path"))
    while not frontier.isEmpty():
        step = inner.join(_merged(frontier.withColumnRenamed("node", "a")), ["component", "a"]).groupBy("component", "b").agg(F.min(F.concat_ws(" -> ", "path", "b")).alias("path"))
        step = kept(step.select("component", F.col("b").alias("node"), "path"))
        back = kept(step.where("node = component"))
        found.add(back)
        frontier = kept(step.join(_merged(back.select("component")), "component", "left_anti").join(_merged(seen.rows()), ["component", "node"], "left_anti"))
        seen.add(frontier.select("component", "node"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.rows().join(_merged(sizes), "component").select("component", "size", F.col("path").alias("cycle"))
