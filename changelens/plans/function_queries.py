"""Driver queries of the scalar functions, each over all symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions import exprs as X
from changelens.plans.base import query
from changelens.sources.graph import star_graph as star


@query("f03_display_names", "SELECT id, CASE WHEN kind IN ('Method', 'Constructor') THEN qualified_name || coalesce(signature, '') ELSE qualified_name END AS display FROM symbols")
def f03(spark, sf):
    return star(spark, sf).symbols.select("id", X.display_name().alias("display"))


_PARTS = "string_split(qualified_name, '.')"


@query("f04_map_labels", f"SELECT id, CASE WHEN len({_PARTS}) >= 2 THEN {_PARTS}[-2] || '.' || {_PARTS}[-1] ELSE qualified_name END || CASE WHEN kind IN ('Method', 'Constructor', 'Function') THEN '()' ELSE '' END AS label FROM symbols")
def f04(spark, sf):
    return star(spark, sf).symbols.select("id", X.map_label("qualified_name", "kind").alias("label"))


def _foldered() -> Column:
    """Paths in folders by start_line: obj, Tests, src/bin, testing."""
    m = F.col("start_line") % 4
    return F.concat(F.when(m == 0, "obj\\").when(m == 1, "Tests\\").when(m == 2, "src/bin/").otherwise("testing/"), F.col("relative_path"))


@query("f05_test_only", "SELECT id, start_line % 4 = 1 OR lower(project) LIKE '%.tests' OR lower(name) LIKE '%tests' AS test_only FROM symbols")
def f05(spark, sf):
    return star(spark, sf).symbols.select("id", X.is_test(_foldered()).alias("test_only"))


@query("f06_tokens", "SELECT id, CAST(ceil(length(qualified_name) / 4.0) AS INT) AS tokens FROM symbols")
def f06(spark, sf):
    return star(spark, sf).symbols.select("id", X.approx_tokens("qualified_name").alias("tokens"))


@query("f07_costs", "SELECT id, CAST(greatest(1, (length(qualified_name) + length(kind) + 15) // 4) AS INT) AS cost FROM symbols")
def f07(spark, sf):
    return star(spark, sf).symbols.select("id", X.candidate_cost("qualified_name", "kind").alias("cost"))


@query("f09_last_names", "SELECT id, regexp_extract(qualified_name || '/x+' || name, '([^.+/]+)[.+/]*$', 1) AS last_name FROM symbols")
def f09(spark, sf):
    text = F.concat("qualified_name", F.lit("/x+"), "name", F.lit("./(a.b)"))
    return star(spark, sf).symbols.select("id", X.last_name(text).alias("last_name"))


@query("f13_stable_ids", "SELECT id, 'sym-' || project || '-' || substring(sha256(project || '|' || coalesce(signature, '') || '|' || name), 1, 8) AS stable_id FROM symbols")
def f13(spark, sf):
    return star(spark, sf).symbols.select("id", X.stable_id("sym", F.col("project"), F.col("signature"), F.col("name")).alias("stable_id"))


@query("f16_generated", "SELECT id, start_line % 2 = 0 OR end_line % 5 = 0 AS generated FROM symbols")
def f16(spark, sf):
    path = F.when(F.col("end_line") % 5 == 0, F.regexp_replace(_foldered(), r"\.cs$", ".G.cs")).otherwise(_foldered())
    return star(spark, sf).symbols.select("id", X.is_generated(path).alias("generated"))


@query("f18_path_alignment", "SELECT id, start_line % 4 IN (0, 2) AS bare, start_line % 4 = 1 AS below FROM symbols")
def f18(spark, sf):
    m, path = F.col("start_line") % 4, F.col("relative_path")
    bare = X.paths_align(F.when(m % 2 == 0, F.upper(path)).otherwise(F.concat(F.lit("src/"), path)), path)
    below = X.paths_align(F.when(m == 1, F.concat(F.lit("root/SRC/"), path)).otherwise(path), F.concat(F.lit("src/"), path))
    return star(spark, sf).symbols.select("id", bare.alias("bare"), below.alias("below"))


@query("f19_escaped_ids", "SELECT id, 'scip:' || url_encode(project || ' ~*%7E+é/' || qualified_name) AS escaped FROM symbols")
def f19(spark, sf):
    return star(spark, sf).symbols.select("id", F.concat(F.lit("scip:"), X.escape_id(F.concat("project", F.lit(" ~*%7E+é/"), "qualified_name"))).alias("escaped"))
