"""Driver queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions import exprs as X
from changelens.functions.storage import shared_path
from changelens.operators import arch, lookup, rank, relations, traverse
from changelens.plans.base import C, E, S, V, query
from changelens.sources import graph as G

star = G.star_graph


def walked(spark, sf):
    """The graph with what its edges are aggregated from kept: traversals read it once for each level."""
    return star(spark, sf, keep=True)


def stored(spark, sf):
    """The graph saved to the shared folder and loaded: by either end of its edges, with postings of its names."""
    path = shared_path(spark)
    G.save(star(spark, sf), path)
    return G.load(spark, path)


_IS_TEST = "(lower(project) LIKE '%.tests' OR lower(name) LIKE '%tests' OR ('/' || lower(replace(relative_path, chr(92), '/')) || '/') LIKE '%/test/%' OR ('/' || lower(replace(relative_path, chr(92), '/')) || '/') LIKE '%/tests/%' OR ('/' || lower(relative_path) || '/') LIKE '%tests.cs/%')"
_ENOUGH = "(e.confidence IS NULL OR e.confidence >= {})"
_CODE = "('References', 'Calls', 'Constructs', 'UsesType', 'Implements', 'Inherits')"
_APP = "('References', 'Calls', 'Constructs', 'UsesType', 'Implements', 'Inherits', 'RoutesTo', 'Registers', 'ResolvesTo', 'ImplementedBy', 'Renders', 'BindsTo', 'HandlesEvent', 'UsesViewModel')"
_HTTP = "('RoutesTo', 'Registers', 'ResolvesTo', 'Calls', 'UsesType', 'Implements', 'ImplementedBy')"


@query("s01_load_counts", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges")
def s01(spark, sf):
    g = star(spark, sf)
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(g.files, "files").crossJoin(n(g.symbols, "symbols")).crossJoin(g.edge_count())


@query("s02_architecture_projection", "SELECT e.source_id, e.target_id, e.kind, e.confidence FROM edges e WHERE e.kind NOT IN ('Contains', 'Defines') AND e.resolution_kind <> 'heuristic'")
def s02(spark, sf):
    return G.architecture_projection(star(spark, sf), True).edges.select("source_id", "target_id", "kind", "confidence")


@query("s03_project_scope", """SELECT DISTINCT e.source_id, e.target_id, e.kind, e.line, e.resolution_kind, e.confidence FROM edges e
WHERE e.source_id IN (SELECT id FROM symbols WHERE project = 'EUROPE') OR e.target_id IN (SELECT id FROM symbols WHERE project = 'EUROPE')""")
def s03(spark, sf):
    return G.project_scope(star(spark, sf), "EUROPE").whole()


@query("s28_content_hash", "SELECT id, sha256(relative_path || chr(10) || qualified_name) AS hash FROM symbols")
def s28(spark, sf):
    return star(spark, sf).symbols.select("id", G.content_hash(F.col("relative_path"), F.col("qualified_name")).alias("hash"))


@query("s31_query_paths", """, p AS (SELECT 'src/' || project || '/code/' || relative_path AS path FROM files), d AS (SELECT DISTINCT project, 'src/' || project AS directory FROM files UNION ALL SELECT 'deep', 'src/EUROPE/code')
SELECT path, project, substring(path, length(directory) + 2) AS relative_path FROM p JOIN d ON starts_with(lower(path), lower(directory) || '/')
QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(directory) DESC) = 1""")
def s31(spark, sf):
    f = star(spark, sf).files
    paths = f.select(F.concat(F.lit("src/"), "project", F.lit("/code/"), "relative_path").alias("path"))
    deep = spark.range(1).select(F.lit("deep").alias("project"), F.lit("src\\EUROPE\\code").alias("directory"))
    return G.query_paths(paths, f.select("project", F.concat(F.lit("src/"), "project").alias("directory")).distinct().unionByName(deep))


_FIND = """, h AS (SELECT {S}, CASE WHEN s.id = '{q}' OR lower(s.name) = lower('{q}') OR lower(s.qualified_name) = lower('{q}') THEN 3
  WHEN starts_with(lower(s.qualified_name), lower('{q}')) THEN 2 WHEN contains(lower(s.qualified_name), lower('{q}')) THEN 1 END AS tier,
  CASE WHEN lower(s.qualified_name) = lower('{q}') OR lower(CASE WHEN kind IN ('Method', 'Constructor') THEN qualified_name || coalesce(signature, '') ELSE qualified_name END) = lower('{q}') OR lower(s.id) = lower('{q}') THEN 1000
  WHEN lower(s.name) = lower('{q}') THEN 900 WHEN starts_with(lower(CASE WHEN kind IN ('Method', 'Constructor') THEN qualified_name || coalesce(signature, '') ELSE qualified_name END), lower('{q}')) THEN 700 ELSE 500 END AS score FROM symbols s)
SELECT {C}, score FROM h WHERE tier = (SELECT max(tier) FROM h) AND score // 100 = (SELECT max(score // 100) FROM h WHERE tier = (SELECT max(tier) FROM h))
ORDER BY score DESC, starts_with(project, 'external:'), qualified_name, coalesce(signature, ''), id LIMIT 20"""


@query("l04_find_postings", _FIND.format(S=S, C=C, q="er#"))
def l04_postings(spark, sf):
    return lookup.find_stored(stored(spark, sf), "er#")


@query("l04_find_postings_long", _FIND.format(S=S, C=C, q="#000000042"))
def l04_postings_long(spark, sf):
    return lookup.find_stored(stored(spark, sf), "#000000042")


@query("l01_find_contains", _FIND.format(S=S, C=C, q="er#00000001"))
def l01(spark, sf):
    return lookup.find(star(spark, sf).symbols, "er#00000001")


@query("l02_find_exact", _FIND.format(S=S, C=C, q="supplier#000000003"))
def l02(spark, sf):
    return lookup.find(star(spark, sf).symbols, "supplier#000000003")


@query("l03_find_prefix", _FIND.format(S=S, C=C, q="customer.customer#00000010"))
def l03(spark, sf):
    return lookup.find(star(spark, sf).symbols, "customer.customer#00000010")


@query("l06_by_ids", f"SELECT {C} FROM symbols WHERE id IN ('s:1', 'c:7', 'p:3', 'nobody')")
def l06(spark, sf):
    return lookup.by_ids(star(spark, sf).symbols, spark.createDataFrame([("s:1",), ("c:7",), ("p:3",), ("nobody",), ("s:1",)], "id string"))


@query("l07_files", "SELECT id, project, relative_path, language FROM files")
def l07(spark, sf):
    return lookup.files_in_order(star(spark, sf).files)


@query("l08_resolve_callable", f"""SELECT {C}, (count(*) OVER () > 1) AS ambiguous FROM symbols WHERE kind IN ('Method', 'Constructor', 'Function') AND (lower(name) = 'customer#000000004' OR lower(qualified_name || coalesce(signature, '')) = 'customer#000000004')""")
def l08(spark, sf):
    return lookup.resolve(star(spark, sf).symbols, "Customer#000000004", True)


@query("l11_symbols_in_files", f"""SELECT {C} FROM symbols WHERE lower(relative_path) IN ('nation_3.cs', 'nation_7.cs') OR lower(project || '/' || relative_path) IN ('asia.tests/nation_2.cs') ORDER BY qualified_name, id LIMIT 500""")
def l11(spark, sf):
    return lookup.in_files(star(spark, sf).symbols, spark.createDataFrame([("NATION_3.cs",), ("nation_7.CS",), ("ASIA.Tests\\Nation_2.cs",)], "path string"))


@query("l12_public_symbols", f"SELECT {C} FROM symbols WHERE lower(visibility) = 'public' ORDER BY project, qualified_name, id LIMIT 100000")
def l12(spark, sf):
    return lookup.public_symbols(star(spark, sf).symbols)


@query("l13_intersecting", f"""SELECT f.project || '/' || f.relative_path AS span_id, {S} FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.start_line <= 60 AND s.end_line >= 40""")
def l13(spark, sf):
    g = star(spark, sf)
    path = F.concat("project", F.lit("/"), "relative_path")
    return lookup.intersecting(g.symbols, g.files.select(path.alias("span_id"), path.alias("path"), F.lit(40).alias("start"), F.lit(60).alias("end")))


@query("l14_incoming", "SELECT source_id, target_id, kind, line, resolution_kind, confidence FROM edges WHERE target_id = 's:2' AND kind IN ('Calls', 'Implements')")
def l14(spark, sf):
    return lookup.edges_of(star(spark, sf).edges, "s:2", ["Calls", "Implements"], incoming=True)


@query("l15_changed_symbols", f"""SELECT f.project || '/' || f.relative_path AS span_id, 'overlap' AS source, {S} FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.n_nationkey < 5 AND s.start_line <= 30 AND s.end_line >= 20
UNION ALL SELECT f.project || '/' || f.relative_path, 'type', {S} FROM symbols s JOIN files f ON f.id = s.file_id WHERE f.n_nationkey BETWEEN 5 AND 9 AND s.kind IN ('Class', 'Interface')
UNION ALL SELECT 'gone', 'unknown', {', '.join(['NULL'] * 11)}""")
def l15(spark, sf):
    g = star(spark, sf)
    path = F.concat("project", F.lit("/"), "relative_path")
    some = g.files.where("n_nationkey < 10").select(path.alias("span_id"), path.alias("path"), F.when(F.col("n_nationkey") < 5, 20).alias("start"), F.when(F.col("n_nationkey") < 5, 30).alias("end"))
    gone = spark.createDataFrame([("gone", "gone.cs", 1, 2)], "span_id string, path string, start int, end int")
    return lookup.changed_symbols(g.symbols, some.unionByName(gone))


@query("l16_page", f"SELECT {C}, true AS has_more FROM symbols ORDER BY qualified_name, id LIMIT 10 OFFSET 20")
def l16(spark, sf):
    return lookup.page(star(spark, sf).symbols.select(*G.SYMBOL), [F.col("qualified_name"), F.col("id")], 10, 20)


@query("r02_callers", f"""SELECT {C}, {V} FROM (SELECT {S}, {E}, row_number() OVER (PARTITION BY s.id ORDER BY e.line, e.source_id, e.kind) AS rn
FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.target_id = 's:3' AND (e.kind = 'Calls' OR (e.kind = 'References' AND e.resolution_kind = 'semantic' AND starts_with(s.project, 'scip:'))) AND {_ENOUGH.format(0.95)}) WHERE rn = 1""")
def r02(spark, sf):
    g = star(spark, sf)
    return relations.callers(g.symbols, g.edges, spark.createDataFrame([("s:3",)], "target_id string"), 0.95)


@query("r02_callers_of_all", """SELECT via_target AS target_id, count(*) AS callers FROM (SELECT e.target_id AS via_target, s.id FROM edges e JOIN symbols s ON s.id = e.source_id
WHERE e.kind = 'Calls' OR (e.kind = 'References' AND e.resolution_kind = 'semantic' AND starts_with(s.project, 'scip:')) GROUP BY ALL) GROUP BY via_target""")
def r02_all(spark, sf):
    g = star(spark, sf)
    return relations.caller_counts(g.symbols, g.single, g.bundles)


@query("r04_implementations", f"""SELECT {C}, {V} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE via_kind WHEN 'ImplementedBy' THEN 0 ELSE 1 END, via_source, via_target) AS rn FROM (
SELECT {S}, {E} FROM edges e JOIN symbols s ON s.id = e.target_id WHERE e.source_id = 's:5' AND e.kind = 'ImplementedBy'
UNION ALL SELECT {S}, {E} FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.target_id = 's:5' AND e.kind = 'Implements') x) y WHERE rn = 1""")
def r04(spark, sf):
    g = star(spark, sf)
    return relations.implementations(g.symbols, g.edges, "s:5")


@query("r05_referenced_by", f"""SELECT {C}, {V} FROM (SELECT {S}, {E}, row_number() OVER (PARTITION BY s.id ORDER BY e.kind, e.source_id, e.target_id, e.line) AS rn
FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.target_id = 'p:8' AND e.kind IN {_CODE}) WHERE rn = 1""")
def r05(spark, sf):
    g = star(spark, sf)
    return relations.referenced_by(g.symbols, g.edges, "p:8")


@query("r06_pair_relations", f"SELECT {S}, {E} FROM edges e JOIN symbols s ON s.id = e.target_id WHERE (e.source_id, e.target_id) = (SELECT (source_id, target_id) FROM edges WHERE kind = 'Implements' ORDER BY source_id, target_id LIMIT 1) AND {_ENOUGH.format(0.5)}")
def r06(spark, sf):
    g = star(spark, sf)
    a, b = g.edges.where("kind = 'Implements'").orderBy("source_id", "target_id").select("source_id", "target_id").first()
    return relations.pair_relations(g.symbols, g.edges, a, b, least=0.5)


@query("r07_caller_view", f"""SELECT id, rank FROM (SELECT id, rank, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn FROM (
SELECT DISTINCT s.id, 0 AS rank FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.target_id = 'p:9' AND (e.kind = 'Calls' OR (e.kind = 'References' AND e.resolution_kind = 'semantic' AND starts_with(s.project, 'scip:'))) AND {_ENOUGH.format(0.93)}
UNION ALL SELECT id, 1 FROM (SELECT s.id, e.confidence, row_number() OVER (PARTITION BY s.id ORDER BY e.kind) AS rn FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.target_id = 'p:9' AND e.kind IN {_CODE}) e WHERE rn = 1 AND {_ENOUGH.format(0.93)}) x) y WHERE rn = 1""")
def r07(spark, sf):
    g = star(spark, sf)
    return relations.caller_view(g.symbols, g.edges, "p:9", 0.93).select("id", "rank")


@query("r08_reference_view", f"""SELECT id, 'implementation' AS source FROM (SELECT e.target_id AS id FROM edges e WHERE e.source_id = 's:6' AND e.kind = 'ImplementedBy' UNION SELECT e.source_id FROM edges e WHERE e.target_id = 's:6' AND e.kind = 'Implements')
UNION ALL SELECT DISTINCT e.source_id, 'reference' FROM edges e WHERE e.target_id = 's:6' AND e.kind IN {_CODE}""")
def r08(spark, sf):
    g = star(spark, sf)
    return relations.reference_view(g.symbols, g.edges, "s:6").select("id", "source")


@query("r09_top_targets", f"""SELECT via_source, CAST(rn AS INT) AS rn, {C} FROM (SELECT e.source_id AS via_source, {S}, row_number() OVER (PARTITION BY e.source_id ORDER BY s.qualified_name, s.id, e.kind) AS rn
FROM edges e JOIN symbols s ON s.id = e.target_id WHERE e.kind IN ('Calls', 'UsesType', 'Constructs')) WHERE rn <= 3""")
def r09(spark, sf):
    g = star(spark, sf)
    return relations.top_targets(g.symbols, g.single, bundles=g.bundles)


_PICK = """, pick AS (SELECT r.target_id AS interface, min(x.target_id) AS implementation FROM (SELECT target_id, min(source_id) AS reg FROM di WHERE kind = 'Registers' GROUP BY target_id HAVING count(*) = 1) r
JOIN di x ON x.source_id = r.reg AND x.kind = 'ResolvesTo' GROUP BY r.target_id)
, narrowed AS (SELECT e.* FROM edges e LEFT JOIN pick ON e.source_id = interface AND e.kind = 'ImplementedBy' WHERE implementation IS NULL OR e.target_id = implementation)"""


@query("r10_di_narrowing", f"{_PICK} SELECT e.source_id, e.target_id, e.line FROM narrowed e WHERE kind = 'ImplementedBy'")
def r10(spark, sf):
    g = star(spark, sf)
    return relations.di_narrowed(g.edges.where("kind = 'ImplementedBy'"), g.di).select("source_id", "target_id", "line")


def _bfs_sql(edges: str, root: str, depth: int, reverse: bool, order: str, where: str) -> str:
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return f""", ok AS (SELECT * FROM {edges} e WHERE {where}), walk(id, depth) AS (SELECT '{root}', 0 UNION SELECT e.{far}, w.depth + 1 FROM ok e JOIN walk w ON e.{near} = w.id WHERE w.depth < {depth})
, least AS (SELECT id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY id)
SELECT {C}, {V}, depth, '{root}' AS root_id FROM (SELECT {S}, {E}, m.depth, row_number() OVER (PARTITION BY m.id ORDER BY {order}) AS rn FROM least m JOIN ok e ON e.{far} = m.id
JOIN walk w ON w.id = e.{near} AND w.depth = m.depth - 1 JOIN symbols s ON s.id = m.id) WHERE rn = 1"""


@query("t01_callees", _bfs_sql("edges", "c:1", 3, False, "e.source_id, e.target_id", f"e.kind = 'Calls' AND {_ENOUGH.format(0.91)}"))
def t01(spark, sf):
    g = walked(spark, sf)
    return traverse.callees(g.symbols, g.edges, "c:1", 3, 0.91)


@query("t02_impact", _bfs_sql("edges", "s:1", 3, True, "e.source_id, e.kind, e.target_id, e.line", f"e.kind IN {_CODE}"))
def t02(spark, sf):
    g = walked(spark, sf)
    return traverse.impact(g.symbols, g.edges, traverse.single_root(g.symbols, "s:1"), 3)


@query("t01_callees_stored", _bfs_sql("edges", "c:3", 3, False, "e.source_id, e.target_id", f"e.kind = 'Calls' AND {_ENOUGH.format(0.93)}"))
def t01_stored(spark, sf):
    g = stored(spark, sf)
    return traverse.callees(g.symbols, g.forward, "c:3", 3, 0.93)


@query("t02_impact_stored", _bfs_sql("edges", "s:2", 3, True, "e.source_id, e.kind, e.target_id, e.line", f"e.kind IN {_CODE}"))
def t02_stored(spark, sf):
    g = stored(spark, sf)
    return traverse.impact(g.symbols, g.edges, traverse.single_root(g.symbols, "s:2"), 3)


@query("t02_impact_app_di", _PICK + _bfs_sql("narrowed", "p:2", 2, True, "e.source_id, e.kind, e.target_id, e.line", f"e.kind IN {_APP}"))
def t02_app(spark, sf):
    g = walked(spark, sf)
    return traverse.impact(g.symbols, g.edges, traverse.single_root(g.symbols, "p:2"), 2, "app", g.di)


@query("t03_flow_http", _PICK + _bfs_sql("narrowed", "c:2", 3, False, "e.kind, e.source_id, e.target_id", f"e.kind IN {_HTTP} AND {_ENOUGH.format(0.92)}"))
def t03(spark, sf):
    g = walked(spark, sf)
    return traverse.flow(g.symbols, g.edges, "c:2", "http", 3, 0.92, g.di)


_UNION = f""", roots AS (SELECT id AS root_id, row_number() OVER (ORDER BY id) AS root_order FROM symbols WHERE kind = 'Interface'), ok AS (SELECT * FROM edges e WHERE e.kind IN {_CODE})
, walk(root_id, id, depth) AS (SELECT root_id, root_id, 0 FROM roots UNION SELECT w.root_id, e.source_id, w.depth + 1 FROM ok e JOIN walk w ON e.target_id = w.id WHERE w.depth < 2)
, least AS (SELECT root_id, id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY root_id, id)
, one AS (SELECT {S}, {E}, m.depth, m.root_id, row_number() OVER (PARTITION BY m.root_id, m.id ORDER BY e.source_id, e.kind, e.target_id, e.line) AS rn FROM least m JOIN ok e ON e.source_id = m.id
JOIN walk w ON w.root_id = m.root_id AND w.id = e.target_id AND w.depth = m.depth - 1 JOIN symbols s ON s.id = m.id)"""


@query("t04_impact_union", f"""{_UNION}, cut AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY depth, qualified_name, id) AS k FROM one WHERE rn = 1)
SELECT {C}, {V}, depth, root_id FROM (SELECT cut.*, row_number() OVER (PARTITION BY id ORDER BY depth, root_order) AS f FROM cut JOIN roots USING (root_id) WHERE k <= 200) WHERE f = 1""")
def t04(spark, sf):
    g = walked(spark, sf)
    return traverse.impact_union(g.symbols, g.edges, _roots(g), 2, 200)


def _roots(g):
    from pyspark.sql import Window

    return g.symbols.where("kind = 'Interface'").select(F.col("id").alias("root_id"), F.row_number().over(Window.orderBy("id")).cast("long").alias("root_order"))


@query("t05_impact_detailed", f"{_UNION} SELECT {C}, {V}, depth, root_id FROM one WHERE rn = 1")
def t05(spark, sf):
    g = walked(spark, sf)
    return traverse.impact(g.symbols, g.edges, _roots(g), 2, packed=True)


@query("t06_focus_distance", """, u AS (SELECT source_id, target_id FROM edges WHERE kind NOT IN ('Contains', 'Defines') UNION ALL SELECT target_id, source_id FROM edges WHERE kind NOT IN ('Contains', 'Defines'))
, b(id, depth) AS (SELECT 's:7', 0 UNION SELECT u.target_id, b.depth + 1 FROM u JOIN b ON u.source_id = b.id WHERE b.depth < 2) SELECT id, min(depth) AS distance FROM b GROUP BY id""")
def t06(spark, sf):
    g = walked(spark, sf)
    return traverse.focus_distance(g.symbols, g.edges, "Supplier#000000007")


@query("t08_walk_truncated", f"{_UNION} SELECT r.root_id, count(o.id) AS impacted, count(o.id) > 300 AS truncated FROM roots r LEFT JOIN (SELECT * FROM one WHERE rn = 1) o USING (root_id) GROUP BY r.root_id")
def t08(spark, sf):
    g = walked(spark, sf)
    return traverse.walk_truncated(g.symbols, g.edges, _roots(g), 2, 300)


@query("t09_budgeted_callers", f""", roots AS (SELECT id AS root_id, row_number() OVER (ORDER BY id) AS root_order FROM symbols WHERE kind = 'Interface')
, c AS (SELECT {S}, r.root_order, e.target_id AS via_target, row_number() OVER (PARTITION BY e.target_id, s.id ORDER BY e.line, e.source_id, e.kind) AS k FROM edges e JOIN roots r ON e.target_id = r.root_id JOIN symbols s ON s.id = e.source_id
WHERE e.kind = 'Calls' OR (e.kind = 'References' AND e.resolution_kind = 'semantic' AND starts_with(s.project, 'scip:')))
SELECT id, via_target, rn FROM (SELECT *, row_number() OVER (ORDER BY root_order, project, qualified_name, coalesce(signature, ''), id) AS rn FROM c WHERE k = 1) WHERE rn <= 100""")
def t09(spark, sf):
    g = star(spark, sf)
    return traverse.budgeted_callers(g.symbols, g.edges, _roots(g), 100).select("id", "via_target", "rn")


@query("t10_deletion_impact", f""", gone AS (SELECT id FROM symbols WHERE lower(relative_path) = 'nation_5.cs')
, c AS (SELECT {S}, e.target_id AS via_target, row_number() OVER (PARTITION BY e.target_id, s.id ORDER BY e.line, e.source_id, e.kind) AS k FROM edges e JOIN gone g ON e.target_id = g.id JOIN symbols s ON s.id = e.source_id
WHERE e.kind = 'Calls' OR (e.kind = 'References' AND e.resolution_kind = 'semantic' AND starts_with(s.project, 'scip:')))
SELECT id, via_target FROM (SELECT *, row_number() OVER (PARTITION BY via_target ORDER BY project, qualified_name, coalesce(signature, ''), id) AS rn FROM c WHERE k = 1) WHERE rn <= 5""")
def t10(spark, sf):
    g = star(spark, sf)
    return traverse.deletion_impact(g.symbols, g.single, spark.createDataFrame([("NATION_5.cs",)], "path string"), 5, g.bundles).select("id", "via_target")


_DEGREE = ", deg AS (SELECT id, sum(i) AS incoming, sum(o) AS outgoing FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM edges WHERE kind NOT IN ('Contains', 'Defines') UNION ALL SELECT target_id, 1, 0 FROM edges WHERE kind NOT IN ('Contains', 'Defines')) GROUP BY id)"
_SCORE = f"""CAST(coalesce(incoming, 0) * 2 + coalesce(outgoing, 0) + CASE WHEN kind = 'Interface' THEN 6 ELSE 0 END + CASE WHEN kind IN ('Class', 'Struct', 'Record') AND visibility = 'public' THEN 4 ELSE 0 END + CASE WHEN visibility = 'public' THEN 2 ELSE 0 END
+ CASE WHEN regexp_matches(lower(name), 'service|handler|repository|controller|factory|provider|gateway|writer|query') THEN 3 ELSE 0 END + CASE WHEN kind = 'Constructor' THEN coalesce(outgoing, 0) ELSE 0 END + CASE WHEN {_IS_TEST} THEN -10 ELSE 0 END
+ CASE WHEN contains(lower(name), 'dto') OR contains(lower(name), 'options') THEN -2 ELSE 0 END + CASE WHEN contains(lower(name), 'converter') OR kind = 'Enum' THEN -1 ELSE 0 END {{more}} AS BIGINT) AS score"""


@query("a01_map_scores", f"{_DEGREE} SELECT {C}, {_SCORE.format(more='')} FROM symbols LEFT JOIN deg USING (id)")
def a01(spark, sf):
    g = star(spark, sf)
    return rank.map_scores(g.symbols, g.single, bundles=g.bundles)


@query("a01_map_scores_focus", f"""{_DEGREE}, u AS (SELECT source_id, target_id FROM edges UNION ALL SELECT target_id, source_id FROM edges)
, b(id, depth) AS (SELECT 's:7', 0 UNION SELECT u.target_id, b.depth + 1 FROM u JOIN b ON u.source_id = b.id WHERE b.depth < 2), fd AS (SELECT id, min(depth) AS distance FROM b GROUP BY id)
SELECT {C}, {_SCORE.format(more="+ CASE WHEN lower(name) = 'supplier#000000007' OR lower(qualified_name) = 'supplier#000000007' THEN 30 WHEN contains(lower(name), 'supplier#000000007') OR contains(lower(qualified_name), 'supplier#000000007') THEN 12 ELSE 0 END + CASE WHEN distance <= 2 THEN 10 - distance * 3 ELSE 0 END")}
FROM symbols LEFT JOIN deg USING (id) LEFT JOIN fd USING (id)""")
def a01_focus(spark, sf):
    g = walked(spark, sf)
    name = "Supplier#000000007"
    return rank.map_scores(g.symbols, g.edges, name, None, traverse.focus_distance(g.symbols, g.edges, name))


@query("a02_map_lines")
def a02(spark, sf):
    g = star(spark, sf)
    lines = rank.build_map(g.symbols, g.single, 400, bundles=g.bundles)
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


@query("a03_project_label", """SELECT source_id, CASE WHEN count(DISTINCT project) = 1 THEN min(project) WHEN count(DISTINCT project) > 1 THEN 'multiple' ELSE 'unknown' END AS label FROM edges e LEFT JOIN symbols s ON s.id = e.target_id GROUP BY source_id""")
def a03(spark, sf):
    g = star(spark, sf)
    return rank.target_labels(g.symbols, g.single, g.bundles)


@query("a04_risk", f"""{_UNION}, imp AS (SELECT * FROM one WHERE rn = 1), ch AS (SELECT s.* FROM symbols s JOIN roots ON id = root_id)
, n AS (SELECT (SELECT count(DISTINCT id) FROM (SELECT id, visibility, kind FROM ch UNION ALL SELECT id, visibility, kind FROM imp) WHERE visibility = 'public' AND kind IN ('Class', 'Struct', 'Record', 'Interface', 'Method', 'Property', 'Delegate')) AS public_apis,
(SELECT count(*) FROM imp WHERE via_kind = 'Calls') AS callers, (SELECT count(*) FROM imp WHERE lower(project) NOT IN (SELECT lower(project) FROM ch)) AS cross_project,
(SELECT count(*) FROM ch WHERE NOT {_IS_TEST} AND id NOT IN (SELECT root_id FROM imp WHERE {_IS_TEST})) AS untested, (SELECT avg(CASE WHEN via_confidence IS NULL OR via_confidence = 0 THEN 1.0 ELSE via_confidence END) FROM imp) AS w)
SELECT public_apis, callers, cross_project, untested, round_even(public_apis * 2 + callers * w + cross_project * 2 + untested * 3, 2) AS weighted_total, 'high' AS level FROM n""")
def a04(spark, sf):
    g = walked(spark, sf)
    roots = _roots(g)
    changed = g.symbols.join(roots.select(F.col("root_id").alias("id")), "id", "left_semi")
    return rank.risk(changed, traverse.impact(g.symbols, g.edges, roots, 2, packed=True))


_CAND = """, cand AS (SELECT e.target_id AS id, e.kind AS via_kind, CASE e.resolution_kind WHEN 'semantic' THEN 3 WHEN 'syntactic' THEN 2 ELSE 1 END AS tier, e.line AS depth, e.confidence, length(e.target_id) + e.line AS cost, CASE WHEN e.line % 2 = 0 THEN 'even' ELSE 'odd' END AS provider FROM edges e WHERE e.source_id LIKE 'c:1%')"""


def _candidates(g):
    e = g.edges.where(F.col("source_id").startswith("c:1"))
    tier = F.when(F.col("resolution_kind") == "semantic", 3).when(F.col("resolution_kind") == "syntactic", 2).otherwise(1)
    return e.select(F.col("target_id").alias("id"), F.col("kind").alias("via_kind"), tier.alias("tier"), F.col("line").alias("depth"), "confidence", (F.length("target_id") + F.col("line")).alias("cost"), F.when(F.col("line") % 2 == 0, "even").otherwise("odd").alias("provider"))


@query("a06_distinct_candidates", f"""{_CAND} SELECT id, tier, depth, provider, coalesce((SELECT string_agg(DISTINCT c2.provider, ',') FROM cand c2 WHERE c2.id = c.id AND c2.provider <> c.provider), '') AS others
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier DESC, depth, provider) AS rn FROM cand) c WHERE rn = 1""")
def a06(spark, sf):
    return rank.distinct_candidates(_candidates(star(spark, sf))).select("id", "tier", "depth", "provider", "others")


_RANKED = f"""{_CAND}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier DESC, depth, provider, via_kind, confidence NULLS FIRST) AS rn FROM cand) WHERE rn = 1)
, ranked AS (SELECT id, via_kind, cost, CASE via_kind WHEN 'Calls' THEN 1.0 WHEN 'RoutesTo' THEN 1.0 WHEN 'Renders' THEN 0.95 WHEN 'BindsTo' THEN 0.9 ELSE 0.5 END AS relevance, tier, depth, confidence FROM best)
, r AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, tier DESC, depth, coalesce(confidence, 1.0) DESC, greatest(1, cost), id) AS rank FROM ranked)"""


def _best(g):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("tier"), "depth", "provider", "via_kind", F.asc_nulls_first("confidence"))
    return _candidates(g).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("a07_ranked_candidates", f"{_RANKED} SELECT id, CAST(relevance AS DOUBLE) AS relevance, CAST(rank AS INT) AS rank FROM r")
def a07(spark, sf):
    return rank.ranked_candidates(_best(star(spark, sf)), "trace").select("id", "relevance", "rank")


@query("a08_within_budget", f"{_RANKED} SELECT id, CAST(sum(greatest(1, cost)) OVER (ORDER BY rank) AS BIGINT) AS spent, sum(greatest(1, cost)) OVER (ORDER BY rank) <= 500 AS selected FROM r")
def a08(spark, sf):
    return rank.within_budget(rank.ranked_candidates(_best(star(spark, sf)), "trace"), 500).select("id", "spent", "selected")


@query("a09_coverage", f"""{_CAND}, x AS (SELECT c.*, s.project FROM cand c JOIN symbols s USING (id)) SELECT fact, count(*) AS n FROM (SELECT 'tier:' || tier AS fact FROM x UNION ALL SELECT CASE WHEN starts_with(project, 'external:') THEN 'external' ELSE 'source' END FROM x UNION ALL SELECT 'provider:' || provider FROM x) GROUP BY fact""")
def a09(spark, sf):
    g = star(spark, sf)
    return rank.coverage(_candidates(g).join(g.symbols.select("id", "project"), "id"))


@query("a10_merged_spans", """, sp AS (SELECT file_id AS file, start_line AS st, end_line AS en FROM symbols), m AS (SELECT *, max(en) OVER (PARTITION BY file ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)
, k AS (SELECT *, sum(CASE WHEN st > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(st) AS start, max(en) AS "end", count(*) AS spans FROM k GROUP BY file, island""")
def a10(spark, sf):
    s = star(spark, sf).symbols.select(F.col("file_id").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return rank.merged_spans(s)


@query("a11_counts", "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges")
def a11(spark, sf):
    g = star(spark, sf)
    return g.symbols.agg(F.count(F.lit(1)).alias("symbols")).crossJoin(g.edge_count())


@query("c01_layer_violations", """, l AS (SELECT id, CASE WHEN contains(lower(project), 'asia') OR contains(lower(relative_path), 'asia') THEN 'asia' WHEN contains(lower(project), 'europe') OR contains(lower(relative_path), 'europe') THEN 'europe' END AS layer FROM symbols WHERE NOT starts_with(project, 'external:'))
SELECT e.source_id, e.target_id, e.kind, a.layer AS from_layer, b.layer AS to_layer FROM edges e JOIN l a ON a.id = e.source_id JOIN l b ON b.id = e.target_id WHERE e.kind IN ('UsesType', 'Calls', 'Imports', 'Inherits') AND a.layer = 'asia' AND b.layer = 'europe'""")
def c01(spark, sf):
    g = star(spark, sf)
    return arch.layer_violations(g.symbols, g.single, ["asia", "europe"], [("ASIA", "europe")], g.bundles)


@query("c02_fan_violations", """, f AS (SELECT 'fan-in' AS rule, target_id AS id, count(*) AS n FROM edges GROUP BY target_id UNION ALL SELECT 'fan-out', source_id, count(*) FROM edges GROUP BY source_id)
SELECT rule, id, qualified_name, n FROM f JOIN symbols USING (id) WHERE n > 40 AND NOT starts_with(project, 'external:')""")
def c02(spark, sf):
    g = star(spark, sf)
    return arch.fan_violations(g.symbols, g.single, bundles=g.bundles)


@query("c03_orphans", f"SELECT id, qualified_name, kind FROM symbols WHERE lower(visibility) = 'public' AND kind IN ('Class', 'Interface', 'Method') AND NOT starts_with(project, 'external:') AND NOT {_IS_TEST} AND id NOT IN (SELECT target_id FROM edges WHERE source_id LIKE 's:%')")
def c03(spark, sf):
    g = star(spark, sf)
    of = lambda df: df.where("source_id like 's:%'")
    return arch.orphans(g.symbols, of(g.single), G.Bundles(of(g.bundles.sources), g.bundles.targets, g.bundles.keys))


@query("c06_surface", """SELECT project, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS fingerprint, count(*) AS entries FROM (SELECT DISTINCT project, kind || '|' || qualified_name || '|' || coalesce(signature, '') AS entry FROM symbols WHERE lower(visibility) = 'public') GROUP BY project""")
def c06(spark, sf):
    return arch.surface(star(spark, sf).symbols)


def _surfaces(g):
    p = g.symbols.where("visibility = 'public'")
    before = p.where("start_line % 7 <> 0").select("project", "kind", "qualified_name", "signature")
    sig = F.when((F.col("start_line") % 5 == 0) & (F.col("project") != "ASIA"), "(int)").otherwise(F.col("signature"))
    after = p.where("start_line % 11 <> 0 or project = 'ASIA'").select("project", "kind", "qualified_name", sig.alias("signature"))
    return before, after


_SURFACES = """, bf AS (SELECT DISTINCT project, kind, qualified_name, coalesce(signature, '') AS signature FROM symbols WHERE visibility = 'public' AND start_line % 7 <> 0)
, af AS (SELECT DISTINCT project, kind, qualified_name, coalesce(CASE WHEN start_line % 5 = 0 AND project <> 'ASIA' THEN '(int)' ELSE signature END, '') AS signature FROM symbols WHERE visibility = 'public' AND (start_line % 11 <> 0 OR project = 'ASIA'))
, d AS (SELECT a.*, CASE WHEN b.signature IS NULL THEN 'added' ELSE 'modified' END AS change FROM af a LEFT JOIN bf b USING (project, kind, qualified_name) WHERE b.signature IS NULL OR b.signature <> a.signature
UNION ALL SELECT b.*, 'removed' FROM bf b LEFT JOIN af a USING (project, kind, qualified_name) WHERE a.signature IS NULL)"""


@query("c07_surface_diff", f"{_SURFACES} SELECT project, kind, qualified_name, signature, change FROM d")
def c07(spark, sf):
    return arch.surface_diff(*_surfaces(star(spark, sf)))


@query("c08_surface_verdicts", f"""{_SURFACES}, n AS (SELECT p.project, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM (SELECT DISTINCT project FROM bf) p LEFT JOIN d USING (project) GROUP BY p.project)
SELECT *, CASE WHEN removed + modified > 0 AND added > 0 THEN 'Mixed' WHEN removed + modified > 0 THEN 'Breaking' WHEN added > 0 THEN 'Additive' ELSE 'Unchanged' END AS change, CASE WHEN removed + modified > 0 THEN 'Fail' ELSE 'Pass' END AS status FROM n""")
def c08(spark, sf):
    return arch.surface_verdicts(*_surfaces(star(spark, sf)))


@query("f_scalars", f"""SELECT id, CASE WHEN kind IN ('Method', 'Constructor') THEN qualified_name || coalesce(signature, '') ELSE qualified_name END AS display, CAST(ceil(length(qualified_name) / 4.0) AS INT) AS tokens,
CASE WHEN instr(qualified_name, '(') > 1 THEN split_part(qualified_name, '(', 1) ELSE qualified_name END AS trimmed, greatest(1, CAST((length(qualified_name) + length(kind) + 15) // 4 AS INT)) AS cost, {_IS_TEST} AS is_test,
'O-P001A-' || left(sha256('P001A|Compatibility|' || id), 8) AS stable FROM symbols""")
def f_scalars(spark, sf):
    s = star(spark, sf).symbols
    return s.select("id", X.display_name().alias("display"), X.approx_tokens("qualified_name").alias("tokens"), X.trim_signature("qualified_name").alias("trimmed"), X.candidate_cost("qualified_name", "kind").alias("cost"), X.is_test().alias("is_test"), X.stable_id("O", F.lit("P001A"), F.lit("Compatibility"), F.col("id")).alias("stable"))


@query("f12_evidence_labels", """SELECT kind, resolution_kind, confidence, CASE WHEN resolution_kind = 'semantic' THEN 'semantic' WHEN kind = 'BindsTo' THEN 'markup-data-binding' WHEN kind = 'References' AND confidence BETWEEN 0.85 AND 0.90 THEN 'static-import'
WHEN kind = 'References' AND confidence >= 0.70 AND confidence < 0.85 THEN 'same-file-fallback' WHEN kind = 'References' AND confidence >= 0.60 AND confidence < 0.70 THEN 'name-fallback' ELSE 'unknown' END AS label FROM edges""")
def f12(spark, sf):
    return star(spark, sf).edges.select("kind", "resolution_kind", "confidence", X.evidence_label(F.col("kind"), F.col("resolution_kind"), F.col("confidence")).alias("label"))
