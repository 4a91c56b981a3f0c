"""Driver queries of single rules and functions that the larger queries use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions import exprs as X
from changelens.functions.storage import kept, shared_path
from changelens.operators import arch, binding, diagnostics, incremental, lookup, obligations, traverse
from changelens.plans.base import C, query
from changelens.plans.change_queries import _BOUND, _CHANGE, _P05, POLICY, _bound, _change
from changelens.plans.graph_queries import _ENOUGH, _FIND, _bfs_sql, walked
from changelens.sources import graph as G
from changelens.sources import readers, snapshots
from changelens.sources.graph import star_graph as star


@query("s04_guarded_load", "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges")
def s04(spark, sf):
    path = shared_path(spark)
    G.save(star(spark, sf), path, {"csharp": "1"})
    g = G.load(spark, path, {"csharp": "1"})
    return g.symbols.agg(F.count(F.lit(1)).alias("symbols")).crossJoin(g.edge_count())


@query("s06_metadata", "SELECT * FROM (VALUES ('schema_version', '4'), ('state', 'ready'), ('analyzer:csharp', '1')) t(key, value)", graph=False)
def s06(spark, sf):
    path = shared_path(spark)
    G.save(star(spark, sf), path, {"csharp": "1"})
    return spark.read.parquet(f"{path}/metadata")


@query("s27_project_references", "SELECT DISTINCT 'p' || s_suppkey AS project, 'n' || s_nationkey AS depends_on FROM supplier", graph=False)
def s27(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    text = F.format_string('{"projects": [{"projectName": "p%s", "references": ["n%s", "n%s"]}, {"projectName": " ", "references": ["x"]}]}', "s_suppkey", "s_nationkey", "s_nationkey")
    return snapshots.project_references(s.select(text.alias("text")))


@query("s29_source_snapshot", "SELECT 'd' || p_partkey AS doc_id, 'Modified' AS kind, sha256('old' || p_name) AS old_sha, sha256('new' || p_name) AS new_sha, CAST(p_size AS INT) AS new_start, CAST(p_size + greatest(p_size % 4, 1) - 1 AS INT) AS new_end FROM part", graph=False)
def s29(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    doc, path = F.concat(F.lit("d"), "p_partkey"), F.concat(F.lit("a/F"), "p_partkey", F.lit(".cs"))
    listed = readers.name_status(p.select(doc.alias("doc_id"), F.concat(F.lit("M\u0000"), path, F.lit("\u0000")).alias("text")))
    text = F.format_string("--- a/%s\n+++ b/%s\n@@ -1 +%s,%s @@\n-x\n+y", path, path, "p_size", F.col("p_size") % 4)
    hunks = readers.hunks(p.select(doc.alias("doc_id"), text.alias("text")))
    blob = lambda side: p.select(path.alias("path"), F.lit(side).alias("side"), F.concat(F.lit(side), "p_name").alias("content"))
    d = snapshots.deltas(listed, hunks, blob("old").unionByName(blob("new")))
    return d.select("doc_id", "kind", "old_sha", "new_sha", F.col("new_spans")[0]["start"].alias("new_start"), F.col("new_spans")[0]["end"].alias("new_end"))


@query("s25_sinks", "SELECT 'json' AS sink, id || '|' || project || '|' || CAST(start_line AS VARCHAR) AS line FROM symbols UNION ALL SELECT 'text', qualified_name FROM symbols")
def s25(spark, sf):
    """S-25: rows written as JSON lines and as text, read back."""
    s = star(spark, sf).symbols.select("id", "project", "start_line", "qualified_name")
    rows_, lines = shared_path(spark), shared_path(spark)
    readers.write_json(s.drop("qualified_name"), rows_)
    readers.write_lines(s, lines, "qualified_name")
    back = spark.read.schema("id string, project string, start_line int").json(rows_)
    text = spark.read.text(lines).select(F.lit("text").alias("sink"), F.col("value").alias("line"))
    return back.select(F.lit("json").alias("sink"), F.concat_ws("|", "id", "project", "start_line").alias("line")).unionByName(text)


@query("s30_stored_surface", "SELECT project, kind, qualified_name FROM symbols WHERE visibility = 'public'")
def s30(spark, sf):
    path = shared_path(spark)
    snapshots.save_surface(star(spark, sf).symbols.where("visibility = 'public'").select("project", "kind", "qualified_name", "signature"), path, "abc")
    return snapshots.load_surface(spark, path, "abc").select("project", "kind", "qualified_name")


@query("l04_contains_tier", _FIND.format(S=", ".join(f"s.{c}" for c in G.SYMBOL), C=C, q="r#000000012"))
def l04(spark, sf):
    return lookup.find(star(spark, sf).symbols, "R#000000012")


@query("l05_ranked_ids", _FIND.format(S=", ".join(f"s.{c}" for c in G.SYMBOL), C=C, q="s:12"))
def l05(spark, sf):
    return lookup.find(star(spark, sf).symbols, "s:12")


@query("l09_prefer_source", f"SELECT {C} FROM symbols WHERE (name LIKE 'Supplier#%' AND project NOT LIKE 'external:%')")
def l09(spark, sf):
    return lookup.prefer_source(star(spark, sf).symbols.where("name like 'Supplier#%'"), "Supplier").select(*G.SYMBOL)


@query("l10_resolve_by_signature", f"SELECT {C}, false AS ambiguous FROM symbols WHERE qualified_name = 'Customer.Customer#000000009'")
def l10(spark, sf):
    return lookup.resolve(star(spark, sf).symbols, "customer.customer#000000009()", True)


@query("r03_callees_depth1", _bfs_sql("edges", "s:2", 1, False, "e.source_id, e.target_id", f"e.kind = 'Calls' AND {_ENOUGH.format(0.0)}"))
def r03(spark, sf):
    g = walked(spark, sf)
    return traverse.callees(g.symbols, g.edges, "s:2", 0)


@query("t07_forward_walk", ", w(id, depth) AS (SELECT 's:2', 0 UNION SELECT e.target_id, w.depth + 1 FROM edges e JOIN w ON e.source_id = w.id WHERE w.depth < 2) SELECT id, min(depth) AS depth FROM w WHERE id <> 's:2' GROUP BY id")
def t07(spark, sf):
    g = walked(spark, sf)
    return traverse.bfs(g.edges, traverse.single_root(g.symbols, "s:2"), 2, False, ["source_id"], root_returns=False).select("id", "depth")


@query("p05_unmapped", f"{_CHANGE} {_P05}")
def p05(spark, sf):
    _, ch, im, ca, rel, tm, *_ = _change(spark, sf)
    return obligations.tests(ch, im, ca, rel, tm, POLICY).where("rule_id = 'P005'")


_BUILD = ", o AS (SELECT 'o:' || id AS id, project AS subject_id, id AS sid FROM symbols), e AS (SELECT 'e:' || project || m AS id, CASE m WHEN 0 THEN 'all.sln' WHEN 1 THEN 'src/' || lower(project) || '.csproj' ELSE 'src/x/' || project || 'More.csproj' END AS target FROM (SELECT DISTINCT project, start_line % 3 AS m FROM symbols))"


def _builds(spark, sf, kind, subject="project", e_kind="Build"):
    """Obligations of every symbol, builds of every project."""
    s = star(spark, sf).symbols
    o = s.select(F.concat(F.lit("o:"), "id").alias("id"), F.lit("P").alias("rule_id"), F.lit(kind).alias("kind"), F.col(subject).alias("subject_id"), F.col("project").alias("subject_project"), F.lit(None).cast("string").alias("subject_display"), F.lit(True).alias("required"))
    m = F.col("m")
    target = F.when(m == 0, "all.sln").when(m == 1, F.concat(F.lit("src/"), F.lower("project"), F.lit(".csproj"))).otherwise(F.concat(F.lit("src\\x\\"), "project", F.lit("More.csproj")))
    e = s.select("project", (F.col("start_line") % 3).alias("m")).distinct().select(F.concat(F.lit("e:"), "project", "m").alias("id"), F.lit(e_kind).alias("kind"), F.lit("Pass").alias("status"), F.lit("c").alias("check_id"), F.lit(None).cast("string").alias("subject"), target.alias("target"), F.lit("now").alias("source_digest"), F.lit(None).cast("array<struct<id:string,project:string,name:string>>").alias("refs"), F.lit(None).cast("array<string>").alias("subjects"))
    return binding.bind(kept(o), kept(e), "now").select("obligation_id", "evidence_id", "rule", "strength")


_PROJECT_RULE = "CASE WHEN target <> 'all.sln' AND lower(regexp_replace(split_part(target, '/', -1), '\\.[^.]*$', '')) = lower(subject_id) THEN 'BIND_BUILD_PROJECT' WHEN target <> 'all.sln' AND (contains(lower(target), lower(subject_id)) OR contains(lower(subject_id), lower(regexp_replace(split_part(target, '/', -1), '\\.[^.]*$', '')))) THEN 'BIND_BUILD_PROJECT_HEURISTIC' WHEN target = 'all.sln' THEN 'BIND_BUILD_SOLUTION' END"


@query("b04_build_rules", f"{_BUILD} SELECT * FROM (SELECT o.id AS obligation_id, e.id AS evidence_id, {_PROJECT_RULE} AS rule, CAST(CASE WHEN {_PROJECT_RULE} = 'BIND_BUILD_PROJECT' THEN 3 ELSE 2 END AS INT) AS strength FROM o, e) WHERE rule IS NOT NULL")
def b04(spark, sf):
    return _builds(spark, sf, "CrossProject")


@query("b05_compatibility_rules", f"{_BUILD} SELECT o.id AS obligation_id, e.id AS evidence_id, 'BIND_BUILD_SUPPORTING_API' AS rule, 2 AS strength FROM o, e")
def b05(spark, sf):
    return _builds(spark, sf, "Compatibility")


@query("b06_caller_rules", f"{_BUILD} SELECT * FROM (SELECT o.id AS obligation_id, e.id AS evidence_id, 'BIND_CALLER_COMPILE' AS rule, 2 AS strength, {_PROJECT_RULE} AS r FROM o, e) WHERE r = 'BIND_BUILD_PROJECT'".replace("SELECT * FROM (SELECT o.id", "SELECT obligation_id, evidence_id, rule, strength FROM (SELECT o.id"))
def b06(spark, sf):
    return _builds(spark, sf, "CallerContract", "id")


@query("b07_app_rules", f"{_BUILD} SELECT obligation_id, evidence_id, rule, strength FROM (SELECT o.id AS obligation_id, e.id AS evidence_id, 'BIND_APP_BUILD_SUPPORTING' AS rule, 2 AS strength, {_PROJECT_RULE} AS r FROM o, e) WHERE r = 'BIND_BUILD_PROJECT'")
def b07(spark, sf):
    return _builds(spark, sf, "AppContract", "id", "StaticAnalysis")


@query("b08_direct_links", f"{_BOUND} SELECT obligation_id, evidence_id, rule FROM ln WHERE relation = 'direct'")
def b08(spark, sf):
    return binding.bind(*_bound(spark, sf), digest="now").where("relation = 'direct'").select("obligation_id", "evidence_id", "rule")


@query("d03_lines_in_hunks", "SELECT l_orderkey, p_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE l_linenumber * 7 >= p_size AND l_linenumber * 7 < p_size + greatest(p_size % 9, 1)", graph=False)
def d03(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").alias("new_start"), (F.col("p_size") % 9).alias("new_length"))
    return li.join(p, F.col("p_partkey") == F.col("l_partkey")).where(diagnostics.in_hunk(F.col("l_linenumber") * 7)).select("l_orderkey", "p_partkey")


@query("d12_cache_keys", "SELECT o_orderkey, sha256('build' || chr(10) || 'dotnet build' || chr(10) || o_orderstatus || chr(10)) AS key FROM orders", graph=False)
def d12(spark, sf):
    from changelens.operators.evidence import cache_key

    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", cache_key(F.lit("build"), F.lit("dotnet build"), F.col("o_orderstatus"), F.lit(None).cast("string")).alias("key"))


@query("f01_path_keys", "SELECT id, lower(project || '/' || relative_path) AS key, lower(relative_path) AS path FROM symbols")
def f01(spark, sf):
    s = star(spark, sf).symbols
    return s.select("id", X.project_path_key("project", F.replace(F.col("relative_path"), F.lit("/"), F.lit("\\"))).alias("key"), X.path_key("relative_path").alias("path"))


@query("f02_literal_queries", f"SELECT {C} FROM symbols WHERE contains(lower(qualified_name), '%_') LIMIT 20")
def f02(spark, sf):
    return lookup.find(star(spark, sf).symbols, "%_").select(*G.SYMBOL)


@query("f11_globs", "SELECT relative_path, regexp_matches(lower(project || '/' || relative_path), '^asia[^/]*/nation_[0-9]\\.cs$') AS hit FROM files")
def f11(spark, sf):
    path = F.concat("project", F.lit("/"), "relative_path")
    return star(spark, sf).files.select("relative_path", path.rlike(X.glob_regex("Asia*/NATION_?.cs")).alias("hit"))


@query("f17_severities", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Info' WHEN 'view' THEN 'Info' ELSE 'Warning' END AS severity FROM events", graph=False)
def f17(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "note").when(F.col("event_type") == "view", "none").otherwise("warning")
    return e.select("event_id", X.severity_of_level(level).alias("severity"))


@query("f23_diagram_text", "SELECT id, replace(replace(qualified_name, '(', '_'), '[', '_') || '_a_' AS text FROM symbols")
def f23(spark, sf):
    return star(spark, sf).symbols.select("id", X.diagram_text(F.concat("qualified_name", F.lit("<a>"))).alias("text"))


@query("m10_watched_listing", "SELECT project, relative_path, 'v2' AS content_hash FROM files WHERE n_nationkey % 2 = 0 UNION ALL SELECT project, relative_path, 'v1' FROM files WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0")
def m10(spark, sf):
    """M-10 to M-12: two listings through the stream, one trigger each; the second updates and removes."""
    from changelens.streaming import watch

    f = star(spark, sf).files
    src, state = shared_path(spark), shared_path(spark)
    seen = F.lit("2024-01-01").cast("timestamp").alias("seen_at")
    f.select("project", "relative_path", F.lit("v1").alias("content_hash"), seen).write.parquet(src)
    watch.watch(spark, src, state, once=True).awaitTermination()
    change = F.when(F.col("n_nationkey") % 2 == 0, "v2")
    f.where("n_nationkey % 2 = 0 or n_nationkey % 3 = 0").select("project", "relative_path", change.alias("content_hash"), seen).write.mode("append").parquet(src)
    watch.watch(spark, src, state, once=True).awaitTermination()
    return watch.current(spark, state)


@query("m12_update_wave", ", af AS (SELECT id, project, CASE WHEN project = 'ASIA.Tests' THEN start_line + 1 ELSE start_line END AS start_line FROM symbols WHERE project <> 'EUROPE' AND NOT (project = 'scip:AMERICA' AND start_line % 2 = 0)) SELECT id, project, CAST(start_line AS INT) AS start_line FROM af")
def m12(spark, sf):
    """M-12: a wave: the projects whose listing changed are replaced by their new analysis, projects that are gone leave, the rest stays as stored."""
    g = star(spark, sf)
    line = F.when(F.col("project") == "ASIA.Tests", F.col("start_line") + 1).otherwise(F.col("start_line")).cast(g.symbols.schema["start_line"].dataType)
    after = g.symbols.where("project <> 'EUROPE' and not (project = 'scip:AMERICA' and start_line % 2 = 0)").withColumn("start_line", line)
    listing = lambda s: s.select("project", F.col("id").alias("relative_path"), F.col("start_line").cast("string").alias("content_hash"))
    before_, after_ = listing(g.symbols), listing(after)
    dirty = incremental.dirty_projects(before_, after_)
    new = after.join(dirty, "project", "left_semi").select(*after.columns)
    fresh = G.Graph(g.files.join(dirty, "project", "left_semi").select(*g.files.columns), new, g.edges.join(new.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*g.edges.columns))
    return incremental.replace_projects(g, fresh, incremental.removed_projects(before_, after_)).symbols.select("id", "project", F.col("start_line").cast("int").alias("start_line"))


@query("v19_retargeted", "SELECT o_orderkey, 'dotnet test b' || o_orderkey || '.csproj -c R' AS command FROM orders", graph=False)
def v19(spark, sf):
    from changelens.operators.evidence import retargeted

    c = F.lit("dotnet  test All.sln -c R")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", retargeted(c, F.lit("All.sln"), F.format_string("b%s.csproj", "o_orderkey")).alias("command"))


@query("v21_surface_facts", "SELECT project, count(*) AS entries FROM (SELECT DISTINCT project, kind, qualified_name, signature FROM symbols WHERE lower(visibility) = 'public') GROUP BY project")
def v21(spark, sf):
    return arch.surface(star(spark, sf).symbols).select("project", "entries")


_V22 = """, un AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM st WHERE status = 'Unresolved'), pv AS (SELECT count(*) FILTER (status = 'Proven') AS p, count(*) FILTER (status = 'Unresolved') AS u, count(*) FILTER (required AND status = 'Failed') AS f FROM st)
SELECT 0 AS part, CAST(k AS BIGINT) AS k, line FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest(['## Proof verdict', '', '**' || CASE WHEN f > 0 THEN 'NOTREADY' ELSE '' END || '**', 'Reason: `OBLIGATION_FAILED`', '']) AS line FROM pv)
UNION ALL SELECT 1, 0, 'Obligations: ' || p || ' proven / ' || u || ' unresolved' FROM pv
UNION ALL SELECT 2, k, line FROM (SELECT unnest([0, 1]) AS k, unnest(['', '### Unresolved (' || u || ')']) AS line FROM pv WHERE u > 0)
UNION ALL SELECT 3, k, '- `P` ' || subject_id || ' (unknown file)' FROM un WHERE k < 30
UNION ALL SELECT 4, 0, '- ... and ' || (u - 30) || ' more' FROM pv WHERE u > 30
UNION ALL SELECT 5, k, line FROM (SELECT unnest([0, 1]) AS k, unnest(['', '### Blocking constraints (1)']) AS line) UNION ALL SELECT 6, 0, '- `C1` rules are missing'"""


@query("v22_summary", f"{_BOUND} {_V22}")
def v22(spark, sf):
    from changelens.operators.evidence import summary_lines

    o, e = _bound(spark, sf)
    st = kept(binding.statuses(o, binding.bound(o, e, "now"), e))
    constraints = spark.createDataFrame([("C1", "rules are missing", "Blocking"), ("C2", "no matter", "info")], "code string, message string, severity string")
    return summary_lines(binding.verdict(st, e, constraints), st, constraints, "OBLIGATION_FAILED")


@query("s26_diagram")
def s26(spark, sf):
    g = star(spark, sf)
    top = g.edges.where("source_id = 's:1' and kind = 'Calls'").orderBy("target_id").limit(20).collect()
    return spark.createDataFrame(list(enumerate(readers.mermaid([(r["source_id"], r["target_id"], r["kind"]) for r in top]).split("\n"))), "n int, line string")


@query("m05_collisions", ", s2 AS (SELECT DISTINCT 'x:' || start_line AS id, project FROM symbols) SELECT * FROM (SELECT id, project AS project_a, lead(project) OVER (PARTITION BY id ORDER BY project) AS project_b FROM s2) WHERE project_b IS NOT NULL")
def m05(spark, sf):
    return incremental.collisions(star(spark, sf).symbols.select(F.concat(F.lit("x:"), "start_line").alias("id"), "project"))
