"""Driver queries of readers, imports, evidence and the remaining functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions import exprs as X
from changelens.functions.storage import kept
from changelens.operators import arch, binding, diagnostics, evidence, incremental, obligations, rank, relations, traverse
from changelens.plans.base import C, S, query
from changelens.plans.change_queries import _BOUND, _CHANGE, _LISTINGS, POLICY, _bound, _change, _changed, _listings
from changelens.plans.graph_queries import _IS_TEST, _SURFACES, _surfaces
from changelens.sources import readers, scip
from changelens.sources.graph import SYMBOL, Bundles
from changelens.sources.graph import star_graph as star


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


@query("s15_name_status", "SELECT event_id AS doc_id, 'Modified' AS kind, 'a/F' || user_id || '.cs' AS old_path, 'a/F' || user_id || '.cs' AS new_path FROM events UNION ALL SELECT event_id, 'Renamed', 'old.cs', 'new/x.cs' FROM events UNION ALL SELECT event_id, 'Deleted', 'gone.cs', NULL FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'Added', NULL, 'gone.cs' FROM events WHERE event_id % 2 = 1", graph=False)
def s15(spark, sf):
    nul = F.lit("\u0000")
    last = F.when(F.col("event_id") % 2 == 0, "D").otherwise("A")
    text = F.concat_ws("\u0000", F.lit("M"), F.format_string("a\\F%s.cs", "user_id"), F.lit("R100"), F.lit("old.cs"), F.lit("new/x.cs"), last, F.lit("gone.cs"))
    return readers.name_status(events(spark, sf).select(F.col("event_id").alias("doc_id"), F.concat(text, nul).alias("text")))


@query("s17_trx", "SELECT event_id AS doc_id, 'T.N' || user_id AS name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS outcome, CAST(1500.0 AS DOUBLE) AS duration_ms, CASE WHEN event_type = 'error' THEN 'boom' END AS message FROM events", graph=False)
def s17(spark, sf):
    bad = F.col("event_type") == "error"
    info = F.when(bad, "<Output><ErrorInfo><Message>boom</Message><StackTrace>at X()</StackTrace></ErrorInfo></Output>").otherwise("")
    text = F.format_string('<TestRun xmlns="http://x/y"><Results><UnitTestResult testId="%s" testName="T.N%s" outcome="%s" duration="00:00:01.5000000">%s</UnitTestResult></Results></TestRun>', "event_id", "user_id", F.when(bad, "Failed").otherwise("Passed"), info)
    return readers.trx(events(spark, sf).select(F.col("event_id").alias("doc_id"), text.alias("text"))).select("doc_id", "name", "outcome", "duration_ms", "message")


@query("s18_junit", "SELECT event_id AS doc_id, 'K.' || user_id AS name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END AS outcome, CAST(250.0 AS DOUBLE) AS duration_ms FROM events", graph=False)
def s18(spark, sf):
    inner = F.when(F.col("event_type") == "error", '<failure message="m">trace</failure>').when(F.col("event_type") == "view", "<skipped>s</skipped>").otherwise("")
    suite = F.format_string('<testsuite name="s"><testcase name="%s" classname="K" time="0.25">%s</testcase></testsuite>', "user_id", inner)
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<testsuites>"), suite, F.lit("</testsuites>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?>'), suite))
    return readers.junit(events(spark, sf).select(F.col("event_id").alias("doc_id"), text.alias("text"))).select("doc_id", "name", "outcome", "duration_ms")


@query("s22_cobertura", "SELECT 'N.C' || user_id || '.M' AS method, CAST(sum(event_id % 3 + 1) AS BIGINT) AS hits FROM events GROUP BY user_id", graph=False)
def s22(spark, sf):
    m = '<method name="%s" signature="()"><lines><line number="1" hits="%s"/><line number="2" hits="%s"/></lines></method>'
    text = F.format_string(f'<coverage><packages><package name="p"><classes><class name="N.C%s" filename="f"><methods>{m}{m}</methods></class></classes></package></packages></coverage>', "user_id", F.lit("M"), F.col("event_id") % 3, F.lit(1), F.lit("Never"), F.lit(0), F.lit(0))
    return readers.cobertura(events(spark, sf).select(F.col("event_id").alias("doc_id"), text.alias("text")))


@query("s23_api_compat", "SELECT event_id AS doc_id, CASE WHEN event_type = 'error' THEN 'Fail' WHEN event_type IN ('view', 'click') THEN 'Pass' ELSE 'Uncertain' END AS status FROM events", graph=False)
def s23(spark, sf):
    kind = F.when(F.col("event_type") == "error", "Breaking").when(F.col("event_type") == "view", "additive").otherwise("passed")
    text = F.when(F.col("event_type") == "signup", "not json").when(F.col("event_type") == "purchase", '{"projects": [{"project": "A", "status": "inconclusive"}]}').otherwise(F.format_string('{"projects": [{"project": "A", "status": "unchanged"}, {"project": "B", "status": "%s"}, {"project": " "}]}', kind))
    return readers.api_status(events(spark, sf).select(F.col("event_id").alias("doc_id"), text.alias("text")))


@query("s21_build_events", "SELECT 'build-' || event_id AS id, CASE event_type WHEN 'error' THEN 'Error' ELSE 'Warning' END AS severity, 'a/F.cs' AS file FROM events WHERE event_type IN ('error', 'click')", graph=False)
def s21(spark, sf):
    e = events(spark, sf)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "warning").otherwise("message")
    return readers.build_events(e.select("event_id", level.alias("level"), F.lit("C1").alias("code"), F.lit("m").alias("message"), F.lit("a\\F.cs").alias("file"), F.lit(1).alias("line"), F.lit("P").alias("project"))).select("id", "severity", "file")


@query("s32_first_source", "SELECT event_id AS doc_id, CASE WHEN event_type = 'error' THEN 'logger' ELSE 'trx' END AS origin FROM events", graph=False)
def s32(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("doc_id"), "event_type")
    return readers.first_source(e.where("event_type = 'error'").select("doc_id", F.lit("logger").alias("origin")), e.select("doc_id", F.lit("trx").alias("origin")))


@query("s34_changed_files", "SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN '../x' ELSE 'src/F' || user_id END AS path, user_id % 3 <> 0 AS resolvable FROM events", graph=False)
def s34(spark, sf):
    p = events(spark, sf).select(F.when(F.col("user_id") % 3 == 0, "../x").otherwise(F.concat(F.lit("src\\F"), "user_id")).alias("path"), "event_type")
    return readers.changed_files(p.where("event_type = 'error'"), p.where("event_type <> 'error'"))


# An imported index over orders and lines: a document for each customer, definitions for orders, references for lines.
_SCIP = """, df AS (SELECT o_custkey AS doc, 'sym ' || CAST(o_orderkey AS VARCHAR) AS symbol, CAST(o_orderkey % 50 * 10 AS INT) AS a, CAST(o_orderkey % 50 * 10 + 5 + o_orderkey % 20 AS INT) AS b FROM orders)
, rf AS (SELECT DISTINCT o_custkey AS doc, 'sym ' || CAST(l_orderkey AS VARCHAR) AS symbol, CAST(l_partkey % 500 AS INT) AS line FROM lineitem JOIN orders ON o_orderkey = (l_orderkey + 1))
, near AS (SELECT * FROM (SELECT rf.doc, rf.symbol, rf.line, df.symbol AS outer_, row_number() OVER (PARTITION BY rf.doc, rf.symbol, rf.line ORDER BY df.b - df.a, df.symbol) AS rn FROM rf JOIN df ON df.doc = rf.doc AND rf.line BETWEEN df.a AND df.b AND df.symbol <> rf.symbol WHERE rf.symbol IN (SELECT symbol FROM df)) WHERE rn = 1)"""


def _scip(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    sym = lambda c: F.concat(F.lit("sym "), F.col(c).cast("string"))
    k = F.col("o_orderkey")
    a, b = (k % 50 * 10).cast("int"), (k % 50 * 10 + 5 + k % 20).cast("int")
    defs = o.select(F.col("o_custkey").alias("doc"), sym("o_orderkey").alias("symbol"), F.lit(True).alias("is_definition"), a.alias("start_line"), a.alias("end_line"), a.alias("enclosing_start"), b.alias("enclosing_end"))
    refs = li.join(o, F.col("o_orderkey") == F.col("l_orderkey") + 1).select(F.col("o_custkey").alias("doc"), sym("l_orderkey").alias("symbol"), (F.col("l_partkey") % 500).cast("int").alias("start_line")).distinct()
    refs = refs.select("doc", "symbol", F.lit(False).alias("is_definition"), "start_line", F.col("start_line").alias("end_line"), F.lit(None).cast("int").alias("enclosing_start"), F.lit(None).cast("int").alias("enclosing_end"))
    docs = o.select(F.col("o_custkey").alias("doc")).distinct().select("doc", F.concat(F.lit("c"), "doc", F.lit(".ts")).alias("path"), F.lit("ts").alias("language"))
    symbols = o.select(sym("o_orderkey").alias("symbol"), sym("o_orderkey").alias("name"), F.lit("Method").alias("kind"))
    rel = o.where("o_orderkey % 9 = 0").select(sym("o_orderkey").alias("symbol"), F.concat(F.lit("sym "), F.col("o_orderkey") + 1).alias("target"), F.lit(True).alias("is_implementation"))
    return scip.to_graph("demo", docs, defs.unionByName(refs), symbols, rel)


@query("s08_scip_edges", f"""{_SCIP} SELECT 'scip://demo/' || replace(outer_, ' ', '%20') AS source_id, 'scip://demo/' || replace(symbol, ' ', '%20') AS target_id, 'References' AS kind, line FROM near
UNION ALL SELECT 'scip://demo/sym%20' || o_orderkey, 'scip://demo/sym%20' || (o_orderkey + 1), 'Implements', NULL FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'scip://demo/sym%20' || (o_orderkey + 1), 'scip://demo/sym%20' || o_orderkey, 'ImplementedBy', NULL FROM orders WHERE o_orderkey % 9 = 0""")
def s08(spark, sf):
    return _scip(spark, sf).edges.select("source_id", "target_id", "kind", "line").distinct()


@query("s09_scip_imports", "SELECT 'demo' AS name, count(DISTINCT o_orderkey) AS symbols FROM orders", graph=False)
def s09(spark, sf):
    return scip.imports(_scip(spark, sf).symbols)


@query("r01_members", f"SELECT {S} FROM symbols s JOIN edges e ON e.target_id = s.id WHERE e.source_id = 's:3' AND e.kind = 'Calls' AND s.kind = 'Method' ORDER BY s.start_line NULLS LAST, s.name, s.id LIMIT 8")
def r01(spark, sf):
    g = star(spark, sf)
    e = g.edges.withColumn("kind", F.when(F.col("kind") == "Calls", "Contains").otherwise(F.col("kind")))
    return relations.members(g.symbols, e, "s:3")


@query("a12_with_members", f"""SELECT id, members FROM (SELECT {S} FROM symbols s WHERE kind = 'Interface') LEFT JOIN (SELECT source_id AS id, string_agg(name, ',' ORDER BY rn) AS members FROM (SELECT e.source_id, s.name, row_number() OVER (PARTITION BY e.source_id ORDER BY s.start_line NULLS LAST, s.name, s.id) AS rn FROM edges e JOIN symbols s ON s.id = e.target_id WHERE e.kind = 'Calls' AND s.kind = 'Method') WHERE rn <= 8 GROUP BY source_id) USING (id)""")
def a12(spark, sf):
    g = star(spark, sf)
    held = lambda df: df.withColumn("kind", F.when(F.col("kind") == "Calls", "Contains").otherwise(F.col("kind")))
    bundles = Bundles(held(g.bundles.sources), g.bundles.targets, g.bundles.keys)
    return rank.with_members(g.symbols.where("kind = 'Interface'").select(*SYMBOL), g.symbols, held(g.single), bundles=bundles).select("id", "members")


@query("a05_providers", f"""SELECT {C}, provider FROM (SELECT * FROM (SELECT {S}, 'methods' AS provider, 0 AS o FROM symbols s WHERE kind = 'Method' ORDER BY qualified_name, id LIMIT 8) UNION ALL SELECT * FROM (SELECT {S}, 'types', 1 FROM symbols s WHERE kind = 'Class' ORDER BY qualified_name, id LIMIT 8)) ORDER BY o, qualified_name, id LIMIT 12""")
def a05(spark, sf):
    s = star(spark, sf).symbols.select(*SYMBOL)
    return rank.provider_union([("methods", s.where("kind = 'Method'")), ("types", s.where("kind = 'Class'"))], 8, 12, ["qualified_name", "id"]).select(*SYMBOL, "provider")


@query("t14_slice", ", b(id, depth) AS (SELECT 0, 0 UNION SELECT CAST(u AS INT), b.depth + 1 FROM (SELECT s_suppkey AS d, s_suppkey * 2 + 1 AS u FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 7 FROM supplier) x JOIN b ON x.d = b.id WHERE b.depth < 6) SELECT CAST(id AS VARCHAR) AS id, min(depth) AS depth FROM b GROUP BY id")
def t14(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    uses = s.select(k.cast("string").alias("def_id"), F.explode(F.array((k * 2 + 1).cast("string"), (k + 7).cast("string"))).alias("use_id"))
    return traverse.slice_of(uses, spark.createDataFrame([("0",)], "id string"), backward=False, depth=6)


@query("c05_architecture_check", """, l AS (SELECT id, CASE WHEN contains(lower(project), 'asia') THEN 'asia' WHEN contains(lower(project), 'europe') THEN 'europe' END AS layer FROM symbols WHERE NOT starts_with(project, 'external:'))
, f AS (SELECT 'fan-in' AS rule, target_id AS id, count(*) AS n FROM edges GROUP BY target_id UNION ALL SELECT 'fan-out', source_id, count(*) FROM edges GROUP BY source_id)
SELECT 'layer' AS rule, e.source_id AS subject, e.target_id AS object FROM edges e JOIN l a ON a.id = e.source_id JOIN l b ON b.id = e.target_id WHERE e.kind IN ('UsesType', 'Calls', 'Imports', 'Inherits') AND a.layer = 'asia' AND b.layer = 'europe'
UNION ALL SELECT rule, id, NULL FROM f JOIN symbols USING (id) WHERE n > 60 AND NOT starts_with(project, 'external:') UNION ALL SELECT 'cycle', 'a', NULL
UNION ALL SELECT 'orphan', id, NULL FROM symbols WHERE lower(visibility) = 'public' AND NOT starts_with(project, 'external:') AND NOT """ + _IS_TEST + """ AND id NOT IN (SELECT target_id FROM edges)""")
def c05(spark, sf):
    g = star(spark, sf)
    rules = {"layers": ["asia", "europe"], "forbid": [("asia", "europe")], "max_fan_in": 60, "max_fan_out": 60}
    return arch.check(g.symbols, g.single, rules, [("a", "b"), ("b", "a")], g.bundles).select("rule", "subject", "object")


_BARE = ", bare AS (SELECT id, display, file FROM ch WHERE id LIKE 'c:%' AND NOT is_test)"


@query("v03_test_map_evidence", f"{_CHANGE} SELECT 'TM:' || id AS id, id AS subject FROM ch WHERE NOT is_test AND display IN (SELECT symbol FROM tm)")
def v03(spark, sf):
    _, ch, im, ca, rel, tm, *_ = _change(spark, sf)
    o = ch.where("not is_test").select(F.col("id").alias("subject_id"), F.col("display").alias("subject_display"), F.lit("TestMapping").alias("kind"))
    return evidence.from_test_maps(o, tm, "now").select("id", "subject")


@query("v03_surface_evidence", f"{_SURFACES}, n AS (SELECT p.project, count(*) FILTER (change <> 'added') AS bad FROM (SELECT DISTINCT project FROM bf) p LEFT JOIN d USING (project) GROUP BY p.project) SELECT project AS subject, CASE WHEN bad > 0 THEN 'Fail' ELSE 'Pass' END AS status FROM n")
def v03s(spark, sf):
    return evidence.from_surfaces(arch.surface_verdicts(*_surfaces(star(spark, sf))), "now").select("subject", "status")


@query("v10_map_suggestions", f"{_CHANGE}{_BARE}, ts AS (SELECT DISTINCT qualified_name || '.Checks.' || CAST(start_line AS VARCHAR) AS display, relative_path AS file FROM symbols WHERE start_line BETWEEN 3 AND 6) SELECT DISTINCT id, t.display AS test FROM bare JOIN ts t ON lower(t.file) = lower(bare.file) OR contains(t.display, split_part(bare.display, '.', 1)) OR contains(t.display, split_part(bare.display, '.', 2))")
def v10(spark, sf):
    g, ch = _changed(spark, sf)
    ts = g.symbols.where("start_line between 3 and 6").select(F.concat("qualified_name", F.lit(".Checks."), "start_line").alias("display"), F.col("relative_path").alias("file")).distinct()
    return binding.suggest_maps(ch.where("id like 'c:%' and not is_test"), ts)


@query("v11_coverage_hits", f"{_CHANGE} SELECT 'o' || id AS id, display AS method FROM ch WHERE id LIKE 'c:%' AND length(id) % 2 = 1 AND NOT is_test")
def v11(spark, sf):
    _, ch, *_ = _change(spark, sf)
    o = ch.where("not is_test").select(F.concat(F.lit("o"), "id").alias("id"), F.lit("P005").alias("rule_id"), F.concat("display", F.lit("(int)")).alias("subject_id"))
    return binding.coverage_hits(o, ch.where("id like 'c:%' and length(id) % 2 = 1").select(F.col("display").alias("method")))


_SECTION = """SELECT '{name}' AS section, sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS digest FROM (SELECT left(sha256({key}), 2) AS bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT {key}, sha256(CAST(to_json({{{row}}}) AS VARCHAR)) AS line FROM {table}) GROUP BY 1)"""
_V05 = ", parts AS (" + " UNION ALL ".join([
    _SECTION.format(name="impact", key="id", row="'id': id, 'project': project", table="symbols"),
    _SECTION.format(name="evidence", key="id", row="'id': id, 'kind': kind, 'status': status, 'source_digest': digest", table="ev"),
    _SECTION.format(name="evaluation", key="id", row="'id': id, 'kind': kind, 'required': required, 'status': status", table="st"),
]) + """) SELECT * FROM parts UNION ALL SELECT 'statement', sha256(concat_ws(chr(10), 'schema_version=3', 'base_revision=b', 'head_revision=h', 'verdict=NotReady', 'source_digest=now', 'toolchain=',
'impact=' || (SELECT digest FROM parts WHERE section = 'impact'), 'plan=', 'evidence=' || (SELECT digest FROM parts WHERE section = 'evidence'), 'evaluation=' || (SELECT digest FROM parts WHERE section = 'evaluation'), 'verification_plan=', 'constraints=', 'artifact_manifest='))"""  # fmt: skip


@query("v05_canonical_digest", f"{_BOUND} {_V05}")
def v05(spark, sf):
    o, e = _bound(spark, sf)
    st = binding.statuses(o, binding.bound(o, e, "now"), e).select("id", "kind", "required", "status")
    fields = {"schema_version": "3", "base_revision": "b", "head_revision": "h", "verdict": "NotReady", "source_digest": "now"}
    sections = {"impact": star(spark, sf).symbols.select("id", "project"), "evidence": e.select("id", "kind", "status", "source_digest"), "evaluation": st}
    return binding.canonical_digest(fields, {k: (v, "id") for k, v in sections.items()})


@query("v06_run_ids", "SELECT o_orderkey, 'run-' || CASE WHEN o_orderkey % 2 = 0 THEN 'nosrc' ELSE left(sha256(CAST(o_orderkey AS VARCHAR)), 12) END || '-' || left(sha256('base|' || o_orderstatus || '|full'), 8) AS run_id FROM orders", graph=False)
def v06(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    digest = F.when(F.col("o_orderkey") % 2 == 1, F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256)))
    return o.select("o_orderkey", evidence.run_id(digest, F.lit("base"), F.col("o_orderstatus"), F.lit("full")).alias("run_id"))


_FLAGS = "WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 4 AS unknown_spans, o_orderkey % 3 = 0 AS a, o_orderkey % 5 = 0 AS b, o_custkey % 2 AS h FROM orders)"


@query("v12_completeness", f"{_FLAGS} SELECT run_id, CASE WHEN unknown_spans > 0 THEN 'Partial' ELSE 'Complete' END AS location, CASE WHEN a OR b THEN 'PotentiallyTruncated' ELSE 'Complete' END AS traversal, CASE WHEN a OR b OR unknown_spans > 0 THEN 'partial' ELSE 'complete' END AS coverage, h > 0 AS has_heuristic FROM r", graph=False)
def v12(spark, sf):
    k = F.col("o_orderkey")
    r = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("run_id"), (k % 4).alias("unknown_spans"), (k % 3 == 0).alias("impact_truncated"), (k % 5 == 0).alias("caller_truncated"), (F.col("o_custkey") % 2).alias("heuristic_edges"))
    return evidence.completeness(r)


@query("v14_metrics", "SELECT event_type AS stage, count(*) AS runs, avg(value) AS mean_seconds, max(value) AS max_seconds, CAST(sum(user_id) AS BIGINT) AS rows FROM events GROUP BY event_type", graph=False)
def v14(spark, sf):
    return evidence.metrics(events(spark, sf).select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), F.col("user_id").alias("rows")))


@query("v16_imported_trust", "SELECT false AS trusted", graph=False)
def v16(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("check_id"), F.when(F.col("o_orderkey") % 100 == 1, "old").otherwise("now").alias("source_digest"))
    return binding.imported_trust(o, o, "now")


@query("v17_cached_results", "SELECT CAST(c_custkey AS VARCHAR) AS key, max_by(CAST(o_orderkey AS VARCHAR), o_orderkey) AS result, count(o_orderkey) > 0 AS hit FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", graph=False)
def v17(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("result"), F.col("o_orderkey").alias("stored_at"))
    return evidence.cached(c, o)


@query("v20_degradations", f"{_FLAGS} SELECT run_id, concat_ws(',', CASE WHEN a THEN 'FileWideFallback' END, CASE WHEN b THEN 'UntrackedCaptureFailed' END, CASE WHEN h > 0 THEN 'ContentHashCaptureFailed' END) AS degradations FROM r", graph=False)
def v20(spark, sf):
    k = F.col("o_orderkey")
    r = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("run_id"), (k % 3 == 0).alias("file_wide_fallback"), (k % 5 == 0).alias("untracked_failed"), (F.col("o_custkey") % 2 > 0).alias("hashes_failed"), F.lit(False).alias("deltas_failed"))
    return evidence.degradations(r)


@query("d07_blocked", ", bl(id) AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 40 = 3 UNION SELECT s.s_suppkey FROM supplier s JOIN bl ON s.s_suppkey // 2 = bl.id AND s.s_suppkey > 0) SELECT CAST(s_suppkey AS VARCHAR) AS check_id, CASE WHEN s_suppkey % 40 = 3 THEN 'Fail' WHEN s_suppkey IN (SELECT id FROM bl) THEN 'Blocked' ELSE 'Pass' END AS status FROM supplier")
def d07(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    c = s.select(F.col("s_suppkey").cast("string").alias("check_id"), F.when(F.col("s_suppkey") % 40 == 3, "Fail").otherwise("Pass").alias("status"))
    n = s.where("s_suppkey > 0").select(F.col("s_suppkey").cast("string").alias("check_id"), F.expr("cast(s_suppkey div 2 as string)").alias("needs"))
    return diagnostics.blocked(c, n)


@query("d10_evidence", "SELECT 'case:' || l_orderkey || ':t' || l_linenumber AS id, 'TestCase' AS kind, CASE min(l_returnflag) WHEN 'A' THEN 'Fail' WHEN 'N' THEN 'Pass' ELSE 'Skipped' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber UNION ALL SELECT 'run:' || o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Build' WHEN 1 THEN 'TestRun' ELSE 'StaticAnalysis' END, 'Pass' FROM orders", graph=False)
def d10(spark, sf):
    k = F.col("o_orderkey")
    c = spark.read.parquet(f"{sf}/orders.parquet").select(k.cast("string").alias("check_id"), F.when(k % 3 == 0, "build").when(k % 3 == 1, "test").otherwise("analysis").alias("kind"), F.lit("Pass").alias("status"), F.lit("x.csproj").alias("target"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    cases = li.select(F.col("l_orderkey").cast("string").alias("check_id"), F.concat(F.lit("t"), "l_linenumber").alias("name"), F.when(F.col("f") == "A", "Failed").when(F.col("f") == "N", "Passed").otherwise("NotExecuted").alias("outcome"))
    return diagnostics.as_evidence(c, cases, "now").select("id", "kind", "status")


@query("d15_commands", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'my dir/' || o_orderkey || '.csproj' END AS target, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 5 END AS n FROM orders", graph=False)
def d15(spark, sf):
    k = F.col("o_orderkey")
    c = F.when(k % 3 == 0, "dotnet test --no-build  -v q").otherwise(F.format_string('dotnet  test "my dir/%s.csproj" -c "a b"', k))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", evidence.command_target(c).alias("target"), (F.size(evidence.tokens(c)) - F.when(k % 3 == 0, 1).otherwise(0)).alias("n"))


@query("m03_analysis_plan", f"{_LISTINGS}, dirty AS (SELECT DISTINCT coalesce(b.project, a.project) AS project FROM bf b FULL JOIN af a ON a.project = b.project AND a.p = b.p WHERE (b.p IS NULL OR a.p IS NULL OR a.h <> b.h) AND coalesce(b.project, a.project) IN (SELECT project FROM af)) SELECT project, true AS selected FROM dirty UNION ALL SELECT 'Z', true")
def m03(spark, sf):
    b, a = _listings(spark, sf)
    refs = spark.createDataFrame([("Z", "EUROPE")], "project string, depends_on string")
    return incremental.analysis_plan(b, a, refs, spark.createDataFrame([("EUROPE", "x", "y")], "project string, before string, after string"))


@query("m08_strip_suffix", "SELECT o_orderkey, 'a#b' AS id FROM orders", graph=False)
def m08(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", incremental.strip_suffix(F.concat(F.lit("a#b"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("#"), "o_orderkey")).otherwise(""))).alias("id"))


@query("f08_names", "SELECT id, name AS last, CAST(length(qualified_name) + 5 AS INT) AS n, CASE WHEN kind = 'Method' THEN 'Customer.' || name || '()' WHEN kind = 'Interface' THEN 'Supplier.' || name ELSE NULL END AS label FROM symbols WHERE kind IN ('Method', 'Interface')")
def f08(spark, sf):
    s = star(spark, sf).symbols.where("kind in ('Method', 'Interface')")
    return s.select("id", X.last_name(F.concat("qualified_name", F.lit("(int)"))).alias("last"), F.length(F.concat("qualified_name", F.lit("(int)"))).alias("n"), X.map_label("qualified_name", "kind").alias("label"))


@query("f10_symbol_matches", "SELECT id, start_line % 3 <> 2 AS hit, start_line % 4 <> 3 AS heuristic FROM symbols WHERE kind = 'Method'")
def f10(spark, sf):
    s = star(spark, sf).symbols.where("kind = 'Method'")
    m = F.col("start_line") % 3
    want = F.when(m == 0, F.upper("qualified_name")).when(m == 1, F.concat(F.lit("A."), "qualified_name", F.lit("(x)"))).otherwise(F.col("name"))
    other = F.when(F.col("start_line") % 4 == 3, "zz").otherwise(F.concat(F.lit("X.Y."), "name"))
    return s.select("id", X.symbol_matches(F.col("id"), F.col("qualified_name"), want).alias("hit"), X.heuristic_match(F.col("qualified_name"), other).alias("heuristic"))


@query("l19_path_policy", f"{_CHANGE} SELECT path, kind FROM dl WHERE NOT (path LIKE 'src/lib/F1%' OR path LIKE '%/secrets/%')")
def l19(spark, sf):
    deltas = _change(spark, sf)[6]
    p = obligations.Policy(ignored_paths=("src/lib/F1*", "**/secrets/**"))
    return obligations.path_policy(deltas, p).select(F.coalesce("new_path", "old_path").alias("path"), "kind")


@query("l20_admitted", "SELECT CAST(o_orderkey AS VARCHAR) AS check_id FROM orders WHERE o_orderkey % 3 = 0", graph=False)
def l20(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("check_id"))
    return binding.admitted(o, o.where("check_id % 3 = 0"))


@query("f14_snapshot_digests", "SELECT o_custkey AS snapshot_id, count(*) AS files, sha256(string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'Added' ELSE 'Modified' END || chr(1) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'a/' || o_orderkey END || chr(1) || 'a/' || o_orderkey || chr(1) || chr(1) || o_orderstatus, chr(10) ORDER BY 'a/' || o_orderkey)) AS digest FROM orders GROUP BY o_custkey", graph=False)
def f14(spark, sf):
    k = F.col("o_orderkey")
    p = F.concat(F.lit("a\\"), k)
    f = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("snapshot_id"), F.when(k % 2 == 0, "Added").otherwise("Modified").alias("kind"), F.when(k % 2 == 1, p).alias("old_path"), p.alias("new_path"), F.lit(None).cast("string").alias("old_sha"), F.col("o_orderstatus").alias("new_sha"))
    return evidence.snapshot_digest(f)


@query("f15_paths", "SELECT event_id, 'Src/F' || user_id || '.g.cs' AS path, true AS generated, user_id % 2 = 0 AS aligned, 'a%20b%2A' || user_id AS escaped FROM events", graph=False)
def f15(spark, sf):
    u = F.col("user_id")
    path = X.relative_identity(F.format_string("./C:\\work\\Src\\F%s.g.cs", u), "c:/Work")
    aligned = X.paths_align(F.format_string("a/b/F%s.cs", u), F.when(u % 2 == 0, F.format_string("B/f%s.cs", u)).otherwise(F.format_string("F%s.cs", u)))
    return events(spark, sf).select("event_id", path.alias("path"), X.is_generated(path).alias("generated"), aligned.alias("aligned"), X.escape_id(F.format_string("a b*%s", u)).alias("escaped"))


@query("f22_confidence", "SELECT source_id, target_id, kind, confidence IS NOT NULL AND confidence BETWEEN 0 AND 1 AS ok FROM edges")
def f22(spark, sf):
    return star(spark, sf).whole().select("source_id", "target_id", "kind", X.valid_confidence("confidence").alias("ok"))


@query("p12_coverable", f"{_CHANGE} SELECT DISTINCT 'b' AS check_id, project AS subject FROM im WHERE EXISTS (SELECT 1 FROM ch WHERE is_public)")
def p12c(spark, sf):
    _, ch, im, *_ = _change(spark, sf)
    o = kept(obligations.public_api(ch, im, POLICY))
    hit = obligations.coverable(o, spark.createDataFrame([("b", "Build", None)], "check_id string, kind string, project string"))
    return hit.join(o.select(F.col("id").alias("obligation_id"), F.col("subject_id").alias("subject")), "obligation_id").select("check_id", "subject")
