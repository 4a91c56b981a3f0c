"""Driver queries of planning, binding, verdicts, diagnostics and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions import exprs as X
from changelens.functions.storage import kept
from changelens.operators import binding, diagnostics, incremental, obligations, relations, traverse
from changelens.plans.base import query
from changelens.plans.graph_queries import _IS_TEST
from changelens.sources import readers
from changelens.sources.graph import star_graph as star

POLICY = obligations.Policy(static_analysis_required=True, app_contract_required=True, architecture="required", test_mapping_projects=("EUROPE", "AMERICA"), manual_review_paths=("**/secrets/*",))

# A change: customers with start_line 5 changed, and suppliers 1 to 3; what is one reverse step away is impacted.
_CHANGE = f""", ch AS (SELECT id, qualified_name AS display, project, relative_path AS file, visibility = 'public' AS is_public, {_IS_TEST} AS is_test FROM symbols WHERE (kind = 'Method' AND start_line = 5) OR id IN ('s:1', 's:2', 's:3'))
, rel AS (SELECT e.target_id AS root_id, e.source_id AS impacted_id, e.kind AS edge_kind, e.resolution_kind AS resolution, e.confidence FROM edges e JOIN ch ON ch.id = e.target_id)
, im AS (SELECT DISTINCT s.id, qualified_name AS display, project, relative_path AS file, visibility = 'public' AS is_public, {_IS_TEST} AS is_test FROM symbols s JOIN rel ON rel.impacted_id = s.id)
, ca AS (SELECT DISTINCT root_id AS changed_id, impacted_id AS caller_id, im.project AS caller_project, im.is_test FROM rel JOIN im ON im.id = impacted_id WHERE edge_kind = 'Calls')
, tm AS (SELECT display AS symbol, 'Mapped.' || display AS test FROM ch WHERE id LIKE 'c:%' AND length(id) % 2 = 1)
, dl AS (SELECT CASE l_linenumber WHEN 1 THEN 'Deleted' WHEN 2 THEN 'BinaryModified' WHEN 3 THEN 'SubmoduleChanged' WHEN 4 THEN 'Modified' ELSE 'Unsupported' END AS kind, 'src/' || CASE WHEN l_partkey % 10 = 0 THEN 'secrets/' ELSE 'lib/' END || 'F' || CAST(l_partkey AS VARCHAR) || '.cs' AS path FROM (SELECT l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_partkey))"""


def _shape(s):
    return s.select("id", F.col("qualified_name").alias("display"), "project", F.col("relative_path").alias("file"), (F.col("visibility") == "public").alias("is_public"), X.is_test().alias("is_test"))


def _changed(spark, sf):
    """The graph and its changed symbols, for queries that need no edges of the change."""
    g = star(spark, sf)
    return g, kept(_shape(g.symbols.where("(kind = 'Method' and start_line = 5) or id in ('s:1', 's:2', 's:3')")))


def _change(spark, sf):
    g, changed = _changed(spark, sf)
    rel = g.edges.join(changed.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    rel = kept(rel.select(F.col("target_id").alias("root_id"), F.col("source_id").alias("impacted_id"), F.col("kind").alias("edge_kind"), F.col("resolution_kind").alias("resolution"), "confidence"))
    impacted = kept(_shape(g.symbols.join(rel.select(F.col("impacted_id").alias("id")), "id", "left_semi")))
    callers = rel.where("edge_kind = 'Calls'").join(impacted.select(F.col("id").alias("impacted_id"), F.col("project").alias("caller_project"), "file", "is_test"), "impacted_id")
    callers = callers.select(F.col("root_id").alias("changed_id"), F.col("impacted_id").alias("caller_id"), "caller_project", "file", "is_test").distinct()
    maps = changed.where("id like 'c:%' and length(id) % 2 = 1").select(F.col("display").alias("symbol"), F.concat(F.lit("Mapped."), "display").alias("test"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_partkey").agg(F.min("l_linenumber").alias("n"))
    kind = F.when(F.col("n") == 1, "Deleted").when(F.col("n") == 2, "BinaryModified").when(F.col("n") == 3, "SubmoduleChanged").when(F.col("n") == 4, "Modified").otherwise("Unsupported")
    path = F.concat(F.lit("src/"), F.when(F.col("l_partkey") % 10 == 0, "secrets/").otherwise("lib/"), F.lit("F"), "l_partkey", F.lit(".cs"))
    deltas = lines.select(kind.alias("kind"), path.alias("old_path"), F.when(F.col("n") != 1, path).alias("new_path"))
    resolved = lines.where("l_partkey % 3 = 0").select(F.concat(F.lit("lib/F"), "l_partkey", F.lit(".cs")).alias("path"))
    return g, changed, impacted, callers, rel, maps, deltas, resolved


_ID = "'O-' || {r} || '-' || left(sha256({r} || '|' || {k} || '|' || {s}), 8)"


def _o(rule: str, kind: str, subject: str, required: str, weight: str, reason: str, rest: str) -> str:
    return f"SELECT {_ID.format(r=repr(rule), k=repr(kind), s=subject)} AS id, '{rule}' AS rule_id, '{kind}' AS kind, {subject} AS subject_id, {required} AS required, CAST({weight} AS INT) AS risk_weight, {reason} AS reason {rest}"


_P01 = _o("P001A", "Compatibility", "id", "true", "4", "'changed public symbol in ' || project", "FROM ch WHERE is_public") + " UNION ALL " + _o("P001B", "Build", "project", "true", "3", "'impacted internal consumer must compile'", "FROM (SELECT min(project) AS project FROM im GROUP BY lower(project)) WHERE EXISTS (SELECT 1 FROM ch WHERE is_public)")
_P02 = _o("P002", "CallerContract", "caller_id", "true", "3", "'caller relation detected'", "FROM (SELECT DISTINCT caller_id FROM ca WHERE is_test)")
_P03 = _o("P003", "CrossProject", "project", "true", "3", "'semantic cross-project impact'", "FROM (SELECT min(project) AS project FROM im WHERE lower(project) NOT IN (SELECT lower(project) FROM ch WHERE {priv}) GROUP BY lower(project)) WHERE NOT EXISTS (SELECT 1 FROM ch WHERE is_public AND {priv})")
_P04 = _o("P004", "Test", "subject", "true", "4", "reason", """FROM (SELECT subject, arg_min(reason, rank) AS reason FROM (SELECT id AS subject, 0 AS rank, 'impacted test symbol' AS reason FROM im WHERE is_test
UNION ALL SELECT caller_id, 1, 'caller relation from a test symbol' FROM ca WHERE is_test AND changed_id IN (SELECT id FROM ch WHERE NOT is_test)
UNION ALL SELECT test, 2, 'explicit test map entry' FROM tm JOIN ch ON ch.display = tm.symbol WHERE NOT is_test) GROUP BY subject)""")
_P05 = _o("P005", "TestMapping", "id", "lower(project) IN ('europe', 'america')", "2", "'no mapped test relation found'", """FROM ch WHERE NOT is_test AND id NOT IN (SELECT root_id FROM rel JOIN im ON im.id = impacted_id WHERE im.is_test)
AND id NOT IN (SELECT changed_id FROM ca WHERE is_test) AND display NOT IN (SELECT symbol FROM tm)""")
_P07 = _o("P008", "StaticAnalysis", "project", "true", "2", "'policy.staticAnalysis=required'", "FROM (SELECT min(project) AS project FROM (SELECT project FROM im UNION SELECT project FROM ch) GROUP BY lower(project))")
_P08 = _o("P009", "ManualReview", "path", "true", "3", "reason", """FROM (SELECT path, CASE WHEN contains(path, '/secrets/') THEN 'MANUAL_REVIEW_REQUIRED' WHEN kind = 'Deleted' AND NOT (contains(path, 'lib/') AND CAST(regexp_extract(path, 'F([0-9]+)', 1) AS INT) % 3 = 0) THEN 'CHANGE_DELETION_ANALYSIS_UNAVAILABLE'
WHEN kind = 'BinaryModified' THEN 'CHANGE_BINARY_ANALYSIS_UNAVAILABLE' WHEN kind = 'SubmoduleChanged' THEN 'CHANGE_SUBMODULE_ANALYSIS_UNAVAILABLE' END AS reason FROM dl) WHERE reason IS NOT NULL""")
_P09 = _o("P010", "AppContract", "id", "true", "2", "'application edge in the impact'", """FROM (SELECT DISTINCT impacted_id AS id FROM rel WHERE edge_kind IN ('RoutesTo', 'Registers', 'ResolvesTo', 'Renders', 'BindsTo', 'HandlesEvent', 'UsesViewModel') AND resolution <> 'heuristic' AND (confidence IS NULL OR confidence >= 0.75)) WHERE id NOT IN (SELECT id FROM im WHERE is_test)""")


@query("p01_public_api", f"{_CHANGE} {_P01}")
def p01(spark, sf):
    _, ch, im, *_ = _change(spark, sf)
    return obligations.public_api(ch, im, POLICY)


@query("p02_caller_contracts", f"{_CHANGE} {_P02}")
def p02(spark, sf):
    return obligations.caller_contracts(_change(spark, sf)[3])


@query("p03_cross_project", f"{_CHANGE} {_P03.format(priv='NOT is_public')}")
def p03(spark, sf):
    _, ch, im, *_ = _change(spark, sf)
    return obligations.cross_project(ch.where("not is_public"), im, POLICY)


@query("p04_tests", f"{_CHANGE} {_P04} UNION ALL {_P05}")
def p04(spark, sf):
    _, ch, im, ca, rel, tm, *_ = _change(spark, sf)
    return obligations.tests(ch, im, ca, rel, tm, POLICY)


@query("p07_static_analysis", f"{_CHANGE} {_P07}")
def p07(spark, sf):
    _, ch, im, *_ = _change(spark, sf)
    return obligations.static_analysis(ch, im, POLICY)


@query("p08_capture", f"{_CHANGE} {_P08}")
def p08(spark, sf):
    *_, deltas, resolved = _change(spark, sf)
    return obligations.capture(deltas, resolved, POLICY)


@query("p08_constraints", f"{_CHANGE} SELECT 'CHANGE_UNSUPPORTED_KIND' AS code, 'blocking' AS severity, 'Unsupported change' AS message, path AS subject FROM dl WHERE kind = 'Unsupported' AND NOT contains(path, '/secrets/') UNION ALL SELECT 'IMPACT_POTENTIALLY_TRUNCATED', 'blocking', 'Impact traversal reached a result limit', NULL")
def p08c(spark, sf):
    return obligations.constraints(spark, obligations.Completeness(impact_truncated=True), POLICY, _change(spark, sf)[6])


@query("p09_app_contracts", f"{_CHANGE} {_P09.replace('edge_kind IN', "CASE edge_kind WHEN 'Calls' THEN 'RoutesTo' WHEN 'Implements' THEN 'BindsTo' ELSE edge_kind END IN")}")
def p09(spark, sf):
    _, _, im, _, rel, *_ = _change(spark, sf)
    kind = F.when(F.col("edge_kind") == "Calls", "RoutesTo").when(F.col("edge_kind") == "Implements", "BindsTo").otherwise(F.col("edge_kind"))
    return obligations.app_contracts(rel.withColumn("edge_kind", kind), im, POLICY)


_VIOLATIONS = ", vi AS (SELECT id AS subject_id, CASE WHEN start_line % 2 = 0 THEN 'layer' ELSE 'fan-in' END AS kind FROM symbols UNION ALL SELECT id, 'orphan' FROM symbols WHERE kind = 'Class')"
_P10 = _o("P011", "Architecture", "subject_id", "contains(kinds, 'layer')", "CASE WHEN contains(kinds, 'layer') THEN 3 ELSE 1 END", "kinds", "FROM (SELECT subject_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM vi GROUP BY subject_id)") + " UNION ALL " + _o("P011", "Architecture", "'architecture-rules'", "true", "3", "'architecture policy check required'", "")


def _violations(g):
    v = g.symbols.select(F.col("id").alias("subject_id"), F.when(F.col("start_line") % 2 == 0, "layer").otherwise("fan-in").alias("kind"))
    return v.unionByName(g.symbols.where("kind = 'Class'").select(F.col("id").alias("subject_id"), F.lit("orphan").alias("kind")))


@query("p10_architecture", f"{_VIOLATIONS} {_P10}")
def p10(spark, sf):
    return obligations.architecture(spark, _violations(star(spark, sf)), obligations.Completeness(rules_present=True), POLICY)


_PLAN = " UNION ALL ".join([_P01, _P02, _P03.format(priv="true"), _P04, _P05, _P07, _P08, _P09, _P10])


def _plan(spark, sf):
    g, ch, im, ca, rel, tm, deltas, resolved = _change(spark, sf)
    return kept(obligations.plan(spark, ch, im, ca, rel, POLICY, tm, deltas, resolved, _violations(g), obligations.Completeness(rules_present=True)))


@query("p11_plan", f"{_CHANGE} {_VIOLATIONS} {_PLAN}")
def p11(spark, sf):
    return _plan(spark, sf)


_CAPS = [("build-all", "Build", None), ("build-europe", "Build", "EUROPE"), ("api", "Compatibility", None), ("tests", "Test", None), ("lint", "StaticAnalysis", None)]


@query("p13_uncovered", f"{_CHANGE} {_VIOLATIONS}, pl AS ({_PLAN}) SELECT 'REQUIRED_EVIDENCE_CAPABILITY_MISSING' AS code, 'blocking' AS severity, id AS subject FROM pl WHERE required AND kind NOT IN ('Build', 'Compatibility', 'Test', 'StaticAnalysis')")
def p13(spark, sf):
    plan = _plan(spark, sf)
    return obligations.uncovered(plan, obligations.coverable(plan, spark.createDataFrame(_CAPS, "check_id string, kind string, project string")))


# Obligations and evidence: one of each for every symbol, with digests that fit, are missing or are another.
_BOUND = """, ob AS (SELECT 'o:' || id AS id, CASE start_line % 5 WHEN 0 THEN 'TestMapping' WHEN 1 THEN 'Compatibility' WHEN 2 THEN 'Test' WHEN 3 THEN 'AppContract' ELSE 'StaticAnalysis' END AS kind, CASE WHEN start_line % 5 = 4 THEN project ELSE id END AS subject_id, project AS subject_project, start_line % 2 = 0 AS required FROM symbols)
, ev AS (SELECT 'e:' || id AS id, CASE start_line % 5 WHEN 0 THEN 'TestMapping' WHEN 1 THEN 'ApiCompatibility' WHEN 2 THEN 'TestCase' WHEN 3 THEN 'RuntimeCoverage' ELSE 'StaticAnalysis' END AS kind, CASE start_line % 3 WHEN 0 THEN 'Fail' WHEN 1 THEN 'Pass' ELSE 'InfraError' END AS status, CASE WHEN start_line % 5 = 4 THEN project ELSE id END AS subject, CASE WHEN symbols.kind = 'Interface' THEN 'all.sln' ELSE 'x/none.csproj' END AS target, CASE length(id) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE 'now' END AS digest FROM symbols)
, ln AS (SELECT ob.id AS obligation_id, ev.id AS evidence_id, CASE WHEN d IS NOT NULL THEN d.rel ELSE NULL END AS relation, d.n AS strength, d.rule, d.reason FROM (SELECT ob.id AS oid, ev.id AS eid, CASE
  WHEN ev.kind = 'TestMapping' AND ob.kind = 'TestMapping' AND ev.subject = ob.subject_id THEN {'rel': 'direct', 'n': 3, 'rule': 'BIND_TEST_MAPPING', 'reason': 'SCOPE_MATCH'}
  WHEN ev.kind = 'RuntimeCoverage' AND ob.kind IN ('TestMapping') AND ev.subject = ob.subject_id THEN {'rel': 'direct', 'n': 3, 'rule': 'BIND_TEST_MAPPING', 'reason': 'SCOPE_MATCH'}
  WHEN ev.kind = 'ApiCompatibility' AND ob.kind = 'Compatibility' AND ev.subject = ob.subject_id THEN {'rel': 'direct', 'n': 3, 'rule': 'BIND_API_COMPAT', 'reason': 'SCOPE_MATCH'}
  WHEN ev.kind = 'ApiCompatibility' AND ob.kind = 'Compatibility' AND ev.target = 'all.sln' THEN {'rel': 'supporting', 'n': 2, 'rule': 'BIND_API_COMPAT_SUPPORTING', 'reason': 'EVIDENCE_TOO_WEAK'}
  WHEN ev.kind = 'TestCase' AND ob.kind = 'Test' AND ev.subject = ob.subject_id THEN {'rel': 'direct', 'n': 3, 'rule': 'BIND_TEST_CASE', 'reason': 'SCOPE_MATCH'}
  WHEN ev.kind = 'TestCase' AND ob.kind = 'Test' AND (contains(ev.subject, ob.subject_id) OR contains(ob.subject_id, ev.subject)) THEN {'rel': 'supporting', 'n': 2, 'rule': 'BIND_TEST_HEURISTIC', 'reason': 'EVIDENCE_TOO_WEAK'}
  WHEN ev.kind = 'RuntimeCoverage' AND ob.kind = 'AppContract' AND ev.subject = ob.subject_id THEN {'rel': 'direct', 'n': 3, 'rule': 'BIND_APP_COVERAGE', 'reason': 'SCOPE_MATCH'}
  WHEN ev.kind = 'StaticAnalysis' AND ob.kind = 'StaticAnalysis' AND lower(ev.subject) = lower(ob.subject_id) THEN {'rel': 'direct', 'n': 3, 'rule': 'BIND_STATIC_ANALYSIS', 'reason': 'SCOPE_MATCH'}
  WHEN ev.kind = 'StaticAnalysis' AND ob.kind = 'StaticAnalysis' AND ev.target = 'all.sln' THEN {'rel': 'supporting', 'n': 2, 'rule': 'BIND_STATIC_ANALYSIS', 'reason': 'SCOPE_SUPPORTING'} END AS d
  FROM ob, ev WHERE ev.digest = 'now') x JOIN ob ON ob.id = oid JOIN ev ON ev.id = eid WHERE d IS NOT NULL)
, st AS (SELECT ob.*, CASE coalesce(best, 0) WHEN 3 THEN 'Failed' WHEN 2 THEN 'Blocked' WHEN 1 THEN 'Proven' ELSE 'Unresolved' END AS status FROM ob LEFT JOIN (SELECT obligation_id, max(CASE status WHEN 'Fail' THEN 3 WHEN 'InfraError' THEN 2 WHEN 'Pass' THEN 1 ELSE 0 END) AS best FROM ln JOIN ev ON ev.id = evidence_id WHERE relation = 'direct' AND strength >= 3 GROUP BY obligation_id) b ON b.obligation_id = ob.id)"""


def _bound(spark, sf):
    s = star(spark, sf).symbols
    m, own = F.col("start_line") % 5, F.when(F.col("start_line") % 5 == 4, F.col("project")).otherwise(F.col("id"))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (m + 1).cast("int"))
    o = s.select(F.concat(F.lit("o:"), "id").alias("id"), F.lit("P").alias("rule_id"), pick(["TestMapping", "Compatibility", "Test", "AppContract", "StaticAnalysis"]).alias("kind"), own.alias("subject_id"), F.col("project").alias("subject_project"), F.lit(None).cast("string").alias("subject_display"), (F.col("start_line") % 2 == 0).alias("required"))
    n = F.length("id")
    digest = F.when(n % 4 == 1, "old").when(n % 4 != 0, "now")
    status = F.when(F.col("start_line") % 3 == 0, "Fail").when(F.col("start_line") % 3 == 1, "Pass").otherwise("InfraError")
    e = s.select(
        F.concat(F.lit("e:"), "id").alias("id"), pick(["TestMapping", "ApiCompatibility", "TestCase", "RuntimeCoverage", "StaticAnalysis"]).alias("kind"), status.alias("status"), F.lit("check").alias("check_id"), own.alias("subject"),
        F.when(F.col("kind") == "Interface", "all.sln").otherwise("x/none.csproj").alias("target"), digest.alias("source_digest"), F.lit(None).cast("array<struct<id:string,project:string,name:string>>").alias("refs"), F.lit(None).cast("array<string>").alias("subjects"),
    )
    return kept(o), kept(e)


@query("b01_bind", f"{_BOUND} SELECT obligation_id, evidence_id, relation, CAST(strength AS INT) AS strength, rule, reason FROM ln")
def b01(spark, sf):
    return binding.bind(*_bound(spark, sf), digest="now")


@query("b01_link_counts", f"{_BOUND} SELECT evidence_id, ob.kind AS o_kind, relation, CAST(strength AS INT) AS strength, rule, reason, count(*) AS obligations FROM ln JOIN ob ON ob.id = obligation_id GROUP BY ALL")
def b01_link_counts(spark, sf):
    return binding.bound(*_bound(spark, sf), digest="now").counted()


@query("b01_rejections", f"{_BOUND} SELECT id AS evidence_id, 'BIND_SOURCE_DIGEST' AS rule, CASE WHEN digest IS NULL THEN 'EVIDENCE_SOURCE_IDENTITY_MISSING' ELSE 'EVIDENCE_STALE_SOURCE' END AS reason, (SELECT count(*) FROM ob) AS obligations FROM ev WHERE digest IS NULL OR digest <> 'now'")
def b01_rejections(spark, sf):
    return binding.rejections(*_bound(spark, sf), digest="now")


@query("b03_digest_states", f"{_BOUND} SELECT id, CASE WHEN digest IS NULL THEN 'missing' WHEN digest = 'now' THEN 'valid' ELSE 'stale' END AS state FROM ev")
def b03(spark, sf):
    return _bound(spark, sf)[1].select("id", binding.digest_state("now").alias("state"))


@query("v01_statuses", f"{_BOUND} SELECT id, kind, required, status FROM st")
def v01(spark, sf):
    o, e = _bound(spark, sf)
    return binding.statuses(o, binding.bound(o, e, "now"), e).select("id", "kind", "required", "status")


@query("v02_verdict", f"{_BOUND} SELECT 'NotReady' AS verdict, count(*) FILTER (required) AS required_n, count(*) FILTER (required AND status = 'Proven') AS proven_n, count(*) FILTER (required AND status = 'Failed') AS failed_n, CAST(1 AS BIGINT) AS blocking_n FROM st")
def v02(spark, sf):
    o, e = _bound(spark, sf)
    ev = binding.statuses(o, binding.bound(o, e, "now"), e)
    return binding.verdict(ev, e, spark.createDataFrame([("C", "Blocking")], "code string, severity string"))


@query("r11_explain", f"{_BOUND} SELECT id, count(evidence_id) AS links, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id), '') AS evidence FROM ob LEFT JOIN (SELECT * FROM ln WHERE relation <> 'rejected') l ON l.obligation_id = ob.id GROUP BY id")
def r11(spark, sf):
    o, e = _bound(spark, sf)

    def listed(links):
        ids = F.transform(F.coalesce(links, F.array()), lambda v: v["evidence_id"])
        return [F.size(ids).cast("long").alias("links"), F.array_join(F.array_sort(ids), ",").alias("evidence")]

    return relations.explain(o, binding.bound(o, e, "now"), e, listed).select("id", "links", "evidence")


@query("a14_certificate_summary", f"{_BOUND} SELECT count(*) FILTER (status = 'Proven') AS proven, count(*) FILTER (status = 'Unresolved') AS unresolved, count(*) FILTER (required) AS required, CAST(1 AS BIGINT) AS blocking FROM st")
def a14(spark, sf):
    from changelens.operators import rank

    o, e = _bound(spark, sf)
    return rank.certificate_summary(binding.statuses(o, binding.bound(o, e, "now"), e), spark.createDataFrame([("C", "blocking"), ("D", "advisory")], "code string, severity string"))


@query("l17_open_obligations", f"{_BOUND} SELECT id, status FROM st WHERE status IN ('Unresolved', 'Failed')")
def l17(spark, sf):
    o, e = _bound(spark, sf)
    return binding.statuses(o, binding.bound(o, e, "now"), e).where("status in ('Unresolved', 'Failed')").select("id", "status")


@query("v08_exceptions", f"{_BOUND} SELECT id, CASE WHEN subject_id LIKE 's:%' THEN 'Expired' WHEN subject_id = 'p:3' THEN 'Valid' ELSE NULL END AS exception FROM ob")
def v08(spark, sf):
    o, _ = _bound(spark, sf)
    sup = o.where("subject_id like 's:%'").select(F.lit("P").alias("rule_id"), "subject_id", F.lit("").alias("source_digest"), F.lit("sig").alias("signature"), F.lit("2020-01-01").cast("timestamp").alias("expires_at"))
    one = spark.createDataFrame([("P", "p:3", "now", "sig", None), ("P", "p:3", "old", "", None), ("Q", "*", "", "sig", None)], "rule_id string, subject_id string, source_digest string, signature string, expires_at timestamp")
    return binding.exceptions(o, sup.distinct().unionByName(one), F.lit("2024-01-01").cast("timestamp"), "now").select("id", "exception")


@query("v09_certificate_diff", f"{_BOUND}, b AS (SELECT id, status FROM st WHERE length(id) % 2 = 0 OR required), a AS (SELECT id, CASE WHEN required THEN 'Proven' ELSE status END AS status FROM st WHERE length(id) % 3 <> 0) SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.status <> b.status")
def v09(spark, sf):
    o, e = _bound(spark, sf)
    st = kept(binding.statuses(o, binding.bound(o, e, "now"), e).withColumn("what", F.lit("obligation")))
    after = st.where("length(id) % 3 <> 0").withColumn("status", F.when(F.col("required"), "Proven").otherwise(F.col("status")))
    return binding.certificate_diff(st.where("length(id) % 2 = 0 or required"), after).select("id", "change")


@query("v04_route_coverage", f"{_CHANGE} SELECT DISTINCT e.target_id AS id FROM edges e JOIN ch ON ch.id = e.target_id WHERE e.kind = 'Implements' AND e.resolution_kind = 'semantic' AND NOT ch.is_test ")
def v04(spark, sf):
    g, ch, *_ = _change(spark, sf)
    routes = g.edges.where("kind = 'Implements'").withColumn("kind", F.lit("RoutesTo"))
    return binding.route_coverage(routes, g.symbols.select(F.col("id").alias("route")), ch)


@query("v15_test_projects", f"SELECT id, CASE WHEN project = 'EUROPE' THEN true WHEN project = 'ASIA.Tests' THEN false ELSE {_IS_TEST} END AS is_test FROM symbols")
def v15(spark, sf):
    return binding.test_projects(star(spark, sf).symbols, spark.createDataFrame([("europe", True), ("Asia.tests", False)], "project string, is_test boolean"))


# Diagnostics over events: kinds by event type, places by user and event.
_DIAG = """, dg AS (SELECT 'd' || CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN 'Build' WHEN 'signup' THEN 'Test' ELSE 'Analysis' END AS kind, CASE WHEN event_type IN ('error', 'signup') THEN 'Error' WHEN event_type = 'click' THEN 'Warning' ELSE 'Info' END AS severity, event_type AS code, CAST(user_id % 7 AS VARCHAR) AS message, CASE WHEN user_id % 11 = 0 THEN 'obj/F' ELSE 'src/F' END || CAST(user_id % 50 AS VARCHAR) || '.cs' AS file, CAST(event_id % 40 AS INT) AS line, event_id, user_id FROM events)
, hk AS (SELECT 'src/F' || CAST(p_partkey % 50 AS VARCHAR) || '.cs' AS file, CAST(p_size AS INT) AS ns, CAST(p_size % 4 AS INT) AS nl FROM part), cf AS (SELECT 'src/f' || CAST(n_nationkey AS VARCHAR) || '.CS' AS file FROM nation)
, graded AS (SELECT dg.id, dg.kind, severity, code, message, dg.file, line, CAST((CASE WHEN c.file IS NOT NULL THEN 60 ELSE 0 END) + (CASE WHEN EXISTS (SELECT 1 FROM hk WHERE hk.file = dg.file AND line >= ns AND line < ns + greatest(nl, 1)) THEN 100 ELSE 0 END)
+ CASE WHEN event_id % 3 = 0 THEN -60 ELSE 0 END + CASE WHEN event_id % 3 = 1 AND 'src/f' || CAST(event_id % 30 AS VARCHAR) || '.cs' IN (SELECT lower(file) FROM cf) THEN 60 ELSE 0 END + CASE WHEN event_id % 3 = 1 AND event_id % 40 > 0 AND EXISTS (SELECT 1 FROM hk WHERE lower(hk.file) = 'src/f' || CAST(event_id % 30 AS VARCHAR) || '.cs' AND line >= ns AND line < ns + greatest(nl, 1)) THEN 90 ELSE 0 END
+ CASE WHEN dg.kind = 'Test' AND (c.file IS NOT NULL OR (event_id % 3 = 1 AND 'src/f' || CAST(event_id % 30 AS VARCHAR) || '.cs' IN (SELECT lower(file) FROM cf))) THEN 50 ELSE 0 END + CASE WHEN dg.kind = 'Build' AND severity = 'Error' THEN 50 ELSE 0 END + CASE WHEN dg.kind = 'Test' THEN 45 ELSE 0 END + CASE WHEN severity = 'Warning' THEN -20 ELSE 0 END + CASE WHEN starts_with(dg.file, 'obj/') THEN -40 ELSE 0 END AS BIGINT) AS score
FROM dg LEFT JOIN cf c ON lower(c.file) = lower(dg.file))"""


def _diagnostics(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "Build").when(F.col("event_type") == "signup", "Test").otherwise("Analysis")
    severity = F.when(F.col("event_type").isin("error", "signup"), "Error").when(F.col("event_type") == "click", "Warning").otherwise("Info")
    file = F.concat(F.when(F.col("user_id") % 11 == 0, "obj/F").otherwise("src/F"), F.col("user_id") % 50, F.lit(".cs"))
    d = e.select(F.concat(F.lit("d"), "event_id").alias("id"), kind.alias("kind"), severity.alias("severity"), F.lit("events").alias("source"), F.col("event_type").alias("code"), (F.col("user_id") % 7).cast("string").alias("message"), file.alias("file"), (F.col("event_id") % 40).cast("int").alias("line"), F.lit(None).cast("string").alias("test_name"), F.lit(1.0).alias("confidence"))
    f = e.where("event_id % 3 < 2").select(F.concat(F.lit("d"), "event_id").alias("diagnostic_id"), (F.col("event_id") % 3 == 0).alias("is_framework"), F.concat(F.lit("src/F"), F.col("event_id") % 30, F.lit(".cs")).alias("file"), (F.col("event_id") % 40).cast("int").alias("line"))
    h = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("src/F"), F.col("p_partkey") % 50, F.lit(".cs")).alias("file"), F.col("p_size").cast("int").alias("new_start"), (F.col("p_size") % 4).cast("int").alias("new_length"))
    c = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("src/f"), "n_nationkey", F.lit(".CS")).alias("file"))
    return diagnostics.scored(d, f, h, c)


@query("d01_scores", f"{_DIAG} SELECT id, score FROM graded")
def d01(spark, sf):
    return _diagnostics(spark, sf).select("id", "score")


@query("d02_ranked", f"{_DIAG} SELECT id, kind, severity, score FROM (SELECT *, row_number() OVER (PARTITION BY kind, code, message, lower(file), line ORDER BY score DESC, CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END, id) AS rn FROM graded) WHERE rn = 1")
def d02(spark, sf):
    return diagnostics.ranked(_diagnostics(spark, sf)).select("id", "kind", "severity", "score")


@query("d14_failure_pack", f"{_DIAG} SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY kind, code, message, lower(file), line ORDER BY score DESC, id) AS rn FROM graded) WHERE rn = 1 AND severity = 'Error' ORDER BY score DESC, id LIMIT 20")
def d14(spark, sf):
    return diagnostics.failure_pack(diagnostics.ranked(_diagnostics(spark, sf))).select("id", "score")


@query("l18_of_kind", f"{_DIAG} SELECT id FROM dg WHERE lower(kind) = 'test'")
def l18(spark, sf):
    return diagnostics.of_kind(_diagnostics(spark, sf), "test").select("id")


_RUNS = "WITH ck AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey AS VARCHAR) AS check_id, CASE o_orderkey % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'test' ELSE 'analysis' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN 'Fail' WHEN 1 THEN 'InfraError' WHEN 2 THEN 'Uncertain' ELSE 'Pass' END AS status FROM orders)"


def _checks(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "build").when(F.col("o_orderkey") % 3 == 1, "test").otherwise("analysis")
    status = F.when(F.col("o_orderkey") % 7 == 0, "Fail").when(F.col("o_orderkey") % 7 == 1, "InfraError").when(F.col("o_orderkey") % 7 == 2, "Uncertain").otherwise("Pass")
    return o.select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("check_id"), kind.alias("kind"), status.alias("status"))


@query("d04_sufficiency", f"""{_RUNS}, di AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey AS VARCHAR) AS check_id, CASE WHEN l_linenumber < 3 THEN 'Build' ELSE 'Test' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'Error' ELSE 'Warning' END AS severity, 1.0 - l_discount * 6 AS confidence, CASE WHEN l_linenumber > 4 THEN 't' END AS test_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N')
, own AS (SELECT run_id, check_id, count(*) FILTER (kind = 'Build') AS builds, count(test_name) AS named FROM di GROUP BY ALL), dd AS (SELECT run_id, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Error' AND confidence < 0.5) AS unsure FROM di GROUP BY run_id)
, r AS (SELECT ck.run_id, max(CASE status WHEN 'InfraError' THEN 4 WHEN 'Fail' THEN 3 WHEN 'Uncertain' THEN 2 ELSE 1 END) AS worst, bool_or(kind = 'build' AND status = 'Fail' AND coalesce(builds, 0) = 0) AS bb, bool_or(kind = 'test' AND status = 'Fail' AND coalesce(named, 0) = 0) AS bt FROM ck LEFT JOIN own USING (run_id, check_id) GROUP BY ck.run_id)
, x AS (SELECT r.*, coalesce(errors, 0) AS e, coalesce(unsure, 0) AS u FROM r LEFT JOIN dd USING (run_id))
SELECT run_id, CASE WHEN worst = 1 THEN '' ELSE concat_ws(',', CASE WHEN worst = 4 THEN 'infrastructure' END, CASE WHEN e = 0 THEN 'no-primary' END, CASE WHEN bb THEN 'build-without-diagnostics' END, CASE WHEN NOT bb AND bt THEN 'test-without-name' END, CASE WHEN NOT bb AND u > 0 THEN 'low-confidence' END) END AS notes,
worst = 1 OR (NOT bb AND e > 0) AS sufficient, worst <> 1 AND (bb OR e = 0 OR bt OR u > 0) AS force_uncertain, CASE WHEN worst = 1 THEN 'Pass' WHEN worst = 4 THEN 'InfraError' WHEN bb OR e = 0 OR bt OR u > 0 THEN 'Uncertain' WHEN worst = 3 THEN 'Fail' ELSE 'Uncertain' END AS status FROM x""", graph=False)
def d04(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag <> 'N'")
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    d = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("check_id"), F.when(F.col("l_linenumber") < 3, "Build").otherwise("Test").alias("kind"),
        F.when(F.col("l_linenumber") % 2 == 0, "Error").otherwise("Warning").alias("severity"), (1.0 - F.col("l_discount") * 6).alias("confidence"), F.when(F.col("l_linenumber") > 4, "t").alias("test_name"),
    )
    return diagnostics.sufficiency(_checks(spark, sf), d)


@query("d05_overall", f"{_RUNS} SELECT run_id, CASE max(CASE status WHEN 'InfraError' THEN 3 WHEN 'Fail' THEN 2 WHEN 'Uncertain' THEN 1 ELSE 0 END) WHEN 3 THEN 'InfraError' WHEN 2 THEN 'Fail' WHEN 1 THEN 'Uncertain' ELSE 'Pass' END AS status FROM ck GROUP BY run_id", graph=False)
def d05(spark, sf):
    return diagnostics.overall(_checks(spark, sf))


@query("d11_run_totals", "SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS passed, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A') AS skipped, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'Fail' WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'Pass' ELSE 'Uncertain' END AS status FROM lineitem GROUP BY l_orderkey", graph=False)
def d11(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    outcome = F.when(F.col("l_returnflag") == "N", "Passed").when(F.col("l_returnflag") == "R", "failed").otherwise("Skipped")
    return diagnostics.run_totals(li.select(F.col("l_orderkey").cast("string").alias("run_id"), outcome.alias("outcome")))


@query("d09_excerpts", "SELECT output_id, line_no FROM (SELECT l_suppkey AS output_id, l_orderkey * 10 + l_linenumber AS line_no, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS rn FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)) WHERE rn <= 40", graph=False)
def d09(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    return diagnostics.excerpts(li.select(F.col("l_suppkey").alias("output_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no")))


@query("d13_retention", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, (rn > 20 AND o_orderdate < DATE '1998-01-01' AND o_orderkey <> 5 AND o_orderkey % 9 <> 0) AS prune FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders)", graph=False)
def d13(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    runs = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderkey") % 9 == 0).alias("active"))
    return diagnostics.retained(runs, F.lit("1998-01-08").cast("timestamp"), protected="5").select("run_id", "prune")


@query("d16_latest_run", """SELECT run_id, "at" FROM (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "at", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""", graph=False)
def d16(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("date").cast("string").alias("at"), "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("by"))
    return obligations.latest(o, "o_custkey", "by").select("run_id", "at")


@query("a13_history", """SELECT kind, value, count(*) AS n, min("at") AS first_at, max("at") AS last_at FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "at", 'verdict' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'rule', o_orderpriority FROM orders UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'reason', 'open' FROM orders WHERE o_orderstatus = 'O') GROUP BY kind, value""", graph=False)
def a13(spark, sf):
    from changelens.operators import rank

    o = spark.read.parquet(f"{sf}/orders.parquet")
    return rank.history(o.select(F.col("o_orderdate").cast("date").cast("string").alias("at"), F.col("o_orderstatus").alias("verdict"), F.array("o_orderpriority").alias("rules"), F.array(F.when(F.col("o_orderstatus") == "O", "open")).alias("reasons")))


@query("v07_gate", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS run_id FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')", graph=False)
def v07(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return binding.gate(o.select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("code")), ["1-Urgent", "2-HIGH"])


_LISTINGS = ", bf AS (SELECT project, qualified_name AS p, start_line % 13 AS h FROM symbols WHERE start_line % 7 <> 0 AND project <> 'EUROPE'), af AS (SELECT project, qualified_name AS p, CASE WHEN start_line % 5 = 0 THEN -1 ELSE start_line % 13 END AS h FROM symbols WHERE start_line % 11 <> 0 AND project <> 'external:AFRICA')"


def _listings(spark, sf):
    s = star(spark, sf).symbols.select("project", F.col("qualified_name").alias("relative_path"), "start_line")
    b = s.where("start_line % 7 <> 0 and project <> 'EUROPE'").select("project", "relative_path", (F.col("start_line") % 13).cast("string").alias("content_hash"))
    a = s.where("start_line % 11 <> 0 and project <> 'external:AFRICA'").select("project", "relative_path", F.when(F.col("start_line") % 5 == 0, "-1").otherwise((F.col("start_line") % 13).cast("string")).alias("content_hash"))
    return b, a


@query("m01_file_changes", f"{_LISTINGS} SELECT coalesce(b.project, a.project) AS project, coalesce(b.p, a.p) AS relative_path, CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' ELSE 'updated' END AS change FROM bf b FULL JOIN af a ON a.project = b.project AND a.p = b.p WHERE b.p IS NULL OR a.p IS NULL OR a.h <> b.h")
def m01(spark, sf):
    return incremental.file_changes(*_listings(spark, sf))


@query("m02_removed_projects", f"{_LISTINGS} SELECT DISTINCT project FROM bf WHERE project NOT IN (SELECT project FROM af)")
def m02(spark, sf):
    return incremental.removed_projects(*_listings(spark, sf))


@query("m04_orphaned_externals", "SELECT DISTINCT project FROM symbols WHERE starts_with(project, 'external:') AND project NOT IN (SELECT t.project FROM edges e JOIN symbols s ON s.id = e.source_id JOIN symbols t ON t.id = e.target_id WHERE s.project <> t.project)")
def m04(spark, sf):
    g = star(spark, sf)
    return incremental.orphaned_externals(g.symbols, g.single, g.bundles)


@query("m05_unique_ids", ", s2 AS (SELECT 'x:' || CAST(start_line AS VARCHAR) AS id, project FROM symbols GROUP BY ALL) SELECT CASE WHEN n > 1 THEN id || '#' || CAST(n AS VARCHAR) ELSE id END AS id, id AS original_id, project FROM (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY project) AS n FROM s2)")
def m05(spark, sf):
    s = star(spark, sf).symbols.select(F.concat(F.lit("x:"), "start_line").alias("id"), "project").distinct()
    return incremental.with_unique_ids(s).select("id", "original_id", "project")


@query("m06_resolved_edges", """, s2 AS (SELECT 'x:' || CAST(start_line AS VARCHAR) AS original_id, project, CASE WHEN n > 1 THEN 'x:' || CAST(start_line AS VARCHAR) || '#' || CAST(n AS VARCHAR) ELSE 'x:' || CAST(start_line AS VARCHAR) END AS id FROM (SELECT start_line, project, dense_rank() OVER (PARTITION BY start_line ORDER BY project) AS n FROM (SELECT DISTINCT start_line, project FROM symbols)))
, ed AS (SELECT DISTINCT project, id AS source_id, 'x:' || CAST((start_line * 7) % 400 + 1 AS VARCHAR) AS target_id, CASE WHEN start_line % 2 = 0 THEN 'EUROPE' END AS target_project, 'Calls' AS kind FROM symbols)
SELECT project, source_id, stored AS target_id, kind FROM (SELECT ed.*, s2.id AS stored, row_number() OVER (PARTITION BY ed.project, ed.source_id, ed.target_id, ed.kind ORDER BY CASE WHEN s2.project = ed.project THEN 0 WHEN c.n = 1 THEN 1 ELSE 2 END, s2.id) AS rn
FROM ed JOIN s2 ON s2.original_id = ed.target_id JOIN (SELECT original_id, count(*) AS n FROM s2 GROUP BY ALL) c ON c.original_id = s2.original_id WHERE s2.project = ed.project OR c.n = 1 OR s2.project = ed.target_project) WHERE rn = 1""")
def m06(spark, sf):
    g = star(spark, sf).symbols
    s = incremental.with_unique_ids(g.select(F.concat(F.lit("x:"), "start_line").alias("id"), "project").distinct())
    e = g.select("project", F.col("id").alias("source_id"), F.concat(F.lit("x:"), (F.col("start_line") * 7) % 400 + 1).alias("target_id"), F.when(F.col("start_line") % 2 == 0, "EUROPE").alias("target_project"), F.lit("Calls").alias("kind")).distinct()
    return incremental.resolved_edges(e, s)


@query("m07_sweep", "SELECT e.source_id, e.target_id, e.kind FROM edges e WHERE e.source_id IN (SELECT id FROM symbols WHERE start_line % 3 <> 0) AND e.target_id IN (SELECT id FROM symbols WHERE start_line % 3 <> 0)")
def m07(spark, sf):
    g = star(spark, sf)
    return incremental.sweep(g.edges, g.symbols.where("start_line % 3 <> 0")).select("source_id", "target_id", "kind")


@query("s05_replace_projects", """, nw AS (SELECT id FROM symbols WHERE project = 'EUROPE' AND start_line % 2 = 0), keep AS (SELECT id FROM symbols WHERE project NOT IN ('EUROPE', 'MIDDLE EAST'))
SELECT e.source_id, e.target_id, e.kind FROM edges e WHERE e.source_id IN (SELECT id FROM keep UNION ALL SELECT id FROM nw) AND e.target_id IN (SELECT id FROM keep UNION ALL SELECT id FROM nw)""")
def s05(spark, sf):
    from changelens.sources.graph import Bundles, Graph, touching

    g = star(spark, sf)
    new = g.symbols.where("project = 'EUROPE' and start_line % 2 = 0")
    bundles = Bundles(touching(g.bundles.sources, "source_id", new, "id"), g.bundles.targets, g.bundles.keys)
    fresh = Graph.of(g.files.where("project = 'EUROPE'"), new, touching(g.single, "source_id", new, "id"), bundles)
    return incremental.replace_projects(g, fresh, spark.createDataFrame([("MIDDLE EAST",)], "project string")).whole().select("source_id", "target_id", "kind")


@query("m09_readiness", """SELECT index_id, error IS NULL AS can_query, NOT (so OR ao) AND state IN ('Building', 'Failed', 'Stale', 'Updating') AS stale, error FROM (SELECT *, CASE WHEN so THEN 'schema_outdated' WHEN ao THEN 'analyzer_outdated' WHEN state IN ('Missing', 'RebuildRequired') THEN 'index_not_found'
WHEN state = 'Building' THEN 'index_building' WHEN state = 'Failed' THEN 'index_failed' WHEN state = 'Updating' AND NOT pr THEN 'index_updating' END AS error FROM (SELECT o_orderkey AS index_id, o_orderkey % 10 = 0 AS so, o_orderkey % 11 = 0 AS ao, o_custkey % 2 = 0 AS pr,
CASE o_orderkey % 7 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Building' WHEN 2 THEN 'Failed' WHEN 3 THEN 'Stale' WHEN 4 THEN 'Updating' WHEN 5 THEN 'RebuildRequired' ELSE 'Ready' END AS state FROM orders))""", graph=False)
def m09(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    state = F.element_at(F.array(*map(F.lit, ["Missing", "Building", "Failed", "Stale", "Updating", "RebuildRequired", "Ready"])), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return incremental.readiness(o.select(F.col("o_orderkey").alias("index_id"), state.alias("state"), (F.col("o_orderkey") % 10 == 0).alias("schema_outdated"), (F.col("o_orderkey") % 11 == 0).alias("analyzer_outdated"), (F.col("o_custkey") % 2 == 0).alias("previous_ready")))


@query("s16_hunks", "SELECT 'd' || CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS hunk_no, 'a/F' || CAST(p_partkey AS VARCHAR) || '.cs' AS file, CAST(p_size AS INT) AS old_start, 1 AS old_length, CAST(p_size AS INT) + 1 AS new_start, CAST(p_size % 4 AS INT) AS new_length, CAST(3 AS BIGINT) AS n_lines FROM part UNION ALL SELECT 'd' || CAST(p_partkey AS VARCHAR), 2, 'gone.cs', 7, 2, 0, 0, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END FROM part", graph=False)
def s16(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    text = F.format_string("diff --git\r\n--- a/a/F%s.cs\n+++ b/a\\F%s.cs\n@@ -%s +%s,%s @@ head\n-x\n+y\n--- a/gone.cs\n+++ /dev/null\n@@ -7,2 +0,0 @@\n-z%s", "p_partkey", "p_partkey", "p_size", F.col("p_size") + 1, F.col("p_size") % 4, F.when(F.col("p_partkey") % 2 == 0, "").otherwise("\n-zz"))
    return readers.hunks(p.select(F.concat(F.lit("d"), "p_partkey").alias("doc_id"), text.alias("text"))).withColumn("hunk_no", F.col("hunk_no").cast("long"))


@query("s20_sarif", "SELECT 'sarif-' || CAST(event_id AS VARCHAR) || '-0-0' AS id, CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type = 'click' THEN 'Info' ELSE 'Warning' END AS severity, event_type AS code, 'src/F' || CAST(user_id AS VARCHAR) || '.cs' AS file, CAST(event_id % 90 AS INT) AS line FROM events", graph=False)
def s20(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "note").otherwise("warning")
    text = F.format_string('{"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "%s", "level": "%s", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src\\\\F%s.cs"}, "region": {"startLine": %s}}}]}]}]}', "event_type", level, "user_id", F.col("event_id") % 90)
    return readers.sarif(e.select(F.col("event_id").alias("doc_id"), text.alias("text"))).select("id", "severity", "code", "file", "line")


@query("s19_test_events", "SELECT user_id AS doc_id, count(*) AS cases, user_id % 2 = 0 AS complete FROM events GROUP BY user_id", graph=False)
def s19(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    line = F.format_string('{"v": 1, "type": "test-result", "name": "N.%s", "outcome": "passed", "durationMs": 1.5}', "event_id")
    ends = F.when(F.col("user_id") % 2 == 0, '\n{"type": "run-complete", "total": 1}').otherwise("\nnot json")
    docs = e.groupBy("user_id").agg(F.concat_ws("\n", F.collect_list(line)).alias("body")).select(F.col("user_id").alias("doc_id"), F.concat(F.lit('{"type": "run-start"}\n'), "body", ends).alias("text"))
    return readers.test_events(docs)[1]


@query("s24_format_text", "SELECT event_id AS doc_id, 'src/F' || CAST(user_id AS VARCHAR) || '.cs' AS file, CAST(event_id % 90 AS INT) AS line, CAST(0.8 AS DOUBLE) AS confidence FROM events UNION ALL SELECT event_id, NULL, NULL, CAST(0.7 AS DOUBLE) FROM events", graph=False)
def s24(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.format_string("src/F%s.cs(%s,3): error IDE1\nhello\nFormat complete", "user_id", F.col("event_id") % 90)
    return readers.format_text(e.select(F.col("event_id").alias("doc_id"), text.alias("text"))).select("doc_id", "file", "line", "confidence")


@query("d08_stack_frames", "SELECT event_id AS case_id, CAST(1 AS INT) AS frame_no, 'A.B' || CAST(user_id AS VARCHAR) || '(Int32 x)' AS method, '/src/F.cs' AS file, CAST(event_id % 90 AS INT) AS line, false AS is_framework FROM events UNION ALL SELECT event_id, 2, 'System.Run()', NULL, NULL, true FROM events", graph=False)
def d08(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stack = F.format_string("boom\n   at A.B%s(Int32 x) in /src/F.cs:line %s\r\n   at System.Run()", "user_id", F.col("event_id") % 90)
    return diagnostics.stack_frames(e.select(F.col("event_id").alias("case_id"), stack.alias("stack")))


@query("f20_redaction", "SELECT event_id, 'x password=*** y Bearer *** z token=*** ' || CAST(user_id AS VARCHAR) AS text FROM events", graph=False)
def f20(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", X.redact(F.format_string("x password=p%s y Bearer abc.%s z token=%s %s", "event_id", "user_id", "event_id", "user_id")).alias("text"))


@query("f21_run_stamps", "SELECT o_orderkey, strptime('20240101' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '3000', '%Y%m%d%H%M%S') AS at FROM orders", graph=False)
def f21(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", X.run_stamp(F.concat(F.lit("20240101"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("3000-abc"))).alias("at"))


@query("t11_changed_impact", f"{_CHANGE} SELECT id FROM (SELECT e.source_id AS id, s.qualified_name, e.confidence, row_number() OVER (PARTITION BY e.source_id ORDER BY e.target_id, e.kind) AS rn FROM edges e JOIN symbols s ON s.id = e.source_id WHERE e.kind IN ('References', 'Calls', 'Constructs', 'UsesType', 'Implements', 'Inherits') AND e.target_id IN (SELECT id FROM ch)) WHERE rn = 1 AND (confidence IS NULL OR confidence >= 0.9) ORDER BY qualified_name, id LIMIT 5000")
def t11(spark, sf):
    g, ch = _changed(spark, sf)
    return traverse.changed_impact(g.symbols, g.edges, ch, 1, 0.9, 5000).select("id")
