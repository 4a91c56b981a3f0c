"""Driver queries of operators that work in steps (cycles, investigations, span budgets, covers, freshness), of texts, and of rules over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.functions.storage import kept, shared_path
from changelens.operators import binding, cycles, diagnostics, evidence, investigation, obligations, relations, traverse
from changelens.plans.base import query
from changelens.plans.change_queries import _BOUND, _CAPS, _CHANGE, _DIAG, _PLAN, _VIOLATIONS, _bound, _change, _diagnostics, _plan
from changelens.sources import scip, web
from changelens.sources.graph import star_graph as star


@query("c04_cycles", """, pr AS (SELECT DISTINCT a.project AS a, b.project AS b FROM edges e JOIN symbols a ON a.id = e.source_id JOIN symbols b ON b.id = e.target_id WHERE a.project <> b.project)
, wk(s, n, path, len) AS (SELECT a, b, [a, b], 1 FROM pr UNION ALL SELECT s, b, list_append(path, b), len + 1 FROM wk JOIN pr ON pr.a = wk.n WHERE n <> s AND NOT list_contains(path[2:], b))
, rc AS (SELECT DISTINCT s, n FROM wk), part AS (SELECT x.s AS node, min(x.n) AS component FROM rc x JOIN rc y ON y.s = x.n AND y.n = x.s GROUP BY x.s)
, best AS (SELECT s, arg_min(array_to_string(path, ' -> '), (len, array_to_string(path, ' -> '))) AS cycle FROM wk WHERE n = s GROUP BY s)
SELECT component, count(*) AS size, any_value(cycle) AS cycle FROM part JOIN best ON best.s = component GROUP BY component""")
def c04(spark, sf):
    g = star(spark, sf)
    return cycles.cycles(relations.project_pairs(g.symbols, g.single, g.bundles).where("a <> b"))


@query("t12_project_cycles", """WITH RECURSIVE nx AS (SELECT 'p' || s_suppkey AS a, 'p' || ((s_suppkey * s_suppkey + 3) % (SELECT count(*) FROM supplier) + 1) AS b FROM supplier)
, wk(s, n, path, len) AS (SELECT a, b, a || ' -> ' || b, 1 FROM nx UNION ALL SELECT s, b, path || ' -> ' || b, len + 1 FROM wk JOIN nx ON nx.a = wk.n WHERE n <> s AND len < (SELECT count(*) FROM supplier))
SELECT s AS component, CAST(len AS BIGINT) AS size, path AS cycle FROM wk WHERE n = s AND s = list_min(string_split(path, ' -> '))""", graph=False)
def t12(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n = s.count()
    return cycles.cycles(s.select(F.concat(F.lit("p"), "s_suppkey").alias("a"), F.concat(F.lit("p"), F.pmod(F.col("s_suppkey") * F.col("s_suppkey") + 3, F.lit(n)) + 1).alias("b")))


_P12_STEPS = 5
_P12 = f"""{_CHANGE} {_VIOLATIONS}, pl AS ({_PLAN}), caps(check_id, kind, project, cost) AS (VALUES {', '.join(f"('{c}', '{k}', {'NULL' if p is None else repr(p)}, {dict(tests=5).get(c, 3 if c == 'build-all' else 1)})" for c, k, p in _CAPS)})
, cv AS (SELECT DISTINCT check_id, cost, id AS o, greatest(1, risk_weight) AS w FROM pl JOIN caps ON caps.kind = pl.kind AND (project IS NULL OR lower(project) = lower(subject_id)) WHERE required)
, r0 AS (SELECT * FROM cv), {', '.join(f"g{i} AS (SELECT check_id, cost, sum(w) AS gain FROM r{i} GROUP BY check_id, cost ORDER BY sum(w)::DOUBLE / cost DESC, check_id LIMIT 1), r{i + 1} AS (SELECT * FROM r{i} WHERE o NOT IN (SELECT o FROM r{i} JOIN g{i} USING (check_id)))" for i in range(_P12_STEPS))}
{' UNION ALL '.join(f'SELECT {i} AS step, check_id, CAST(gain AS BIGINT) AS gain FROM g{i}' for i in range(_P12_STEPS))}"""


def _cover(spark, sf):
    plan = _plan(spark, sf)
    pairs = obligations.coverable(plan, spark.createDataFrame(_CAPS, "check_id string, kind string, project string"))
    return obligations.greedy_cover(pairs, plan.select("id", "risk_weight"), spark.createDataFrame([("build-all", 3), ("tests", 5)], "check_id string, cost int"))


@query("p12_greedy_checks", _P12)
def p12(spark, sf):
    return _cover(spark, sf)


@query("p12_needed_checks", "WITH RECURSIVE nd AS (SELECT DISTINCT 'c' || o_custkey AS check_id, 'c' || (o_custkey // 3) AS depends_on FROM orders WHERE o_custkey > 2), ch AS (SELECT DISTINCT 'c' || o_custkey AS check_id FROM orders WHERE o_orderstatus = 'P'), w(check_id, depth) AS (SELECT check_id, 0 FROM ch UNION SELECT depends_on, depth + 1 FROM w JOIN nd USING (check_id)) SELECT check_id, min(depth) AS depth FROM w GROUP BY check_id", graph=False)
def p12_needed(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    name = lambda c: F.concat(F.lit("c"), c)
    needs = o.where("o_custkey > 2").select(name("o_custkey").alias("check_id"), name(F.expr("o_custkey div 3")).alias("depends_on")).distinct()
    return obligations.needed(o.where("o_orderstatus = 'P'").select(name("o_custkey").alias("check_id")), needs)


# An investigation of s:2: everything that it calls, all that calls it, and what implements it, within 40 rows.
_A05 = """, hop AS (SELECT 'Callees' AS provider, 0 AS turn, target_id AS id FROM edges WHERE source_id = 's:2' AND kind = 'Calls' UNION SELECT 'Callers', 1, source_id FROM edges WHERE target_id = 's:2' AND kind = 'Calls' UNION SELECT 'Implementations', 2, target_id FROM edges WHERE source_id = 's:2' AND kind = 'ImplementedBy')
, rk AS (SELECT provider, turn, s.id, row_number() OVER (PARTITION BY provider ORDER BY project, qualified_name, s.id) AS nth FROM hop JOIN symbols s ON s.id = hop.id)
, n AS (SELECT t AS turn, p AS provider, coalesce(n, 0) AS n FROM (VALUES (0, 'Callees'), (1, 'Callers'), (2, 'Implementations')) x(t, p) LEFT JOIN (SELECT turn, count(*) AS n FROM rk GROUP BY turn) y ON y.turn = t)
, t0 AS (SELECT turn, provider, n, least(n, 64, 40) AS got, 40 AS room FROM n WHERE turn = 0)
, t1 AS (SELECT n.turn, n.provider, n.n, CASE WHEN t0.got >= 40 THEN 0 ELSE least(n.n, 64, 40 - t0.got) END AS got, 40 - t0.got AS room FROM n, t0 WHERE n.turn = 1)
, t2 AS (SELECT n.turn, n.provider, n.n, CASE WHEN t1.room - t1.got <= 0 THEN 0 ELSE least(n.n, 64, t1.room - t1.got) END AS got, t1.room - t1.got AS room FROM n, t1 WHERE n.turn = 2)
, tk AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""


def _investigation(spark, sf):
    g = star(spark, sf)
    s = g.symbols.select("id", "project", "qualified_name")
    hop = lambda near, far, kind: s.join(g.edges.where((F.col(near) == "s:2") & (F.col("kind") == kind)).select(F.col(far).alias("id")).distinct(), "id")
    providers = {"Callees": hop("source_id", "target_id", "Calls"), "Callers": hop("target_id", "source_id", "Calls"), "Implementations": hop("source_id", "target_id", "ImplementedBy")}
    return investigation.investigate("debug", providers, 40, ["project", "qualified_name", "id"])


@query("a05_investigation", f"{_A05} SELECT rk.provider, id, nth, CAST(CASE WHEN nth <= 8 THEN 0 ELSE ceil((nth - 8) / 16) END AS INT) AS window FROM rk JOIN tk USING (turn) WHERE nth <= got")
def a05i(spark, sf):
    return _investigation(spark, sf)[0].select("provider", "id", "nth", "window")


@query("a05_provider_states", f"{_A05} SELECT provider, CASE WHEN room <= 0 THEN 'not_run' WHEN got = room AND n > got THEN 'partial' WHEN n > got THEN 'partial' ELSE 'complete' END AS state, CASE WHEN room <= 0 OR got = room AND n > got THEN 'global_cap' END AS reason, CASE WHEN room <= 0 THEN 0 WHEN got = room AND n > got THEN 40 - room + got ELSE got END AS found FROM tk")
def a05s(spark, sf):
    return spark.createDataFrame(_investigation(spark, sf)[1], "provider string, state string, reason string, found long")


# Spans of single lines, ten apart, so that few merge; cost by their lines and beginning.
_A10 = """, rq AS (SELECT project || '/' || relative_path AS file, start_line * 10 AS s, start_line * 10 + length(id) AS e, CASE kind WHEN 'Interface' THEN 0 WHEN 'Method' THEN 1 ELSE 2 END AS priority, id FROM symbols)
, op AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY file ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS new FROM rq)
, isl AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS i FROM op)
, mg AS (SELECT file, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS "end", min(priority) AS priority, list_sort(list(DISTINCT id)) AS ids FROM isl GROUP BY file, i)"""


def _requests(spark, sf):
    s = star(spark, sf).symbols
    priority = F.when(F.col("kind") == "Interface", 0).when(F.col("kind") == "Method", 1).otherwise(2)
    return s.select(F.concat("project", F.lit("/"), "relative_path").alias("file"), (F.col("start_line") * 10).alias("start"), (F.col("start_line") * 10 + F.length("id")).alias("end"), priority.alias("priority"), "id")


@query("a10_merged_requests", f"{_A10} SELECT file, start, \"end\", priority, array_to_string(ids, ',') AS ids FROM mg")
def a10m(spark, sf):
    return investigation.merged_requests(_requests(spark, sf)).withColumn("ids", F.array_join("ids", ","))


@query("a10_span_budget", f"""{_A10}, ct AS (SELECT *, greatest(1, CAST(ceil((("end" - start + 1) * (start % 7 + 3)) / 4) AS BIGINT)) AS cost, row_number() OVER (ORDER BY priority, file, start) AS n FROM mg)
, fo AS (SELECT CASE WHEN bool_or(priority < 2) THEN 64 ELSE 0 END AS reserve FROM mg)
, tk(n, used, took) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL SELECT ct.n, CASE WHEN cost <= 900 - used - CASE WHEN priority >= 2 THEN reserve ELSE 0 END THEN used + cost ELSE used END, cost <= 900 - used - CASE WHEN priority >= 2 THEN reserve ELSE 0 END FROM tk JOIN ct ON ct.n = tk.n + 1, fo)
SELECT file, start, "end", ct.priority, cost, used FROM tk JOIN ct ON ct.n = tk.n WHERE took""")
def a10b(spark, sf):
    merged = kept(investigation.merged_requests(_requests(spark, sf)))
    spans = merged.withColumn("cost", investigation.span_cost((F.col("end") - F.col("start") + 1) * (F.col("start") % 7 + 3)))
    return investigation.spans_within(spans, 900).select("file", "start", "end", "priority", "cost", "used")


@query("m11_freshness", "WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS root, event_id, event_type = 'error' AS is_change FROM events), lg AS (SELECT *, max(CASE WHEN is_change THEN event_id END) OVER w AS changed, max(CASE WHEN NOT is_change THEN event_id END) OVER w AS asked FROM ev WINDOW w AS (PARTITION BY root ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT root, event_id, CASE WHEN asked IS NOT NULL AND (changed IS NULL OR asked > changed) THEN 'hit' ELSE 'miss' END AS answer FROM lg WHERE NOT is_change", graph=False)
def m11(spark, sf):
    """M-11: two batches of events through the stream; what the first leaves in the state answers the second."""
    from changelens.streaming import watch

    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("root"), "event_id", (F.col("event_type") == "error").alias("is_change"))
    middle = e.agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0]
    src, out, progress = shared_path(spark), shared_path(spark), shared_path(spark)
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        e.where(part).write.mode("append").parquet(src)
        answers = watch.freshness(spark.readStream.schema(e.schema).parquet(src))
        answers.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(watch.ASKED).parquet(out)


@query("d14_pack_text", f"""{_DIAG}, dd AS (SELECT *, row_number() OVER (PARTITION BY kind, code, message, lower(file), line ORDER BY score DESC, id) AS rn FROM graded), er AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS k FROM dd WHERE rn = 1 AND severity = 'Error')
, ck AS (SELECT r_regionkey AS n, 'check-' || r_name AS c FROM region)
SELECT 0 AS part, CAST(k AS BIGINT) AS k, line FROM (SELECT unnest([0, 1, 2, 3]) AS k, unnest(['VERIFY: FAIL', 'Profile: default', 'Run: runs/1', 'Git evidence: unavailable']) AS line)
UNION ALL SELECT 1, n * 2, 'Check ' || c || ' (build): Fail exit=' || CASE WHEN n = 0 THEN 'n/a' ELSE CAST(n AS VARCHAR) END || ' source=' || CASE WHEN n = 1 THEN 'unknown' ELSE 'src' END FROM ck UNION ALL SELECT 1, n * 2 + 1, '  Raw: raw/' || c || '.log' FROM ck WHERE n % 2 = 0
UNION ALL SELECT 2, k, line FROM (SELECT unnest([0, 1]) AS k, unnest(['', 'Primary diagnostics:']) AS line)
UNION ALL SELECT 3, k, code || '  ' || file || ':' || CAST(line AS VARCHAR) || '  token=***  [events, confidence=1.00]' FROM er WHERE k < 20
UNION ALL SELECT 4, k, line FROM (SELECT unnest([0, 1]) AS k, unnest(['', 'Sufficiency notes:']) AS line) UNION ALL SELECT 5, n, '  - see ' || c FROM ck
UNION ALL SELECT 6, k, line FROM (SELECT unnest([0, 1]) AS k, unnest(['', 'Raw excerpts:']) AS line) UNION ALL SELECT 7, n * 1048576 + k, CASE k WHEN 0 THEN '[' || c || '] unparsed  raw/' || c || '.log' WHEN 1 THEN '  ' || c ELSE '  password=***' END FROM ck, (SELECT unnest([0, 1, 2]) AS k)
UNION ALL SELECT 8, k, line FROM (SELECT unnest([0, 1, 2]) AS k, unnest(['', 'Git diff: runs/1/git/diff.patch', 'Failure pack: runs/1/failure-pack.txt']) AS line)""")
def d14_text(spark, sf):
    ranked = diagnostics.ranked(_diagnostics(spark, sf)).withColumn("message", F.concat(F.lit("token="), "message"))
    c = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("nth"), F.concat(F.lit("check-"), "r_name").alias("check_id"))
    raw = F.concat(F.lit("raw/"), "check_id", F.lit(".log"))
    checks = c.select("nth", "check_id", F.lit("build").alias("kind"), F.lit("Fail").alias("status"), F.when(F.col("nth") > 0, F.col("nth")).alias("exit_code"), F.when(F.col("nth") != 1, "src").alias("source_id"), F.when(F.col("nth") % 2 == 0, raw).alias("artifact"))
    notes = c.select("nth", F.concat(F.lit("see "), "check_id").alias("note"))
    cuts = c.select("nth", "check_id", F.lit("unparsed").alias("reason"), raw.alias("artifact"), F.array("check_id", F.lit("password=x")).alias("lines"))
    return diagnostics.pack_text("Fail", "runs/1", checks, ranked, notes, cuts, git_available=False)


_T13 = "SELECT DISTINCT 'n' || p_partkey AS project, 'n' || (p_partkey // 2) AS depends_on FROM part WHERE p_partkey > 0"


@query("t13_propagation", f"""WITH RECURSIVE refs AS ({_T13}), same AS (SELECT 'n' || p_partkey AS project FROM part WHERE p_size % 5 = 0)
, sel(project) AS (SELECT unnest(['n1', 'n5']) UNION SELECT r.project FROM refs r JOIN sel ON sel.project = r.depends_on WHERE r.depends_on NOT IN (SELECT project FROM same))
SELECT project, true AS selected FROM sel UNION ALL SELECT DISTINCT r.project, false FROM refs r JOIN sel ON sel.project = r.depends_on JOIN same ON same.project = r.depends_on WHERE r.project NOT IN (SELECT project FROM sel)""", graph=False)
def t13(spark, sf):
    """Projects as parts, each of which depends on the one of half its number; the surfaces of some sizes are unchanged."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    name = lambda c: F.concat(F.lit("n"), c)
    refs = p.where("p_partkey > 0").select(name("p_partkey").alias("project"), name(F.expr("p_partkey div 2")).alias("depends_on")).distinct()
    prints = p.select(name("p_partkey").alias("project"), F.lit("a").alias("before"), F.when(F.col("p_size") % 5 == 0, "a").otherwise("b").alias("after"))
    return traverse.propagate(spark.createDataFrame([("n1",), ("n5",)], "project string"), refs, prints)


@query("v18_capabilities", """SELECT check_id, unnest(kinds) AS kind, project, cost FROM (SELECT 'c' || o_orderkey AS check_id, CASE o_orderkey % 3 WHEN 0 THEN ['Build', 'CrossProject'] WHEN 1 THEN ['Test', 'CallerContract'] ELSE ['StaticAnalysis'] END AS kinds, CASE o_orderkey % 3 WHEN 1 THEN 'P' || o_custkey || '.Tests' END AS project, CAST(greatest(1, o_orderkey % 4) AS INT) AS cost FROM orders WHERE o_orderkey % 5 <> 0)""", graph=False)
def v18(spark, sf):
    k = F.col("o_orderkey")
    command = F.when(k % 3 == 0, "dotnet build All.sln").when(k % 3 == 1, F.format_string('dotnet test "src\\P%s.Tests.csproj" -c Release', "o_custkey")).otherwise("dotnet lint --all")
    kind = F.when(k % 5 == 0, "format").when(k % 3 == 0, "build").when(k % 3 == 1, "Test").otherwise("analysis")
    c = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("c"), k).alias("check_id"), kind.alias("kind"), command.alias("command"), (k % 4).cast("int").alias("cost"))
    return evidence.capabilities(c).select("check_id", "kind", "project", "cost")


@query("b02_candidate_kinds", f"""{_BOUND}, ck(o_kind, e_kind) AS (VALUES ('Build', 'Build'), ('CrossProject', 'Build'), ('Compatibility', 'ApiCompatibility'), ('Compatibility', 'Build'), ('Test', 'TestCase'), ('Test', 'TestRun'), ('CallerContract', 'TestCase'), ('CallerContract', 'TestRun'), ('CallerContract', 'Build'), ('TestMapping', 'TestMapping'), ('TestMapping', 'RuntimeCoverage'), ('ManualReview', 'ManualReview'), ('AppContract', 'RuntimeCoverage'), ('AppContract', 'Build'), ('AppContract', 'StaticAnalysis'), ('Architecture', 'Architecture'), ('StaticAnalysis', 'StaticAnalysis'))
SELECT o_kind, e_kind, (SELECT count(*) FROM ob WHERE ob.kind = o_kind) AS obligations, (SELECT count(*) FROM ev WHERE ev.kind = e_kind) AS evidence FROM ck""")
def b02(spark, sf):
    """How many obligations and how much evidence each admitted pair of kinds has."""
    o, e = (x.groupBy(F.col("kind").alias(k)).agg(F.count(F.lit(1)).alias(n)) for x, k, n in zip(_bound(spark, sf), ("o_kind", "e_kind"), ("obligations", "evidence"), strict=True))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return binding.candidate_kinds(spark).join(o, "o_kind", "left").join(e, "e_kind", "left").select("o_kind", "e_kind", zero("obligations"), zero("evidence"))


@query("p06_uncertainty", f"{_CHANGE}, un(r, c, hit) AS (SELECT 'P006', 'IMPACT_LOCATION_UNKNOWN', EXISTS (SELECT 1 FROM dl WHERE kind = 'Deleted') UNION ALL SELECT 'P006', 'CALLER_POTENTIALLY_TRUNCATED', (SELECT count(*) FROM ca) > 50 UNION ALL SELECT 'P007', 'HEURISTIC_EDGE_BLOCKING', EXISTS (SELECT 1 FROM rel WHERE resolution = 'heuristic')) SELECT 'O-' || r || '-' || left(sha256(r || '|Uncertainty|' || c), 8) AS id, r AS rule_id, 'Uncertainty' AS kind, c AS subject_id, true AS required, 1 AS risk_weight, c AS reason FROM un WHERE hit")
def p06(spark, sf):
    """What limits a change's conclusions, as its deltas, callers and relations have it."""
    _, _, _, callers, rel, _, deltas, _ = _change(spark, sf)
    many = callers.select("changed_id", "caller_id", "caller_project", "is_test").distinct().limit(51).count() > 50
    c = obligations.Completeness(location="complete" if deltas.where("kind = 'Deleted'").isEmpty() else "partial", callers_truncated=many, heuristic_edges=not rel.where("resolution = 'heuristic'").isEmpty())
    return obligations.uncertainty(spark, c, obligations.Policy(heuristic_impact="blocking"))


_IPAD, _OPAD = (bytes(b ^ pad for b in b"key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query("v13_attestation", f"SELECT o_orderkey, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(sha256(CAST(o_orderkey AS VARCHAR)))))) AS payload FROM orders", graph=False)
def v13(spark, sf):
    digest = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", evidence.attestation_of(digest, b"key").alias("payload"))


@query("v13_trust", """SELECT o_orderkey, o_orderkey % 4 IN (0, 2) OR o_orderkey % 4 = 1 AND o_custkey % 2 = 0 AS valid, CASE WHEN o_orderkey % 4 = 3 THEN 'UNKNOWN_PROVIDER' WHEN o_orderkey % 4 = 1 AND o_custkey % 2 = 1 THEN 'SIGNATURE_MISMATCH' WHEN o_custkey % 3 = 0 THEN 'ISSUER_NOT_TRUSTED' WHEN o_orderkey % 4 IN (0, 2) THEN 'SIGNATURE_REQUIRED' END AS reason FROM orders""", graph=False)
def v13_trust(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    digest = F.sha2(k.cast("string").cast("binary"), 256)
    provider = F.when(k % 4 == 3, "other").when(k % 4 == 1, "HMAC-SHA256").otherwise("None")
    envelopes = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", digest.alias("statement_digest"), provider.alias("provider"), F.when(c % 3 == 0, "someone").when(c % 3 == 1, "ci").otherwise("owner").alias("signer"), F.when(c % 2 == 0, evidence.attestation_of(digest, b"key")).otherwise("00").alias("payload")
    )
    return evidence.trusted(envelopes, b"key", ["ci", "owner"], require_signed=True).select("o_orderkey", "valid", "reason")


@query("d06_check_order", "WITH RECURSIVE up(i, n) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT i, n // 2 FROM up WHERE n > 0), fi AS (SELECT n, min(i) AS i FROM up GROUP BY n) SELECT row_number() OVER (ORDER BY i, n) - 1 AS n, 'n' || n AS check_id FROM fi", graph=False)
def d06(spark, sf):
    """A profile of the nations of two regions, each a check that needs the one of half its number."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey").collect()  # a profile is a short list
    needs = {f"n{r['n_nationkey']}": [f"n{r['n_nationkey'] // 2}"] if r["n_nationkey"] else [] for r in rows}
    profile = [f"n{r['n_nationkey']}" for r in sorted(rows, key=lambda r: r["n_nationkey"]) if r["n_regionkey"] in (1, 3)]
    return spark.createDataFrame(list(enumerate(evidence.profile_order(profile, needs))), "n long, check_id string")


def _field(n, data):
    """A field of bytes in an index message, of less than 128 bytes."""
    return F.concat(F.unhex(F.lit(f"{n << 3 | 2:02x}")), F.unhex(F.lpad(F.hex(F.length(data)), 2, "0")), data)


@query("s07_scip_rows", "SELECT 'f' || s_suppkey || '.ts' AS doc, r AS row, sy AS symbol, ln AS start_line FROM supplier, (VALUES ('document', NULL, NULL), ('occurrence', 'a().', 5), ('occurrence', 'b().', 7), ('symbol', 'a().', 26), ('relationship', 'a().', NULL)) t(r, sy, ln)", graph=False)
def s07(spark, sf):
    """An index for each supplier, built as the messages that a file holds."""
    raw = lambda b: F.unhex(F.lit(b.hex()))
    text = lambda t: F.lit(t).cast("binary")
    first = F.concat(_field(1, raw(bytes([4, 0, 3]))), _field(2, text("a().")), raw(bytes([3 << 3, 1])), _field(7, raw(bytes([4, 0, 9, 1]))))
    second = F.concat(_field(1, raw(bytes([6, 0, 3]))), _field(2, text("b().")))
    symbol = F.concat(_field(1, text("a().")), raw(bytes([5 << 3, 26])), _field(6, text("a")), _field(4, F.concat(_field(1, text("b().")), raw(bytes([3 << 3, 1])))))
    path = F.concat(F.lit("f"), "s_suppkey", F.lit(".ts")).cast("binary")
    index = _field(2, F.concat(_field(1, path), _field(2, first), _field(2, second), _field(3, symbol), _field(4, text("ts"))))
    files = spark.read.parquet(f"{sf}/supplier.parquet").select(index.alias("content")).select(F.length("content").cast("long").alias("length"), "content")
    return scip.decoded(files).select("doc", "row", "symbol", "start_line")


_S13 = " UNION ALL ".join(
    f"SELECT page_id, '{name}' AS relation, '{kind}' AS kind, unnest(regexp_extract_all(coalesce(html, ''), '{pattern.replace(chr(39), chr(39) * 2)}', 1)) AS target, {web.CONFIDENCE[how]} AS confidence FROM pages"
    for name, kind, how, pattern in web.PATTERNS if name != "class"
)


@query("s13_web_relations", f"""WITH r AS ({_S13} UNION ALL SELECT page_id, 'class', 'UsesCss', unnest(regexp_split_to_array(c, '\\s+')), 0.85 FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '\\sclass\\s*=\\s*["'']([^"'']+)["'']', 1)) AS c FROM pages))
SELECT page_id, relation, kind, target, CAST(confidence AS DOUBLE) AS confidence, count(*) AS uses FROM r WHERE target <> '' GROUP BY ALL""", graph=False)
def s13(spark, sf):
    return web.web_relations(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id", "html")


_CERT = r"""WITH ev AS (SELECT l_orderkey AS k, string_agg('    {' || chr(10) || '      "id": "' || l_linenumber || '",' || chr(10) || '      "kind": "' || l_returnflag || '\u002B' || l_linestatus || '",' || chr(10) || '      "passed": ' || CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END || chr(10) || '    }', ',' || chr(10) ORDER BY CAST(l_linenumber AS VARCHAR), l_returnflag || '+' || l_linestatus, l_quantity > 25) AS evidence FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
, st AS (SELECT o_orderkey AS k, o_orderstatus AS v, '{' || chr(10) || concat_ws(',' || chr(10), '  "schemaVersion": 3', '  "baseRevision": "b' || o_custkey || '"', '  "headRevision": "h' || o_orderkey || '"', '  "verdict": "' || o_orderstatus || '"', '  "impact": null', '  "plan": null',
 '  "evidence": ' || CASE WHEN evidence IS NULL THEN '[]' ELSE '[' || chr(10) || evidence || chr(10) || '  ]' END, '  "evaluation": null', '  "sourceDigest": ' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"' || sha256(CAST(o_orderkey AS VARCHAR)) || '"' END, '  "toolchain": null', '  "verificationPlan": null', '  "constraints": null', '  "artifactManifest": null') || chr(10) || '}' AS statement FROM orders LEFT JOIN ev ON o_orderkey = k)
"""


def _certificates(spark, sf):
    o, i = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    k = F.col("o_orderkey")
    source = F.when(F.col("o_custkey") % 3 != 0, F.sha2(k.cast("string").cast("binary"), 256))
    heads = o.select(k.alias("k"), F.lit(3).alias("schema_version"), F.concat(F.lit("b"), "o_custkey").alias("base_revision"), F.concat(F.lit("h"), k).alias("head_revision"), F.col("o_orderstatus").alias("verdict"), source.alias("source_digest"))
    rows = i.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("id"), F.concat("l_returnflag", F.lit("+"), "l_linestatus").alias("kind"), (F.col("l_quantity") > 25).alias("passed"))
    return evidence.statements(evidence.with_section(heads, "evidence", rows, "k", ["id"]))


@query("v05_statement_json", f"{_CERT} SELECT k, statement, sha256(statement) AS statement_digest FROM st", graph=False)
def v05_statement(spark, sf):
    return _certificates(spark, sf).select("k", "statement", "statement_digest")


@query("s25_certificates", f"""{_CERT}, b AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag <> 'N') AS open, count(*) FILTER (WHERE l_returnflag = 'N') AS good FROM lineitem GROUP BY l_orderkey)
SELECT v AS folder, count(*) AS documents, CAST(sum(coalesce(good, 0)) AS BIGINT) AS proven, CAST(sum(coalesce(open, 0)) AS BIGINT) AS unresolved, max(sha256(statement)) AS last_digest FROM st LEFT JOIN b USING (k) GROUP BY v""", graph=False)
def s25_certificates(spark, sf):
    """Summaries written as documents below a folder for each verdict and read back."""
    c = _certificates(spark, sf)
    i = spark.read.parquet(f"{sf}/lineitem.parquet")
    o = i.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("rule_id"), F.concat(F.lit("claim "), F.col("l_linenumber")).alias("claim"), F.when(F.col("l_returnflag") == "N", "PROVEN").otherwise("UNRESOLVED").alias("status"), F.lit(None).cast("string").alias("reason_code"), F.concat(F.lit("p:"), "l_partkey").alias("subject_id"), F.lit(None).cast("string").alias("file"))
    path = shared_path(spark)
    evidence.write_certificates(evidence.summaries(c, o, "k").withColumn("folder", F.col("verdict")).drop("k"), path, "folder")
    text = spark.read.option("lineSep", "\n}\n").text(path).select("folder", F.concat("value", F.lit("\n}")).alias("value"))
    back = text.select("folder", F.from_json("value", "statementDigest string, provenCount long, unresolvedCount long, unresolved array<struct<ruleId:string>>").alias("d"))
    return back.groupBy("folder").agg(F.count(F.lit(1)).alias("documents"), F.sum("d.provenCount").alias("proven"), F.sum(F.greatest(F.size("d.unresolved"), F.lit(0)).cast("long")).alias("unresolved"), F.max("d.statementDigest").alias("last_digest"))
