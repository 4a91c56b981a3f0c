"""Verdicts, digests, hunks, readers, evidence and the watcher on hand-made rows."""

import time

import pytest
from pyspark.sql import functions as F

from changelens.operators import binding, diagnostics, evidence, obligations
from changelens.sources import readers
from changelens.streaming import watch

OBLIGATIONS = "id string, rule_id string, kind string, subject_id string, subject_project string, subject_display string, required boolean"
EVIDENCE = "id string, kind string, status string, check_id string, subject string, target string, source_digest string, refs array<struct<id:string,project:string,name:string>>, subjects array<string>"


def ob(spark, *rows):
    """(id, kind, subject, project)"""
    return spark.createDataFrame([(i, "P", k, s, p, None, True) for i, k, s, p in rows], OBLIGATIONS)


def ev(spark, *rows):
    """(id, kind, status, subject, target, digest)"""
    return spark.createDataFrame([(i, k, st, "c", s, t, d, None, None) for i, k, st, s, t, d in rows], EVIDENCE)


def test_status_precedence(spark):
    o = ob(spark, ("o", "TestMapping", "x", "P"))
    for statuses, want in ((["Pass"], "Proven"), (["Pass", "InfraError"], "Blocked"), (["Pass", "InfraError", "Fail"], "Failed"), (["Skipped"], "Unresolved"), ([], "Unresolved")):
        e = ev(spark, *[(f"e{i}", "TestMapping", s, "x", None, "d") for i, s in enumerate(statuses)])
        assert binding.statuses(o, binding.bind(o, e, "d"), e).first()["status"] == want


def test_digests(spark):
    e = ev(spark, ("1", "Build", "Pass", "x", None, "d"), ("2", "Build", "Pass", "x", None, None), ("3", "Build", "Pass", "x", None, "e"), ("4", "Note", "Pass", "x", None, None))
    got = {r["id"]: r["s"] for r in e.select("id", binding.digest_state("d").alias("s")).collect()}
    assert got == {"1": "valid", "2": "missing", "3": "stale", "4": "valid"}
    assert {r["s"] for r in e.select(binding.digest_state(None).alias("s")).collect()} == {"valid"}


def test_build_binding(spark):
    o = ob(spark, ("o", "Build", "Alpha.Engine", None), ("u", "Uncertainty", "x", None))
    e = ev(spark, ("exact", "Build", "Pass", "", "src/alpha.engine.csproj", "d"), ("part", "Build", "Pass", "", "src/Alpha.csproj", "d"), ("wide", "Build", "Pass", "", "All.slnx", "d"), ("none", "Build", "Pass", "", "src/Other.csproj", "d"), ("stale", "Build", "Pass", "", "All.sln", "x"))
    got = {r["evidence_id"]: (r["relation"], r["strength"], r["rule"]) for r in binding.bind(o, e, "d").collect()}
    assert got == {"exact": ("direct", 3, "BIND_BUILD_PROJECT"), "part": ("supporting", 2, "BIND_BUILD_PROJECT_HEURISTIC"), "wide": ("supporting", 2, "BIND_BUILD_SOLUTION")}
    assert [tuple(r) for r in binding.rejections(o, e, "d").collect()] == [("stale", "BIND_SOURCE_DIGEST", "EVIDENCE_STALE_SOURCE", 1)]
    plan = binding._candidates(o.selectExpr("id as obligation_id", "kind as o_kind", "subject_id", "subject_project", "subject_display").join(binding.candidate_kinds(spark), "o_kind"), e.selectExpr("id as evidence_id", "kind as e_kind", "status", "subject", "target", "refs", "subjects"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_verdicts(spark):
    none = spark.createDataFrame([], "code string, severity string")
    block = spark.createDataFrame([("C", "blocking")], "code string, severity string")
    say = lambda statuses, c=none, empty=False, e=None: binding.verdict(
        spark.createDataFrame([("o", "s", "P", True, s) for s in statuses], "id string, subject_id string, subject_project string, required boolean, status string"), e if e is not None else ev(spark), c, empty
    ).first()["verdict"]
    assert say(["Proven"]) == "Proven" and say(["Proven", "Failed", "Blocked"]) == "NotReady" and say(["Proven", "Blocked"]) == "InfraError"
    assert say(["Proven", "Unresolved"]) == "Uncertain" and say([]) == "Uncertain" and say(["Proven"], block) == "Uncertain" and say(["Failed"], empty=True) == "NoChange"
    assert say(["Proven"], e=ev(spark, ("e", "Build", "InfraError", "", "src/p.csproj", "d"))) == "InfraError"
    # Further unrelated passes never help.
    assert say(["Unresolved"], e=ev(spark, ("e", "Build", "Pass", "", "x", "d"))) == "Uncertain"


def test_greedy_cover_and_order():
    covers = {"all": {"a", "b", "c"}, "ab": {"a", "b"}, "c": {"c"}, "useless": set()}
    assert obligations.greedy_checks(covers, {}, {"all": 10}) == ["ab", "c"] and obligations.greedy_checks(covers, {"c": 9}, {"all": 2, "c": 3}) == ["all"]
    assert obligations.greedy_checks({}, {}, {}) == []
    assert obligations.with_dependencies(["t", "l"], {"t": ["b"], "b": ["r"], "l": ["r"]}) == ["r", "b", "t", "l"]
    with pytest.raises(ValueError):
        obligations.with_dependencies(["a"], {"a": ["b"], "b": ["a"]})


def test_hunk_bounds(spark):
    d = spark.createDataFrame([("start", 5), ("last", 7), ("past", 8), ("zero", 20), ("zero_past", 21)], "id string, line int")
    d = d.select("id", F.lit("Build").alias("kind"), F.lit("Info").alias("severity"), F.lit("s").alias("source"), F.lit("c").alias("code"), "id", F.lit("A.cs").alias("file"), "line", F.lit(None).cast("string").alias("test_name")).toDF("id", "kind", "severity", "source", "code", "message", "file", "line", "test_name")
    h = spark.createDataFrame([("./a.cs", 5, 3), ("A.cs", 20, 0)], "file string, new_start int, new_length int")
    frames = spark.createDataFrame([("past", False, "a.cs", 6), ("past", True, "a.cs", 6)], "diagnostic_id string, is_framework boolean, file string, line int")
    got = {r["id"]: r["score"] for r in diagnostics.scored(d, frames, h, spark.createDataFrame([], "file string")).collect()}
    assert got == {"start": 100, "last": 100, "past": 90 - 60, "zero": 100, "zero_past": 0}


def test_unified_diff(spark):
    text = "diff --git a/x b/x\n--- a/x.cs\r\n+++ b/x.cs\r\n@@ -1 +1,2 @@ f\n a\n+b\n@@ -9,2 +10 @@\n-c\n d\n--- a/gone.cs\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-x\n"
    got = readers.hunks(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "doc_id string, text string")).orderBy("hunk_no").collect()
    assert [(r["file"], r["old_start"], r["old_length"], r["new_start"], r["new_length"]) for r in got] == [("x.cs", 1, 1, 1, 2), ("x.cs", 9, 2, 10, 1), ("gone.cs", 1, 3, 0, 0)]


def test_incomplete_events(spark):
    docs = spark.createDataFrame([("a", '{"type":"run-start"}\n{"type":"test-result","name":"x","outcome":"failed","error":"e","stack":"at A.B() in C:/r/T.cs:line 10"}'), ("b", '{"type":"run-start"}\n{"type":"run-complete"}')], "doc_id string, text string")
    cases, runs = readers.test_events(docs)
    assert {r["doc_id"]: r["complete"] for r in runs.collect()} == {"a": False, "b": True}
    frame = diagnostics.stack_frames(cases.select(F.col("doc_id").alias("case_id"), "stack")).first()
    assert (frame["method"], frame["file"], frame["line"], frame["is_framework"]) == ("A.B()", "C:/r/T.cs", 10, False)


def test_broken_documents_give_no_rows(spark):
    docs = spark.createDataFrame([("a", "not json"), ("b", None), ("c", "{}")], "doc_id string, text string")
    assert readers.sarif(docs).count() == readers.trx(docs).count() == readers.junit(docs).count() == readers.cobertura(docs).count() == readers.api_compat(docs).count() == 0
    assert {r["status"] for r in readers.api_status(docs).collect()} == {"Uncertain"}


def test_commands_and_ids(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(evidence.tokens(F.lit('  dotnet test "a b/c.csproj"  --x="1 2" '))) == ["dotnet", "test", "a b/c.csproj", "--x=1 2"]
    assert one(evidence.command_target(F.lit("dotnet test --x"))) is None
    assert one(evidence.retargeted(F.lit("dotnet test a.sln -c R"), F.lit("a.sln"), F.lit("b.csproj"))) == "dotnet test b.csproj -c R"
    assert evidence.attested("d", evidence.attestation("d", b"k"), b"k") and not evidence.attested("e", evidence.attestation("d", b"k"), b"k")


def test_policy_exceptions(spark):
    o = ob(spark, ("1", "Test", "x", None), ("2", "Test", "y", None))
    g = spark.createDataFrame([("P", "x", "", "s", None), ("P", "*", "other", "s", None), ("P", "y", "", " ", None)], "rule_id string, subject_id string, source_digest string, signature string, expires_at timestamp")
    got = {r["id"]: r["exception"] for r in binding.exceptions(o, g, F.current_timestamp(), "d").collect()}
    assert got == {"1": "Valid", "2": "Unsigned"}


def test_watcher(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, "project string, relative_path string, content_hash string").withColumn("seen_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)
    put([("P", "a.cs", "1"), ("P", "b.cs", "1")])
    watch.watch(spark, src, state, once=True).awaitTermination(60)
    time.sleep(0.1)
    put([("P", "a.cs", "2"), ("P", "b.cs", None), ("Q", "c.cs", "1")])
    watch.watch(spark, src, state, once=True).awaitTermination(60)
    watch.watch(spark, src, state, once=True).awaitTermination(60)
    assert {(r["project"], r["relative_path"], r["content_hash"]) for r in watch.current(spark, state).collect()} == {("P", "a.cs", "2"), ("Q", "c.cs", "1")}
    assert watch.latest_version(spark, state) == 1


def test_index_file(spark, tmp_path):
    from changelens.sources import scip

    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    number = lambda n, v: bytes([n << 3, v])
    occ = field(2, field(1, bytes([4, 0, 3])) + field(2, b"a().") + number(3, 1) + field(7, bytes([4, 0, 9, 1])))
    occ += field(2, field(1, bytes([6, 0, 3])) + field(2, b"b().")) + field(2, field(1, bytes([20, 0, 3])) + field(2, b"b().") + number(3, 1) + field(7, bytes([20, 0, 22, 1])))
    sym = field(3, field(1, b"a().") + number(5, 26) + field(6, b"a") + field(4, field(1, b"b().") + number(3, 1))) + field(3, field(1, b"b().") + number(5, 7))
    (tmp_path / "i.scip").write_bytes(field(2, field(1, b"x.ts") + occ + sym + field(4, b"ts")))
    g = scip.to_graph("demo", *scip.tables(scip.read_indexes(spark, str(tmp_path / "i.scip"))))
    assert {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in g.symbols.collect()} == {("a", "Method", 5, 10), ("b().", "Class", 21, 23)}
    assert {(r["source_id"][-5:], r["kind"], r["line"]) for r in g.edges.collect()} == {("%28%29."[-5:], "References", 7), ("28%29."[-5:], "Implements", None), ("28%29."[-5:], "ImplementedBy", None)}


def test_wire_json_equals_a_plain_writer(spark):
    import hashlib
    import json
    import re

    from changelens.operators import evidence
    from changelens.functions.wire import camel, wire_json

    texts = ["", "plain", 'a"b\\c/d', "x<y>&'z'+`~", "tab\tnl\ncr\rbell\x07del\x7f", "é漢\U0001f600", "\b\f", None]
    numbers = [0.0, 1.0, 0.9, 0.0001, 0.00001, 1.25e-7, 123456.789, 1e14, 1e15, 1.5e20, -2.5, None]
    cols = "k int, schema_version int, base_revision string, impact array<struct<display_name:string,confidence:double,tags:array<string>>>, toolchain struct<sdk:string,ok:boolean>"
    data = [(n, 3, t, None if n == 3 else [(t, x, [t, "q"] if n % 2 else []) for x in numbers[: n * 2]], None if n == 2 else (t, n % 2 == 0)) for n, t in enumerate(texts)]
    got = {r["k"]: r for r in evidence.statements(spark.createDataFrame(data, cols)).collect()}

    def plain(v):
        form = {0.0: "0", 1.0: "1", 0.00001: "1E-05", 1.25e-7: "1.25E-07", 1e14: "100000000000000", 1e15: "1E+15", 1.5e20: "1.5E+20"}
        marks: list[str] = []

        def walk(x):
            if isinstance(x, float):
                marks.append(form.get(x, repr(x)))
                return f"@@{len(marks) - 1}@@"
            return {a: walk(b) for a, b in x.items()} if isinstance(x, dict) else [walk(b) for b in x] if isinstance(x, list) else x

        out = json.dumps(walk(v), indent=2, ensure_ascii=True)
        out = re.sub(r"\\u([0-9a-f]{4})", lambda m: "\\u" + m[1].upper(), out).replace('\\"', "\\u0022").replace("\x7f", "\\u007F")
        for c in "<>&'+`":
            out = out.replace(c, f"\\u{ord(c):04X}")
        return re.sub('"@@([0-9]+)@@"', lambda m: marks[int(m[1])], out)

    for k, v, base, impact, tool in data:
        want = dict.fromkeys(camel(c) for c in evidence.STATEMENT_FIELDS)
        want |= {"schemaVersion": v, "baseRevision": base, "impact": impact and [{"displayName": a, "confidence": x, "tags": g} for a, x, g in impact] if impact is not None else None, "toolchain": tool and {"sdk": tool[0], "ok": tool[1]}}
        assert got[k]["statement"] == plain(want), k
        assert got[k]["statement_digest"] == hashlib.sha256(got[k]["statement"].encode()).hexdigest()
    with pytest.raises(TypeError):
        wire_json(F.current_date(), spark.range(1).select(F.current_date().alias("d")).schema["d"].dataType)


def test_certificates_are_folders_of_one_document(spark, tmp_path):
    import json

    from changelens.operators import evidence

    heads = spark.createDataFrame([("r1", "READY", "s", 3), ("r2", "NOT_READY", None, 3)], "run_id string, verdict string, source_digest string, schema_version int")
    c = evidence.statements(evidence.with_section(heads, "evidence", spark.createDataFrame([("r1", "e2", "x"), ("r1", "e1", "y"), ("r1", "e1", "y")], "run_id string, id string, kind string"), "run_id", ["id"]))
    assert {r["run_id"]: [x["id"] for x in r["evidence"]] for r in c.collect()} == {"r1": ["e1", "e1", "e2"], "r2": []}
    o = spark.createDataFrame([("r2", "P2", "c", "FAILED", "F", "s:1", "a.cs"), ("r2", "P1", "d", "PENDING", None, "s:2", None), ("r2", "P0", "d", "PROVEN", None, "s:2", None)], "run_id string, rule_id string, claim string, status string, reason_code string, subject_id string, file string")
    evidence.write_certificates(evidence.summaries(c, o, "run_id"), str(tmp_path / "s"), "run_id")
    docs = {r["run_id"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "s"), wholetext=True).collect()}
    assert [x["ruleId"] for x in docs["r2"]["unresolved"]] == ["P1", "P2"] and docs["r2"]["provenCount"] == 1
    assert docs["r1"]["unresolved"] == [] and docs["r1"]["unresolvedCount"] == 0
    digests = {r["run_id"]: r["statement_digest"] for r in c.collect()}
    assert {k: d["statementDigest"] for k, d in docs.items()} == digests
