"""Operators that work in steps, against plain Python: cycles, binding by classes, covers, investigations, spans, the watcher and freshness."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.functions.storage import kept, shared_path
from changelens.operators import binding, cycles, diagnostics, evidence, investigation, obligations
from changelens.plans.change_queries import _bound
from changelens.streaming import watch


def brute_cycles(edges):
    """component, size, first of the shortest cycles through the smallest node."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: reach(x) for x in {n for e in edges for n in e}}
    out = set()
    for x in far:
        part = {y for y in far[x] if x in far[y]}
        if x in far[x] and x == min(part):
            paths = [[x]]
            while not (done := [p for p in paths if len(p) > 1 and p[-1] == x]):
                paths = [[*p, y] for p in paths for y in after.get(p[-1], ()) if y in part and y not in p[1:]]
            out.add((x, len(part), min(" -> ".join(p) for p in done)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(16)} | {("z1", "z2"), ("z2", "z3"), ("n03", "z1"), ("loop", "loop"), ("z3", "z1")}
    got = cycles.cycles(spark.createDataFrame(sorted(edges), "a string, b string"))
    assert {tuple(r) for r in got.collect()} == brute_cycles(edges)


def test_no_cycles(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "b")], "a string, b string")
    assert cycles.cycles(chain).collect() == [] and cycles.cycles(chain.limit(0)).collect() == []


def test_names_meet_by_their_rarest_run(spark, sf):
    """No key gathers the names, and few pairs are looked at: the fixture's names share long beginnings."""
    o, _ = _bound(spark, sf.replace("0.001", "0.01"))
    digits = F.lpad(F.regexp_replace("subject_id", "[^0-9]", ""), 9, "0")
    names = kept(o.select(F.lit("k").alias("kind"), F.concat(F.lit("customer.customer#"), digits).alias("name")).distinct())
    keys = kept(binding.rarest_runs(names, names))
    n = names.count()
    assert keys.count() == n > 1000
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] <= n // 100
    assert keys.agg(F.sum("n")).first()[0] <= 40 * n


def test_contained(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc.") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    a, b = set(words[:90]), set(words[60:])
    frame = lambda x: spark.createDataFrame([("k", w) for w in x] + [("other", "abc")], "kind string, name string")
    got = {(r["name"], r["long"]) for r in binding.contained(frame(a), frame(b)).where("kind = 'k'").collect()}
    assert got == {(x, y) for x in a for y in b if x in y and x != y}


def test_wide_evidence_is_a_row_for_each_kind(spark):
    """Links of whole-repository evidence don't grow with the obligations, and their numbers and pairs agree."""
    o = spark.createDataFrame([(f"o{i}", "P", "CrossProject" if i % 2 else "Compatibility", f"P{i}", f"P{i}", None, True) for i in range(40)], "id string, rule_id string, kind string, subject_id string, subject_project string, subject_display string, required boolean")
    e = spark.createDataFrame(
        [(f"e{i}", "Build", "Pass", "c", None, "all.sln" if i % 3 else "src/P7.csproj", "d", None, None) for i in range(12)] + [("old", "Build", "Pass", "c", None, "all.sln", "x", None, None)],
        "id string, kind string, status string, check_id string, subject string, target string, source_digest string, refs array<struct<id:string,project:string,name:string>>, subjects array<string>",
    )
    b = binding.bound(o, e, "d")
    assert b.kind_links.count() == 4 and b.links.count() == 1 and b.evidence.select("e_class").distinct().count() == 2
    pairs = b.expanded()
    assert pairs.count() == 8 * 20 + 12 * 20 + 4
    key = ["evidence_id", "o_kind", "relation", "strength", "rule", "reason"]
    counted = pairs.join(o.select(F.col("id").alias("obligation_id"), F.col("kind").alias("o_kind")), "obligation_id").groupBy(*key).agg(F.count(F.lit(1)).alias("obligations"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, b.counted().select(*key, "obligations").collect()))
    strong = binding.statuses(o, b, e).where("status = 'Proven'").select("id").collect()
    assert [r["id"] for r in strong] == ["o7"]


def test_greedy_cover(spark):
    rng = random.Random(2)
    covers = {f"c{i}": {f"o{rng.randrange(30)}" for _ in range(rng.randint(0, 9))} for i in range(12)}
    weights, costs = {f"o{i}": rng.randint(0, 5) for i in range(29)}, {f"c{i}": rng.randint(0, 4) for i in range(8)}
    rest, want = set().union(*covers.values()), []
    while rest:
        gain = {c: sum(max(1, weights.get(o, 1)) for o in ids & rest) for c, ids in covers.items()}
        best = min((c for c in covers if gain[c]), key=lambda c: (-gain[c] / max(1, costs.get(c, 1)), c))
        want.append((len(want), best, gain[best]))
        rest -= covers[best]
    pairs = spark.createDataFrame([(c, o) for c, ids in covers.items() for o in ids], "check_id string, obligation_id string")
    got = obligations.greedy_cover(pairs, spark.createDataFrame(list(weights.items()), "id string, risk_weight int"), spark.createDataFrame(list(costs.items()), "check_id string, cost int"))
    assert [tuple(r) for r in got.orderBy("step").collect()] == want
    assert obligations.greedy_cover(pairs.limit(0), spark.createDataFrame([], "id string, risk_weight int"), spark.createDataFrame([], "check_id string, cost int")).count() == 0


def test_needed_checks_on_a_cycle(spark):
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "check_id string, depends_on string")
    got = obligations.needed(spark.createDataFrame([("a",)], "check_id string"), needs)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def provider(spark, n, at=0):
    return spark.createDataFrame([(f"i{at + i:03}", "m") for i in range(n)], "id string, member string").drop("member")


def test_windows_cap_and_early_stop(spark):
    rows, states = investigation.investigate("impact", {"Impact": provider(spark, 100), "Callers": provider(spark, 100, 500)}, 80, ["id"])
    assert states == [("Impact", "partial", None, 64), ("Callers", "partial", "global_cap", 80)]
    windows = {r["window"]: r["n"] for r in rows.where("provider = 'Impact'").groupBy("window").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert windows == {0: 8, 1: 16, 2: 16, 3: 16, 4: 8}
    rows, states = investigation.investigate("trace", {"Flow": provider(spark, 3), "Callees": provider(spark, 9)}, 80, ["id"])
    assert states == [("Flow", "complete", None, 3), ("Callees", "not_run", "early_stop", 0)] and rows.count() == 3
    rows, states = investigation.investigate("trace", {"Flow": provider(spark, 0), "Callees": provider(spark, 9)}, 9, ["id"])
    assert states == [("Flow", "complete", None, 0), ("Callees", "complete", None, 9)] and rows.count() == 9
    _, states = investigation.investigate("debug", {"Callees": provider(spark, 5), "Callers": provider(spark, 5)}, 5, ["id"])
    assert states == [("Callees", "complete", None, 5), ("Callers", "not_run", "global_cap", 0)]


def test_understanding_reads_the_first_members(spark):
    own = spark.createDataFrame([(f"i{m:03}", f"x{m}-{k}") for m in range(9) for k in range(20)], "member string, id string").select("id", "member")
    rows, states = investigation.investigate("understand", {"Members": provider(spark, 9), "Callees": provider(spark, 1)}, 40, ["id"], of_members={"Callees": own})
    assert states == [("Members", "complete", None, 9), *[("Callees", "partial", None, 8)] * 3, ("Callees", "partial", "global_cap", 40), ("Callees", "not_run", "global_cap", 0)]
    assert rows.count() == 40 and rows.where("id like 'x3-%'").count() == 7


def test_spans_keep_a_reserve(spark):
    data = [("a", 1, 0, 30), ("a", 50, 2, 100), ("b", 1, 1, 500), ("b", 90, 1, 60), ("c", 1, 2, 26), ("c", 9, 2, 20), ("d", 1, 2, 1)]
    spans = spark.createDataFrame(data, "file string, start int, priority int, cost long")
    got = {(r["file"], r["start"]) for r in investigation.spans_within(spans, 180, batch=2).collect()}
    assert got == {("a", 1), ("b", 90), ("c", 1), ("c", 9)} - {("c", 9)} | {("d", 1)}  # 45 are kept from priority 2: 90 used, 45 left, then 26, 20 does not fit, 1
    plain = {(r["file"], r["start"]) for r in investigation.spans_within(spans.where("priority = 2"), 120).collect()}
    assert plain == {("a", 50), ("c", 9)} and investigation.spans_within(spans.limit(0), 10).count() == 0


def listing(spark, rows, at):
    return spark.createDataFrame([("p", path, h) for path, h in rows], "project string, relative_path string, content_hash string").withColumn("seen_at", F.lit(at).cast("timestamp"))


def files(spark, state):
    return {r["relative_path"]: r["content_hash"] for r in watch.current(spark, state).collect()}


def test_watcher_writes_deltas(spark, monkeypatch):
    monkeypatch.setattr(watch, "COMPACT_AFTER", 3)
    state, fs = shared_path(spark), lambda name: watch._path(spark, f"{state}/{name}")
    there = lambda name: fs(name)[0].exists(fs(name)[1])
    assert watch.latest_version(spark, state) == -1 and files(spark, state) == {}
    want = {f"f{i}": "1" for i in range(200)}
    watch.update(spark, state, listing(spark, want.items(), "2024-01-01"), 0)
    for n in range(1, 9):
        watch.update(spark, state, listing(spark, [("f7", str(n)), (f"f{n + 20}", None)], f"2024-01-0{n}"), n)
        want["f7"] = str(n)
        del want[f"f{n + 20}"]
        assert files(spark, state) == want and watch.latest_version(spark, state) == n
        if n == 1:
            parts = spark.read.parquet(f"{state}/delta-1").select("bucket").distinct().count()
            assert parts <= 2 < spark.read.parquet(f"{state}/delta-0").select("bucket").distinct().count()
    watch.update(spark, state, listing(spark, [("f7", "again")], "2025-01-01"), 8)  # a batch once more
    assert files(spark, state) == want
    assert not there("delta-0") and not there("base-2") and there("base-8") and there("base-5")


def test_freshness_across_batches(spark):
    src, out, progress = shared_path(spark), shared_path(spark), shared_path(spark)
    steps = [[("a", 1, False), ("a", 2, False), ("b", 3, True), ("b", 4, False)], [("a", 5, False), ("b", 6, False), ("a", 7, True)], [("a", 8, False), ("c", 9, True), ("b", 10, False)]]
    for step in steps:
        df = spark.createDataFrame(step, "root string, event_id long, is_change boolean")
        df.write.mode("append").parquet(src)
        said = watch.freshness(spark.readStream.schema(df.schema).parquet(src))
        said.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["answer"] for r in spark.read.schema(watch.ASKED).parquet(out).collect()}
    assert got == {1: "miss", 2: "hit", 4: "miss", 5: "hit", 6: "hit", 8: "miss", 10: "hit"}


def test_pack_without_errors(spark):
    none = spark.createDataFrame([], "id string, severity string, source string, code string, message string, file string, line int, test_name string, confidence double, score long")
    checks = spark.createDataFrame([(0, "b", "build", "Pass", 0, None, " ")], "nth int, check_id string, kind string, status string, exit_code int, source_id string, artifact string")
    notes = spark.createDataFrame([], "nth int, note string")
    cuts = spark.createDataFrame([], "nth int, check_id string, reason string, artifact string, lines array<string>")
    lines = [r["line"] for r in diagnostics.pack_text("pass", "r", checks, none, notes, cuts, profile="fast").orderBy("part", "k").collect()]
    assert lines == ["VERIFY: PASS", "Profile: fast", "Run: r", "Check b (build): Pass exit=0 source=unknown", "", "Primary diagnostics:", "  (none captured)", "", "Git diff: r/git/diff.patch", "Failure pack: r/failure-pack.txt"]


def test_pack_line(spark):
    df = spark.createDataFrame([("t.x", "E1", "a.cs", 3, "Bearer abc", "Trx", 0.5, ["line", "test"]), (None, None, None, None, "m", "Other", 1.0, [])], "test_name string, code string, file string, line int, message string, source string, confidence double, why array<string>")
    got = [r[0] for r in df.select(diagnostics.pack_line(F.col("why"))).collect()]
    assert got == ["t.x  E1  a.cs:3  Bearer ***  [trx, confidence=0.50]  {line,test}", "m  [other, confidence=1.00]"]


def test_trust_policy(spark):
    key = b"k" * 70
    rows = [("d", "None", "ci", None, {"ref": "main"}), ("d", "hmac-sha256", "ci", evidence.attestation("d", key), {"branch": "main"}), ("d", "hmac-sha256", "ci", evidence.attestation("e", key), {"ref": "main"}), ("d", "x", "ci", None, None), ("d", "none", "other", None, {"ref": "main"}), ("d", "none", "ci", None, {"ref": "dev", "branch": "main"}), ("d", None, "ci", None, None)]
    e = spark.createDataFrame(rows, "statement_digest string, provider string, signer string, payload string, claims map<string,string>")
    got = [(r["valid"], r["reason"]) for r in evidence.trusted(e, key, ["ci"], claims={"ref": ["main"]}).collect()]
    assert got == [(True, None), (True, None), (False, "SIGNATURE_MISMATCH"), (False, "UNKNOWN_PROVIDER"), (True, "ISSUER_NOT_TRUSTED"), (True, "CLAIM_MISMATCH:ref"), (False, "UNKNOWN_PROVIDER")]
    got = [(r["valid"], r["reason"]) for r in evidence.trusted(e.limit(2), None, require_signed=True).collect()]
    assert got == [(True, "SIGNATURE_REQUIRED"), (False, "KEY_MISSING")]
