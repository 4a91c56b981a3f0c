"""Diagnostics: scoring against a change, deduplication, sufficiency and status.

diagnostics (id, kind, severity, source, code, message, file, line, test_name, confidence);
frames (diagnostic_id, file, line, is_framework); hunks (file, new_start, new_length); changed (file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.exprs import blank, is_generated, redact, relative_identity

# Points of the correlation score.
POINTS = {"line_in_hunk": 100, "frame_in_hunk": 90, "changed_file": 60, "test_file": 50, "compiler": 50, "assertion": 45, "warning": -20, "generated": -40, "framework": -60}
#: Order of severities and of outcomes, worst first.
SEVERITIES = ["Error", "Warning", "Info"]
OUTCOMES = ["InfraError", "Fail", "Uncertain", "Pass"]


def severity_rank(c: Column | str = "severity") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "Error", 0).when(c == "Warning", 1).otherwise(2)


def _key(c: str, root: str | None) -> Column:
    return F.lower(relative_identity(c, root))


def in_hunk(line: Column) -> Column:
    """D-03: from the first new line, for at least one line."""
    return (line >= F.col("new_start")) & (line < F.col("new_start") + F.greatest("new_length", F.lit(1)))


#: Lines of a bin, as a power of two, by which lines meet the ranges of their file.
BIN = 10


def islands(hunks: DataFrame) -> DataFrame:
    """key, first, end: the lines of hunks (key, new_start, new_length) as ranges that neither touch nor overlap, ``end`` excluded; equal hunks count once."""
    at = hunks.select("key", F.col("new_start").cast("long").alias("first"), (F.col("new_start") + F.greatest("new_length", F.lit(1))).cast("long").alias("end")).where("key is not null and first < end").distinct()
    w = Window.partitionBy("key").orderBy("first", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = at.withColumn("new", F.when(F.col("first") > reach, 1).otherwise(0))
    island = opened.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("key", "island").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("island")


def struck(points: DataFrame, hunks: DataFrame) -> DataFrame:
    """``points`` (key, line) that stand in a hunk (key, new_start, new_length) of their file, once each however many hunks hold them."""
    bins = F.sequence(F.shiftright("first", BIN), F.shiftright(F.col("end") - 1, BIN))
    ranges = islands(hunks).select("key", "first", "end", F.explode(bins).alias("bin"))
    hit = points.withColumn("bin", F.shiftright(F.col("line").cast("long"), BIN)).join(ranges, ["key", "bin"])
    return hit.where((F.col("line") >= F.col("first")) & (F.col("line") < F.col("end"))).select(*points.columns)


def scored(diagnostics: DataFrame, frames: DataFrame, hunks: DataFrame, changed: DataFrame, root: str | None = None) -> DataFrame:
    """D-01: ``diagnostics`` with score. Lines meet the merged hunks of their file; frames are added up first."""
    files = changed.select(_key("file", root).alias("key")).distinct().withColumn("hit", F.lit(True))
    h = hunks.select(_key("file", root).alias("key"), "new_start", "new_length")
    d = diagnostics.select("*", _key("file", root).alias("key"))
    own = d.where("key is not null").select("id", "key", "line")
    lines = struck(own, h).select("id").distinct().withColumn("line_hit", F.lit(True))
    f = frames.select("diagnostic_id", "is_framework", "line", _key("file", root).alias("key"))
    code = f.where("not is_framework and key is not null")
    touched = code.join(files, "key", "left_semi").groupBy("diagnostic_id").agg(F.count(F.lit(1)).alias("frame_files"))
    hits = struck(code.where("line > 0"), h).groupBy("diagnostic_id").agg(F.count(F.lit(1)).alias("frame_hunks"))
    outside = f.where("is_framework").groupBy("diagnostic_id").agg(F.count(F.lit(1)).alias("framework"))
    j = d.join(files, "key", "left").join(lines, "id", "left")
    for extra in (touched, hits, outside):
        j = j.join(extra.withColumnRenamed("diagnostic_id", "id"), "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    on = lambda c: F.coalesce(c, F.lit(False))
    give = lambda what, c: F.when(on(c), POINTS[what]).otherwise(0)
    test = F.col("kind") == "Test"
    total = (
        give("changed_file", F.col("hit")) + give("line_in_hunk", F.col("line_hit"))
        + n("frame_files") * POINTS["changed_file"] + n("frame_hunks") * POINTS["frame_in_hunk"] + n("framework") * POINTS["framework"]
        + give("test_file", test & (on(F.col("hit")) | (n("frame_files") > 0))) + give("compiler", (F.col("kind") == "Build") & (F.col("severity") == "Error"))
        + give("assertion", test) + give("warning", F.col("severity") == "Warning") + give("generated", is_generated(relative_identity("file", root)))
    )
    return j.select(*diagnostics.columns, total.cast("long").alias("score"))


def ranked(rows: DataFrame, root: str | None = None) -> DataFrame:
    """D-02: the best of equal diagnostics (kind, code, message, test, file, line); order it with ``rank_order``."""
    key = ["kind", "code", "message", "test_name", _key("file", root), "line"]
    w = Window.partitionBy(*key).orderBy(F.desc("score"), severity_rank(), "id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def rank_order() -> list[Column]:
    return [F.desc("score"), severity_rank(), F.col("id")]


def of_kind(diagnostics: DataFrame, kind: str) -> DataFrame:
    """L-18"""
    return diagnostics.where(F.lower("kind") == kind.lower())


def sufficiency(checks: DataFrame, diagnostics: DataFrame, least: float = 0.5) -> DataFrame:
    """D-04: one row for each run (run_id): notes, whether the evidence suffices, whether it forces uncertainty.

    checks (run_id, check_id, kind, status), diagnostics with run_id and check_id.
    """
    d = diagnostics.groupBy("run_id").agg(
        F.count(F.when(F.col("severity") == "Error", 1)).alias("errors"), F.count(F.when((F.col("severity") == "Error") & (F.col("confidence") < least), 1)).alias("unsure"),
    )
    own = diagnostics.groupBy("run_id", "check_id").agg(F.count(F.when(F.col("kind") == "Build", 1)).alias("builds"), F.count(F.when(~blank("test_name"), 1)).alias("named"))
    c = checks.join(own, ["run_id", "check_id"], "left")
    n0 = lambda x: F.coalesce(F.col(x), F.lit(0))
    failed = F.col("status") == "Fail"
    r = c.groupBy("run_id").agg(
        F.max(F.when(F.col("status") == "InfraError", 4).when(failed, 3).when(F.col("status") == "Uncertain", 2).otherwise(1)).alias("worst"),
        F.max((F.lower("kind") == "build") & failed & (n0("builds") == 0)).alias("bare_build"), F.max((F.lower("kind") == "test") & failed & (n0("named") == 0)).alias("bare_test"),
    ).join(d, "run_id", "left").fillna(0, ["errors", "unsure"])
    passed = F.col("worst") == 1
    none = F.col("errors") == 0
    notes = F.filter(F.array(
        F.when(F.col("worst") == 4, "infrastructure"), F.when(none, "no-primary"), F.when(F.col("bare_build"), "build-without-diagnostics"),
        F.when(~F.col("bare_build") & F.col("bare_test"), "test-without-name"), F.when(~F.col("bare_build") & (F.col("unsure") > 0), "low-confidence"),
    ), lambda x: x.isNotNull())
    forced = F.col("bare_build") | none | F.col("bare_test") | (F.col("unsure") > 0)
    return r.select(
        "run_id", F.when(passed, "").otherwise(F.array_join(notes, ",")).alias("notes"), (passed | (~F.col("bare_build") & ~none)).alias("sufficient"), (~passed & forced).alias("force_uncertain"),
        F.when(passed, "Pass").when(F.col("worst") == 4, "InfraError").when(forced, "Uncertain").when(F.col("worst") == 3, "Fail").otherwise("Uncertain").alias("status"),
    )


def overall(checks: DataFrame) -> DataFrame:
    """D-05: the worst status of each run."""
    worst = F.max(F.when(F.col("status") == "InfraError", 3).when(F.col("status") == "Fail", 2).when(F.col("status") == "Uncertain", 1).otherwise(0))
    return checks.groupBy("run_id").agg(F.element_at(F.array(*map(F.lit, reversed(OUTCOMES))), (worst + 1).cast("int")).alias("status"))


def blocked(checks: DataFrame, needs: DataFrame, rounds: int = 20) -> DataFrame:
    """D-07: checks (check_id, status) of a run; what needs (check_id, needs) a check that did not pass is blocked in turn."""
    from changelens.functions.storage import kept

    state = kept(checks.select("check_id", "status"))
    for _ in range(rounds):
        bad = state.where("status <> 'Pass'").select(F.col("check_id").alias("needs"))
        hit = needs.join(bad, "needs", "left_semi").select("check_id").distinct().withColumn("hit", F.lit(True))
        after = kept(state.join(hit, "check_id", "left").select("check_id", F.when(F.col("hit") & (F.col("status") == "Pass"), "Blocked").otherwise(F.col("status")).alias("status")))
        if after.where("status <> 'Pass'").count() == state.where("status <> 'Pass'").count():
            return after
        state = after
    return state


#: File and line of a stack frame.
FRAME = r"\bin (.+):line ([0-9]+)"


def test_diagnostics(cases: DataFrame) -> DataFrame:
    """D-08: failed cases (case_id, name, outcome, message, project) as diagnostics."""
    failed = cases.where(F.lower("outcome").isin("failed", "error", "timeout"))
    return failed.select(
        F.concat(F.lit("test-"), "case_id").alias("id"), F.lit("Test").alias("kind"), F.lit("Error").alias("severity"), F.lit("test").alias("source"),
        F.lit("TEST_FAILED").alias("code"), F.coalesce("message", F.lit("Test failed.")).alias("message"), F.col("name").alias("test_name"), F.lit(1.0).alias("confidence"),
    )


def stack_frames(cases: DataFrame) -> DataFrame:
    """D-08: case_id, frame_no, method, file, line, is_framework of the stack (text) of every case."""
    lines = cases.where("stack is not null").select("case_id", F.posexplode(F.split("stack", r"\r?\n")).alias("frame_no", "text"))
    at = lines.where(F.col("text").rlike(r"^\s*at "))
    method = F.regexp_extract("text", r"^\s*at (.+?\))", 1)
    file = F.regexp_extract("text", FRAME, 1)
    return at.select("case_id", "frame_no", method.alias("method"), F.nullif(file, F.lit("")).alias("file"), F.expr(rf"try_cast(regexp_extract(text, r'{FRAME}', 2) AS INT)").alias("line"), (file == "").alias("is_framework"))


def excerpts(output: DataFrame, n: int = 40) -> DataFrame:
    """D-09: the last lines of every output (output_id, line_no, text)."""
    w = Window.partitionBy("output_id").orderBy(F.desc("line_no"))
    return output.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def as_evidence(checks: DataFrame, cases: DataFrame, digest: str) -> DataFrame:
    """D-10: evidence of checks (check_id, kind, status, target) and of their cases (check_id, name, outcome)."""
    kinds = F.when(F.lower("kind") == "build", "Build").when(F.lower("kind") == "test", "TestRun").when(F.lower("kind") == "analysis", "StaticAnalysis").otherwise("Other")
    ref = "array<struct<id:string,project:string,name:string>>"
    runs = checks.select(F.concat(F.lit("run:"), "check_id").alias("id"), kinds.alias("kind"), "status", "check_id", F.col("check_id").alias("subject"), "target", F.lit(digest).alias("source_digest"), F.lit(None).cast(ref).alias("refs"))
    status = F.when(F.lower("outcome") == "passed", "Pass").when(F.lower("outcome").isin("skipped", "notexecuted"), "Skipped").otherwise("Fail")
    refs = F.array(F.struct(F.col("name").alias("id"), F.lit(None).cast("string").alias("project"), F.col("name").alias("name")))
    each = cases.select(F.concat(F.lit("case:"), "check_id", F.lit(":"), "name").alias("id"), F.lit("TestCase").alias("kind"), status.alias("status"), "check_id", F.col("name").alias("subject"), F.lit(None).cast("string").alias("target"), F.lit(digest).alias("source_digest"), refs.cast(ref).alias("refs"))
    return runs.unionByName(each)


def run_totals(cases: DataFrame) -> DataFrame:
    """D-11: counts and status of the cases of every run."""
    is_ = lambda *v: F.count(F.when(F.lower("outcome").isin(*v), 1))
    t = cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), is_("passed").alias("passed"), is_("failed", "error", "timeout").alias("failed"), is_("skipped", "notexecuted").alias("skipped"))
    return t.withColumn("status", F.when(F.col("failed") > 0, "Fail").when(F.col("passed") > 0, "Pass").otherwise("Uncertain"))


def retained(runs: DataFrame, now: Column, keep: int = 20, days: int = 7, protected: str | None = None) -> DataFrame:
    """D-13: runs (run_id, at, active) with ``prune``: beyond the newest ``keep``, older than ``days``, neither protected nor active.

    The newest rows are found by a limit, so no single task sees all runs.
    """
    newest = runs.orderBy(F.desc("at"), "run_id").limit(keep).select("run_id", F.lit(True).alias("recent"))
    j = runs.join(F.broadcast(newest), "run_id", "left")  # ``keep`` rows
    old = F.col("at") < now - F.make_interval(days=F.lit(days))
    safe = F.lower("run_id") == (protected or "").lower()
    return j.select(*runs.columns, (F.col("recent").isNull() & old & ~safe & ~F.col("active")).alias("prune"))


# Names of where a diagnostic comes from; others are written in lower case.
PROVENANCE = {"msbuildbinarylog": "msbuild-binlog", "vstestloggerevent": "vstest-logger", "trx": "trx"}


def pack_line(reasons: Column | None = None) -> Column:
    """D-14: one diagnostic as text: test, code and place as far as known, the redacted message, where it comes from, and the reasons (array) of its score."""
    part = lambda c: F.when(blank(c), "").otherwise(F.concat(F.col(c), F.lit("  ")))
    place = F.when(F.col("file").isNotNull(), F.concat("file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit("  "))).otherwise("")
    source = F.lower("source")
    for known, name in PROVENANCE.items():
        source = F.when(F.lower("source") == known, name).otherwise(source)
    said = F.format_string("  [%s, confidence=%.2f]", source, F.col("confidence").cast("double"))
    why = F.lit("") if reasons is None else F.when(F.size(reasons) > 0, F.concat(F.lit("  {"), F.array_join(reasons, ","), F.lit("}"))).otherwise("")
    return F.concat(part("test_name"), part("code"), place, redact("message"), said, why)


def failure_pack(ranked_rows: DataFrame, n: int = 20) -> DataFrame:
    """D-14: lines of the first errors."""
    top = ranked_rows.where("severity = 'Error'").orderBy(*rank_order()).limit(n)
    return top.select("id", "score", pack_line().alias("text"))


def pack_text(status: str, run: str, checks: DataFrame, ranked_rows: DataFrame, notes: DataFrame, cuts: DataFrame, profile: str | None = None, git_available: bool = True, n: int = 20, title: str = "VERIFY") -> DataFrame:
    """D-14: part, k, line: the whole failure pack of a run, ordered by part and k.

    checks (nth, check_id, kind, status, exit_code, source_id, artifact), notes
    (nth, note) and cuts (nth, check_id, reason, artifact, lines array) are those
    of one run and are listed by ``nth``; of the errors the first ``n``. Messages and excerpts are redacted.
    """
    spark = checks.sparkSession
    row = lambda part, lines: spark.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, k long, line string")
    head = [f"{title}: {status.upper()}", f"Profile: {profile or 'default'}", f"Run: {run}"] + ([] if git_available else ["Git evidence: unavailable"])
    at = F.col("nth").cast("long")
    said = F.concat(F.lit("Check "), "check_id", F.lit(" ("), "kind", F.lit("): "), "status", F.lit(" exit="), F.coalesce(F.col("exit_code").cast("string"), F.lit("n/a")), F.lit(" source="), F.coalesce("source_id", F.lit("unknown")))
    raw = F.when(~blank("artifact"), F.concat(F.lit("  Raw: "), "artifact"))
    each = checks.select(F.lit(1).alias("part"), at.alias("n_"), F.posexplode(F.filter(F.array(said, raw), lambda x: x.isNotNull())).alias("i", "line")).select("part", (F.col("n_") * 2 + F.col("i")).alias("k"), "line")
    # A limited number of rows, in one list.
    top = failure_pack(ranked_rows, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "text"))).alias("all"))
    errors = top.select(F.lit(3).alias("part"), F.posexplode(F.when(F.size("all") > 0, F.transform("all", lambda x: x["text"])).otherwise(F.array(F.lit("  (none captured)")))).alias("k", "line")).withColumn("k", F.col("k").cast("long"))
    out = row(0, head).unionByName(each).unionByName(row(2, ["", "Primary diagnostics:"])).unionByName(errors)
    listed = notes.select(F.lit(5).alias("part"), at.alias("k"), F.concat(F.lit("  - "), "note").alias("line"))
    first = lambda of, part, lines: of.limit(1).select(F.lit(part).alias("part"), F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("k", "line")).withColumn("k", F.col("k").cast("long"))
    out = out.unionByName(first(notes, 4, ["", "Sufficiency notes:"])).unionByName(listed)
    cut = F.concat(F.array(F.concat(F.lit("["), "check_id", F.lit("] "), "reason", F.lit("  "), "artifact")), F.transform("lines", lambda x: F.concat(F.lit("  "), redact(x))))
    cut_lines = cuts.select(F.lit(7).alias("part"), at.alias("n_"), F.posexplode(cut).alias("i", "line")).select("part", (F.shiftleft("n_", 20) + F.col("i")).alias("k"), "line")
    out = out.unionByName(first(cuts, 6, ["", "Raw excerpts:"])).unionByName(cut_lines)
    return out.unionByName(row(8, ["", f"Git diff: {run}/git/diff.patch", f"Failure pack: {run}/failure-pack.txt"]))
