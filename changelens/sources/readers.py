"""Readers of build, test and analysis artifacts: text or parsed columns in, rows out. Each keeps the id of its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.exprs import slashes

# Shapes of the documents.
SARIF = (
    "struct<runs: array<struct<tool: struct<driver: struct<name: string>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int>>>>>>>>>"
)
TEST_EVENT = "v int, type string, name string, outcome string, durationMs double, error string, stack string, total int, passed int, failed int, skipped int"
TRX = "struct<Results: struct<UnitTestResult: array<struct<_testId: string, _testName: string, _outcome: string, _duration: string, Output: struct<ErrorInfo: struct<Message: string, StackTrace: string>>>>>>"
JUNIT = "struct<testsuite: array<struct<_name: string, testcase: array<struct<_name: string, _classname: string, _time: double, failure: struct<_message: string, _VALUE: string>, error: struct<_message: string, _VALUE: string>, skipped: string>>>>>"
COBERTURA = "struct<packages: struct<package: array<struct<_name: string, classes: struct<class: array<struct<_name: string, _filename: string, methods: struct<method: array<struct<_name: string, _signature: string, lines: struct<line: array<struct<_number: int, _hits: long>>>>>>>>>>>>>"
API_COMPAT = "struct<projects: array<struct<project: string, status: string, message: string>>>"

_HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def lines_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, line_no, line without carriage return."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "raw")).select("doc_id", "line_no", F.regexp_replace("raw", r"\r$", "").alias("line"))


def hunks(patches: DataFrame) -> DataFrame:
    """S-16: doc_id, hunk_no, file, old_start, old_length, new_start, new_length, n_lines of unified diffs (doc_id, text).

    The file of a hunk is the last new name before it, of a deletion the old name; names and numbers are carried forward by windows.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    s = lines_of(patches)
    old = F.when(F.col("line").startswith("--- a/"), slashes(F.expr("substring(line, 7)")))
    s = s.withColumn("old_file", F.last(old, ignorenulls=True).over(w))
    new = (
        F.when(F.col("line").startswith("+++ b/"), slashes(F.expr("substring(line, 7)")))
        .when(F.col("line").startswith("+++ /dev/null"), F.col("old_file"))
        .when(F.col("line").startswith("+++ "), slashes(F.trim(F.expr("substring(line, 5)"))))
    )
    s = s.withColumn("file", F.last(new, ignorenulls=True).over(w))
    head, name = F.col("line").rlike(_HUNK), F.col("line").startswith("+++ ") | F.col("line").startswith("--- a/")
    s = s.withColumn("head", head).withColumn("hunk_no", F.sum(F.when(head, 1).otherwise(0)).over(w)).withColumn("block", F.sum(F.when(F.col("line").startswith("+++ "), 1).otherwise(0)).over(w))
    part = lambda i: F.expr(rf"try_cast(nullif(regexp_extract(line, r'{_HUNK}', {i}), '') AS INT)")
    heads = s.where("head and file is not null").select("doc_id", "hunk_no", "file", "block", part(1).alias("old_start"), F.coalesce(part(2), F.lit(1)).alias("old_length"), part(3).alias("new_start"), F.coalesce(part(4), F.lit(1)).alias("new_length"))
    body = s.where(~name & (F.col("hunk_no") > 0)).groupBy("doc_id", "hunk_no", "block").agg(F.count(F.lit(1)).alias("n_lines"))
    return heads.join(body, ["doc_id", "hunk_no", "block"], "left").drop("block")


def name_status(text: DataFrame) -> DataFrame:
    """S-15: doc_id, status, old_path, new_path of a NUL-separated name-status listing (doc_id, text)."""
    parts = text.select("doc_id", F.split("text", "\u0000").alias("p"))
    step = F.expr("""aggregate(p, named_struct('out', cast(array() as array<struct<status:string,a:string,b:string>>), 's', '', 'a', ''),
      (z, x) -> if(z.s = '', named_struct('out', z.out, 's', x, 'a', ''),
        if(z.s rlike '^[RC]' and z.a = '', named_struct('out', z.out, 's', z.s, 'a', x),
          named_struct('out', concat(z.out, array(named_struct('status', z.s, 'a', if(z.a = '', x, z.a), 'b', x))), 's', '', 'a', ''))), z -> z.out)""")
    rows = parts.select("doc_id", F.explode(step).alias("r"))
    s = F.substring("r.status", 1, 1)
    kind = F.when(s == "A", "Added").when(s == "D", "Deleted").when(s == "R", "Renamed").when(s == "C", "Copied").when(s == "M", "Modified").when(s == "T", "TypeChanged").otherwise("Unsupported")
    return rows.select("doc_id", kind.alias("kind"), F.when(s != "A", slashes("r.a")).alias("old_path"), F.when(s != "D", slashes("r.b")).alias("new_path"))


def sarif(docs: DataFrame) -> DataFrame:
    """S-20: diagnostics of SARIF documents (doc_id, text)."""
    from changelens.functions.exprs import severity_of_level

    runs = docs.select("doc_id", F.posexplode(F.from_json("text", SARIF)["runs"]).alias("run_no", "run"))
    res = runs.select("doc_id", "run_no", F.col("run.tool.driver.name").alias("tool"), F.posexplode("run.results").alias("n", "r"))
    place = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    return res.select(
        F.concat_ws("-", F.lit("sarif"), "doc_id", "run_no", "n").alias("id"), "doc_id", F.lit("Analysis").alias("kind"), severity_of_level(F.coalesce("r.level", F.lit("warning"))).alias("severity"),
        F.coalesce("tool", F.lit("sarif")).alias("source"), F.col("r.ruleId").alias("code"), F.col("r.message.text").alias("message"),
        slashes(place["artifactLocation"]["uri"]).alias("file"), place["region"]["startLine"].alias("line"), F.lit(1.0).alias("confidence"),
    )


def test_events(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-19: cases (doc_id, case_no, name, outcome, duration_ms, message, stack), and per document whether it has a start and an end."""
    e = lines_of(docs).where("trim(line) <> ''").select("doc_id", "line_no", F.from_json("line", TEST_EVENT).alias("e")).select("doc_id", "line_no", "e.*")
    cases = e.where("type = 'test-result'").select("doc_id", F.col("line_no").alias("case_no"), "name", "outcome", F.col("durationMs").alias("duration_ms"), F.col("error").alias("message"), "stack")
    has = lambda t: F.coalesce(F.bool_or(F.col("type") == t), F.lit(False))
    runs = e.groupBy("doc_id").agg(F.count(F.when(F.col("type") == "test-result", 1)).alias("cases"), (has("run-start") & has("run-complete")).alias("complete"))
    return cases, runs


def trx(docs: DataFrame) -> DataFrame:
    """S-17: cases of TRX documents (doc_id, text)."""
    r = docs.select("doc_id", F.explode(F.from_xml(F.regexp_replace("text", r"\sxmlns=\"[^\"]*\"", ""), TRX)["Results"]["UnitTestResult"]).alias("r"))
    info = F.col("r.Output.ErrorInfo")
    return r.select("doc_id", F.col("r._testId").alias("case_id"), F.col("r._testName").alias("name"), F.lower("r._outcome").alias("outcome"), _clock(F.col("r._duration")).alias("duration_ms"), info["Message"].alias("message"), info["StackTrace"].alias("stack"))


def _clock(c: Column) -> Column:
    """Milliseconds of h:mm:ss.fraction."""
    p = F.split(c, ":")
    return (p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")) * 1000


def junit(docs: DataFrame) -> DataFrame:
    """S-18: cases of JUnit documents (doc_id, text), with one suite or several."""
    text = F.when(F.col("text").rlike(r"<testsuites[\s>]"), F.col("text")).otherwise(F.concat(F.lit("<testsuites>"), F.regexp_replace("text", r"^\s*<\?xml[^>]*\?>", ""), F.lit("</testsuites>")))
    s = docs.select("doc_id", F.explode(F.from_xml(text, JUNIT)["testsuite"]).alias("s")).select("doc_id", F.col("s._name").alias("suite"), F.explode("s.testcase").alias("c"))
    bad = F.coalesce(F.col("c.failure"), F.col("c.error"))
    outcome = F.when(bad.isNotNull(), "failed").when(F.col("c.skipped").isNotNull(), "skipped").otherwise("passed")
    return s.select("doc_id", "suite", F.concat_ws(".", "c._classname", "c._name").alias("name"), outcome.alias("outcome"), (F.col("c._time") * 1000).alias("duration_ms"), F.coalesce(bad["_message"], F.substring_index(bad["_VALUE"], "\n", 1)).alias("message"), bad["_VALUE"].alias("stack"))


def cobertura(docs: DataFrame) -> DataFrame:
    """S-22: executed methods (class.method) of coverage documents, with their hits."""
    c = docs.select("doc_id", F.explode(F.from_xml("text", COBERTURA)["packages"]["package"]).alias("p")).select("doc_id", F.explode("p.classes.class").alias("c"))
    m = c.select("doc_id", F.col("c._name").alias("cls"), F.explode("c.methods.method").alias("m"))
    hits = F.aggregate(F.transform("m.lines.line", lambda x: x["_hits"]), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return m.groupBy(F.concat("cls", F.lit("."), "m._name").alias("method")).agg(F.sum(hits).alias("hits")).where("hits > 0")


def api_compat(docs: DataFrame) -> DataFrame:
    """S-23: diagnostics of API reports (doc_id, text) by project; entries without project or status are passed over."""
    p = docs.select("doc_id", F.explode(F.from_json("text", API_COMPAT)["projects"]).alias("p")).select("doc_id", "p.*").where("trim(coalesce(project, '')) <> '' and trim(coalesce(status, '')) <> ''")
    low = F.lower("status")
    severity = F.when(low.isin("fail", "failed", "breaking"), "Error").when(low.isin("pass", "passed", "unchanged", "additive"), "Info").otherwise("Warning")
    message = F.coalesce("message", F.concat(F.lit("API compatibility "), "status", F.lit(" for "), "project"))
    return p.select(F.concat_ws("-", "doc_id", "project").alias("id"), "doc_id", F.lit("Analysis").alias("kind"), severity.alias("severity"), F.lit("apicompat").alias("source"), F.upper("status").alias("code"), message.alias("message"), "project", F.lit(1.0).alias("confidence"))


def api_status(docs: DataFrame) -> DataFrame:
    """S-23: doc_id, status: failed by any project, passed by all, else uncertain; so is a report that cannot be read."""
    d = api_compat(docs).groupBy("doc_id").agg(F.bool_or(F.col("severity") == "Error").alias("bad"), F.bool_and(F.col("severity") == "Info").alias("good"))
    status = F.when(F.col("bad"), "Fail").when(F.col("good"), "Pass").otherwise("Uncertain")
    return docs.select("doc_id").join(d, "doc_id", "left").select("doc_id", status.alias("status"))


def format_text(docs: DataFrame) -> DataFrame:
    """S-24: diagnostics of the output of a formatter: lines that name a source file or formatting."""
    place = r"^\s*(.+?\.cs)\(([0-9]+)(?:,([0-9]+))?\)"
    hit = lines_of(docs).where(F.lower("line").contains(".cs") | F.lower("line").contains("format"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    file = F.nullif(F.regexp_extract("line", place, 1), F.lit(""))
    return hit.select(
        F.concat_ws("-", F.lit("format"), "doc_id", n).alias("id"), "doc_id", F.lit("Format").alias("kind"), F.lit("Error").alias("severity"), F.lit("FORMAT_VIOLATION").alias("code"),
        F.trim("line").alias("message"), file.alias("file"), F.expr(rf"try_cast(nullif(regexp_extract(line, r'{place}', 2), '') AS INT)").alias("line"), F.when(file.isNull(), 0.7).otherwise(0.8).alias("confidence"),
    )


def build_events(events: DataFrame) -> DataFrame:
    """S-21: diagnostics of build events (event_id, level, code, message, file, line, project)."""
    e = events.where(F.lower("level").isin("error", "warning"))
    return e.select(F.concat(F.lit("build-"), "event_id").alias("id"), F.lit("Build").alias("kind"), F.initcap("level").alias("severity"), F.lit("build").alias("source"), "code", "message", slashes("file").alias("file"), "line", "project", F.lit(1.0).alias("confidence"))


def first_source(primary: DataFrame, fallback: DataFrame, key: str = "doc_id") -> DataFrame:
    """S-32: rows of the primary source, and of the fallback for documents that it has none of."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def changed_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """S-34: path, resolvable of changed files of both listings (path)."""
    p = tracked.select(slashes("path").alias("path")).unionByName(untracked.select(slashes("path").alias("path"))).distinct()
    return p.select("path", (~F.col("path").startswith("../") & ~F.col("path").startswith("/") & (F.col("path") != "")).alias("resolvable"))


def write_json(rows: DataFrame, path: str) -> None:
    """S-25: normalized rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, path: str, text: str = "text") -> None:
    """S-25: text lines, such as of a failure pack."""
    rows.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def mermaid(edges: list[tuple[str, str, str]]) -> str:
    """S-26: a diagram of a short list of edges (source, target, kind)."""
    clean = lambda t: "".join("_" if c in '"[](){}<>|`' else c for c in t)
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for a, b, _ in edges for x in (a, b)}))}
    lines = [f'  {names[n]}["{clean(n)}"]' for n in names] + [f"  {names[a]} -->|{clean(k)}| {names[b]}" for a, b, k in edges]
    return "\n".join(["graph LR", *lines])
