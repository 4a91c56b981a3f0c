"""Planning: what a change must prove. Each rule is a filtered projection; a plan is their union.

Inputs, all DataFrames:
changed (id, display, project, file, is_public, is_test); impacted (the same);
callers (changed_id, caller_id, caller_project, file, is_test);
relations (root_id, impacted_id, edge_kind, resolution, confidence);
test_maps (symbol, test); deltas (kind, old_path, new_path); resolved (path);
violations (subject_id, kind, project, file, display, message).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions.storage import kept

from changelens.functions.exprs import APP_KINDS, blank, glob_regex, paths_align, slashes, stable_id, symbol_matches, trim_signature

COLUMNS = ["id", "rule_id", "kind", "subject_id", "required", "risk_weight", "reason"]


@dataclass(frozen=True)
class Policy:
    heuristic_impact: str = "advisory"
    location_unknown: str = "blocking"
    impact_truncated: str = "blocking"
    caller_truncated: str = "blocking"
    public_api_required: bool = True
    internal_consumers_required: bool = True
    test_mapping_required: bool = True
    static_analysis_required: bool = False
    app_contract_required: bool = False
    architecture: str = "off"
    min_confidence: float = 0.75
    test_mapping_projects: tuple[str, ...] = ()
    manual_review_paths: tuple[str, ...] = ()
    ignored_paths: tuple[str, ...] = ()
    fail_on_uncertain: tuple[str, ...] = ()


@dataclass(frozen=True)
class Completeness:
    """What is known of how complete an analysis is: the one row that the uncertainty rules read."""

    location: str = "complete"
    impact_truncated: bool = False
    callers_truncated: bool = False
    heuristic_edges: bool = False
    file_wide_fallback: bool = False
    untracked_failed: bool = False
    hashes_failed: bool = False
    deltas_failed: bool = False
    rules_present: bool | None = None
    architecture_ran: bool = False
    notes: tuple[str, ...] = field(default=())


def row(rule: str, kind: str, subject: Column, required: Column | bool, weight: Column | int, reason: Column | str) -> list[Column]:
    """The columns of an obligation."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [
        stable_id("O", F.lit(rule), F.lit(kind), subject).alias("id"), F.lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), subject.alias("subject_id"),
        lit(required).alias("required"), lit(weight).cast("int").alias("risk_weight"), lit(reason).alias("reason"),
    ]


def first_spelling(projects: DataFrame, c: str = "project") -> DataFrame:
    """Projects that differ in more than case, each in its least spelling."""
    named = projects.select(F.col(c).alias("project")).where(~blank("project"))
    return named.groupBy(F.lower("project").alias("key")).agg(F.min("project").alias("project"))


def public_api(changed: DataFrame, impacted: DataFrame, p: Policy) -> DataFrame:
    """P-01: P001A for public changed symbols and, if there is any, P001B for impacted projects."""
    public = changed.where("is_public")
    a = public.select(*row("P001A", "Compatibility", F.col("id"), p.public_api_required, 4, F.concat(F.lit("changed public symbol in "), "project")))
    any_public = public.select(F.lit(1).alias("one")).limit(1)
    projects = first_spelling(impacted).join(F.broadcast(any_public))  # at most one row
    return a.unionByName(projects.select(*row("P001B", "Build", F.col("project"), p.internal_consumers_required, 3, "impacted internal consumer must compile")))


def caller_contracts(callers: DataFrame) -> DataFrame:
    """P-02: P002 for every test that calls what changed."""
    tests = callers.where("is_test").select("caller_id").distinct()
    return tests.select(*row("P002", "CallerContract", F.col("caller_id"), True, 3, "caller relation detected"))


def cross_project(changed: DataFrame, impacted: DataFrame, p: Policy) -> DataFrame:
    """P-03: P003 for impacted projects that did not change and have no P001B."""
    own = changed.select(F.lower("project").alias("key")).distinct()
    rest = first_spelling(impacted).join(own, "key", "left_anti")
    covered = changed.where("is_public").select(F.lit(1).alias("one")).limit(1)
    rest = rest.join(F.broadcast(covered), F.lit(True), "left_anti")  # P001B covers all impacted projects if there is any
    return rest.select(*row("P003", "CrossProject", F.col("project"), True, 3, "semantic cross-project impact"))


def mapped_tests(changed: DataFrame, test_maps: DataFrame) -> DataFrame:
    """changed_id, test: pairs by explicit maps.

    Equal or dotted-suffix names share their last dotted part, which makes this an equi-join.
    """
    tail = lambda c: F.lower(F.element_at(F.split(trim_signature(c), r"\."), -1))
    keyed = changed.where("not is_test").select("id", "display", F.explode(F.array_distinct(F.array(tail("id"), tail("display")))).alias("key"))
    maps = test_maps.where(~blank("test")).select("symbol", "test", tail("symbol").alias("key"))
    hit = keyed.join(maps, "key").where(symbol_matches(F.col("id"), F.col("display"), F.col("symbol")))
    return hit.select(F.col("id").alias("changed_id"), "test").distinct()


def tests(changed: DataFrame, impacted: DataFrame, callers: DataFrame, relations: DataFrame, test_maps: DataFrame, p: Policy) -> DataFrame:
    """P-04, P-05: P004 for impacted, calling and mapped tests, each once; P005 for production changes without any."""
    production = changed.where("not is_test")
    called = callers.where("is_test").join(production.select(F.col("id").alias("changed_id")), "changed_id", "left_semi")
    mapped = mapped_tests(changed, test_maps)
    found = (
        impacted.where("is_test").select(F.col("id").alias("subject"), F.lit(0).alias("rank"), F.lit("impacted test symbol").alias("reason"))
        .unionByName(called.select(F.col("caller_id").alias("subject"), F.lit(1).alias("rank"), F.lit("caller relation from a test symbol").alias("reason")))
        .unionByName(mapped.select(F.col("test").alias("subject"), F.lit(2).alias("rank"), F.lit("explicit test map entry").alias("reason")))
    )
    best = found.groupBy("subject").agg(F.min_by("reason", "rank").alias("reason"))
    p004 = best.select(*row("P004", "Test", F.col("subject"), True, 4, F.col("reason")))
    roots = relations.join(impacted.where("is_test").select(F.col("id").alias("impacted_id")), "impacted_id", "left_semi").select(F.col("root_id").alias("id"))
    tested = roots.unionByName(called.select(F.col("changed_id").alias("id"))).unionByName(mapped.select(F.col("changed_id").alias("id"))).distinct()
    bare = production.join(tested, "id", "left_anti")
    scope = [x.lower() for x in p.test_mapping_projects]
    required = F.lit(p.test_mapping_required) & (F.coalesce(F.lower("project").isin(*scope), F.lit(False)) if scope else F.lit(True))
    return p004.unionByName(bare.select(*row("P005", "TestMapping", F.col("id"), required, 2, "no mapped test relation found")))


def _uncertain(c: Completeness, p: Policy) -> list[tuple[str, str, str]]:
    """Code, message and disposition of what is not known."""
    facts = [
        (c.location in ("partial", "unknown"), "IMPACT_LOCATION_UNKNOWN", "Impact coverage is partial or unknown", p.location_unknown),
        (c.impact_truncated, "IMPACT_POTENTIALLY_TRUNCATED", "Impact traversal reached a result limit", p.impact_truncated),
        (c.callers_truncated, "CALLER_POTENTIALLY_TRUNCATED", "Caller collection reached a result limit", p.caller_truncated),
        (c.heuristic_edges, "HEURISTIC_EDGE_BLOCKING", "Heuristic or low-confidence impact requires review", p.heuristic_impact),
    ]
    return [f[1:] for f in facts if f[0]]


def uncertainty(spark: SparkSession, c: Completeness, p: Policy) -> DataFrame:
    """P-06: P006 or P007 for each blocking uncertainty."""
    rows = [(code, "P007" if code.startswith("HEURISTIC") else "P006") for code, _, d in _uncertain(c, p) if d == "blocking"]
    df = spark.createDataFrame(rows, "code string, rule string")
    return df.select(
        stable_id("O", F.col("rule"), F.lit("Uncertainty"), F.col("code")).alias("id"), F.col("rule").alias("rule_id"), F.lit("Uncertainty").alias("kind"),
        F.col("code").alias("subject_id"), F.lit(True).alias("required"), F.lit(1).alias("risk_weight"), F.col("code").alias("reason"),
    )


def constraints(spark: SparkSession, c: Completeness, p: Policy, deltas: DataFrame | None = None) -> DataFrame:
    """P-06, P-08: code, severity, message and subject of what limits a conclusion."""
    rows = [(code, "blocking" if d == "blocking" else "advisory", message, None) for code, message, d in _uncertain(c, p)]
    capture = [
        (c.file_wide_fallback, "CHANGE_FILE_WIDE_FALLBACK", "advisory", "Hunks were unavailable; file-wide spans were used."),
        (c.untracked_failed, "CHANGE_CAPTURE_UNTRACKED_FAILED", "blocking", "Untracked files could not be captured."),
        (c.hashes_failed, "CHANGE_CAPTURE_CONTENT_HASH_FAILED", "blocking", "Content hashes could not be captured."),
        (c.deltas_failed, "CHANGE_STRUCTURED_DELTA_FAILED", "blocking", "Change kinds could not be captured."),
    ]
    rows += [(code, severity, message, None) for on, code, severity, message in capture if on]
    out = spark.createDataFrame(rows, "code string, severity string, message string, subject string")
    if deltas is None:
        return out
    path = slashes(F.coalesce("new_path", "old_path", F.lit("")))
    odd = deltas.where("kind = 'Unsupported'").where(~_reviewed(path, p))
    return out.unionByName(odd.select(F.lit("CHANGE_UNSUPPORTED_KIND").alias("code"), F.lit("blocking").alias("severity"), F.lit("Unsupported change").alias("message"), path.alias("subject")))


def _reviewed(path: Column, p: Policy) -> Column:
    out = F.lit(False)
    for g in p.manual_review_paths:
        out = out | path.rlike(glob_regex(g))
    return out


def static_analysis(changed: DataFrame, impacted: DataFrame, p: Policy) -> DataFrame:
    """P-07: P008 for every project in reach, if the policy asks for it."""
    both = first_spelling(impacted.select("project").unionByName(changed.select("project")))
    both = both if p.static_analysis_required else both.limit(0)
    return both.select(*row("P008", "StaticAnalysis", F.col("project"), True, 2, "policy.staticAnalysis=required"))


def capture(deltas: DataFrame, resolved: DataFrame, p: Policy) -> DataFrame:
    """P-08: P009 for reviewed paths, untraced deletions, binaries and submodules, each path once."""
    path = slashes(F.coalesce("new_path", "old_path", F.lit("")))
    d = deltas.select("kind", path.alias("path"), F.ltrim(slashes("old_path"), F.lit("/")).alias("old"), F.monotonically_increasing_id().alias("n"))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))  # noqa: E731  aligned paths share their file name
    traced = d.where("kind = 'Deleted'").withColumn("key", name(F.col("old"))).join(resolved.select(F.ltrim(slashes("path"), F.lit("/")).alias("r")).withColumn("key", name(F.col("r"))), "key")
    traced = traced.where(paths_align(F.col("old"), F.col("r"))).select("path").distinct()
    asked = d.withColumn("reviewed", _reviewed(F.col("path"), p)).join(traced.withColumn("traced", F.lit(True)), "path", "left")
    reason = (
        F.when(F.col("reviewed"), "MANUAL_REVIEW_REQUIRED")
        .when((F.col("kind") == "Deleted") & F.col("traced").isNull(), "CHANGE_DELETION_ANALYSIS_UNAVAILABLE")
        .when(F.col("kind") == "BinaryModified", "CHANGE_BINARY_ANALYSIS_UNAVAILABLE")
        .when(F.col("kind") == "SubmoduleChanged", "CHANGE_SUBMODULE_ANALYSIS_UNAVAILABLE")
    )
    hit = asked.withColumn("reason", reason).where(F.col("reason").isNotNull() & ~blank("path"))
    once = hit.groupBy("path").agg(F.min_by("reason", F.struct("n", "reason")).alias("reason"))
    return once.select(*row("P009", "ManualReview", F.col("path"), True, 3, F.col("reason")))


def app_contracts(relations: DataFrame, impacted: DataFrame, p: Policy) -> DataFrame:
    """P-09: P010 for what is reached by a certain application edge and is no test."""
    least = p.min_confidence if p.min_confidence > 0 else 0.75
    sure = (F.lower("resolution") != "heuristic") & (F.col("confidence").isNull() | (F.col("confidence") >= least))
    hit = relations.where(F.col("edge_kind").isin(*APP_KINDS) & sure).select(F.col("impacted_id").alias("id")).distinct()
    hit = hit.join(impacted.where("is_test").select("id"), "id", "left_anti")
    hit = hit if p.app_contract_required else hit.limit(0)
    return hit.select(*row("P010", "AppContract", F.col("id"), True, 2, "application edge in the impact"))


def architecture(spark: SparkSession, violations: DataFrame | None, c: Completeness, p: Policy) -> DataFrame:
    """P-10: P011 for the rules as such, if required, and for every subject with violations."""
    reason = "architecture rules file missing" if c.rules_present is not True else "architecture check did not run" if violations is None else "architecture policy check required"
    one = spark.range(1 if p.architecture == "required" else 0).select(*row("P011", "Architecture", F.lit("architecture-rules"), True, 3, reason))
    if violations is None or p.architecture == "off":
        return one
    kinds = violations.groupBy("subject_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    needed = F.lit(p.architecture == "required") & (F.array_contains("kinds", "cycle") | F.array_contains("kinds", "layer"))
    return one.unionByName(kinds.select(*row("P011", "Architecture", F.col("subject_id"), needed, F.when(needed, 3).otherwise(1), F.array_join("kinds", ","))))


def plan(
    spark: SparkSession, changed: DataFrame, impacted: DataFrame, callers: DataFrame, relations: DataFrame, p: Policy,
    test_maps: DataFrame, deltas: DataFrame, resolved: DataFrame, violations: DataFrame | None = None, c: Completeness | None = None,
) -> DataFrame:
    """P-11: all obligations of a change."""
    c = c or Completeness()
    parts = [
        public_api(changed, impacted, p), caller_contracts(callers), cross_project(changed, impacted, p), tests(changed, impacted, callers, relations, test_maps, p),
        uncertainty(spark, c, p), static_analysis(changed, impacted, p), capture(deltas, resolved, p), app_contracts(relations, impacted, p), architecture(spark, violations, c, p),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def in_order(obligations: DataFrame) -> DataFrame:
    return obligations.orderBy(F.desc("required"), "rule_id", "subject_id")


def path_policy(deltas: DataFrame, p: Policy) -> DataFrame:
    """L-19: changes outside of the ignored paths."""
    path = slashes(F.coalesce("new_path", "old_path", F.lit("")))
    out = F.lit(False)
    for g in p.ignored_paths:
        out = out | path.rlike(glob_regex(g))
    return deltas.where(~out)


def greedy_checks(covers: dict[str, set[str]], weights: dict[str, int], costs: dict[str, int]) -> list[str]:
    """P-12: checks that together cover all that any covers, by weight gained for the cost, over sets in memory: ``greedy_cover`` for a short list."""
    rest, chosen = set().union(*covers.values()) if covers else set(), []
    while rest:
        gain = {c: sum(weights.get(o, 1) for o in ids & rest) / max(1, costs.get(c, 1)) for c, ids in covers.items() if c not in chosen}
        best = min((c for c in gain if gain[c] > 0), key=lambda c: (-gain[c], c), default=None)
        if best is None:
            break
        chosen.append(best)
        rest -= covers[best]
    return chosen


def greedy_cover(covers: DataFrame, obligations: DataFrame, costs: DataFrame) -> DataFrame:
    """P-12: step, check_id, gain of the checks chosen: each time the one with most weight gained for its cost, ties by id.

    ``covers`` (check_id, obligation_id), ``obligations`` (id, risk_weight),
    ``costs`` (check_id, cost; 1 where none is given). A step is one aggregation
    by check over what no chosen check covers, and one row comes back from it;
    the driver holds the chosen checks, at most the catalog.
    """
    spark = covers.sparkSession
    weight = F.greatest(F.lit(1), F.coalesce("risk_weight", F.lit(1)))
    by_id = obligations.groupBy(F.col("id").alias("obligation_id")).agg(F.first("risk_weight").alias("risk_weight"))
    rest = kept(covers.distinct().join(by_id, "obligation_id", "left").join(costs.select("check_id", F.greatest(F.lit(1), "cost").alias("cost")), "check_id", "left").select("check_id", "obligation_id", weight.alias("weight"), F.coalesce("cost", F.lit(1)).alias("cost")))
    chosen: list[tuple[int, str, int]] = []
    while True:
        gains = rest.groupBy("check_id", "cost").agg(F.sum("weight").alias("gain"))
        best = gains.orderBy(F.desc(F.col("gain").cast("double") / F.col("cost")), "check_id").first()
        if best is None:
            return spark.createDataFrame(chosen, "step int, check_id string, gain long")
        chosen.append((len(chosen), best["check_id"], best["gain"]))
        done = rest.where(F.col("check_id") == best["check_id"]).select("obligation_id")
        rest = kept(rest.join(done, "obligation_id", "left_anti"))


def needed(chosen: DataFrame, needs: DataFrame) -> DataFrame:
    """P-12: check_id, depth of the chosen checks (check_id) and all they need (check_id, depends_on), over any number of steps: 0 if chosen, else the steps from the nearest chosen one."""
    level, depth = kept(chosen.select("check_id").distinct()), 0
    out = level.withColumn("depth", F.lit(0))
    while True:
        depth += 1
        after = needs.join(level, "check_id", "left_semi").select(F.col("depends_on").alias("check_id")).distinct()
        level = kept(after.join(out.select("check_id"), "check_id", "left_anti"))
        if level.isEmpty():
            return out
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))


def with_dependencies(chosen: list[str], needs: dict[str, list[str]]) -> list[str]:
    """P-12, D-06: the chosen checks after those they need; raises on a cycle."""
    out: list[str] = []
    open_: list[str] = []

    def add(check: str) -> None:
        if check in out:
            return
        if check in open_:
            raise ValueError(f"checks need each other: {' -> '.join([*open_, check])}")
        open_.append(check)
        for n in needs.get(check, []):
            add(n)
        open_.pop()
        out.append(check)

    for c in chosen:
        add(c)
    return out


def coverable(obligations: DataFrame, capabilities: DataFrame) -> DataFrame:
    """P-12: check_id, obligation_id: capabilities (check_id, kind, project; null for all) that serve required obligations."""
    o = obligations.where("required").select(F.col("id").alias("obligation_id"), "kind", "subject_id")
    hit = o.join(capabilities, "kind").where(F.col("project").isNull() | (F.lower("project") == F.lower("subject_id")))
    return hit.select("check_id", "obligation_id").distinct()


def uncovered(obligations: DataFrame, covers: DataFrame) -> DataFrame:
    """P-13: blocking constraints for required obligations that no check covers."""
    bare = obligations.where("required").join(covers.select(F.col("obligation_id").alias("id")), "id", "left_anti")
    return bare.select(F.lit("REQUIRED_EVIDENCE_CAPABILITY_MISSING").alias("code"), F.lit("blocking").alias("severity"), F.col("id").alias("subject"))


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """D-16: the newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
