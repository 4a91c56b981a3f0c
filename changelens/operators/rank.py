"""Ranking, scoring and aggregation over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.exprs import STRUCTURAL_KINDS, approx_tokens, blank, is_test, map_label
from changelens.functions.ordering import placed
from changelens.functions.storage import kept
from changelens.sources.graph import EDGE, SYMBOL, Bundles, touching

# Name parts that mark a symbol as central.
CENTRAL_NAMES = ["service", "handler", "repository", "controller", "factory", "provider", "gateway", "writer", "query"]
PUBLIC_API_KINDS = ["Class", "Struct", "Record", "Interface", "Method", "Property", "Delegate"]
# Relevance of an edge kind for the goal of an investigation; 0.5 where none is given.
RELEVANCE = {
    "debug": {"Calls": 0.90, "Implements": 0.85, "ImplementedBy": 0.85},
    "trace": {"Calls": 1.00, "RoutesTo": 1.00, "Renders": 0.95, "BindsTo": 0.90},
    "impact": {"Calls": 1.00, "RoutesTo": 0.95, "ImplementedBy": 0.90},
    "understand": {"Contains": 1.00, "Calls": 0.85, "Implements": 0.80},
}


def degrees(edges: DataFrame, bundles: Bundles | None = None) -> DataFrame:
    """id, incoming, outgoing of non-structural edges; both ends are counted in one aggregation, those of ``bundles`` by the sizes of the other side."""
    e = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS))
    ends = e.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("o")))).alias("x")).select("x.*")
    if bundles is not None:
        s, t = bundles.sources.where(~F.col("kind").isin(*STRUCTURAL_KINDS)), bundles.targets
        size = lambda df: df.groupBy(*bundles.keys).agg(F.count(F.lit(1)).alias("n"))
        ends = ends.unionByName(s.join(size(t), bundles.keys).select(F.col("source_id").alias("id"), F.lit(0).cast("long").alias("i"), F.col("n").alias("o")))
        ends = ends.unionByName(t.join(size(s), bundles.keys).select(F.col("target_id").alias("id"), F.col("n").alias("i"), F.lit(0).cast("long").alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def map_scores(symbols: DataFrame, edges: DataFrame, focus: str | None = None, project: str | None = None, distances: DataFrame | None = None, bundles: Bundles | None = None) -> DataFrame:
    """A-01: symbol rows with their score for a repository map; ``distances`` (id, distance) come from the focus.

    Edges of ``bundles`` count beside ``edges``.
    """
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    name = F.lower("name")
    s = symbols.where("kind <> 'Namespace'").select(*SYMBOL).join(degrees(edges, bundles), "id", "left")
    if project:
        s = s.where(F.lower("project") == project.lower())
    public = F.col("visibility") == "public"
    points = [
        n0("incoming") * 2 + n0("outgoing"),
        F.when(F.col("kind") == "Interface", 6).otherwise(0),
        F.when(F.col("kind").isin("Class", "Struct", "Record") & public, 4).otherwise(0),
        F.when(public, 2).otherwise(0),
        F.when(F.lower("name").rlike("|".join(CENTRAL_NAMES)), 3).otherwise(0),
        F.when(F.col("kind") == "Constructor", n0("outgoing")).otherwise(0),
        F.when(is_test(), -10).otherwise(0),
        F.when(name.contains("dto") | name.contains("options"), -2).otherwise(0),
        F.when(name.contains("converter") | (F.col("kind") == "Enum"), -1).otherwise(0),
    ]
    if focus:
        f = focus.lower()
        full, path = F.lower("qualified_name"), F.lower("relative_path")
        points.append(F.when((name == f) | (full == f), 30).when(name.contains(f) | full.contains(f) | path.contains(f), 12).otherwise(0))
        if distances is not None:
            s = s.join(distances, "id", "left")
            points.append(F.when(F.col("distance") <= 2, 10 - F.col("distance") * 3).otherwise(0))
    total = points[0]
    for p in points[1:]:
        total = total + p
    return s.select(*SYMBOL, total.cast("long").alias("score"))


def map_order(project: str | None = None) -> list[Column]:
    external = F.lit(0) if project else F.when(F.col("project").startswith("external:"), 1).otherwise(0)
    return [F.desc("score"), external, F.col("project"), F.col("qualified_name"), F.coalesce(F.col("signature"), F.lit("")), F.col("id")]


def _map_line_label(name: str, qualified: str, kind: str) -> str:
    """The name, or for callables the last two parts of the qualified name without signature, and parentheses."""
    if kind not in ("Method", "Constructor"):
        return name
    parts = [x for x in qualified.split("(")[0].split(".") if x]
    return f"{'.'.join(parts[-2:]) if len(parts) > 1 else name}()"


def build_map(symbols: DataFrame, edges: DataFrame, budget: int, focus: str | None = None, project: str | None = None, batch: int = 2000, bundles: Bundles | None = None) -> list[str]:
    """A-02: lines of a repository map within ``budget`` tokens (of four characters, line ends included).

    A head of four lines, then the symbols in the order of their scores with
    their first targets. A symbol that does not fit is passed over, a target
    that does not fit ends its symbol's list. The ranked symbols are a table;
    the driver reads the next ``batch`` of those whose line fits into what is
    left, until nothing is left or no symbol fits: each batch takes one at
    least, so the budget bounds the batches, and no symbol is left out. Targets
    are ranked for the symbols of a batch only. ``bundles`` are edges beside
    ``edges``; with a focus these are spelt out where its distances are walked.
    """
    from changelens.operators.relations import top_targets
    from changelens.operators.traverse import focus_distance

    near = focus_distance(symbols, edges if bundles is None else edges.select(*EDGE).unionByName(bundles.expanded()), focus) if focus else None
    own = symbols.where("kind <> 'Namespace'")
    short = F.filter(F.split(F.substring_index("qualified_name", "(", 1), r"\."), lambda x: x != "")
    label = F.when(F.size(short) > 1, F.array_join(F.slice(short, -2, 2), ".")).otherwise(F.col("name"))
    size = F.when(F.col("kind").isin("Method", "Constructor"), F.length(label) + 2).otherwise(F.length("name"))
    ranked = map_scores(own, edges, focus, project, near, bundles).withColumn("tokens", F.ceil((size + 3) / 4))
    order = map_order(project)
    keyed = ranked.select("id", "name", "qualified_name", "kind", "tokens", F.struct((-F.col("score")).alias("a"), *[x.alias(n) for n, x in zip("bcdef", order[1:], strict=True)]).alias("place"))
    keyed = kept(keyed)
    named = project or project_label(own.select("project", F.lit(1).alias("all")), "all").first()
    lines, used = [], 0

    def add(line: str) -> bool:
        nonlocal used
        more = (1 if lines else 0) + len(line)
        if lines and -(-used // 4) - (-more // 4) > max(1, budget):
            return False
        lines.append(line)
        used += more
        return True

    for line in ("# CodeMap", f"project: {named if isinstance(named, str) else named['label'] if named else 'unknown'}", f"symbols: {symbols.count()}", ""):
        add(line)
    last = None
    while (room := max(1, budget) - -(-used // 4)) > 0:
        rest = keyed.where(F.col("tokens") <= room)
        if last is not None:
            rest = rest.where(F.col("place") > F.struct(*[F.lit(v).alias(n) for n, v in last.asDict().items()]).cast(keyed.schema["place"].dataType))
        part = kept(rest.orderBy("place").limit(batch))
        rows = part.orderBy("place").collect()  # a batch
        if not rows:
            break
        lists: dict[str, list] = {}
        there = bundles and Bundles(touching(bundles.sources, "source_id", part, "id"), bundles.targets, bundles.keys)
        targets = top_targets(symbols, touching(edges, "source_id", part, "id"), bundles=there)
        for r in targets.select(F.col("via_source").alias("id"), F.struct("rn", "name", "qualified_name", "kind").alias("t")).collect():  # three of each symbol of a batch
            lists.setdefault(r["id"], []).append(r["t"])
        for r in rows:
            if not add(f"  {_map_line_label(r['name'], r['qualified_name'], r['kind'])}"):
                continue
            for t in sorted(lists.get(r["id"], []), key=lambda t: t["rn"]):
                if not add(f"    > {_map_line_label(t['name'], t['qualified_name'], t['kind'])}"):
                    break
        last = rows[-1]["place"]
    return lines


def project_label(rows: DataFrame, *keys: str) -> DataFrame:
    """A-03: the one project of the rows of a group, else multiple, or unknown without any."""
    # Groups and their projects are hashed first, so few rows are left whose least and largest project are looked for.
    least, most = F.min("project"), F.max("project")
    return rows.select(*keys, "project").distinct().groupBy(*keys).agg(F.when(least == most, least).when(least < most, "multiple").otherwise("unknown").alias("label"))


def target_labels(symbols: DataFrame, edges: DataFrame, bundles: Bundles | None = None) -> DataFrame:
    """A-03: source_id, label of what each source points at; of ``bundles``, edges beside ``edges``, the least and the largest project of the targets tell."""
    own = symbols.select(F.col("id").alias("target_id"), "project")
    seen = edges.select("source_id", "target_id").join(own, "target_id", "left").select("source_id", "project")
    if bundles is not None:
        sides = bundles.targets.join(own, "target_id", "left").groupBy(*bundles.keys).agg(F.array_distinct(F.array(F.min("project"), F.max("project"))).alias("projects"))
        seen = seen.unionByName(bundles.sources.join(sides, bundles.keys).select("source_id", F.explode("projects").alias("project")))
    return project_label(seen, "source_id")


def risk(changed: DataFrame, impact: DataFrame) -> DataFrame:
    """A-04: one row: public APIs, callers, cross-project and untested counts, weighted total and level.

    ``changed`` are symbol rows, ``impact`` rows have via columns and root_id.
    """
    api = (F.lower("visibility") == "public") & F.col("kind").isin(*PUBLIC_API_KINDS)
    projects = changed.select(F.lower("project").alias("p")).distinct().withColumn("own", F.lit(True))
    weight = F.when(F.col("via_confidence").isNull() | (F.col("via_confidence") == 0), 1.0).otherwise(F.col("via_confidence"))
    # The impact is walked once: its rows are counted by root and by symbol, and only these counts are written.
    rated = impact.join(projects, F.lower("project") == F.col("p"), "left")
    rated = rated.select("root_id", "id", api.alias("api"), (F.col("via_kind") == "Calls").alias("calls"), F.col("own").isNull().alias("cross"), weight.alias("weight"), is_test().alias("test"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if("calls").alias("calls"), F.count_if("cross").alias("cross"), F.sum("weight").alias("weight"), F.max("api").alias("api"), F.max("test").alias("test")]
    by = kept(rated.groupingSets([["root_id"], ["id"]], "root_id", "id").agg(F.grouping("id").alias("of_root"), *sums))
    of_root = by.where("of_root = 1")
    apis = changed.where(api).select("id").unionByName(by.where("of_root = 0 and api").select("id")).agg(F.count_distinct("id").alias("public_apis"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    seen = of_root.agg(none("calls").alias("callers"), none("cross").alias("cross_project"), F.coalesce(F.sum("weight") / F.sum("n"), F.lit(1.0)).alias("weight"))
    tested = of_root.where("test").select(F.col("root_id").alias("id"))
    untested = changed.where(~is_test()).join(tested, "id", "left_anti").agg(F.count(F.lit(1)).alias("untested"))
    one = apis.crossJoin(seen).crossJoin(untested)  # a row each
    total = F.col("public_apis") * 2 + F.col("callers") * F.col("weight") + F.col("cross_project") * 2 + F.col("untested") * 3
    level = F.when(F.col("total") >= 8, "high").when(F.col("total") >= 4, "medium").otherwise("low")
    return one.withColumn("total", total).select("public_apis", "callers", "cross_project", "untested", F.bround("total", 2).alias("weighted_total"), level.alias("level"))


def provider_union(providers: list[tuple[str, DataFrame]], per_provider: int, total: int, order: list[str]) -> DataFrame:
    """A-05: rows of the providers in turn, so many of each and so many in all; the columns of all agree."""
    out = None
    for n, (name, rows) in enumerate(providers):
        part = rows.orderBy(*order).limit(per_provider).withColumn("provider", F.lit(name)).withColumn("provider_order", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("provider_order", *order).limit(total)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """A-06: the best row of each symbol (id): higher tier, lower depth, provider name; and the other providers."""
    best = Window.partitionBy("id").orderBy(F.desc("tier"), "depth", "provider")
    names = candidates.groupBy("id").agg(F.array_sort(F.collect_set("provider")).alias("names"))
    one = candidates.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn").join(names, "id")
    return one.withColumn("others", F.array_join(F.array_remove("names", F.col("provider")), ",")).drop("names")


def relevance(goal: str, via_kind: Column, local: Column | None = None) -> Column:
    out = F.lit(None).cast("double")
    for kind, v in RELEVANCE.get(goal, {}).items():
        out = F.when(via_kind == kind, v).otherwise(out)
    out = F.coalesce(out, F.lit(0.5))
    return F.when(local, 1.10).otherwise(out) if goal == "debug" and local is not None else out


def ranked_candidates(candidates: DataFrame, goal: str) -> DataFrame:
    """A-07: candidates (id, via_kind, tier, depth, confidence, cost) with relevance and rank."""
    c = candidates.withColumn("relevance", relevance(goal, F.col("via_kind")))
    order = [F.desc("relevance"), F.desc("tier"), F.col("depth"), F.desc(F.coalesce("confidence", F.lit(1.0))), F.greatest(F.lit(1), F.col("cost")), F.col("id")]
    return placed(c, order, "rank").withColumn("rank", F.col("rank").cast("int"))


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """A-08: ``ranked`` (rank, cost) with ``selected``: a prefix by rank that ends before the first row over budget."""
    total = placed(ranked, [F.asc("rank")], "place__", "spent", F.greatest(F.lit(1), F.col("cost")))
    return total.drop("place__").withColumn("selected", F.col("spent") <= budget)


def coverage(candidates: DataFrame) -> DataFrame:
    """A-09: rows by tier, by whether they are external, and by provider."""
    external = F.col("project").startswith("external:")
    facts = F.array(F.concat(F.lit("tier:"), F.col("tier")), F.when(external, "external").otherwise("source"), F.concat(F.lit("provider:"), F.col("provider")))
    return candidates.select(F.explode(facts).alias("fact")).groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


def merged_spans(spans: DataFrame, gap: int = 2) -> DataFrame:
    """A-10: spans (file, start, end) merged where at most ``gap`` lines lie between; islands by a running maximum."""
    w = Window.partitionBy("file").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(F.col("start") > reach + gap, 1).otherwise(0))
    island = opened.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("spans")).drop("island")


def counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """A-11"""
    return symbols.agg(F.count(F.lit(1)).alias("symbols")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def with_members(matches: DataFrame, symbols: DataFrame, edges: DataFrame, per_symbol: int = 8, bundles: Bundles | None = None) -> DataFrame:
    """A-12: every match with the names of its first members; of ``bundles``, edges beside ``edges``, only the first targets of a bundle can be among them."""
    from changelens.operators.relations import MEMBER_KINDS

    m = symbols.where(F.col("kind").isin(*MEMBER_KINDS)).select(F.col("id").alias("member_id"), F.col("name").alias("member"), F.col("start_line").alias("line"))
    e = edges.where("kind = 'Contains'").select(F.col("source_id").alias("id"), F.col("target_id").alias("member_id"))
    first = lambda *by: Window.partitionBy(*by).orderBy(F.asc_nulls_last("line"), "member", "member_id")
    e = touching(touching(e, "id", matches, "id"), "member_id", m, "member_id").join(m, "member_id")
    if bundles is not None:
        t = bundles.targets.join(m, F.col("target_id") == F.col("member_id")).withColumn("nth", F.row_number().over(first(*bundles.keys))).where(F.col("nth") <= per_symbol)
        s = touching(bundles.sources.where("kind = 'Contains'").select(*bundles.keys, F.col("source_id").alias("id")), "id", matches, "id")
        e = e.unionByName(s.join(t, bundles.keys).select(*e.columns))
    ranked = e.withColumn("rn", F.row_number().over(first("id"))).where(F.col("rn") <= per_symbol)
    lists = ranked.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "member"))), lambda x: x["member"]), ",").alias("members"))
    return matches.join(lists, "id", "left")


def history(entries: DataFrame) -> DataFrame:
    """A-13: distribution of verdicts, rules and reasons of runs (run_id, at, verdict, rules, reasons), most frequent first."""
    facts = F.flatten(F.array(F.array(F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("value"))), F.transform("rules", lambda r: F.struct(F.lit("rule").alias("kind"), r.alias("value"))), F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("value")))))
    rows = entries.select("at", F.explode(facts).alias("f")).where(~blank("f.value"))
    return rows.groupBy(F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def certificate_summary(obligations: DataFrame, constraints: DataFrame) -> DataFrame:
    """A-14: counts of obligations (status, required) and blocking constraints."""
    o = obligations.agg(F.count(F.when(F.col("status") == "Proven", 1)).alias("proven"), F.count(F.when(F.col("status") == "Unresolved", 1)).alias("unresolved"), F.count(F.when(F.col("required"), 1)).alias("required"))
    return o.crossJoin(constraints.agg(F.count(F.when(F.lower("severity") == "blocking", 1)).alias("blocking")))


def map_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of map labels, F-04 and F-06."""
    label = map_label("qualified_name", "kind")
    return rows.select("id", label.alias("label"), approx_tokens(label).alias("tokens"))
