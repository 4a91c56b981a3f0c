"""Bounded breadth-first traversals over a frontier that is keyed by root.

Each level joins the frontier with the edges, keeps the least via edge of every
new node (a minimum, combined before the shuffle) and drops visited nodes. A
level is written to the shared folder, so plans stay short and lost executors
cost one level; the last one, which no other starts from, is left to the
caller's plan. Roots are not visited at first: on a cycle a root comes back at
the cycle's length, unless ``root_returns`` is false. Of edges that are stored
by the end where a level starts, each level reads the folders of its frontier;
it takes the edges at its frontier by a semi-join before all else, which goes
below the products that bundles of edges are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.exprs import FLOW_HTTP_KINDS, FLOW_UI_KINDS, REFERENCE_KINDS, STRUCTURAL_KINDS, enough
from changelens.functions.storage import kept, shared_path
from changelens.operators.relations import callers, di_narrowed, first_callers
from changelens.sources.graph import EDGE, SYMBOL, VIA, Bundles, holding, touching

PROFILES = {"code": REFERENCE_KINDS, "app": sorted({*REFERENCE_KINDS, *FLOW_HTTP_KINDS, *FLOW_UI_KINDS})}
FLOWS = {"http": FLOW_HTTP_KINDS, "ui": FLOW_UI_KINDS, "all": sorted({*FLOW_HTTP_KINDS, *FLOW_UI_KINDS})}
IMPACT = [*SYMBOL, *VIA, "depth", "root_id"]


def bfs(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool, via_order: list[str], root_returns: bool = True, per_root: int | None = None, known: DataFrame | None = None, symbols: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """T-07: root_id, id, depth and via columns of what ``roots`` (root_id) reach in 1 to ``depth`` steps; with ``symbols`` the rows of ``IMPACT``.

    ``edges`` are filtered already; ``via_order`` names the edge columns that choose among edges from the level before.
    Where only the nearest ``per_root`` nodes that are ``known`` (id) are wanted, a root stops at the level that completes them.
    With ``packed``, for many roots, the last level is shuffled as edges with the roots that stand at their near end.
    """
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    # The far end is the node itself, the same for all edges that are compared.
    via = F.struct(*[c for c in dict.fromkeys([*via_order, "source_id", "target_id", "kind", "line", "resolution_kind", "confidence"]) if c != far])
    steps = [F.col(near).alias("at"), F.col(far).alias("id"), via.alias("via")]

    def shown(level: DataFrame) -> DataFrame:
        v = F.col("via")
        end = lambda c: F.col("id") if c == far else v[c]
        out = level.select(
            "root_id", "id", "depth", end("source_id").alias("via_source"), end("target_id").alias("via_target"), v["kind"].alias("via_kind"),
            v["line"].alias("via_line"), v["resolution_kind"].alias("via_resolution"), v["confidence"].alias("via_confidence"),
        )
        if symbols is None:
            return out
        own = holding(symbols, "id", level, "id").select(*SYMBOL)
        # Symbols are hashed, so that the many rows that meet them are not sorted for it.
        return out.join(own.hint("shuffle_hash") if packed else own, "id").select(*IMPACT)

    start = roots.select("root_id").distinct()
    frontier = start.select("root_id", F.col("root_id").alias("at"))
    visited = start.select("root_id", F.col("root_id").alias("id")) if not root_returns else None
    levels, counts = [], []
    # Symbols that lie by id are read by the ids of each level, so these are written.
    laid = symbols is not None and "bucket" in symbols.columns
    for level in range(1, depth + 1):
        there = touching(holding(edges, near, frontier, "at"), near, frontier, "at")
        if level == depth and packed:
            reached = _last_packed(there.select(*steps), frontier, start)
        else:
            reached = frontier.join(there.select(*steps), "at")
            if level == depth:
                reached = reached.repartition("id")  # serves the groups and the join with symbols
            reached = reached.groupBy("root_id", "id").agg(F.min("via").alias("via"))
        if visited is not None:
            reached = reached.join(visited, ["root_id", "id"], "left_anti")
        reached = reached.withColumn("depth", F.lit(level))
        if level == depth:
            levels.append(kept(reached) if laid else reached)
            break
        reached = kept(reached)
        levels.append(reached)
        seen = reached.select("root_id", "id")
        visited = seen if visited is None else visited.unionByName(seen)
        frontier = seen.withColumnRenamed("id", "at")
        if per_root is not None:
            counts.append(kept(reached.join(known, "id", "left_semi").groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))))
            full = reduce(DataFrame.unionByName, counts).groupBy("root_id").agg(F.sum("n").alias("n")).where(F.col("n") >= per_root)
            frontier = frontier.join(full, "root_id", "left_anti")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, map(shown, levels))


#: Pairs of a root and a node that a task makes of packed edges, about.
TASK_PAIRS = 1_000_000


def _numbered(roots: DataFrame) -> DataFrame:
    """root_id, no: a number for each root, which takes less room in lists than its id."""
    return kept(roots.select("root_id").distinct().withColumn("no", F.monotonically_increasing_id()))


def _last_packed(steps: DataFrame, frontier: DataFrame, roots: DataFrame) -> DataFrame:
    """root_id, id, via of a level from ``steps`` (at, id, via) and ``frontier`` (root_id, at; distinct).

    A step is shuffled once, with the list of the roots at its near end, and the
    pairs are made where they are grouped. One job counts them, so that tasks
    grow in number and not in size.
    """
    numbers = _numbered(roots)
    lists = frontier.join(numbers, "root_id").groupBy("at").agg(F.collect_list("no").alias("roots"))
    n = steps.groupBy("at").agg(F.count(F.lit(1)).alias("n")).join(frontier.groupBy("at").agg(F.count(F.lit(1)).alias("m")), "at")
    pairs = n.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    dealt = steps.join(lists, "at").select("id", "via", "roots").repartition(tasks, "id")
    reached = dealt.select(F.explode("roots").alias("no"), "id", "via").groupBy("no", "id").agg(F.min("via").alias("via"))
    return reached.join(numbers, "no").select("root_id", "id", "via")


def reached_counts(symbols: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root_id, n: how many symbols reach each root (root_id) against the edges in 1 to ``depth`` steps.

    What ``bfs`` finds, by node with the list of its roots: no via edge is
    chosen, and pairs are made after the last shuffle, where they are counted.
    """
    numbers = _numbered(roots)
    lists = numbers.select(F.col("root_id").alias("at"), F.array("no").alias("roots"))
    found = None
    for level in range(1, depth + 1):
        there = touching(holding(edges, "target_id", lists, "at"), "target_id", lists, "at").select(F.col("target_id").alias("at"), F.col("source_id").alias("id")).distinct()
        rows = there.join(lists, "at").select("id", "roots")
        if level == depth and found is not None:
            rows = rows.unionByName(found)
        reached = rows.repartition("id").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))
        if level == depth:
            break
        reached = kept(reached)
        found = reached if found is None else found.unionByName(reached)
        lists = reached.withColumnRenamed("id", "at")
    known = symbols.select("id").distinct().hint("shuffle_hash")
    each = reached.join(known, "id", "left_semi").select(F.explode("roots").alias("no"))
    return each.groupBy("no").agg(F.count(F.lit(1)).alias("n")).join(numbers, "no").select("root_id", "n")


def single_root(symbols: DataFrame, root_id: str) -> DataFrame:
    return symbols.sparkSession.createDataFrame([(root_id,)], "root_id string")


def callees(symbols: DataFrame, edges: DataFrame, root_id: str, depth: int = 1, least: float = 0.0, root_returns: bool = True) -> DataFrame:
    """T-01, R-03"""
    e = edges.where((F.col("kind") == "Calls") & enough("confidence", least))
    return bfs(e, single_root(symbols, root_id), max(1, depth), False, ["source_id", "target_id"], root_returns, symbols=symbols)


def impact(
    symbols: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, profile: str = "code", registrations: DataFrame | None = None, root_returns: bool = True, per_root: int | None = None, packed: bool = False
) -> DataFrame:
    """T-02, T-05: everything that depends on the roots (root_id), for each root on its own; with ``per_root`` the levels that hold its nearest ones, with ``packed`` for many roots."""
    e = edges.where(F.col("kind").isin(*PROFILES[profile]))
    if registrations is not None and "ImplementedBy" in PROFILES[profile]:
        e = di_narrowed(e, registrations)
    if depth < 1:
        return bfs(e, roots.limit(0), 1, True, ["source_id"], symbols=symbols)
    known = None if per_root is None else symbols.select("id").distinct()
    return bfs(e, roots, depth, True, ["source_id", "kind", "target_id", "line"], root_returns, per_root, known, symbols, packed)


def flow(
    symbols: DataFrame, edges: DataFrame, root_id: str, kind: str = "http", depth: int = 4, least: float = 0.0, registrations: DataFrame | None = None, root_returns: bool = True
) -> DataFrame:
    """T-03: forward along the kinds of a flow; depth is held within 1 to 8."""
    e = edges.where(F.col("kind").isin(*FLOWS[kind]) & enough("confidence", least))
    if registrations is not None:
        e = di_narrowed(e, registrations)
    return bfs(e, single_root(symbols, root_id), min(8, max(1, depth)), False, ["kind", "source_id", "target_id"], root_returns, symbols=symbols)


def impact_union(symbols: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, per_root: int, profile: str = "code", registrations: DataFrame | None = None) -> DataFrame:
    """T-04: impact of roots (root_id, root_order), the first ``per_root`` of each, then every symbol once.

    Least depth wins, then the earliest root.
    """
    each = impact(symbols, edges, roots, depth, profile, registrations, per_root=per_root)
    rank = Window.partitionBy("root_id").orderBy("depth", "qualified_name", "id")
    cut = each.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= per_root).join(roots.select("root_id", "root_order"), "root_id")
    first = Window.partitionBy("id").orderBy("depth", "root_order")
    return cut.withColumn("k", F.row_number().over(first)).where("k = 1").select(*IMPACT)


def walk_truncated(symbols: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, limit: int, profile: str = "code") -> DataFrame:
    """T-08: for each root the number of impacted symbols and whether the budget cuts some off."""
    each = reached_counts(symbols, edges.where(F.col("kind").isin(*PROFILES[profile])), roots, depth)
    return roots.select("root_id").join(each, "root_id", "left").select("root_id", F.coalesce("n", F.lit(0)).alias("impacted"), (F.coalesce("n", F.lit(0)) > limit).alias("truncated"))


def budgeted_callers(symbols: DataFrame, edges: DataFrame, roots: DataFrame, budget: int, least: float = 0.0) -> DataFrame:
    """T-09: callers of all roots (root_id, root_order) in order, as many as one budget allows.

    Rows are counted by root first, so only roots at the edge of the budget are ranked across the whole.
    """
    hit = callers(symbols, edges, roots.select(F.col("root_id").alias("target_id")), least)
    hit = hit.join(roots.select(F.col("root_id").alias("via_target"), "root_order"), "via_target")
    sizes = hit.groupBy("root_order").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("root_order").alias("o"), F.coalesce(F.sum("n").over(Window.orderBy("root_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("root_order").orderBy("project", "qualified_name", F.coalesce("signature", F.lit("")), "id")
    ranked = hit.join(before.where(F.col("before") < budget), F.col("root_order") == F.col("o")).withColumn("rn", F.row_number().over(inner) + F.col("before"))
    return ranked.where(F.col("rn") <= budget).select(*SYMBOL, *VIA, "root_order", "rn")


def changed_impact(symbols: DataFrame, edges: DataFrame, changed: DataFrame, depth: int, least: float, limit: int, profile: str = "code") -> DataFrame:
    """T-11: impact union of changed symbols (id), then enough confidence, then the first rows."""
    roots = changed.select(F.col("id").alias("root_id"), F.col("id").alias("root_order")).distinct()  # roots count in the order of their ids
    union = impact_union(symbols, edges, roots, depth, limit, profile)
    return union.where(enough("via_confidence", least)).orderBy("depth", "qualified_name", "id").limit(limit)


def deletion_impact(symbols: DataFrame, edges: DataFrame, deleted: DataFrame, per_symbol: int, bundles: Bundles | None = None) -> DataFrame:
    """T-10: callers of the symbols that stood in deleted files (path), as the base graph has them.

    The first ``per_symbol`` of each symbol; ``truncated`` says of a symbol's
    rows that it has more. Of ``bundles``, edges beside ``edges``, a symbol's
    callers are those of its whole bundle, of which the first ``per_symbol`` and
    one more decide both.
    """
    from changelens.operators.lookup import in_files

    gone = in_files(symbols, deleted, None).select(F.col("id").alias("target_id"))
    if bundles is not None:
        edges = edges.select(*EDGE).unionByName(first_callers(symbols, bundles, per_symbol + 1).expanded())
    hit = callers(symbols, edges, gone)
    w = Window.partitionBy("via_target").orderBy("project", "qualified_name", F.coalesce("signature", F.lit("")), "id")
    more = F.count(F.lit(1)).over(Window.partitionBy("via_target")) > per_symbol
    return hit.withColumn("rn", F.row_number().over(w)).withColumn("truncated", more).where(F.col("rn") <= per_symbol).drop("rn")


def focus_distance(symbols: DataFrame, edges: DataFrame, focus: str, depth: int = 2) -> DataFrame:
    """T-06: id, distance from the first symbol that the focus names, in either direction of non-structural edges."""
    from changelens.functions.exprs import same_text

    hit = symbols.where(same_text(F.col("name"), F.lit(focus)) | same_text(F.col("qualified_name"), F.lit(focus)))
    root = hit.orderBy("project", "qualified_name", F.coalesce("signature", F.lit("")), "id").limit(1).select(F.col("id").alias("root_id"))
    root = kept(root)
    e = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS))
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "kind", "line", "resolution_kind", "confidence")
    reached = bfs(e.select(*back.columns).unionByName(back), root, depth, False, ["source_id"], root_returns=False)
    return root.select(F.col("root_id").alias("id"), F.lit(0).alias("distance")).unionByName(reached.select("id", F.col("depth").alias("distance")))


def propagate(dirty: DataFrame, references: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """T-13: project, selected: dirty projects and, against the references (project, depends_on), their dependents.

    Nothing spreads from a project whose public surface (project, before, after) is known and unchanged;
    a dependent that only such projects reach is listed as not selected. Each round adds its projects to a
    table, until a round has none, however long the chains are.
    """
    spark = dirty.sparkSession
    same = fingerprints.where("before is not null and after is not null and before = after").select("project")
    path, held = shared_path(spark), shared_path(spark)
    frontier = kept(dirty.select("project").distinct())
    skipped = references.select("project").limit(0)
    skipped.write.parquet(held)
    while True:
        frontier.write.mode("append").parquet(path)
        selected = spark.read.schema(frontier.schema).parquet(path)
        still = frontier.join(same, "project", "left_semi").select(F.col("project").alias("depends_on"))
        references.join(still, "depends_on", "left_semi").select("project").write.mode("append").parquet(held)
        moving = frontier.join(same, "project", "left_anti").select(F.col("project").alias("depends_on"))
        frontier = kept(references.join(moving, "depends_on", "left_semi").select("project").distinct().join(selected, "project", "left_anti"))
        if frontier.isEmpty():
            break
    rest = spark.read.schema(skipped.schema).parquet(held).distinct().join(selected, "project", "left_anti")
    return selected.select("project", F.lit(True).alias("selected")).unionByName(rest.select("project", F.lit(False).alias("selected")))


def slice_of(uses: DataFrame, seeds: DataFrame, backward: bool = True, depth: int = 50) -> DataFrame:
    """T-14: id, depth of the operations in a slice, over def-use edges (def_id, use_id) from seeds (id)."""
    rest = [F.lit(None).cast("int").alias("line"), F.lit("semantic").alias("resolution_kind"), F.lit(None).cast("double").alias("confidence")]
    e = uses.select(F.col("def_id").alias("source_id"), F.col("use_id").alias("target_id"), F.lit("DefUse").alias("kind"), *rest)
    # One root stands before (or, backward, behind) all seeds.
    root, seed = ("target_id", "source_id") if backward else ("source_id", "target_id")
    first = seeds.select(F.lit("slice").alias(root), F.col("id").alias(seed), F.lit("Seed").alias("kind"), *rest)
    roots = first.select(F.col(root).alias("root_id")).distinct()
    reached = bfs(e.unionByName(first), roots, depth + 1, backward, ["source_id", "target_id"], root_returns=False)
    return reached.select("id", (F.col("depth") - 1).alias("depth"))


def project_cycles(references: list[tuple[str, str]]) -> list[str]:
    """T-12, C-04: cycles of the project graph (project, depends_on), as paths.

    Projects, unlike symbols, are few enough for the driver; the walk keeps its
    own stack, so a chain may be as long as there are projects.
    """
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(references)):
        after.setdefault(a, []).append(b)
    done: set[str] = set()
    found: list[str] = []
    for first in sorted(after):
        if first in done:
            continue
        path, place, stack = [first], {first: 0}, [iter(after[first])]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                done.add(path[-1])
                del place[path.pop()]
            elif nxt in place:
                found.append(" -> ".join([*path[place[nxt] :], nxt]))
            elif nxt not in done:
                place[nxt] = len(path)
                path.append(nxt)
                stack.append(iter(after.get(nxt, [])))
    return found
