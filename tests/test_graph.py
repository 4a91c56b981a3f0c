"""Hand-made graphs: shapes, confidence, injection, ambiguity, storage and scale of plans."""

import math

import pytest
from pyspark.sql import functions as F

from changelens.functions import exprs as X
from changelens.operators import arch, incremental, lookup, rank, relations, traverse
from changelens.sources import graph as G
from tests.conftest import rows

SYMBOLS = "id string, file_id string, project string, relative_path string, kind string, name string, qualified_name string, signature string, start_line int, end_line int, visibility string, language string"
EDGES = "source_id string, target_id string, kind string, line int, resolution_kind string, confidence double"


def symbols(spark, *rows):
    """(id, project, path, kind, name, start, end)"""
    full = [(i, f"f:{p}/{path}", p, path, kind, name, f"N.{name}", None, a, b, "public", "csharp") for i, p, path, kind, name, a, b in rows]
    return spark.createDataFrame(full, SYMBOLS)


def edges(spark, *rows):
    """(source, target, kind, confidence)"""
    return spark.createDataFrame([(s, t, k, 1, "semantic", c) for s, t, k, c in rows], EDGES)


def letters(spark, names="abcd", project="P"):
    return symbols(spark, *[(x, project, f"{x}.cs", "Method", x, 1, 5) for x in names])


def test_diamond(spark):
    e = edges(spark, ("a", "b", "Calls", None), ("a", "c", "Calls", None), ("b", "d", "Calls", None), ("c", "d", "Calls", None))
    got = {r["id"]: r for r in traverse.callees(letters(spark), e, "a", 5).collect()}
    assert {k: r["depth"] for k, r in got.items()} == {"b": 1, "c": 1, "d": 2} and got["d"]["via_source"] == "b"


def test_cycle_brings_the_root_back(spark):
    e = edges(spark, ("a", "b", "Calls", None), ("b", "c", "Calls", None), ("c", "a", "Calls", None))
    s = letters(spark)
    depth = lambda **k: {r["id"]: r["depth"] for r in traverse.callees(s, e, "a", **k).collect()}
    assert depth(depth=2) == {"b": 1, "c": 2} and depth(depth=5) == {"b": 1, "c": 2, "a": 3}
    assert depth(depth=5, root_returns=False) == {"b": 1, "c": 2}


def test_null_confidence_passes_every_threshold(spark):
    e = edges(spark, ("a", "d", "Calls", None), ("b", "d", "Calls", 0.4), ("c", "d", "Calls", 0.9))
    t = spark.createDataFrame([("d",)], "target_id string")
    ids = lambda least: {r["id"] for r in relations.callers(letters(spark), e, t, least).collect()}
    assert ids(0.0) == {"a", "b", "c"} and ids(0.5) == {"a", "c"} and ids(1.0) == {"a"}


@pytest.mark.parametrize("regs,kept", [([("r0", "Registers")], {"x", "y"}), ([("r0", "Registers"), ("r0", "x", "ResolvesTo")], {"x"}), ([("r0", "Registers"), ("r1", "Registers"), ("r0", "x", "ResolvesTo")], {"x", "y"}), ([], {"x", "y"})])
def test_di_narrowing(spark, regs, kept):
    rows = [(r[0], "i" if len(r) == 2 else r[1], r[-1]) for r in regs]
    di = spark.createDataFrame(rows, "source_id string, target_id string, kind string")
    e = edges(spark, ("i", "x", "ImplementedBy", None), ("i", "y", "ImplementedBy", None), ("i", "z", "Calls", None))
    assert {r["target_id"] for r in relations.di_narrowed(e, di).collect()} == kept | {"z"}


def test_ambiguous_path_gives_nothing(spark):
    s = symbols(spark, ("1", "P", "A.cs", "Class", "A", 1, 9), ("2", "P", "a.cs", "Class", "B", 1, 9), ("3", "P", "C.cs", "Class", "C", 1, 9), ("4", "P", "C.cs", "Class", "D", 20, 29))
    spans = spark.createDataFrame([("s1", "A.cs", 1, 2), ("s2", "p/c.CS", 9, 20), ("s3", "C.cs", 10, 19)], "span_id string, path string, start int, end int")
    assert {(r["span_id"], r["id"]) for r in lookup.intersecting(s, spans).collect()} == {("s2", "3"), ("s2", "4")}


def test_source_is_preferred_to_external(spark):
    s = symbols(spark, ("1", "P", "A.cs", "Method", "Run", 1, 9), ("2", "external:Lib", "B.cs", "Method", "Run", 1, 9))
    assert [r["id"] for r in lookup.resolve(s, "run").collect()] == ["1"]
    assert [r["id"] for r in lookup.resolve(s, "2").collect()] == ["2"]
    assert [r["id"] for r in lookup.find(s, "Run").collect()] == ["1", "2"]


def test_find_takes_wildcards_literally(spark):
    s = symbols(spark, ("1", "P", "A.cs", "Method", "a_b", 1, 9), ("2", "P", "A.cs", "Method", "axb", 1, 9))
    assert [r["id"] for r in lookup.find(s, "N.a_").collect()] == ["1"] and lookup.find(s, "%").count() == 0


def test_page_tells_of_more(spark):
    s = letters(spark)
    pages = [[(r["id"], r["has_more"]) for r in lookup.page(s, [F.col("id")], 3, o).collect()] for o in (0, 3, 9)]
    assert pages == [[("a", True), ("b", True), ("c", True)], [("d", False)], []]


def test_surface_kinds(spark):
    cols = "project string, kind string, qualified_name string, signature string"
    before = spark.createDataFrame([("P", "Method", "N.f", "()"), ("Q", "Method", "N.g", "()"), ("R", "Method", "N.h", "()"), ("U", "Method", "N.u", "()")], cols)
    after = spark.createDataFrame([("P", "Method", "N.f", "()"), ("P", "Method", "N.f", "(int)"), ("Q", "Method", "N.g", "(int)"), ("R", "Method", "N.x", "()"), ("U", "Method", "N.u", "()"), ("Z", "Method", "N.z", "()")], cols)
    got = {r["project"]: (r["change"], r["status"]) for r in arch.surface_verdicts(before, after).collect()}
    assert got == {"P": ("Additive", "Pass"), "Q": ("Breaking", "Fail"), "R": ("Mixed", "Fail"), "U": ("Unchanged", "Pass"), "Z": ("Inconclusive", "Inconclusive")}


def test_save_load_and_guards(spark, tmp_path):
    s = letters(spark)
    g = G.Graph(s.select(F.col("file_id").alias("id"), "project", "relative_path", "language"), s, edges(spark, ("a", "b", "Calls", None)))
    G.save(g, str(tmp_path / "g"), {"csharp": "7"})
    got = G.load(spark, str(tmp_path / "g"), {"csharp": "7"})
    assert got.edges.count() == got.forward.count() == 1
    assert traverse.callees(got.symbols, got.forward, "a", 1).count() == 1
    with pytest.raises(G.NotReadable):
        G.load(spark, str(tmp_path / "g"), {"csharp": "8"})
    spark.createDataFrame([("schema_version", "3"), ("state", "ready")], "key string, value string").write.mode("overwrite").parquet(str(tmp_path / "g/metadata"))
    with pytest.raises(G.NotReadable):
        G.load(spark, str(tmp_path / "g"))


def test_replace_projects_sweeps_edges(spark):
    a, b = letters(spark, "ab", "P"), letters(spark, "cd", "Q")
    g = G.Graph(spark.createDataFrame([("f", "P", "x", "cs"), ("h", "Q", "y", "cs")], "id string, project string, relative_path string, language string"), a.union(b), edges(spark, ("a", "c", "Calls", None), ("a", "d", "Calls", None), ("c", "a", "Calls", None)))
    fresh = G.Graph(g.files.where("project = 'Q'"), letters(spark, "c", "Q"), edges(spark, ("c", "b", "Calls", None)))
    got = incremental.replace_projects(g, fresh, spark.createDataFrame([], "project string"))
    assert {(r["source_id"], r["target_id"]) for r in got.edges.collect()} == {("a", "c"), ("c", "b")} and got.symbols.count() == 3


def test_replace_projects_without_symbols(spark):
    """A project whose files have lost their symbols is replaced all the same."""
    a, b = letters(spark, "ab", "P"), letters(spark, "c", "Q")
    files = spark.createDataFrame([("f", "P", "x", "cs"), ("h", "Q", "y", "cs")], "id string, project string, relative_path string, language string")
    g = G.Graph(files, a.union(b), edges(spark, ("a", "c", "Calls", None)))
    fresh = G.Graph(files.where("project = 'Q'"), b.limit(0), edges(spark, ("a", "c", "Calls", None)).limit(0))
    got = incremental.replace_projects(g, fresh, spark.createDataFrame([], "project string"))
    assert got.files.count() == 2 and {r["id"] for r in got.symbols.collect()} == {"a", "b"} and got.edges.count() == 0


def map_by_hand(ranked, targets, project, budget):
    """Lines of a map, one after the other, from (id, label) in order and the target labels of each."""
    lines, chars = [], 0

    def add(line):
        nonlocal chars
        more = len(line) + bool(lines)
        if lines and math.ceil(chars / 4) + math.ceil(more / 4) > budget:
            return False
        lines.append(line)
        chars += more
        return True

    for line in ("# CodeMap", f"project: {project}", f"symbols: {len(ranked)}", ""):
        add(line)
    for id_, label in ranked:
        if add(f"  {label}"):
            for t in targets.get(id_, []):
                if not add(f"    > {t}"):
                    break
    return lines


def test_map_budget(spark):
    e = edges(spark, ("a", "b", "Calls", None), ("a", "c", "Calls", None), ("b", "c", "Calls", None))
    lines = rank.build_map(letters(spark), e, 60)
    assert lines[:4] == ["# CodeMap", "project: P", f"symbols: {letters(spark).count()}", ""] and lines[4].startswith("  ")
    assert rank.build_map(letters(spark), e, 0) == ["# CodeMap"]
    # Twelve long names before a short one: none of them fits, the short one does.
    long = [(f"x{i}", f"{'L' * 200}{i}", 1) for i in range(12)] + [("y", "S", 0)]
    s = letters(spark, "a").limit(1).drop("id", "name", "qualified_name").crossJoin(spark.createDataFrame([(i, n) for i, n, _ in long], "id string, name string")).withColumn("qualified_name", F.when(F.col("id") == "y", "zz").otherwise(F.col("name"))).select(*letters(spark).columns)
    assert rank.build_map(s, e.limit(0), 20, batch=5) == ["# CodeMap", "project: P", "symbols: 13", "", "  S" if s.first()["kind"] != "Method" else "  S()"]


def test_map_query_by_hand(spark, sf):
    g = G.star_graph(spark, sf)
    label = lambda r: rank._map_line_label(r["name"], r["qualified_name"], r["kind"])
    ranked = [(r["id"], label(r)) for r in rank.map_scores(g.symbols.where("kind <> 'Namespace'"), g.edges).orderBy(*rank.map_order()).collect()]
    targets = {}
    for r in relations.top_targets(g.symbols, g.edges).orderBy("via_source", "rn").collect():
        targets.setdefault(r["via_source"], []).append(label(r))
    projects = {r["project"] for r in g.symbols.select("project").distinct().collect()}
    for budget, batch in ((400, 2000), (77, 3)):
        assert rank.build_map(g.symbols, g.edges, budget, batch=batch) == map_by_hand(ranked, targets, "multiple" if len(projects) > 1 else projects.pop(), budget)


def test_cycles_of_long_chains():
    chain = [(f"p{i:05}", f"p{i + 1:05}") for i in range(5000)]
    assert traverse.project_cycles(chain) == []
    found = traverse.project_cycles([*chain, ("p05000", "p00000"), ("p00002", "p00001")])
    assert len(found) == 2 and found[0] == "p00001 -> p00002 -> p00001" and found[1].count(" -> ") == 5001


def test_propagation_of_long_chains(spark):
    refs = spark.range(30).select(F.concat(F.lit("p"), F.col("id") + 1).alias("project"), F.concat(F.lit("p"), "id").alias("depends_on"))
    got = traverse.propagate(spark.createDataFrame([("p0",)], "project string"), refs, spark.createDataFrame([], "project string, before string, after string"))
    assert got.where("selected").count() == 31


def test_deletion_impact_reports_truncation(spark):
    e = edges(spark, *[(x, "a", "Calls", None) for x in "bcd"], ("a", "b", "Calls", None))
    s = letters(spark)
    path = s.where("id = 'a'").select(F.col("relative_path").alias("path"))
    got = traverse.deletion_impact(s, e, path, 2).collect()
    of = {}
    for r in got:
        of.setdefault(r["via_target"], []).append(r["truncated"])
    assert of["a"] == [True, True]


def test_unknown_checks_raise():
    from changelens.operators import evidence

    with pytest.raises(ValueError, match="unknown checks: lint"):
        evidence.profile_order(["test"], {"test": ["lint"]})


def test_exprs(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert one(X.trim_signature(lit("A.B(int)"))) == "A.B" and one(X.trim_signature(lit("(x)"))) == "(x)"
    assert one(X.last_name(lit("A.B+C/D(int)"))) == "D"
    assert one(X.symbol_matches(lit("A.B.C"), lit(None).cast("string"), lit("b.c"))) and not one(X.symbol_matches(lit("A.B.C"), lit("x"), lit("C")))
    assert one(X.heuristic_match(lit("X.LongEnough"), lit("Y.LongEnough"))) and not one(X.heuristic_match(lit("X.Short"), lit("Y.Short")))
    for glob, yes, no in (("src/**/*.cs", ["src/a.cs", "src/b/c/a.CS"], ["a.cs", "src/a.txt"]), ("*.md", ["x.md"], ["a/x.md"]), ("a?c", ["abc"], ["a/c", "ac"])):
        p = X.glob_regex(glob)
        assert all(one(lit(t).rlike(p)) for t in yes) and not any(one(lit(t).rlike(p)) for t in no)
    assert one(X.redact(lit("password=abc Bearer x.y token=1"))) == "password=*** Bearer *** token=***"
    assert one(X.diagram_text(lit('a["b"]|c'))) == "a__b___c" and one(X.run_stamp(lit("nonsense"))) is None


def test_plans_push_down_and_avoid_python(spark, sf):
    g = G.star_graph(spark, sf)
    plan = relations.callers(g.symbols, g.edges, spark.createDataFrame([("s:1",)], "target_id string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey = 5").select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "PushedFilters" in plan


def _stored(spark, sf, tmp_path):
    g = G.star_graph(spark, sf)
    G.save(g, str(tmp_path / "g"))
    return g, G.load(spark, str(tmp_path / "g"))


def test_stored_adjacency_reads_the_folders_of_a_frontier(spark, sf, tmp_path):
    g, got = _stored(spark, sf, tmp_path)
    assert G.Graph(g.files, got.symbols, got.edges).forward.schema["bucket"].metadata == {"key": "target_id", "buckets": 16}
    one = traverse.single_root(got.symbols, "s:1")
    near = G.holding(got.edges.where("kind = 'Calls'"), "target_id", one, "root_id")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(bucket" in plan and "GreaterThanOrEqual(target_id,s:1)" in plan
    assert {r["target_id"] for r in near.select("target_id").distinct().collect()} == {"s:1"}
    assert rows(near.drop("bucket")) == rows(g.edges.where("kind = 'Calls' and target_id = 's:1'"))
    assert G.holding(got.edges, "source_id", one, "root_id") is got.edges and G.holding(g.edges, "target_id", one, "root_id") is g.edges
    assert G.holding(got.edges, "target_id", one.limit(0), "root_id").count() == 0
    for depth in (1, 3):
        assert rows(traverse.impact(got.symbols, got.edges, one, depth)) == rows(traverse.impact(g.symbols, g.edges, one, depth))
    assert rows(traverse.callees(got.symbols, got.forward, "c:1", 3)) == rows(traverse.callees(g.symbols, g.edges, "c:1", 3))
    # Either order of the edges gives the same rows, and so do edges that came after the graph was stored.
    assert rows(traverse.callees(got.symbols, got.edges, "c:1", 2)) == rows(traverse.callees(g.symbols, g.edges, "c:1", 2))
    more = edges(spark, ("c:5", "s:1", "Calls", None))
    assert rows(traverse.impact(got.symbols, got.edges.unionByName(more, allowMissingColumns=True), one, 2)) == rows(traverse.impact(g.symbols, g.edges.unionByName(more), one, 2))
    assert traverse.impact(got.symbols, got.edges, one.limit(0), 2).count() == 0


def test_stored_graph_may_be_empty_and_stored_again(spark, tmp_path):
    s = letters(spark)
    g = G.Graph(s.select(F.col("file_id").alias("id"), "project", "relative_path", "language"), s, edges(spark, ("a", "b", "Calls", None)).limit(0))
    G.save(g, str(tmp_path / "g"))
    got = G.load(spark, str(tmp_path / "g"))
    assert got.edges.count() == 0 and got.symbols.count() == s.count()
    assert traverse.callees(got.symbols, got.forward, "a", 2).count() == 0
    G.save(got, str(tmp_path / "h"), buckets=3)
    again = G.load(spark, str(tmp_path / "h"))
    assert rows(again.symbols.drop("bucket")) == rows(s) and again.symbols.schema["bucket"].metadata["buckets"] == 3


def test_a_root_stops_where_its_nearest_rows_are_complete(spark):
    s = letters(spark, "abcd")
    e = edges(spark, ("b", "a", "Calls", None), ("c", "b", "Calls", None), ("d", "c", "Calls", None))
    roots = spark.createDataFrame([("a",)], "root_id string")
    for returns in (True, False):
        got = {n: sorted(r["id"] for r in traverse.impact(s, e, roots, 3, root_returns=returns, per_root=n).collect()) for n in (1, 2, 3)}
        assert got == {1: ["b"], 2: ["b", "c"], 3: ["b", "c", "d"]}


def test_find_on_a_stored_graph(spark, sf, tmp_path):
    g, got = _stored(spark, sf, tmp_path)
    name = g.symbols.where("kind = 'Class'").orderBy("id").first()
    for q in ("er#", "SUPPLIER#000000001", "s:1", "c:12", "Customer.", "er", "#", "zzzz", "0000000", name["name"], name["qualified_name"].upper(), "a%b", "Customer.Customer#000000007()"):
        assert rows(lookup.find_stored(got, q)) == rows(lookup.find(g.symbols, q)), q
    assert rows(lookup.find_stored(g, "er#")) == rows(lookup.find(g.symbols, "er#"))
    near = got.postings.where(F.col("gram").isin(["er#"]))
    assert "In(gram" in near._jdf.queryExecution().executedPlan().toString() or "EqualTo(gram,er#)" in near._jdf.queryExecution().executedPlan().toString()
