"""What keeps work in proportion to the input: where joins stand, and what is written."""

import os

from pyspark.sql import functions as F

from changelens.functions.storage import shared_path
from changelens.operators import relations, traverse
from changelens.sources import graph as G


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def below(lines, what):
    """The lines below the first one that holds ``what``."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    first = next(i for i, line in enumerate(lines) if what in line)
    end = next((i for i in range(first + 1, len(lines)) if depth(lines[i]) <= depth(lines[first])), len(lines))
    return lines[first + 1 : end]


def test_edges_at_ids_are_chosen_below_the_product(spark, sf):
    g = G.star_graph(spark, sf)
    ids = spark.createDataFrame([("c:1",), ("s:1",)], "id string")
    for end in ("source_id", "target_id"):
        edges = relations.di_narrowed(g.edges.where("kind in ('Calls', 'ImplementedBy')"), g.di)
        one = G.touching(edges, end, ids, "id")
        assert any("LeftSemi" in line for line in below(optimized(one), "(nation"))
        assert sorted(one.collect()) == sorted(edges.where(F.col(end).isin("c:1", "s:1")).collect())


def test_a_walk_writes_no_edges_and_not_its_last_level(spark, sf):
    g = G.star_graph(spark, sf)
    held = os.path.dirname(shared_path(spark))
    before = set(os.listdir(held)) if os.path.isdir(held) else set()
    roots = g.symbols.where("kind = 'Interface'").select(F.col("id").alias("root_id"))
    two = traverse.impact(g.symbols, g.edges, roots, 2)
    assert len(set(os.listdir(held)) - before) == 1
    assert two.groupBy("depth").count().count() == 2


def test_links_of_a_large_class_are_made_in_parts(spark):
    from changelens.operators import binding

    n = 2000
    ids = spark.range(n)
    nothing = lambda t: F.lit(None).cast(t)
    o = ids.select(F.concat(F.lit("o"), "id").alias("id"), F.lit("P").alias("rule_id"), F.lit("StaticAnalysis").alias("kind"), F.lit("A").alias("subject_id"), F.lit("A").alias("subject_project"), nothing("string").alias("subject_display"), F.lit(True).alias("required"))
    target = F.when(F.col("id") % 2 == 0, "all.sln").otherwise("x.csproj")
    e = ids.where("id < 400").select(F.concat(F.lit("e"), "id").alias("id"), F.lit("StaticAnalysis").alias("kind"), F.lit("Pass").alias("status"), F.lit("c").alias("check_id"), F.when(F.col("id") < 300, "A").otherwise("B").alias("subject"), target.alias("target"), F.lit("now").alias("source_digest"), nothing("array<struct<id:string,project:string,name:string>>").alias("refs"), nothing("array<string>").alias("subjects"))
    bound = binding.bound(o, e, "now")
    pairs = bound.expanded()
    assert pairs.count() == pairs.select("obligation_id", "evidence_id").distinct().count() == n * 350
    spread = pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < n * 350 * 0.7
    uncertain = o.limit(1).withColumn("id", F.lit("u")).withColumn("kind", F.lit("Uncertainty"))
    o2 = o.where("id in ('o0', 'o1')").unionByName(uncertain)
    byclass, bypairs = (relations.explain(o2, x, e).orderBy("id").collect() for x in (binding.bound(o2, e, "now"), binding.bind(o2, e, "now")))
    assert byclass == bypairs and byclass[-1]["links"] is None and len(byclass[0]["links"]) == 350


def test_lines_meet_merged_hunks_once(spark):
    from changelens.operators import diagnostics

    # Each hunk 500 times, as a table of many changes has them; some overlap, touch, are empty, or span bins.
    base = [("f", 5, 3), ("f", 7, 4), ("f", 11, 0), ("f", 20, None), ("f", 1000, 1100), ("g", 5, 1), (None, 5, 9), ("g", None, 2)]
    hunks = spark.createDataFrame(base * 500, "key string, new_start int, new_length int")
    points = spark.createDataFrame([(k, x) for k in ("f", "g", "h", None) for x in (None, -1, 0, 4, 5, 6, 7, 10, 11, 12, 20, 21, 999, 1000, 1023, 1024, 2047, 2048, 2099, 2100)], "key string, line int")
    want = {(k, x) for k, x in ((r["key"], r["line"]) for r in points.collect()) if k and x is not None for f, s, n in base if f == k and s is not None and s <= x < s + max(n or 0, 1)}
    got = diagnostics.struck(points, hunks)
    assert sorted((r["key"], r["line"]) for r in got.collect()) == sorted(want)
    assert diagnostics.islands(hunks).count() == 4


def test_bundles_are_stored_unexpanded(spark, sf, tmp_path):
    g = G.star_graph(spark, sf)
    G.save(g, str(tmp_path / "g"))
    got = G.load(spark, str(tmp_path / "g"))
    n, product = g.edges.count(), g.bundles.expanded().count()
    held = [spark.read.parquet(str(tmp_path / "g" / t)).count() for t in ("edges", "edges_by_source")]
    assert product > 0 and held == [n - product] * 2
    assert got.edges.count() == got.forward.count() == got.edge_count().first()[0] == g.edge_count().first()[0] == n
    assert sorted(map(repr, got.forward.select(*G.EDGE).collect())) == sorted(map(repr, g.edges.select(*G.EDGE).collect()))
    assert got.edges.schema["bucket"].metadata["key"] == "target_id" and got.forward.schema["bucket"].metadata["key"] == "source_id"


def test_bundles_are_counted_and_ranked_unexpanded(spark, sf):
    from changelens.operators import rank

    g = G.star_graph(spark, sf)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for spelt, bundled in (
        (rank.map_scores(g.symbols, g.edges), rank.map_scores(g.symbols, g.single, bundles=g.bundles)),
        (relations.top_targets(g.symbols, g.edges), relations.top_targets(g.symbols, g.single, bundles=g.bundles)),
        (relations.project_pairs(g.symbols, g.edges), relations.project_pairs(g.symbols, g.single, g.bundles)),
    ):
        assert same(spelt, bundled) and spelt.columns == bundled.columns
    assert rank.build_map(g.symbols, g.edges, 120, batch=7) == rank.build_map(g.symbols, g.single, 120, batch=7, bundles=g.bundles)


def test_rounds_of_cycles_pass_nothing_through_the_driver(spark, monkeypatch):
    from changelens.operators import cycles

    plans, keep = [], cycles.kept

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(cycles, "kept", kept)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("e", "g")], "a string, b string")
    got = cycles.cycles(edges)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == [("a", 3, "a -> b -> c -> a"), ("d", 2, "d -> e -> d"), ("f", 1, "f -> f")]
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_groups_of_uses_are_hashed_and_know_any_flag(spark, sf):
    lines = spark.createDataFrame([(1, 2, f, 1, 0.0, 0.1) for f in ("R", "N")] + [(1, 3, f, 2, 0.5, 0.2) for f in ("B", "N")] + [(1, 4, f, 3, 0.5, 0.2) for f in ("A", "Z", None)] + [(2, 4, None, 3, 0.5, 0.2)], "l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int, l_tax double, l_discount double")
    uses = G._uses(lines, ("p:", "l_partkey"), ("s:", "l_suppkey"))
    # The least flag decides: B is before N and neither of the two that count.
    assert {(r["source_id"], r["target_id"]): r["rf"] for r in uses.collect()} == {("p:1", "s:2"): "N", ("p:1", "s:3"): "other", ("p:1", "s:4"): "A", ("p:2", "s:4"): None}
    plan = G.star_graph(spark, sf).single._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_deletions_take_the_first_callers_of_a_bundle_only(spark, sf):
    g = G.star_graph(spark, sf)
    deleted = spark.createDataFrame([("NATION_5.cs",), ("nation_7.cs",)], "path string")
    few = relations.first_callers(g.symbols, g.bundles, 1)
    assert few.sources.groupBy(*few.keys).count().where("count > 1").isEmpty()
    for n in (1, 2, 5):
        spelt = traverse.deletion_impact(g.symbols, g.edges, deleted, n)
        held = traverse.deletion_impact(g.symbols, g.single, deleted, n, g.bundles)
        assert sorted(map(str, held.collect())) == sorted(map(str, spelt.collect()))


def test_suggestions_shuffle_no_pairs(spark):
    from changelens.operators import binding

    names = [("b1", "Alpha.Alpha1", "a.cs"), ("b2", "Alpha.Beta", None), ("b3", " .abc", "A.cs"), ("b3", " .abc", "A.cs"), ("b4", "Gamma", " ")]
    tests = [("Alpha.Alpha1.Checks", "x.cs"), ("Alpha.Alpha1.Checks", "a.cs"), ("My.Betas", "b.cs"), ("T", "A.CS"), ("Other", None)]
    hit = binding.suggest_maps(spark.createDataFrame(names, "id string, display string, file string"), spark.createDataFrame(tests, "display string, file string"))
    expected = [("b1", "Alpha.Alpha1.Checks"), ("b1", "T"), ("b2", "Alpha.Alpha1.Checks"), ("b2", "My.Betas"), ("b3", "Alpha.Alpha1.Checks"), ("b3", "T")]
    assert sorted(map(tuple, hit.collect())) == expected
    assert "Aggregate [id" not in "\n".join(optimized(hit))


def one_bundle(spark, sf, path, suppliers, customers):
    """The small tables with so many suppliers and customers more, all of one nation and digit; returns the folder."""
    for t in G.BASE_TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        n, key, nation = {"supplier": (suppliers, "s_suppkey", "s_nationkey"), "customer": (customers, "c_custkey", "c_nationkey")}.get(t, (0, None, None))
        if n:
            first, kind = df.limit(1), dict(df.dtypes)
            more = first.crossJoin(spark.range(n).withColumnRenamed("id", "i")).withColumn(key, (F.col("i") * 10 + 1_000_001).cast(kind[key])).withColumn(nation, F.lit(3).cast(kind[nation])).drop("i")
            df = df.unionByName(more)
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_all_edges_of_a_large_bundle_are_made_in_blocks(spark, sf, tmp_path, monkeypatch):
    from changelens import plans

    for name, n in (("BLOCK_SOURCES", 50), ("BLOCK_TARGETS", 20), ("TASK_EDGES", 2000)):
        monkeypatch.setattr(G, name, n, raising=False)
    large = one_bundle(spark, sf, tmp_path, 200, 500)
    got = plans.queries()["f22_confidence"](spark, large).where("source_id like 's:1%' and target_id like 'c:1%' and length(source_id) = 9 and length(target_id) = 9")
    spread = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(spread) == got.distinct().count() == 200 * 500
    assert len(spread) > 20 and max(spread) <= 15_000
    g = G.star_graph(spark, large)
    assert sorted(map(repr, g.bundles.in_blocks().collect())) == sorted(map(repr, g.bundles.expanded().collect()))


def test_replaced_projects_keep_bundles_unexpanded_and_edges_once(spark, sf):
    from changelens.operators import incremental

    f = spark.createDataFrame([("A",), ("B",), ("C",)], "project string")
    sym = lambda rows: spark.createDataFrame(rows, "id string, project string")
    src = lambda rows: spark.createDataFrame(rows, "k int, source_id string, kind string, line int, resolution_kind string, confidence double")
    tgt = lambda rows: spark.createDataFrame(rows, "k int, target_id string")
    one = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string, kind string, line int, resolution_kind string, confidence double, source_file_id string")
    call = ("Calls", 1, "semantic", None)
    # s1 stands in two bundles that share t1; s2 twice in one; s3 has no line; gone is of a project that is replaced; t9 is no symbol.
    b = G.Bundles(src([(1, "s1", *call), (2, "s1", *call), (1, "s2", *call), (1, "s2", *call), (1, "s3", "Calls", None, "semantic", None), (1, "gone", *call), (2, "s4", "Uses", 2, "semantic", None)]), tgt([(1, "t1"), (1, "t2"), (1, "t2"), (2, "t1"), (2, "t3"), (1, "t9")]), ["k"])
    single = one([("s2", "t1", *call, None), ("s2", "t1", *call, "f"), ("s3", "t2", "Calls", None, "x", 0.5, None), ("s4", "t2", *call, None), ("s4", "t2", *call, None), ("s1", "t3", *call, None)])
    old = G.Graph.of(f, sym([(i, "A") for i in ("s1", "s2", "s3", "s4", "t1", "t2", "t3")] + [("gone", "B")]), single, b)
    # The fresh project calls as before, and s2 comes with it once more, to another target too.
    fb = G.Bundles(src([(1, "new", *call), (1, "s2", *call)]), tgt([(1, "t1"), (1, "t3")]), ["k"])
    fresh = G.Graph.of(f.where("project = 'B'"), sym([("new", "B")]), one([("new", "t1", *call, None)]), fb)
    spelt = lambda g: G.Graph(g.files, g.symbols, g.edges)
    removed = f.where("project = 'C'")
    key = ["source_id", "target_id", "kind", "line", "source_file_id"]
    got, want = incremental.replace_projects(old, fresh, removed), incremental.replace_projects(spelt(old), spelt(fresh), removed)
    for edges in (got.edges, got.whole().withColumn("source_file_id", F.lit(None).cast("string"))):
        seen, due = ([sorted(map(str, df.select(*key[: 4 if edges is not got.edges else 5]).collect())) for df in (edges, want.edges)])
        assert seen == due
    other = G.Graph.of(fresh.files, fresh.symbols, fresh.single, G.Bundles(fb.sources.withColumnRenamed("k", "j"), fb.targets.withColumnRenamed("k", "j"), ["j"]))
    assert sorted(map(str, incremental.replace_projects(old, other, removed).edges.select(*key).collect())) == sorted(map(str, want.edges.select(*key).collect()))
    assert ("gone" not in {r["source_id"] for r in got.edges.collect()}) and not got.bundles.sources.where("source_id = 'new'").isEmpty()


def test_replaced_projects_shuffle_no_edges_of_bundles(spark, sf, tmp_path):
    from changelens import plans

    store, double = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, double, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    large = one_bundle(spark, sf, tmp_path, 500, 1000)
    before = shuffled()
    q = plans.queries()["s05_replace_projects"](spark, large)
    n = q.groupBy("kind").count().where("kind = 'Calls'").first()["count"]
    assert n >= 500 * 1000 and shuffled() - before < n / 2
