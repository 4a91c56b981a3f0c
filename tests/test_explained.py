"""What is shown of links is made for each class, and members of a class are sent to a bounded number of parts."""

from pyspark.sql import functions as F

from changelens.operators import binding, relations
from tests.conftest import rows


def some(spark):
    o = [(f"o{i}", "P", "StaticAnalysis", f"p{i % 3}", f"p{i % 3}", None, True) for i in range(9)] + [("u", "P", "Uncertainty", "p0", "p0", None, True), ("t", "P", "Test", "x.y", "p0", None, True)]
    e = [(f"e{i}", "StaticAnalysis", "Pass", "c", f"p{i % 2}", ["all.sln", "x.csproj"][i % 2], "now", None, None) for i in range(6)]
    obligations = spark.createDataFrame(o, "id string, rule_id string, kind string, subject_id string, subject_project string, subject_display string, required boolean")
    evidence = spark.createDataFrame(e, "id string, kind string, status string, check_id string, subject string, target string, source_digest string, refs array<struct<id:string,project:string,name:string>>, subjects array<string>")
    return obligations, evidence


def listed(links):
    ids = F.transform(F.coalesce(links, F.array()), lambda v: v["evidence_id"])
    return [F.size(ids).alias("n"), F.array_join(F.array_sort(ids), ",").alias("ids")]


def test_shown_by_class_and_by_pair(spark):
    o, e = some(spark)
    by_class, by_pair = (relations.explain(o, x, e, listed) for x in (binding.bound(o, e, "now"), binding.bind(o, e, "now")))
    assert rows(by_class) == rows(by_pair) and by_class.count() == 11
    got = {r["id"]: (r["n"], r["ids"]) for r in by_class.collect()}
    assert got["u"] == got["t"] == (0, "") and got["o0"] == (3, "e0,e2,e4") and got["o1"][0] == 6


def test_lists_are_sorted_below_the_obligations(spark):
    o, e = some(spark)
    plan = relations.explain(o, binding.bound(o, e, "now"), e, listed)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(plan) if "Join Inner" in x and "o_part" in x]
    sorts = [i for i, x in enumerate(plan) if "array_sort" in x or "sort_array" in x]
    assert joins and sorts and min(i for i in sorts if i > joins[0]) and not any(i < joins[0] for i in sorts)


def test_parts_of_a_class_are_bounded(spark):
    members = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit("c").alias("of"))
    one = spark.createDataFrame([("c",)], "of string")
    assert binding.in_parts(one, members, "of", "part").count() == 64 and binding.in_parts(one, members.limit(350), "of", "part").count() == 4
    dealt = binding.dealt(members, "k", "of", "part")
    assert dealt.count() == 20_000 and dealt.select("part").distinct().count() == 64
