"""Architecture rules and public surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.exprs import STRUCTURAL_KINDS, is_test
from changelens.operators.traverse import project_cycles
from changelens.sources.graph import Bundles, touching

LAYER_KINDS = ["UsesType", "Calls", "Imports", "Inherits"]
ENTRY = ["kind", "qualified_name", "signature"]


def repository_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.col("project").startswith("external:"))


def layer_of(layers: list[str]) -> Column:
    """The first layer whose name the project or path contains."""
    out = F.lit(None).cast("string")
    for layer in reversed(layers):
        n = layer.lower()
        out = F.when(F.lower("project").contains(n) | F.lower("relative_path").contains(n), layer).otherwise(out)
    return out


def layer_violations(symbols: DataFrame, edges: DataFrame, layers: list[str], forbid: list[tuple[str, str]], bundles: Bundles | None = None) -> DataFrame:
    """C-01: source, target, kind and layers of edges between forbidden layers (a short list of rules); ``bundles`` are edges beside ``edges``, of which sides in other layers do not meet."""
    s = repository_symbols(symbols).select("id", "qualified_name", layer_of(layers).alias("layer")).where("layer is not null")
    columns = ["source_id", "target_id", "kind"]
    e = edges.where(F.col("kind").isin(*LAYER_KINDS)).select(*columns)
    src = s.select(F.col("id").alias("source_id"), F.col("layer").alias("from_layer"), F.col("qualified_name").alias("source_name"))
    dst = s.select(F.col("id").alias("target_id"), F.col("layer").alias("to_layer"), F.col("qualified_name").alias("target_name"))
    bad = F.lit(False)
    for a, b in forbid:
        bad = bad | ((F.lower("from_layer") == a.lower()) & (F.lower("to_layer") == b.lower()))
    # Edges with both ends in layers that some rule names, before they meet the symbols.
    named = lambda end, which: end.where(F.lower(which).isin([r[which == "to_layer"].lower() for r in forbid]))
    at_source = lambda df: touching(df, "source_id", named(src, "from_layer"), "source_id")
    at_target = lambda df: touching(df, "target_id", named(dst, "to_layer"), "target_id")
    e = at_target(at_source(e))
    if bundles is not None:
        sides = at_source(bundles.sources.where(F.col("kind").isin(*LAYER_KINDS))), at_target(bundles.targets)
        # Bundles that lead from a layer to one that it must not reference; of the others no edge is made.
        a = sides[0].join(src, "source_id").select(*bundles.keys, "from_layer").distinct()
        b = sides[1].join(dst, "target_id").select(*bundles.keys, "to_layer").distinct()
        there = a.join(b, bundles.keys).where(bad).select(*bundles.keys).distinct()
        left = Bundles(*[df.join(there, bundles.keys, "left_semi") for df in sides], bundles.keys)
        e = e.unionByName(left.expanded().select(*columns))
    return e.join(src, "source_id").join(dst, "target_id").where(bad).select("source_id", "target_id", "kind", "from_layer", "to_layer")


def fan_violations(symbols: DataFrame, edges: DataFrame, most_in: int = 40, most_out: int = 40, bundles: Bundles | None = None) -> DataFrame:
    """C-02: rule (fan-in, fan-out), symbol and count beyond the maximum; of ``bundles``, edges beside ``edges``, one side is counted for the other."""

    def beyond(end: str, other: str, most: int, rule: str) -> DataFrame:
        n = F.count(F.lit(1)).alias("n")
        each = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS)).groupBy(F.col(end).alias("id")).agg(n)
        if bundles is not None:
            sides = {"source_id": bundles.sources.where(~F.col("kind").isin(*STRUCTURAL_KINDS)), "target_id": bundles.targets}
            counted = sides[end].select(*bundles.keys, F.col(end).alias("id")).join(sides[other].groupBy(*bundles.keys).agg(n), bundles.keys)
            each = each.unionByName(counted.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
        return each.where(F.col("n") > most).withColumn("rule", F.lit(rule))

    incoming, outgoing = beyond("target_id", "source_id", most_in, "fan-in"), beyond("source_id", "target_id", most_out, "fan-out")
    return repository_symbols(symbols).select("id", "qualified_name").join(incoming.unionByName(outgoing), "id").select("rule", "id", "qualified_name", "n")


def orphans(symbols: DataFrame, edges: DataFrame, bundles: Bundles | None = None) -> DataFrame:
    """C-03: public types and methods outside of tests that nothing but structure points at; of ``bundles``, edges beside ``edges``, a target needs a bundle with any source."""
    hit = repository_symbols(symbols).where((F.lower("visibility") == "public") & F.col("kind").isin("Class", "Interface", "Method") & ~is_test())
    inbound = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS)).select(F.col("target_id").alias("id"))
    if bundles is not None:
        some = bundles.sources.where(~F.col("kind").isin(*STRUCTURAL_KINDS)).select(*bundles.keys).distinct()
        inbound = inbound.unionByName(bundles.targets.join(some, bundles.keys, "left_semi").select(F.col("target_id").alias("id")))
    return hit.join(inbound, "id", "left_anti").select("id", "qualified_name", "kind")


def check(symbols: DataFrame, edges: DataFrame, rules: dict | None, references: list[tuple[str, str]] | None, bundles: Bundles | None = None) -> DataFrame | None:
    """C-05: all violations as (rule, subject, object, message); null when rules or project references are missing. ``bundles`` are edges beside ``edges``."""
    if rules is None or references is None:
        return None
    spark = symbols.sparkSession
    lay = layer_violations(symbols, edges, rules.get("layers", []), rules.get("forbid", []), bundles)
    out = lay.select(F.lit("layer").alias("rule"), F.col("source_id").alias("subject"), F.col("target_id").alias("object"), F.concat("from_layer", F.lit(" must not reference "), "to_layer").alias("message"))
    fan = fan_violations(symbols, edges, rules.get("max_fan_in", 40), rules.get("max_fan_out", 40), bundles)
    out = out.unionByName(fan.select("rule", F.col("id").alias("subject"), F.lit(None).cast("string").alias("object"), F.concat("qualified_name", F.lit(": "), "n").alias("message")))
    orph = orphans(symbols, edges, bundles)
    out = out.unionByName(orph.select(F.lit("orphan").alias("rule"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("object"), F.col("qualified_name").alias("message")))
    cycles = [("cycle", c.split(" -> ")[0], None, c) for c in project_cycles(references)]
    return out.unionByName(spark.createDataFrame(cycles, "rule string, subject string, object string, message string"))


def surface(symbols: DataFrame) -> DataFrame:
    """C-06: project, fingerprint and size of the public surface: the hash of its sorted, distinct entries."""
    public = symbols.where((F.lower("visibility") == "public") & ~F.col("kind").isin("File", "Namespace"))
    entry = F.concat_ws("|", "kind", "qualified_name", F.coalesce("signature", F.lit("")))
    return public.select("project", entry.alias("entry")).distinct().groupBy("project").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("entry")), "\n").cast("binary"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("entries")
    )


def surface_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """C-07: project, kind, qualified_name, signature, change (added, removed, modified) between two surfaces (project, kind, qualified_name, signature).

    A member with one overload on each side and another signature is modified; otherwise overloads are told apart by signature.
    """
    keys = ["project", "kind", "qualified_name"]
    one = lambda df: df.select(*keys, F.coalesce("signature", F.lit("")).alias("signature")).distinct()
    b, a = one(before).withColumn("b", F.lit(1)), one(after).withColumn("a", F.lit(1))
    both = b.join(a, [*keys, "signature"], "full")
    n = both.groupBy(*keys).agg(F.count("b").alias("nb"), F.count("a").alias("na"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("common"))
    rows = both.where("a is null or b is null").join(n, keys)
    single = (F.col("nb") == 1) & (F.col("na") == 1) & (F.col("common") == 0)
    change = F.when(single, F.when(F.col("a") == 1, "modified")).when(F.col("a") == 1, "added").otherwise("removed")
    return rows.withColumn("change", change).where("change is not null").select(*keys, "signature", "change")


def surface_verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """C-08, V-21: for each project the kind of its change, and whether it passes."""
    d = surface_diff(before, after).groupBy("project").agg(F.count(F.when(F.col("change") == "added", 1)).alias("added"), F.count(F.when(F.col("change") == "removed", 1)).alias("removed"), F.count(F.when(F.col("change") == "modified", 1)).alias("modified"))
    known = before.select("project").distinct().withColumn("b", F.lit(1)).join(after.select("project").distinct().withColumn("a", F.lit(1)), "project", "full").join(d, "project", "left").fillna(0, ["added", "removed", "modified"])
    breaking, additive = (F.col("removed") + F.col("modified")) > 0, F.col("added") > 0
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "Inconclusive").when(breaking & additive, "Mixed").when(breaking, "Breaking").when(additive, "Additive").otherwise("Unchanged")
    status = F.when(F.col("change").isin("Unchanged", "Additive"), "Pass").when(F.col("change").isin("Breaking", "Mixed"), "Fail").otherwise("Inconclusive")
    return known.withColumn("change", kind).select("project", "added", "removed", "modified", "change", status.alias("status"))
