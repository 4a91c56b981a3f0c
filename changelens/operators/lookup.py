"""Lookups and filters over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.exprs import CALLABLE_KINDS, display_name, path_key, project_path_key, same_text, slashes
from changelens.functions.storage import kept
from changelens.sources.graph import GRAM, SYMBOL, Graph, grams_of, holding


def name_order() -> list[Column]:
    return [F.col("project"), F.col("qualified_name"), F.coalesce(F.col("signature"), F.lit("")), F.col("id")]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """L-16: the rows of one page in order, with ``has_more``."""
    n = Window.orderBy(*order)
    taken = rows.orderBy(*order).limit(offset + limit + 1).withColumn("rn", F.row_number().over(n))
    more = taken.withColumn("has_more", F.max("rn").over(Window.partitionBy()) > offset + limit)
    return more.where((F.col("rn") > offset) & (F.col("rn") <= offset + limit)).drop("rn")


def find(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """L-01..L-05: exact, else prefix, else contained names, ranked; one scan scores all tiers.

    The first tier with a match counts; inside of it the best hundred of scores, external projects last.
    """
    q = query.lower()
    full, shown, name = F.lower("qualified_name"), F.lower(display_name()), F.lower("name")
    tier = F.when((F.col("id") == query) | (name == q) | (full == q), 3).when(full.startswith(q), 2).when(full.contains(q), 1)
    score = (
        F.when((full == q) | (shown == q) | (F.lower("id") == q), 1000)
        .when(name == q, 900)
        .when(full.startswith(q) | shown.startswith(q), 700)
        .otherwise(500)
    )
    hits = symbols.select(*SYMBOL, tier.alias("tier"), score.alias("score")).where("tier is not null")
    hits = hits.withColumn("century", F.expr("score div 100"))
    best = hits.agg(F.max(F.struct("tier", "century")).alias("m")).select(F.col("m.tier").alias("t"), F.col("m.century").alias("c"))
    kept = hits.join(F.broadcast(best), (F.col("tier") == F.col("t")) & (F.col("century") == F.col("c")))  # one row
    external = F.col("project").startswith("external:")
    order = [F.desc("score"), external, F.col("qualified_name"), F.coalesce(F.col("signature"), F.lit("")), F.col("id")]
    return kept.orderBy(*order).limit(max(1, limit)).select(*SYMBOL, "score")


def find_stored(graph: Graph, query: str, limit: int = 20, lists: int = 4) -> DataFrame:
    """L-04: ``find`` on a stored graph, by the postings of the query's rarest ``lists`` grams.

    Ids that stand in all of these postings, and the query as an id, are read from
    the symbols and ranked by ``find``, which tests the whole query again. Queries
    of less than three characters have no gram and read all symbols.
    """
    text = query.lower()
    if graph.postings is None or len(text) < GRAM:
        return find(graph.symbols, query, limit)
    spark = graph.symbols.sparkSession
    grams = [r["gram"] for r in spark.range(1).select(F.explode(grams_of(F.lit(text))).alias("gram")).collect()]  # of the query
    counts = {r["gram"]: r["n"] for r in graph.grams.where(F.col("gram").isin(grams)).collect()}
    chosen = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:lists]
    ids = graph.postings.where(F.col("gram").isin(chosen)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("id")
    ids = kept(ids.unionByName(spark.range(1).select(F.lit(query).alias("id"))).distinct())
    return find(by_ids(holding(graph.symbols, "id", ids, "id"), ids), query, limit)


def by_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """L-06: symbols with an id of ``ids`` (id); unknown ids give nothing."""
    return symbols.join(ids.select("id").distinct(), "id", "left_semi").select(*SYMBOL)


def files_in_order(files: DataFrame) -> DataFrame:
    """L-07"""
    return files.select("id", "project", "relative_path", "language").orderBy("project", "relative_path")


def exact_matches(symbols: DataFrame, query: str, callable_only: bool = False) -> DataFrame:
    q = F.lit(query)
    full = F.concat(F.col("qualified_name"), F.coalesce(F.col("signature"), F.lit("")))
    hit = (F.col("id") == q) | same_text(F.col("name"), q) | same_text(F.col("qualified_name"), q) | same_text(full, q) | same_text(display_name(), q)
    return symbols.where(hit & (F.col("kind").isin(*CALLABLE_KINDS) if callable_only else F.lit(True))).select(*SYMBOL)


def prefer_source(matches: DataFrame, query: str) -> DataFrame:
    """L-09: source symbols hide external ones, unless the query is an id among the matches."""
    everywhere = Window.partitionBy()
    external = F.col("project").startswith("external:")
    by_id = F.max(F.col("id") == query).over(everywhere)
    source = F.max(~external).over(everywhere)
    return matches.withColumn("keep", by_id | ~source | ~external).where("keep").drop("keep")


def resolve(symbols: DataFrame, query: str, callable_only: bool = False, limit: int = 20) -> DataFrame:
    """L-08, L-10: symbols that a query names, with ``ambiguous``. Without an exact match, those that ``find`` ranks."""
    exact = prefer_source(exact_matches(symbols, query, callable_only), query)
    pool = symbols.where(F.col("kind").isin(*CALLABLE_KINDS)) if callable_only else symbols
    found = find(pool, query, limit).drop("score")
    n = exact.agg(F.count(F.lit(1)).alias("n_exact"))
    both = exact.withColumn("src", F.lit(0)).unionByName(found.withColumn("src", F.lit(1))).join(F.broadcast(n))  # one row
    kept = both.where((F.col("src") == 0) | (F.col("n_exact") == 0))
    kept = kept.orderBy("qualified_name", F.coalesce("signature", F.lit("")), "id").limit(limit)
    return kept.select(*SYMBOL, (F.count(F.lit(1)).over(Window.partitionBy()) > 1).alias("ambiguous"))


def in_files(symbols: DataFrame, paths: DataFrame, limit: int | None = 500) -> DataFrame:
    """L-11: symbols of the files that ``paths`` (path) names, by path or project and path, without regard to case."""
    want = paths.select(path_key("path").alias("want")).distinct()
    keyed = symbols.where(~F.col("kind").isin("File", "Namespace")).withColumn("want", F.explode(F.array(path_key("relative_path"), project_path_key("project", "relative_path"))))
    hit = keyed.join(want, "want", "left_semi").select(*SYMBOL).distinct()
    return hit if limit is None else hit.orderBy("qualified_name", "id").limit(limit)


def public_symbols(symbols: DataFrame, limit: int = 100_000) -> DataFrame:
    """L-12"""
    hit = symbols.where((F.lower("visibility") == "public") & ~F.col("kind").isin("File", "Namespace"))
    return hit.select(*SYMBOL).orderBy("project", "qualified_name", "id").limit(limit)


def intersecting(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """L-13: symbols whose lines overlap the spans (span_id, path, start, end) of their file.

    An equi-join on the file key, then the overlap. A span that meets symbols of two files gives nothing.
    """
    s = symbols.where(~F.col("kind").isin("File", "Namespace") & F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    s = s.withColumn("key", F.explode(F.array_distinct(F.array(path_key("relative_path"), project_path_key("project", "relative_path")))))
    p = spans.select("span_id", path_key("path").alias("key"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    hit = s.join(p, "key").where((F.col("start_line") <= F.col("span_end")) & (F.col("end_line") >= F.col("span_start")))
    hit = hit.select("span_id", *SYMBOL).distinct()
    one = hit.groupBy("span_id").agg(F.min(F.struct("project", slashes("relative_path"))).alias("a"), F.max(F.struct("project", slashes("relative_path"))).alias("b"))
    return hit.join(one.where("a = b").select("span_id"), "span_id", "left_semi").select("span_id", *SYMBOL)


def changed_symbols(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """L-15: symbols that spans touch; else the types of the file, else all of it; else the span is unknown.

    span_id, source (overlap, type, file, unknown) and the symbol, null for unknown. A span without lines covers its file.
    """
    types = ["Class", "Interface", "Struct", "Record", "Enum", "Delegate"]
    lined = spans.where("start is not null")
    overlap = intersecting(symbols, lined).withColumn("source", F.lit("overlap"))
    left = spans.join(overlap.select("span_id").distinct(), "span_id", "left_anti")
    keyed = symbols.where(~F.col("kind").isin("File", "Namespace")).withColumn("key", F.explode(F.array_distinct(F.array(path_key("relative_path"), project_path_key("project", "relative_path")))))
    whole = left.select("span_id", path_key("path").alias("key")).join(keyed, "key").select("span_id", *SYMBOL).distinct()
    has_type = whole.where(F.col("kind").isin(*types))
    typed = has_type.withColumn("source", F.lit("type"))
    rest = whole.join(has_type.select("span_id").distinct(), "span_id", "left_anti").withColumn("source", F.lit("file"))
    known = overlap.unionByName(typed).unionByName(rest)
    none = spans.join(known.select("span_id").distinct(), "span_id", "left_anti").select("span_id", F.lit("unknown").alias("source"))
    return known.unionByName(none, allowMissingColumns=True).select("span_id", "source", *SYMBOL)


def edges_of(edges: DataFrame, symbol_id: str, kinds: list[str] | None = None, incoming: bool = False) -> DataFrame:
    """L-14"""
    hit = edges.where(F.col("target_id" if incoming else "source_id") == symbol_id)
    return hit.where(F.col("kind").isin(*kinds)) if kinds else hit
