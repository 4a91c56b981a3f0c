"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule names.

DataFrame operations and Spark ML only. The trees learn from the URLs that a
rule judges, which are its labels, and see lexical features alone: lengths,
depth, digit ratio, entropy, parameter counts and the statistics of the host's
suffix among all labelled rows. In training, a row sees the statistics of the
other folds only, so that its own label is no feature of it. The trees are
fitted on a sample of about ``TRAIN_ROWS`` distinct labelled URLs, picked by
hash, half of each verdict where both have as many; weights restore the shares.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import table, written

# Fixed values: (verdict, rule); a rule is a host and the start of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 8, 3, 7
#: Hash values that the sample picks from: a share of a few out of 10^15 URLs is no zero.
HASHES = 1 << 60
#: Folds of the suffix statistics, and the most suffixes that are broadcast; more are joined by a shuffle.
FOLDS, MOST_BROADCAST = 5, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """``pages`` plus host and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _LOWER)
    return out.withColumn("host", host).withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)).drop("rest")


def rule_columns(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits host and path, and its verdict; null if none fits."""
    rule = verdict = None
    for word, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    return rule, verdict


FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix_n", "f_suffix_blocked"]


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) plus the lexical features and the suffix of the host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    times = lambda c, among=url: F.length(among) - F.length(F.translate(among, c, ""))
    # Runs of the sorted characters are their counts: entropy is log n less the mean of log count.
    bits = F.expr(
        "aggregate(array_sort(split(lower(coalesce(url, '')), '')), named_struct('c', '', 'n', 0L, 's', 0D), "
        "(a, c) -> if(a.c = c, named_struct('c', c, 'n', a.n + 1, 's', a.s), named_struct('c', c, 'n', 1L, 's', a.s + if(a.n > 0, a.n * log2(a.n), 0D))), "
        "a -> a.s + if(a.n > 0, a.n * log2(a.n), 0D))"
    )
    return pages.select(
        "*", n.cast("double").alias("f_length"), F.length("host").cast("double").alias("f_host"), F.length("path").cast("double").alias("f_path"),
        times("/", F.col("path")).cast("double").alias("f_depth"), (times(".", F.col("host")) + 1).cast("double").alias("f_labels"),
        (times("0123456789") / F.greatest(n, F.lit(1))).alias("f_digits"),
        F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0).alias("f_entropy"),
        times("=").cast("double").alias("f_params"), times("-").cast("double").alias("f_hyphens"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


def sample(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``train_rows`` distinct URLs of ``labelled``, as many of each verdict, picked by hash before anything is shuffled by URL; weight: the URLs that one stands for."""
    totals = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.approx_count_distinct("url", 0.01).alias("n")).collect()}  # two verdicts
    share = {v: min(1.0, train_rows / len(totals) / max(1, n)) for v, n in totals.items()}
    least, weight = F.lit(0), F.lit(1.0)
    for v, x in share.items():
        least, weight = F.when(F.col("verdict") == v, int(x * HASHES)).otherwise(least), F.when(F.col("verdict") == v, 1 / x).otherwise(weight)
    picked = labelled.where(F.pmod(F.xxhash64("url"), F.lit(HASHES)) < least)
    return picked.groupBy("url", "host", "path").agg(F.min("verdict").alias("verdict")).withColumn("weight", weight)


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).alias("fold")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix, fold, n, blocked of all labelled rows, combined before they are shuffled; fold -1 holds the sum of all."""
    rows = labelled.select(F.substring_index("host", ".", -1).alias("suffix"), _fold(), (F.col("verdict") == "block").cast("long").alias("b"))
    each = written(rows.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("blocked")))
    total = each.groupBy("suffix").agg(F.lit(-1).cast("long").alias("fold"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    return each.select("suffix", F.col("fold").cast("long").alias("fold"), "n", "blocked").unionByName(total)


def _suffix_features(n: Column, blocked: Column) -> list[Column]:
    return [F.log1p(n.cast("double")).alias("f_suffix_n"), ((blocked + 1) / (n + 2)).alias("f_suffix_blocked")]


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[GBTClassificationModel | None, DataFrame]:
    """Trees and suffix statistics from ``labelled`` (url, host, path, verdict). No trees unless both verdicts occur."""
    stats = written(suffix_statistics(labelled))
    all_, own = stats.where("fold = -1").drop("fold"), stats.where("fold >= 0")
    suffixes = written(all_.select("suffix", *_suffix_features(F.col("n"), F.col("blocked"))))
    rows = lexical(written(sample(labelled, train_rows))).withColumn("label", (F.col("verdict") == "block").cast("double"))
    rows = rows.withColumn("fold", _fold()).join(all_.withColumnsRenamed({"n": "n_all", "blocked": "b_all"}), "suffix").join(own, ["suffix", "fold"], "left")
    rest = [F.col(a) - F.coalesce(F.col(b), F.lit(0)) for a, b in (("n_all", "n"), ("b_all", "blocked"))]
    train = written(_vector(rows.select("*", *_suffix_features(*rest))).select("features", "label", "weight").coalesce(4))
    if train.select("label").distinct().count() < 2:
        return None, suffixes
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, weightCol="weight").fit(train), suffixes


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def with_vector(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``rows`` of ``lexical`` with the statistics of their suffix and the vector of features."""
    small = suffixes.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(suffixes) if small else suffixes, "suffix", "left")
    return _vector(joined.fillna({"f_suffix_n": 0.0, "f_suffix_blocked": 0.5}))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of ``pages`` (page_id, url).

    A null url has empty host and path and is judged by the trees, as any that
    no rule fits; without trees (no labels of both kinds) it is allowed.
    Repeated rows get equal rows and null page_ids stay; an empty table gives
    none; other columns, whatever their names, are ignored.
    """
    rule, verdict = rule_columns(RULES if rules is None else rules)
    named = split_url(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("by_rule", verdict)
    model, suffixes = fit(named.where("rule is not null").select("url", "host", "path", F.col("by_rule").alias("verdict")), train_rows)
    if model is None:
        said = named.withColumn("prediction", F.lit(0.0))
    else:
        said = model.transform(with_vector(lexical(named), suffixes))
    method = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return said.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))


def op9_url_gbt(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
