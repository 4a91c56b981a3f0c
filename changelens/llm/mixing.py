"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, in a hashed order of its documents, are one stream cut
into blocks of ``BLOCK`` words; the remainder is a short last block. A target of
t words out of a source of s words takes every block floor(t / s) times, and
(t mod s) words more from blocks in the order of a pseudorandom permutation; its
last slot takes only the start of its block. A slot is one use of one block.

Output shards have ``SHARD`` places. Every place draws a source with the
source's share of all slots, seeded by its number, so the counts of the sources
in a shard are multinomial draws. Over all shards a source is drawn more or less
often than it has slots, by about the root of their number: the draws of a
source are numbered, a pseudorandom permutation of the source maps the numbers to
its slots, and the draws that find no slot, scattered over the shards, go to the
slots that no draw has found. So every slot has one place, and the totals of the
sources hold exactly. Slots meet blocks in a join by source and block index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.llm.common import table, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 256
SHARD = 4096
#: Documents of a hash bucket whose sizes one window task adds up.
BUCKET = 1_000
#: Places that one task draws.
PLACES_PER_TASK = 200_000
#: Numbers that share a bucket in a search for ranges, and buckets at most: beyond them buckets hold more numbers.
RANGE_BUCKET, RANGE_BUCKETS = 64, 1 << 20
#: Any other seed gives another mix of the same sizes.
SEED = 7
_WORD_GAP = r"[\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Number of words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def permuted(df: DataFrame, name: str, j: Column, n: Column, *key: Column | str) -> DataFrame:
    """``df`` plus ``name``: a pseudorandom bijection of 0..n-1 at ``j``, another one for each key.

    Rounds of a Feistel shift on the largest q x m rectangle (q the root of n),
    each followed by a rotation that moves what lies outside of it. The rounds
    are one fold, so that the expression does not grow with them.
    """
    df = df.withColumn("j_", j).withColumn("n_", n).withColumn("k_", F.xxhash64(F.lit(SEED), *key))
    df = df.withColumn("q_", F.greatest(F.floor(F.sqrt(F.col("n_").cast("double"))), F.lit(1).cast("long"))).withColumn("m_", F.expr("n_ div q_"))
    column = "pmod(pmod(a, q_) + pmod(xxhash64(2 * r, a div q_, k_), q_), q_)"
    row = f"pmod(a div q_ + pmod(xxhash64(2 * r + 1, {column}, k_), m_), m_)"
    turn = f"pmod(if(a < q_ * m_, {row} * q_ + {column}, a) + pmod(xxhash64(100 + r, k_), n_), n_)"
    return df.withColumn(name, F.expr(f"aggregate(array(0L, 1L, 2L), j_, (a, r) -> {turn})")).drop("j_", "n_", "k_", "q_", "m_")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, source_size): one row for each source.

    All sizes are shared by weight; a share stops at ``max_repeats`` times its
    source's size and the excess goes to the others. By rising size / weight the
    sources that stop come first, so running sums find where the sharing ends.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    w = sizes.select("source", "source_size", weight.cast("double").alias("w")).withColumn("ratio", F.col("source_size") * max_repeats / F.col("w"))
    left = F.sum("source_size").over(whole) - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("share", share)
    # The first source that need not stop sets the share of all behind it.
    level = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "share"))).over(whole)["share"]
    w = w.withColumn("level", level)
    stop = F.col("source_size").cast("double") * max_repeats
    return w.select("source", "source_size", F.least(stop, F.coalesce(F.col("w") * F.col("level"), stop)).alias("target"))


def offsets(docs: DataFrame) -> DataFrame:
    """``docs`` (with source, size, doc_id, tie, salt) plus ``start``: its place in the word stream of its source.

    Two levels, so that a source of any size is no single task: sizes are added
    up inside hash buckets, and the buckets of a source by their sums.
    """
    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET))
    # Equal rows go to different buckets; the table is written, so every run numbers its rows alike.
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", "salt"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    back = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), F.coalesce(F.sum("n").over(back), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie", "salt").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = ranked.join(bases, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    return joined.select(*docs.columns, (F.col("base") + F.col("inner")).alias("start"))


def in_ranges(rows: DataFrame, at: str, ranges: DataFrame, columns: list[str], total: int) -> DataFrame:
    """``rows`` plus ``columns`` of the range (lo, hi; not empty, none overlaps, all below ``total``) that holds ``at``, from a join by buckets.

    There are ``RANGE_BUCKETS`` buckets at most, so a range of any length is in
    no more of them. A bucket meets no more ranges than it has numbers.
    """
    width = max(RANGE_BUCKET, -(-total // RANGE_BUCKETS))
    spread = ranges.select(F.struct("lo", "hi", *columns).alias("range_"), F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("bucket_"))
    held = spread.groupBy("bucket_").agg(F.collect_list("range_").alias("ranges_"))
    hit = rows.withColumn("bucket_", F.expr(f"{at} div {width}")).join(held, "bucket_")
    one = F.filter("ranges_", lambda r: (r["lo"] <= F.col(at)) & (F.col(at) < r["hi"]))[0]
    return hit.withColumn("range_", one).select(*rows.columns, *[F.col(f"range_.{c}").alias(c) for c in columns])


def _running(column: str) -> Column:
    """The sum of ``column`` over the sources before a row; one row for each source."""
    return F.coalesce(F.sum(column).over(Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def draws(spark: SparkSession, ranges: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """shard, place, source: a source for each of ``total`` places, drawn in proportion to its range (``lo`` to ``hi`` below total).

    The places are drawn one by one from the hash of their number, so the counts
    of the sources in a shard are multinomial.
    """
    places = spark.range(0, total, 1, max(1, -(-total // PLACES_PER_TASK)))
    drawn = places.select(F.col("id").alias("at_"), F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), "id"), F.lit(total)).alias("u_"))
    found = in_ranges(drawn, "u_", ranges, ["source"], total)
    return found.select(F.expr(f"at_ div {shard}").alias("shard"), F.pmod("at_", F.lit(shard)).alias("place"), "source")


def slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """source, block, words, shard, place: every use of a block by the mix, and where it goes, from ``targets``.

    words: how many words of the block are used, from its first.
    """
    spark = plan.sparkSession
    p = plan.where("source_size > 0 and target > 0").withColumn("t", F.round("target").cast("long"))
    p = p.withColumn("t", F.least("t", F.col("source_size") * MAX_REPEATS)).where("t > 0")
    p = p.withColumn("full", F.floor(F.col("source_size") / block).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    p = p.withColumn("passes", F.floor(F.col("t") / F.col("source_size")).cast("long")).withColumn("rest", F.pmod("t", "source_size"))
    p = p.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    p = p.withColumn("lo", _running("slots"))
    p = written(p.withColumn("hi", F.col("lo") + F.col("slots")))
    total = p.agg(F.max("hi")).first()[0] or 0
    drawn = written(draws(spark, p.select("lo", "hi", "source"), total, shard))
    # The draws of a source in their order: those of earlier shards, then those of the shard.
    counts = drawn.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    # What a source is drawn too often, and too seldom, as ranges that cover the same numbers.
    sums = counts.groupBy(F.col("source").alias("source_")).agg(F.sum("n").alias("drawn"))
    p = p.join(sums, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    p = p.withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
    p = written(p.withColumn("over_lo", _running("over")).withColumn("under_lo", _running("under")))
    named = p.select(F.col("source").alias("source_"), F.col("slots").alias("slots_"), F.col("drawn").alias("drawn_"), "over_lo")
    inside = Window.partitionBy("source", "shard").orderBy("place")
    numbered = drawn.withColumn("inside", F.row_number().over(inside) - 1)
    bases = counts.select(F.col("source").alias("s_"), F.col("shard").alias("shard_"), "earlier")
    numbered = numbered.join(bases, F.col("source").eqNullSafe(F.col("s_")) & (F.col("shard") == F.col("shard_"))).drop("s_", "shard_")
    numbered = numbered.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    numbered = written(numbered)
    numbered = permuted(numbered, "slot", F.col("earlier") + F.col("inside"), F.col("drawn_"), F.lit("slots"), "source")
    keep = ["source", "slot", "shard", "place"]
    held = numbered.where("slot < slots_").select(*keep)
    spare = numbered.where("slot >= slots_").select("shard", "place", (F.col("over_lo") + F.col("slot") - F.col("slots_")).alias("q_"))
    lacking = p.where("under > 0").select(F.col("under_lo").alias("lo"), (F.col("under_lo") + F.col("under")).alias("hi"), "source", F.col("drawn").alias("first"), F.col("under_lo").alias("from"))
    moved = in_ranges(spare, "q_", lacking, ["source", "first", "from"], total).withColumn("slot", F.col("first") + F.col("q_") - F.col("from"))
    sizes = p.select(F.col("source").alias("source_"), "source_size", "full", "blocks", "passes", "rest")
    s = written(held.unionByName(moved.select(*keep)))
    s = s.join(sizes, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    s = s.withColumn("j", F.pmod("slot", "blocks")).withColumn("one", F.expr("slot div blocks"))
    # Full blocks are permuted; the short block keeps the last place of a pass.
    s = permuted(s, "turned", F.col("j"), F.greatest("full", F.lit(1).cast("long")), "source", "one")
    size = F.when(F.col("j") < F.col("full"), F.lit(block)).otherwise(F.pmod("source_size", F.lit(block)))
    words = F.when(F.col("one") < F.col("passes"), size).otherwise(F.least(size, F.col("rest") - F.col("j") * block))
    return s.select("source", F.when(F.col("j") < F.col("full"), F.col("turned")).otherwise(F.col("j")).alias("block"), words.cast("long").alias("words"), "shard", "place")


def segments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed`` (``offsets``), one row for each block that a document lies in: block, lo and hi inside of it."""
    stop = F.col("start") + F.col("size")
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((stop - 1) / block))))
    at = F.col("block") * block
    return spread.withColumn("lo", F.greatest(F.col("start") - at, F.lit(0))).withColumn("hi", F.least(stop - at, F.lit(block)))


def uses(slot_rows: DataFrame) -> DataFrame:
    """source_, block_, uses: for each used block its slots, ``MAX_REPEATS`` + 1 at most, as (words, shard, place)."""
    return slot_rows.groupBy(F.col("source").alias("source_"), F.col("block").alias("block_")).agg(F.collect_list(F.struct("words", "shard", "place")).alias("uses"))


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with source_size, target and start; the slots; and the document segments with their uses.

    ``docs`` has doc_id, source, size, tie (to order equal doc_ids) and salt (to
    order equal rows); it is a written table.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(targets(sizes))
    named = plan.withColumnRenamed("source", "source_p")
    placed = written(offsets(docs).join(named, F.col("source").eqNullSafe(F.col("source_p"))).drop("source_p"))
    slot_rows = written(slots(plan))
    used = uses(slot_rows)
    cut = segments(placed).join(used, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")))
    return placed, slot_rows, cut.drop("source_", "block_")


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard, place: one row for each row of ``docs`` (doc_id, source, text).

    shard and place: the first place among the slots that take its words; null
    without any. A null text has no words; a null source is a source of its own, the last;
    repeated rows count each on their own; an empty table gives none. Extra
    columns are ignored.
    """
    narrow = written(_narrow(docs))
    placed, _, cut = mixed(narrow)
    cut = cut.withColumn("uses", F.filter("uses", lambda x: x["words"] > F.col("lo")))
    word_uses = F.expr("aggregate(uses, 0L, (a, x) -> a + least(hi, x.words) - lo)")
    first = F.array_min(F.transform("uses", lambda x: F.struct(x["shard"].alias("shard"), x["place"].alias("place"))))
    got = cut.groupBy("source", "start").agg(F.sum(word_uses).alias("taken"), F.min(first).alias("first"))
    got = got.select(F.col("source").alias("source_"), F.col("start").alias("start_"), "taken", "first.shard", "first.place")
    some = placed.where("size > 0").join(got, F.col("source").eqNullSafe(F.col("source_")) & (F.col("start") == F.col("start_")), "left")
    no = F.lit(None).cast("long")
    none = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "shard": no, "place": no})
    keep = ["doc_id", "size", "source_size", "target"]
    return some.select(*keep, F.coalesce("taken", F.lit(0)).alias("taken"), "shard", "place").unionByName(none.select(*keep, "taken", "shard", "place"))


def _narrow(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, source, size, tie, salt and ``more`` of ``docs``; salt tells equal rows apart."""
    return docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"), *more)


def mix(docs: DataFrame, with_place: bool = False) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each time that words of a document are taken.

    A document that is taken whole keeps its text; of one that is taken in part
    the taken words stay, in order, joined by spaces. n_chars is set anew. With
    ``with_place`` columns ``shard`` and ``place`` follow, the first place among
    the slots that take the row's words: where in the output the row goes. Null
    texts have no words and are never taken; a null source is a source; repeated
    rows count each; an empty table gives an empty mix.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = docs.select(row, "doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("tie")).where("size > 0")
    narrow = written(_narrow(docs).where("size > 0"))
    _, _, cut = mixed(narrow)
    # Copy c of a document has the words of its segments that are used more than c times, longest uses first.
    got = F.filter(F.transform("uses", lambda x: F.struct((F.col("lo") - F.least("hi", x["words"])).alias("less"), x["shard"].alias("shard"), x["place"].alias("place"))), lambda x: x["less"] < 0)
    keys = ["source", "start", "size", "doc_id", "tie"]
    part = cut.select(*keys, (F.col("block") * BLOCK + F.col("lo") - F.col("start")).alias("first"), F.posexplode(F.array_sort(got)).alias("copy", "use"))
    part = part.select(*keys, "copy", "first", (-F.col("use.less")).alias("n"), F.struct("use.shard", "use.place").alias("at"))
    copies = part.groupBy(*keys, "copy").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("cuts"), F.min("at").alias("at"))
    copies = copies.select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.col("tie").alias("tie_"), "taken", "cuts", "at")
    # Equal rows share their text, so one row of each text serves the copies of all of them.
    texts = tagged.dropDuplicates(["doc_id", "source", "tie"])
    hit = copies.join(texts, F.col("id_").eqNullSafe(F.col("doc_id")) & F.col("source_").eqNullSafe(F.col("source")) & (F.col("tie_") == F.col("tie")))
    words = F.split(F.regexp_replace("row.text", f"^{_WORD_GAP}", ""), _WORD_GAP)
    hit = hit.withColumn("words", F.when(F.col("taken") < F.col("size"), words))
    some = F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(F.col("words"), (c["first"] + 1).cast("int"), c["n"].cast("int")))), " ")
    text = F.when(F.col("taken") < F.col("size"), some).otherwise(F.col("row.text"))
    out = hit.withColumn("new_text", text)
    fresh = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    place = [F.col("at.shard"), F.col("at.place")] if with_place else []
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`") for c in docs.columns], *place)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
