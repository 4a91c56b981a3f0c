"""Hard-negative mining by a two-dimensional block matrix product (SUMMA).

Rows, sorted by label, are cut into blocks of ``ROWS`` and anchors into blocks of
``ANCHORS``; either matrix is stored as chunks of ``DIMS`` dimensions. A tile is
an anchor block against a row block. The chunks of a block travel along its
tiles, every task multiplies pairs of chunks to partial int64 tiles, and the
partial tiles of a tile are shuffled together and added.

A tile is reduced where it is added, so scores are never stored. This takes two
rounds: tiles that share a label give each anchor its positives, whose scores
open the windows; tiles with different labels then give each window its best
rows. As rows are sorted by label, few tiles belong to both rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import map_batches, numbered, table, written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percents of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
ROWS, ANCHORS, DIMS = 512, 128, 32
#: Row blocks whose tiles are reduced together.
TOGETHER = 8
#: Stands for a null vec_id, which is behind all others.
NO_ID = (1 << 63) - 1

_IDS = "ids array<long>, labels array<long>, places array<long>"
_BLOCK = f"block long, chunk int, lo long, hi long, data binary, {_IDS}"


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def _blocks(placed: DataFrame, at: str, size: int, dims: int) -> DataFrame:
    """``placed`` (id, label, vector, place) in blocks by ``at``, a row for each chunk of dimensions; short vectors end in zeros.

    The first chunk has the ids, labels and places of the block.
    """
    chunks = max(1, -(-dims // DIMS))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(at)
        vectors = rows.column("vector").combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        whole = np.zeros((len(rows), chunks * DIMS), np.int64)
        whole[np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(n) for n in sizes])] = vectors.flatten().to_numpy()
        labels = rows.column("label").to_numpy()
        once = [pa.array([rows.column(c).to_pylist()] + [None] * (chunks - 1), pa.list_(pa.int64())) for c in ("id", "label", "place")]
        same = [pa.array([v] * chunks, pa.int64()) for v in (key[0].as_py(), int(labels.min()), int(labels.max()))]
        data = pa.array([np.ascontiguousarray(whole[:, k * DIMS : (k + 1) * DIMS]).tobytes() for k in range(chunks)], pa.binary())
        return pa.Table.from_arrays([same[0], pa.array(range(chunks), pa.int32()), *same[1:], data, *once], names=[x.split()[0] for x in _BLOCK.split(", ")])

    return placed.withColumn("block", F.expr(f"{at} div {size}")).groupBy("block").applyInArrow(pack, _BLOCK)


def _tiles(anchors: DataFrame, rows: DataFrame, wanted: Column) -> DataFrame:
    """a, r of the tiles whose ranges of labels (a_lo to a_hi, r_lo to r_hi) satisfy ``wanted``."""
    last = rows.agg(F.max("block")).first()[0]
    a = anchors.where("chunk = 0").select(F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    r = rows.where("chunk = 0").select(F.col("block").alias("r"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    along = a.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    return along.join(r, "r").where(wanted).select("a", "r")


_PART = "a long, r long, part binary, a_ids array<long>, a_labels array<long>, a_places array<long>, windows array<struct<anchor: long, id: long, score: long, nth: long>>, r_ids array<long>, r_labels array<long>"


def _partial_tiles(tiles: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Products of the chunks of ``tiles``: columns of ``_PART``; what the blocks say of their rows stands with the first chunk."""
    x = anchors.select(F.col("block").alias("a"), "chunk", F.col("data").alias("x"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("places").alias("a_places"), "windows")
    y = rows.select(F.col("block").alias("r"), "chunk", F.col("data").alias("y"), F.col("ids").alias("r_ids"), F.col("labels").alias("r_labels"))
    names = [c.split()[0] for c in _PART.replace("struct<anchor: long, id: long, score: long, nth: long>", "windows").split(", ")]
    pairs = tiles.join(x, "a").join(y, ["r", "chunk"]).select("a", "r", "x", "y", *names[3:])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int64).reshape(-1, DIMS) for k in (2, 3))
                part = pa.array([(left @ right.T).tobytes()], pa.binary())
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:2], part, *one.columns[4:]], names=names)

    return map_batches(pairs, multiply, _PART)


def _best(score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, in order; ties by ``tie``, then by place."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return some[np.lexsort((some, tie[some], -score[some]))[:k]]


_FOUND = "a long, anchor long, nth long, positive_id long, positive_score long, id long, place long, score long"


def _reduced(parts: DataFrame, k: int, windows: bool, low: int, high: int) -> DataFrame:
    """The ``k`` best rows of each anchor's label (its own row left out) or, with ``windows``, of other labels for each of its positives: columns of ``_FOUND``.

    Partial tiles are added, and reduced, for ``TOGETHER`` row blocks at a time.
    """

    def reduce(rows: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        said: dict[int, dict] = {}
        for r, part in zip(rows.column("r").to_pylist(), rows.column("part"), strict=True):
            new = np.frombuffer(part.as_buffer(), np.int64)
            sums[r] = sums[r] + new if r in sums else new
        for one in rows.drop_columns(["part"]).filter(pa.compute.is_valid(rows.column("a_ids"))).to_pylist():
            said[one["r"]] = one
        order = sorted(sums)
        first = said[order[0]]
        a_labels, a_places = np.array(first["a_labels"]), np.array(first["a_places"])
        score = np.concatenate([sums[r].reshape(len(a_labels), -1) for r in order], axis=1)
        ids, labels = (np.concatenate([np.array(said[r][c], np.int64) for r in order]) for c in ("r_ids", "r_labels"))
        places = np.concatenate([r * ROWS + np.arange(len(said[r]["r_ids"])) for r in order])
        out: list[tuple] = []

        def keep(anchor: int, nth: int, pid: int, pscore: int, ok: np.ndarray) -> None:
            at = np.flatnonzero(ok)
            at = at[_best(score[anchor, at], ids[at], k)]
            out.extend((first["a"], anchor, nth, pid, pscore, int(ids[i]), int(places[i]), int(score[anchor, i])) for i in at)

        if windows:
            for w in first["windows"] or ():
                i, p = w["anchor"], w["score"]
                s = 100 * score[i]
                keep(i, w["nth"], w["id"], p, (labels != a_labels[i]) & (s >= low * p) & (s <= high * p))
        else:
            for i in range(len(a_labels)):
                keep(i, 0, 0, 0, (labels == a_labels[i]) & (places != a_places[i]))
        return pa.table({c.split()[0]: pa.array([x[n] for x in out], pa.int64()) for n, c in enumerate(_FOUND.split(", "))})

    return parts.groupBy("a", F.expr(f"r div {TOGETHER}")).applyInArrow(reduce, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the rows found for each anchor and window, with ``n`` from 1."""
    order = Window.partitionBy("a", "anchor", "nth").orderBy(F.desc("score"), "id", "place")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (id, label, vector of whole numbers, is_anchor).

    An anchor's positives are its first ``positives`` other rows of its label, by
    falling inner product, then by id. For each of them come the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's; a positive of negative score has none. A null id
    is behind all others, and comes back as null; repeated rows count each, so a
    copy of an anchor may be its positive; rows with a null label or vector take
    no part; vectors of different length end in zeros. Without rows or anchors
    the result is empty. Extra columns are ignored, whatever their names. Scores
    are 64-bit integers.
    """
    own = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    own = own.where("label is not null and vector is not null")
    by_label = [F.asc("label"), F.asc("id"), F.xxhash64("vector").asc()]
    placed = written(numbered(own, by_label, "place"))
    dims = placed.agg(F.max(F.size("vector"))).first()[0] or 0
    anchors = numbered(placed.where("is_anchor"), [F.asc("place")], "nth")
    r = written(_blocks(placed, "place", ROWS, dims))
    a = written(_blocks(anchors, "nth", ANCHORS, dims))
    lo_hi = [F.col(c) for c in ("a_lo", "a_hi", "r_lo", "r_hi")]
    no_windows = F.lit(None).cast("array<struct<anchor: long, id: long, score: long, nth: long>>")
    alike = _tiles(a, r, (lo_hi[0] <= lo_hi[3]) & (lo_hi[2] <= lo_hi[1]))
    best = _first(_reduced(_partial_tiles(alike, a.withColumn("windows", no_windows), r), positives, False, low, high), positives)
    opened = best.groupBy("a").agg(F.collect_list(F.struct("anchor", "id", "score", F.col("n").cast("long").alias("nth"))).alias("windows"))
    a2 = written(a.join(opened.withColumnRenamed("a", "block"), "block", "left").withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows"))))
    unlike = _tiles(a, r, ~((lo_hi[0] == lo_hi[1]) & (lo_hi[2] == lo_hi[3]) & (lo_hi[0] == lo_hi[2])))
    got = _first(_reduced(_partial_tiles(unlike, a2, r), negatives, True, low, high), negatives)
    names = a.where("chunk = 0").select(F.col("block").alias("a"), F.posexplode("ids").alias("anchor", "anchor_id"))
    id_ = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = got.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(names, ["a", "anchor"])
    return out.select(id_("anchor_id"), id_("positive_id"), F.col("n").cast("int").alias("rank"), id_("negative_id"), "positive_score", "negative_score")


def op13_negatives_summa(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select(F.col("vec_id").alias("id"), label.alias("label"), quantized(F.col("embedding")).alias("vector"), (F.col("vec_id") % 100 == 0).alias("is_anchor")))


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same AND 100 * score BETWEEN {LOW} * positive_score AND {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
