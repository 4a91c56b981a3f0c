"""Importance resampling towards a target distribution, by inverted postings of hashed features.

Features are runs of words, hashed into a fixed number of buckets. Documents are
read in blocks of bounded size, and every block gives one posting list for each
bucket that it has: places of documents and counts. Then

1. the bucket totals of both corpora, added up before they are shuffled, are
   grouped by bucket, which gives the gain of the bucket;
2. posting lists are shuffled by bucket and salt to the gains and become
   contributions, gain times count;
3. contributions are reduced by block, and so by document.

A posting list has at most ``BLOCK_DOCS`` entries and a salt takes at most
``BLOCKS_PER_SALT`` blocks in the mean, so that a bucket which every document
has is as many groups as the corpus asks for. Ranks come from a sort by ranges.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import map_arrow, map_batches, numbered, table, written

RUN = 1
BUCKETS = 10_000
SEED = 2024
#: Percent of the documents of at least ``MIN_WORDS`` words that are drawn.
SHARE = 10
MIN_WORDS = 20
#: A block ends at so many documents or features, whichever comes first.
BLOCK_DOCS, BLOCK_FEATURES = 1 << 14, 1 << 20
BLOCKS_PER_SALT = 4096
#: Words whose buckets a task remembers.
_MEMORY = 1 << 20
#: A-Z in lower case; every ASCII byte that is neither letter nor digit becomes a blank.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))

_HEAD = "ids array<long>, words array<long>, features array<long>, noise array<long>"
_POSTINGS = f"block long, bucket int, at array<smallint>, n array<int>, total long, {_HEAD}"


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, lower case, in UTF-8; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """The noise of a document, from a hash of its id; a null id is the empty text."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def gain(s: int, t: int, s_all: int, t_all: int, buckets: int = BUCKETS) -> int:
    """How much more often the target has a bucket (t of t_all features) than the corpus (s of s_all)."""
    return math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))


class _Buckets(dict):
    """Bucket of each word, kept for words seen before."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        self[word] = found = zlib.crc32(word) % self.buckets
        return found


def postings(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Posting lists of ``docs`` (doc_id, text): block, bucket, at (places in the block), n (counts), total.

    A further row of each block, without a bucket, has for each document its id,
    numbers of words and features, and noise.
    """

    def emit(block: int, ids: list, words: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        features = [len(x) for x in found]
        key = np.concatenate([x * BLOCK_DOCS + i for i, x in enumerate(found)]) if found else np.empty(0, np.int64)
        key, n = np.unique(key, return_counts=True)
        bucket, at = key // BLOCK_DOCS, (key % BLOCK_DOCS).astype(np.int16)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(first, len(key)).astype(np.int32)
        total = np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)
        k = len(first)
        # The block's own row comes last.
        lists = [pa.ListArray.from_arrays(pa.array(np.append(ends, len(key)), pa.int32()), pa.array(v, t)) for v, t in ((at, pa.int16()), (n.astype(np.int32), pa.int32()))]
        head = [pa.array([None] * k + [v], pa.list_(pa.int64())) for v in (ids, words, features, [gumbel(i, seed) for i in ids])]
        columns = [pa.array(np.full(k + 1, block)), pa.array([*bucket[first].tolist(), None], pa.int32()), *lists, pa.array([*total.tolist(), None], pa.int64()), *head]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _POSTINGS.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bucket_of = TaskContext.get().partitionId() << 33, _Buckets(buckets)
        ids, words, found, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(text)
                got = [np.fromiter(map(bucket_of.__getitem__, own), np.int64, len(own))]
                for k in range(2, run + 1):
                    runs = [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]
                    got.append(np.fromiter((zlib.crc32(r) % buckets for r in runs), np.int64, len(runs)))
                ids.append(doc_id)
                words.append(len(own))
                found.append(np.concatenate(got))
                size += len(found[-1])
                if len(ids) == BLOCK_DOCS or size >= BLOCK_FEATURES:
                    yield emit(block, ids, words, found)
                    block, ids, words, found, size = block + 1, [], [], [], 0
        if ids:
            yield emit(block, ids, words, found)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), blocks, _POSTINGS)


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket that the corpus has, from the postings of both: a row for each bucket at most."""
    no = F.lit(0).cast("long")
    both = corpus.select("bucket", F.col("total").alias("s"), no.alias("t")).unionByName(target.select("bucket", no.alias("s"), F.col("total").alias("t")))
    sums = written(both.where("bucket is not null").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    s_all, t_all = sums.agg(F.coalesce(F.sum("s"), no), F.coalesce(F.sum("t"), no)).first()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [gain(s, t, s_all, t_all, buckets) for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["bucket", "gain"])

    return map_arrow(sums.where("s > 0"), run, "bucket int, gain long")


def weights(corpus: DataFrame, bucket_gains: DataFrame) -> DataFrame:
    """block, weights: of each document of a block the sum of its contributions, in their order; shorter if the last have none."""
    blocks = corpus.where("bucket is null").count()
    salts = max(1, -(-blocks // BLOCKS_PER_SALT))
    lists = corpus.where("bucket is not null").select("block", "bucket", "at", "n", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    spread = bucket_gains.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hit = lists.join(spread.hint("shuffle_hash"), ["bucket", "salt"])
    parts = hit.select("block", "at", F.transform("n", lambda x: x * F.col("gain")).alias("part"))

    def add(rows: pa.Table) -> pa.Table:
        at, part = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "part"))
        out = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(out, at, part)
        return pa.table({"block": rows.column("block")[:1], "weights": pa.array([out], pa.list_(pa.int64()))})

    return parts.groupBy("block").applyInArrow(add, "block long, weights array<long>")


def scores(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row for each row of ``docs`` (doc_id, text), written to the shared folder.

    ``target`` has texts of the distribution wanted (text).
    """
    corpus = written(postings(docs, run, buckets, seed))
    wanted = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), run, buckets, seed)
    summed = weights(corpus, gains(corpus, wanted, buckets)).withColumnRenamed("block", "block_")
    heads = corpus.where("bucket is null").join(summed, F.col("block") == F.col("block_"), "left")
    each = heads.select("weights", F.posexplode(F.arrays_zip("ids", "words", "features", "noise")).alias("pos", "d"))
    weight = F.coalesce(F.get("weights", F.col("pos")), F.lit(0).cast("long"))
    return written(each.select(F.col("d.ids").alias("doc_id"), F.col("d.words").alias("n_words"), F.col("d.features").alias("n_features"), weight.alias("weight"), (weight + F.col("d.noise")).alias("score")))


def ranked(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``scores`` plus ``rank``: 1, 2, 3... of the drawn documents by falling score, null of the others.

    Drawn are ``share`` percent, rounded down, of the documents of at least
    ``min_words`` words; ties go to the smaller doc_id, a null doc_id is last.
    Null and empty texts have no words: weight 0 and never drawn. Repeated rows
    count each, and are drawn each. An empty ``docs`` gives no rows; with an
    empty ``target`` the gains are those of an even distribution. Extra columns
    are ignored, whatever their names.
    """
    all_ = scores(docs, target, run, buckets, seed)
    some = all_.where(F.col("n_words") >= min_words)
    drawn = some.count() * share // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = numbered(some, order, "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return placed.unionByName(all_.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of ``docs``, all columns; of rows with one doc_id all are drawn or none. Rows without doc_id are not drawn."""
    drawn = ranked(docs, target, share, min_words).where("rank is not null and doc_id is not null").select("doc_id").distinct()
    return docs.join(drawn.withColumnRenamed("doc_id", "drawn_id__"), F.col("doc_id") == F.col("drawn_id__"), "left_semi")


def op11_resample_postings(spark, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP11_SQL = rf"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tbl
  FROM (SELECT i, list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))
),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents
),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM benchmark
),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
dc AS (SELECT doc_id, w, count(*) AS n FROM dw GROUP BY ALL),
bw AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT w FROM dc UNION SELECT w FROM bw),
hashed AS (
  SELECT w, hex(encode(w)) AS h, tbl FROM words, crc_table
),
bucketed AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)], lambda c, x: xor(tbl[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM hashed
),
s AS (SELECT bucket, sum(n) AS s FROM dc JOIN bucketed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucketed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dc JOIN bucketed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {SHARE} * n // 100 THEN place END AS rank FROM placed
"""
