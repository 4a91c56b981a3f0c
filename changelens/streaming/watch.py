"""M-10 to M-12: a file source of change listings, debounced by the trigger, applied batch by batch; and cached freshness.

A listing row is (project, relative_path, content_hash); a null hash is a removal.
A micro-batch writes what it changes, in folders by the hash of the file, and
then names itself in a small table, so a reader sees whole versions and a
repeated batch has no further effect. After ``COMPACT_AFTER`` batches the files
are written anew as a base; what lies before the base before that is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTING = "project string, relative_path string, content_hash string, seen_at timestamp"
FILES = "project string, relative_path string, content_hash string"
BUCKETS = 64
COMPACT_AFTER = 16
KEYS = ["project", "relative_path"]


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path for it."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, state: str) -> list[tuple[int, int]]:
    """(version, base) of the complete versions that are still kept, in order: a row for each batch since the base before the last."""
    fs, p = _path(spark, f"{state}/versions")
    if not fs.exists(p):
        return []
    rows = spark.read.schema("version long, base long").parquet(f"{state}/versions")
    return sorted((r["version"], r["base"]) for r in rows.distinct().collect() if fs.exists(_path(spark, f"{state}/delta-{r['version']}")[1]) or r["version"] == r["base"])


def latest_version(spark: SparkSession, state: str) -> int:
    """M-11: the newest complete version, or -1."""
    return max((v for v, _ in versions(spark, state)), default=-1)


def current(spark: SparkSession, state: str) -> DataFrame:
    """project, relative_path, content_hash of the newest version: the last word on each file in the base and the batches after it."""
    known = versions(spark, state)
    if not known:
        return spark.createDataFrame([], FILES)
    base = known[-1][1]
    parts = [(-1, f"{state}/base-{base}")] if base >= 0 else []
    parts += [(v, f"{state}/delta-{v}") for v, _ in known if v > base]
    rows = None
    for v, path in parts:
        one = spark.read.schema(f"{FILES}, bucket int").parquet(path).withColumn("version", F.lit(v).cast("long"))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("content_hash"), "version").alias("x"))
    return last.select(*KEYS, "x.content_hash").where("content_hash is not null")


def newest(batch: DataFrame) -> DataFrame:
    """The last row of each file in a batch: many saves of one file are one change."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("seen_at"), F.desc_nulls_last("content_hash"))
    return batch.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*KEYS, "content_hash")


def _put(files: DataFrame, path: str) -> None:
    """Files by bucket: a folder for each bucket that has any."""
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")
    files.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def update(spark: SparkSession, state: str, batch: DataFrame, batch_id: int) -> None:
    """Applies one batch of a listing; a batch that was applied before changes nothing."""
    known = versions(spark, state)
    if known and known[-1][0] >= batch_id:
        return
    base = known[-1][1] if known else -1
    name = lambda v, b: spark.createDataFrame([(v, b)], "version long, base long").write.mode("append").parquet(f"{state}/versions")
    _put(newest(batch), f"{state}/delta-{batch_id}")
    name(batch_id, base)
    if sum(v > base for v, _ in known) + 1 < COMPACT_AFTER:
        return
    _put(current(spark, state), f"{state}/base-{batch_id}")
    name(batch_id, batch_id)
    # A reader may still be at the base that this one replaces, but at none before it.
    for v, b in known:
        if b < base:
            for old in (f"{state}/delta-{v}", f"{state}/base-{b}"):
                fs, p = _path(spark, old)
                fs.delete(p, True)


def watch(spark: SparkSession, source: str, state: str, debounce: str = "100 milliseconds", once: bool = False) -> StreamingQuery:
    """Follows Parquet listings that appear below ``source``; one update at a time."""
    stream = spark.readStream.schema(LISTING).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, n: update(spark, state, batch, n)).option("checkpointLocation", f"{state}/progress")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


ASKED = "root string, event_id long, answer string"


def freshness(events: DataFrame) -> DataFrame:
    """M-11: the answer to every question in a stream of (root, event_id, is_change): hit, or miss where the index must be looked at.

    What a question found out stays in the root's state until a change clears
    it. Events of a root count by event_id within a batch, and batch by batch; a
    root's state is one flag, its events pass in pieces.
    """

    def answer(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = state.get[0] if state.exists else False
        rows = pd.concat(list(pieces)).sort_values("event_id")
        said = []
        for n, change in zip(rows["event_id"].tolist(), rows["is_change"].tolist(), strict=True):
            if change:
                fresh = False
            else:
                said.append((key[0], n, "hit" if fresh else "miss"))
                fresh = True
        state.update((fresh,))
        yield pd.DataFrame(said, columns=["root", "event_id", "answer"])

    return events.groupBy("root").applyInPandasWithState(answer, ASKED, "fresh boolean", "append", GroupStateTimeout.NoTimeout)
