"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text that travel to a Python worker at once; keeps batches small when texts are long.
TEXT_ROWS_PER_BATCH = 512
#: Bytes from which a batch is closed, whatever its rows.
BYTES_PER_BATCH = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new path below the cluster's shared checkpoint folder, in a folder of this application.

    Local sessions without ``spark.checkpoint.dir`` (tests) get a folder of their
    own; on a cluster a missing setting is an error, as executors share no local
    folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes the table behind a frame of ``written`` that nothing reads any more: steps of a loop whose next step is written."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus ``name`` (long): the place of each row in the order of ``order``, from 0.

    Rows are sorted by ranges, so a task holds the rows of a range and no task
    all of them; the places of a range begin after the sum of those before it.
    """
    inside = 33  # bits of monotonically_increasing_id that count the rows of a partition
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("laid__", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("laid__", inside).alias("part__")
    sums = laid.groupBy(part).agg(F.count(F.lit(1)).alias("n__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("base__"))
    place = F.col("base__") + F.col("laid__").bitwiseAND(F.lit((1 << inside) - 1))
    own = [F.col(f"`{c}`") for c in df.columns]
    # A row for each partition of the sort.
    return laid.select("*", part).join(F.broadcast(bases), "part__").select(*own, place.alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches.

    The sizes are settings of the session that Spark reads when the frame is
    run, so they cannot be set back here; they are only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        held = df.sparkSession.conf.get(key)
        if not held.isdigit() or not 0 < int(held) <= most:
            df.sparkSession.conf.set(key, str(most))
    return df.mapInArrow(fn, schema)


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``map_batches`` by a function of one batch, which gives one batch or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return map_batches(df, run, schema)


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and every other code point kept."""
    return text.encode("utf-8", "surrogatepass").lower()
