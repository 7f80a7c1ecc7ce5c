"""Sources and one-shot runs of streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.session import fresh_path

PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Input of one micro-batch. Files beyond it wait for the next one and must not be older than the watermark's delay.
BYTES_PER_TRIGGER = str(1 << 30)
# Files of a replayed table that make up a micro-batch
REPLAY_PARTS = 16
# Later than any row, and a time that pandas can hold in nanoseconds
FEED_END = "2262-01-01 00:00:00"


def file_stream(spark: SparkSession, folder: str, schema: str, name: str | None = None, **options: str) -> DataFrame:
    """Parquet files of a folder as a stream; ``name`` picks files by pattern, or a table that is a folder itself.

    A micro-batch reads at most ``BYTES_PER_TRIGGER``, unless the options set another bound.
    """
    bounded = any(name.lower() in ("maxfilespertrigger", "maxbytespertrigger") for name in options)
    reader = spark.readStream.schema(schema).options(**({} if bounded else {"maxBytesPerTrigger": BYTES_PER_TRIGGER}), **options)
    if name:
        if is_folder(spark, f"{folder}/{name}"):
            return reader.parquet(f"{folder}/{name}")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, which need not be a local one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def bytes_of(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def replay(spark: SparkSession, folder: str, schema: str, name: str, time: str, limit: int = int(BYTES_PER_TRIGGER)) -> Callable[[], DataFrame]:
    """A maker of streams of a stored table that has no order of time.

    What one micro-batch takes is read as it is. A larger table is stored once by ranges of time first, as its rows
    would come late otherwise; its files bear times in that order, so streams take them in it, and each micro-batch
    holds at most `limit` bytes, and a file at least.
    """
    size = bytes_of(spark, f"{folder}/{name}")
    if size <= limit:
        return lambda: file_stream(spark, folder, schema, name, maxFilesPerTrigger=str(2**31 - 1))
    rows, path = spark.read.schema(schema).parquet(f"{folder}/{name}"), fresh_path(spark, "replay")
    parts = -(-size * REPLAY_PARTS // limit)
    rows.repartitionByRange(parts, time, *[column for column in rows.columns if column != time]).write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((one.getPath().getName(), one) for one in files.listStatus(place) if one.getPath().getName().startswith("part-"))
    last = max(one.getModificationTime() for _, one in found)
    for i, (_, one) in enumerate(found):
        files.setTimes(one.getPath(), last - 1000 * (len(found) - i), -1)
    return lambda: file_stream(spark, path, schema, maxBytesPerTrigger=str(limit))


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Tick messages of a Kafka topic; needs the Kafka package on the cluster."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a query reads when it starts.

    It keeps the progress of all its batches, a few kB each, and not of the last 100 only. Its state lies
    in RocksDB, which keyed state with timers needs, and which holds state on disk.
    """
    own = {PROGRESS: str(2**31 - 1), STATE_STORE: ROCKS}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_to_table(stream: DataFrame, name: str, path: str | None = None, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Process what is available, exactly once, into a Parquet table; run again to go on."""
    spark = stream.sparkSession
    root = path or fresh_path(spark, name)
    with _stream_settings(spark):
        query = (
            stream.writeStream.outputMode(mode)
            .format("parquet")
            .option("path", f"{root}/data")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data"), query


def run_to_end(
    feed: DataFrame, time: str, job: Callable[[DataFrame], DataFrame], name: str, path: str | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """`run_to_table` of ``job`` over a feed that has ended, so that the rows behind the watermark go out as well.

    Once all is read, the feed gets one more row, of the time `FEED_END` and else null. The watermark passes all
    rows but that one, whose own result never goes out. What comes to the feed after that is late.
    """
    spark = feed.sparkSession
    root, ends = path or fresh_path(spark, name), fresh_path(spark, "end")
    one = [F.lit(FEED_END if f.name == time else None).cast(f.dataType).alias(f.name) for f in feed.schema]
    end = spark.range(1).select(*one)
    end.limit(0).write.parquet(ends)
    stream = job(feed.unionByName(spark.readStream.schema(feed.schema).parquet(ends)))
    run_to_table(stream, name, root)
    end.write.mode("append").parquet(ends)
    return run_to_table(stream, name, root)


def _foreach(stream: DataFrame, write: Callable[[DataFrame, int], None], root: str) -> None:
    with _stream_settings(stream.sparkSession):
        query = (
            stream.writeStream.outputMode("append")
            .foreachBatch(write)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def run_batches(stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Run ``step`` on every micro-batch and store its result by batch.

    A batch writes its own folder, so a repeated batch replaces its earlier output.
    """
    spark = stream.sparkSession
    root = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    _foreach(stream, write, root)
    return spark.read.schema(schema).parquet(f"{root}/data").drop("batch")


def count_late(stream: DataFrame, time: str, delay: str, name: str, path: str | None = None) -> DataFrame:
    """`batch, rows, late, latest`: how many rows of each micro-batch came behind its watermark; run again to go on.

    The watermark of a batch is the latest time of the batches before it less the delay, in milliseconds. A batch
    writes its own folder, so counts outlast the query, and a repeated batch counts once. They are
    counts of rows, where Spark's own metric counts what is left of them after partial aggregation.
    """
    spark = stream.sparkSession
    root = path or fresh_path(spark, name)
    schema = "rows long, late long, latest timestamp_ntz"

    def write(batch: DataFrame, number: int) -> None:
        mark = F.lit(None).cast("timestamp_ntz")
        if number and is_folder(spark, f"{root}/data"):
            before = spark.read.schema(f"{schema}, batch int").parquet(f"{root}/data").where(F.col("batch") < number)
            mark = F.lit(before.agg(F.max("latest")).first()[0]).cast("timestamp_ntz")
            mark = F.date_trunc("millisecond", mark).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        counted = batch.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(time) <= mark).alias("late"),
            F.max(F.col(time).cast("timestamp_ntz")).alias("latest"),
        )
        counted.coalesce(1).write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    _foreach(stream, write, root)
    return spark.read.schema(f"{schema}, batch int").parquet(f"{root}/data").select("batch", "rows", "late", "latest")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, from the progress of all batches of a `run_to_table`."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
