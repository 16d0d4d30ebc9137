"""Reading new files once, windowed features, and running a stream to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.session import cut

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def watch(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: str = EVENTS, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream; `ts` becomes an event time.

    `files_per_batch` bounds what one micro-batch, and so one key within it, can hold.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first arrival of each key, however late it comes.

    Files are taken once by the stream's own checkpoint. The state holds every key seen, a few bytes each, spread over the
    shuffle partitions; long-lived streams should keep it in RocksDB (`spark.sql.streaming.stateStore.providerClass`).
    """
    return events.dropDuplicates([key])


def chunk_features(events: DataFrame, keys: list[str], width: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Count, mean and peak of each window of each key.

    On a stream a window comes out once the newest event is `delay` past its end, and rows that arrive later than that are
    left out: so a watermark works. `finished_features` completes what a finished input has put out.
    """
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak")).select(
        *keys, F.unix_seconds("window.start").alias("start_s"), "n", "mean", "peak"
    )


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into Parquet under `path`, then return it. Calling it again only adds what is new."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    writer.option("path", f"{path}/data").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def open_features(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """Windows that `chunk_features`, drained to `path`, still holds open, with the rows they have so far; None if it never ran."""
    files = f"{path}/checkpoint/state"
    target = spark._jvm.org.apache.hadoop.fs.Path(files)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        return None  # no batch has run
    # the buffers of the three aggregates, in their order
    held = F.col("value").cast("struct<n:bigint,sum:double,count:bigint,peak:double>")
    state = spark.read.format("statestore").load(f"{path}/checkpoint").select("key", held.alias("value"))
    return state.select(
        *[F.col(f"key.{k}").alias(k) for k in keys], F.unix_seconds("key.window.start").alias("start_s"), F.col("value.n").alias("n"),
        (F.col("value.sum") / F.col("value.count")).alias("mean"), F.col("value.peak").alias("peak"),
    )


def finished_features(spark: SparkSession, path: str, drained: DataFrame, events: DataFrame, keys: list[str], width: str = "15 minutes") -> DataFrame:
    """Every window of a finished input with all of its rows.

    `drained` is what the stream put out to `path`, `events` the rows of its files as a batch. Windows still open come from
    the stream's state. Files that came out of order may have brought rows after their window was closed: a count per window over the
    files, which reads the time and the keys alone, tells such windows, and only their rows are aggregated again.
    """
    still_open = open_features(spark, path, keys)
    known = cut(drained if still_open is None else drained.unionByName(still_open))
    start = F.unix_seconds(F.window("ts", width)["start"]).alias("start_s")
    counts = events.select(*keys, start).groupBy(*keys, "start_s").agg(F.count(F.lit(1)).alias("_all"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in [*keys, "start_s"]]
    short = counts.join(known, same(counts, known), "left").where(known["n"].isNull() | (known["n"] != F.col("_all"))).select(*[counts[k] for k in [*keys, "start_s"]])
    short = cut(short)
    if short.isEmpty():
        return known
    rows = events.withColumn("start_s", start)
    late = rows.join(short, same(rows, short), "left_semi").drop("start_s")
    again = chunk_features(late, keys, width)
    return known.join(short, same(known, short), "left_anti").unionByName(again.select(*known.columns))

