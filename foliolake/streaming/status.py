"""Streams of status events: latest state, transitions, progress, and recovery of what stands still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Task states and what clients are told.
TASK_STATES = {"PENDING": "pending", "PROGRESS": "processing", "SUCCESS": "completed", "FAILURE": "failed"}


def latest_status(events: DataFrame, key: str, status: str, ts: str, tie: str) -> DataFrame:
    """The last status of each key; combined on the map side, so a hot key costs one row per partition."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(ts, tie)).alias("status"), F.max(ts).alias("since"), F.count("*").alias("n"))


def transitions(events: DataFrame, key: str, status: str, ts: str, tie: str, unit: str = "day") -> DataFrame:
    """How often one status follows another.

    Windows run within (key, day), so a key with a third of all events is spread over its days; the
    last status of the day before is carried over by a grouped aggregate.
    """
    e = events.select(F.col(key).alias("k"), F.col(status).alias("s"), F.col(ts).alias("t"), F.col(tie).alias("i"), F.date_trunc(unit, ts).alias("d"))
    w = Window.partitionBy("k", "d").orderBy("t", "i")
    inner = e.select(F.lag("s").over(w).alias("old"), F.col("s").alias("new"), F.row_number().over(w).alias("n")).filter("n > 1").select("old", "new")
    order = F.struct("t", "i")
    days = e.groupBy("k", "d").agg(F.min_by("s", order).alias("new"), F.max_by("s", order).alias("last"))
    joints = days.select(F.lag("last").over(Window.partitionBy("k").orderBy("d")).alias("old"), "new")
    return inner.unionByName(joints).filter("old is not null").groupBy("old", "new").agg(F.count("*").alias("n"))


def task_states(events: DataFrame, state: str = "state") -> DataFrame:
    """What clients are told of each state; unknown ones in lower case."""
    m = F.create_map(*[F.lit(x) for kv in TASK_STATES.items() for x in kv])
    return events.withColumn("status", F.coalesce(F.try_element_at(m, F.col(state)), F.lower(state)))


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows; late ones count until the watermark."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    return timed.withWatermark("at", delay).groupBy(F.window("at", window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def running_state(events: DataFrame, key: str = "user_id", status: str = "event_type") -> DataFrame:
    """Stateful: of each key and day the first and last status and the changes between, kept between batches.

    The state is by (key, day), so a key with a third of all events is spread over its days;
    ``rolled_up`` puts the days together. Events are put in order within a batch.
    """
    schema = "key long, day date, first string, last string, changes long"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, changes = state.get if state.exists else (None, None, -1)
        rows = pd.concat([f[["ts", "event_id", status]] for f in frames]).sort_values(["ts", "event_id"])
        seen = rows[status].to_numpy()
        if changes < 0:
            first, last, changes = seen[0], seen[0], 0
        changes += int((seen[1:] != seen[:-1]).sum()) + int(seen[0] != last)
        state.update((first, seen[-1], changes))
        yield pd.DataFrame({"key": [k[0]], "day": [k[1]], "first": [first], "last": [seen[-1]], "changes": [changes]})

    dated = events.select(F.col(key), F.col("ts").cast("date").alias("day"), "ts", "event_id", F.coalesce(F.col(status), F.lit("")).alias(status))
    return dated.groupBy(key, "day").applyInPandasWithState(update, schema, "first string, last string, changes long", "update", "NoTimeout")


def rolled_up(days: DataFrame) -> DataFrame:
    """key, changes (the first status is one) and last status, from the newest rows of ``running_state``."""
    newest = days.groupBy("key", "day").agg(F.max_by(F.struct("first", "last", "changes"), "batch").alias("s")).select("key", "day", "s.*")
    before = F.lag("last").over(Window.partitionBy("key").orderBy("day"))
    joints = newest.withColumn("joint", F.when(before.isNull() | (before != F.col("first")), 1).otherwise(0))
    return joints.groupBy("key").agg(F.sum(F.col("changes") + F.col("joint")).alias("changes"), F.max_by("last", "day").alias("status"))


def run_once(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Everything available now, written to tables in a shared folder and read back with the number of its batch.

    A batch that is run again after a failure overwrites its own part, so each counts once.
    """

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/out")


def recover(stream: DataFrame, now, folder: str) -> DataFrame:
    """Periodic recovery: the stuck pages of each batch, as they are to be queued again."""
    from foliolake.operators.relational import stuck_pages

    return run_once(stuck_pages(stream, now), folder, "append").drop("batch")


def page_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The pages table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/book_pages.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "book_pages*.parquet").parquet(sf_dir)
