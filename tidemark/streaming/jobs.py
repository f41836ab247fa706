"""Structured Streaming twins: file source in, shared-folder sinks out, state by key.

Watermarks follow the received time only: an event may be arbitrarily late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.adapters import records_of
from tidemark.sources.io import shared_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """Records from event files as they come, with an explicit schema and a bound per micro-batch; without one it takes all that is there.

    The path becomes a pattern, which the source takes for one file and for a directory alike.
    """
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return records_of(events).withColumn("received", F.timestamp_micros("received_time_us"))


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream", out: str | None = None) -> DataFrame:
    """All that is available now, through an exactly-once file sink in the shared folder, read back as a table.
    With the ``out`` of an earlier run, it goes on from that run's checkpoint."""
    spark = stream.sparkSession
    out = out or shared_path(spark, name)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int, str], None], name: str = "batches", mode: str = "append") -> str:
    """``each`` (batch, batch id, output path) for every micro-batch; a batch that is tried again writes the same path."""
    out = shared_path(stream.sparkSession, name)
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: each(df, i, out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def with_sequence(batch: DataFrame, batch_id: int, floors: DataFrame) -> DataFrame:
    """Lane positions of a micro-batch: its id as sequence, row numbers per lane as ordinals. Received times never go
    back: no row is before ``floors`` (lane_id, floor_us), the last times of earlier batches."""
    w = Window.partitionBy("lane_id").orderBy("received_time_us", "record_id")
    lifted = batch.join(F.broadcast(floors), "lane_id", "left").withColumn("received_time_us", F.greatest("received_time_us", "floor_us")).drop("floor_us")
    return lifted.withColumn("stream_seq", F.lit(batch_id).cast("bigint")).withColumn("stream_ordinal", F.row_number().over(w) - 1)


def write_sequence(batch: DataFrame, batch_id: int, out: str) -> None:
    """A micro-batch with its positions, and beside it the last received time of each lane, one row a lane."""
    spark = batch.sparkSession
    schema = "lane_id int, floor_us bigint"
    floors = spark.read.schema(schema).parquet(f"{out}-floors/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
    with_sequence(batch, batch_id, floors).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    written = spark.read.parquet(f"{out}/batch={batch_id}").groupBy("lane_id").agg(F.max("received_time_us").alias("floor_us"))
    written.unionByName(floors).groupBy("lane_id").agg(F.max("floor_us").alias("floor_us")).coalesce(1).write.mode("overwrite").parquet(f"{out}-floors/batch={batch_id}")


def live_page(records: DataFrame, positions: list[tuple[int, int]], cuts: list[int], size: int = 100) -> DataFrame:
    """Rows behind each lane's position (sequence, ordinal) up to its cut, in append order, one more than a page."""
    at = F.array(*(F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(o).alias("o")) for s, o in positions))
    here = F.get(at, F.col("lane_id"))
    newer = (F.col("batch_seq") > here["s"]) | ((F.col("batch_seq") == here["s"]) & (F.col("record_ordinal") > here["o"]))
    lowest = min(s for s, _ in positions)
    ready = F.col("batch_seq") <= F.get(F.array(*map(F.lit, cuts)), F.col("lane_id"))
    return records.where((F.col("batch_seq") >= lowest) & newer & ready).orderBy("lane_id", "batch_seq", "record_ordinal", "record_id").limit(size + 1)


def advance(page: DataFrame, size: int, full: bool, cuts: list[int]) -> DataFrame:
    """(lane_id, batch_seq, record_ordinal) after a page: its last delivered rows, or the cuts once everything was seen."""
    if full:
        spark = page.sparkSession
        return spark.createDataFrame([(i, c, 1 << 30) for i, c in enumerate(cuts)], "lane_id int, batch_seq bigint, record_ordinal int")
    last = F.max(F.struct("batch_seq", "record_ordinal"))
    return page.limit(size).groupBy("lane_id").agg(last.alias("p")).select("lane_id", "p.batch_seq", "p.record_ordinal")


def sliding_counts(stream: DataFrame, length: str, slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts per project and sliding window of the received time, in append mode."""
    return stream.withWatermark("received", delay).groupBy("project_id", F.window("received", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("project_id", F.unix_micros("w.end").alias("window_end_us"), "n")


def tumbling_counts(stream: DataFrame, length: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("received", delay).groupBy(F.window("received", length).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("bucket"), "kind", "n")


def issue_states(stream: DataFrame, known: DataFrame) -> DataFrame:
    """The state of each issue that a micro-batch touches (update mode): count, first and last event time, revision, and
    its transition: created where ``known`` lacks the issue, regressed where that is resolved and a row lies beyond the
    cut that the resolution took of its lane. ``record_id`` is the first such row in append order, as far as rows came.

    ``known``: project_id, issue_id, status, revision, resolved_cut array<bigint> (by lane), as the stream starts. Tasks
    send one row per issue to the state, so a hot issue costs no more than others.
    """
    rows = stream.where("issue_id is not null").join(known, ["project_id", "issue_id"], "left")
    beyond = (F.col("status") == "resolved") & (F.col("batch_seq") > F.get("resolved_cut", F.col("lane_id")))
    moment = F.when(F.col("status").isNull() | beyond, F.struct("batch_seq", "lane_id", "record_ordinal", "record_id"))
    state = rows.groupBy("project_id", "issue_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("event_time_us").alias("first_us"), F.max("event_time_us").alias("last_us"),
        F.min(moment).alias("at"), F.max("status").alias("status"), F.max("revision").alias("revision"),
    )
    kind = F.when(F.col("at").isNull(), None).when(F.col("status").isNull(), "created").otherwise("regressed")
    revision = F.coalesce("revision", F.lit(0)) + F.col("at").isNotNull().cast("int")
    return state.select("project_id", "issue_id", "occurrences", "first_us", "last_us", kind.alias("type"), F.col("at.record_id").alias("record_id"), revision.alias("revision"))


def latest_states(written: DataFrame) -> DataFrame:
    """Of the states written so far, each in its ``batch``, the last one of each issue."""
    rest = [c for c in written.columns if c not in ("project_id", "issue_id", "batch")]
    return written.groupBy("project_id", "issue_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("project_id", "issue_id", "s.*")
