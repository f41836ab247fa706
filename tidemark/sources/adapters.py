"""The driver tables as records, payloads and receipts, by formula, and the same formulas in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.io import shared_path
from tidemark.sources.schema import ATTRIBUTE

LANES = 16
#: Bytes of event files that one file of the written records table holds, about, and that one task of dealt events takes.
PART_BYTES = 8 << 20
TASK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events dealt over tasks by id, for much work a row: a part of a Parquet file that one task must read can hold a
    million rows. Before the work is done, rows are narrow."""
    files = _files(spark, f"{sf_dir}/events.parquet")
    return table(spark, sf_dir, "events").repartition(_parts(spark, files, TASK_BYTES), "event_id")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def attribute(namespace: str, path: str, kind: Column | str, **slots: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    null = F.lit(None)
    fields = [
        F.lit(namespace).alias("namespace"), F.lit(path).alias("path"), kind.alias("value_type"), slots.get("string", null).cast("string").alias("string_value"),
        slots.get("integer", null).cast("decimal(38,0)").alias("integer_value"), slots.get("double", null).cast("double").alias("double_value"),
        slots.get("boolean", null).cast("boolean").alias("boolean_value"), slots.get("json", null).cast("string").alias("json_value"), null.cast("string").alias("unit"),
    ]
    return F.struct(*fields).cast(ATTRIBUTE)


def records_of(events: DataFrame) -> DataFrame:
    """The records view over an events table, batch or stream."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("decimal(38,0)")).withColumn("t", micros(F.col("ts")))
    missing, null = F.col("event_id") % 29 == 0, F.col("event_id") % 31 == 0
    k = F.when(null, attribute("attributes", "/k", "null")).otherwise(attribute("attributes", "/k", "integer", integer=F.col("k")))
    attrs = F.array_compact(
        F.array(
            F.when(~missing, k),
            attribute("attributes", "/value", "double", double=F.col("value")),
            attribute("tags", "/event_type", "string", string=F.col("event_type")),
            attribute("attributes", "/flag", "boolean", boolean=F.col("user_id") % 2 == 0),
            F.when(F.col("event_id") % 5 == 0, attribute("attributes", "/mixed", "integer", integer=F.lit(1))).when(F.col("event_id") % 5 == 1, attribute("attributes", "/mixed", "double", double=F.lit(1.0))).when(F.col("event_id") % 5 == 2, attribute("attributes", "/mixed", "string", string=F.lit("1"))).when(F.col("event_id") % 5 == 3, attribute("attributes", "/mixed", "null")),
            F.when(F.col("event_id") % 3 == 0, attribute("attributes", "/features/0", "string", string=F.col("event_type"))),
            F.when(F.col("event_id") % 3 == 0, attribute("attributes", "/features/0/name", "string", string=F.lit("checkout"))),
        )
    )
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "transaction").otherwise("log")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("user_id") % 5 == 0, "warning").otherwise("info")
    return e.select(
        F.lit(1).cast("bigint").alias("tenant_id"), (1 + F.col("user_id") % 4).alias("project_id"), F.sha2(F.concat(F.lit("rec-"), F.col("event_id")), 256).alias("record_id"),
        (F.col("event_id") % LANES).cast("int").alias("lane_id"), (F.floor(F.col("event_id") / 128) + 1).cast("bigint").alias("batch_seq"), (F.col("event_id") % 128).cast("int").alias("record_ordinal"),
        kind.alias("kind"), F.col("t").alias("event_time_us"), (F.col("event_id") % 1000).cast("smallint").alias("event_time_ns_remainder"),
        (F.col("t") + F.col("event_id") * 7919 % 600 * 1000000).alias("received_time_us"), F.md5((F.floor(F.col("event_id") / 3)).cast("string")).alias("source_event_id"),
        F.when(F.col("user_id") % 3 != 0, F.md5(F.concat(F.lit("trace-"), F.floor(F.col("event_id") / 20)))).alias("trace_id"),
        level.alias("level"), F.when(level == "error", 17).when(level == "warning", 13).otherwise(9).cast("smallint").alias("severity_number"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id")).alias("message"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("svc-"), F.col("user_id") % 7)).alias("service"),
        F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev").alias("environment"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("release"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("user_id") % 5)).alias("exception_type"),
        F.when(F.col("event_type") == "error", F.sha2(F.concat_ws("|", 1 + F.col("user_id") % 4, F.concat(F.lit("E"), F.col("user_id") % 5)), 256)).alias("issue_id"),
        attrs.alias("attrs"), F.array("event_type", F.concat(F.lit("user "), F.col("user_id"))).alias("search_values"), F.col("event_id"), F.col("user_id"), F.col("value"), F.col("props"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(table(spark, sf_dir, "events"))


#: Paths of written records tables, by session, input and its files.
_written: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, time of change) of the files below a path: another set when the table was written anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _parts(spark: SparkSession, files: tuple[tuple[str, int, int], ...], part_bytes: int = PART_BYTES) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-sum(size for _, size, _ in files) // part_bytes))


def records_by_time(events: DataFrame, parts: int) -> DataFrame:
    """Records in ``parts`` ranges of time. Events are shuffled, as records are many times as wide; event_time_us is in the order of ts."""
    return records_of(events.repartitionByRange(parts, "ts").sortWithinPartitions("ts"))


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a table in the shared folder, in files by time, written once a session and state of the input.
    Searches read it, so that their filters on record columns reach Parquet and no identity is computed again."""
    files = _files(spark, f"{sf_dir}/events.parquet")
    key = spark.sparkContext.applicationId, sf_dir, files
    rows = records_by_time(table(spark, sf_dir, "events"), _parts(spark, files))
    path = _written.get(key)
    if path is None or not _exists(spark, path):
        path = shared_path(spark, "records")
        rows.write.option("compression", "zstd").parquet(path)
        _written[key] = path
    return spark.read.schema(rows.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of each record, beside the records: only details read it."""
    e = table(spark, sf_dir, "events")
    return e.select(F.sha2(F.concat(F.lit("rec-"), F.col("event_id")), 256).alias("record_id"), F.col("props").alias("raw_json"), F.lit(None).cast("string").alias("envelope_sdk_json"), F.lit("[]").alias("normalization_warnings_json"), F.format_string('{"event_id":%d}', "event_id").alias("canonical_metadata_json"))


#: DuckDB twin of ``records``: scalar columns stand for the attributes.
RECORDS_SQL = """with records as (
  select 1::bigint as tenant_id, 1 + user_id % 4 as project_id, sha256('rec-' || event_id) as record_id,
    (event_id % 16)::int as lane_id, event_id // 128 + 1 as batch_seq, (event_id % 128)::int as record_ordinal,
    case event_type when 'error' then 'error' when 'purchase' then 'transaction' else 'log' end as kind,
    epoch_us(ts) as event_time_us, (event_id % 1000)::smallint as event_time_ns_remainder,
    epoch_us(ts) + event_id * 7919 % 600 * 1000000 as received_time_us, md5((event_id // 3)::varchar) as source_event_id,
    case when user_id % 3 <> 0 then md5('trace-' || (event_id // 20)) end as trace_id,
    case when event_type = 'error' then 'error' when user_id % 5 = 0 then 'warning' else 'info' end as level,
    (case when event_type = 'error' then 17 when user_id % 5 = 0 then 13 else 9 end)::smallint as severity_number,
    event_type || ' by user ' || user_id as message, case when user_id % 7 <> 0 then 'svc-' || (user_id % 7) end as service,
    case when user_id % 2 = 0 then 'prod' else 'dev' end as environment, 'r' || (user_id % 3) as release,
    case when event_type = 'error' then 'E' || (user_id % 5) end as exception_type,
    case when event_type = 'error' then sha256((1 + user_id % 4) || '|' || 'E' || (user_id % 5)) end as issue_id,
    case when event_id % 29 = 0 then 'missing' when event_id % 31 = 0 then 'null' else 'integer' end as k_type,
    case when event_id % 29 <> 0 and event_id % 31 <> 0 then (props::json ->> '$.k')::bigint end as k,
    event_id % 5 as mixed, event_id, user_id, event_type, value, props, ts
  from events)
"""
