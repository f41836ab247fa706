"""Sources and sinks: explicit schemas, files of one table as one relation, provenance, Parquet and JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a day and kind that one file holds, about.
FILE_ROWS = 4_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names for checkpoints. A temporary folder stands in for it only in local mode:
    on a cluster that would be one machine's disk, so a session without the setting is refused there."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, schema, paths: list[str], provenance: bool = False) -> DataFrame:
    """Parquet files as one relation with the given schema, the file of origin beside each row if asked."""
    df = spark.read.schema(schema).option("mergeSchema", "false").parquet(*paths)
    return df.select("*", F.col("_metadata.file_path").alias("file_path")) if provenance else df


def read_json_lines(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Strict JSON lines: a line that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_staged(spark: SparkSession, schema: str, path: str, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(rows, files): staged JSON lines whose ordinals rise strictly within each file, and what became of each file.

    ``rows`` has the fields of ``schema`` and file_path, of sound files only.
    ``files``: file_path, lines and reason, null for a sound file; else the worst of
    its lines: no_json (a line that is no object or does not fit the schema),
    no_ordinal, or ordinal_order. Lines are compared within each split that Spark
    reads; splits then meet by their first and last ordinals, so a file of any size
    is checked in parallel and only a row a split is brought together.
    """
    lines = spark.read.text(path).where("value != ''").select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    wide = schema + ", __corrupt string"
    rows = lines.withColumn("__row", F.from_json("value", wide, {"columnNameOfCorruptRecord": "__corrupt"})).withColumn("__o", F.col(f"__row.{ordinal}").cast("bigint"))
    # Lines of a split are numbered as they stand; the one before is looked up within the split.
    here = Window.partitionBy("file_path", "__split").orderBy("__at")
    broken = F.col("__row").isNull() | F.col("__row.__corrupt").isNotNull()
    worst = F.when(broken, 3).when(F.col("__o").isNull(), 2).when(F.col("__o") <= F.lag("__o").over(here), 1).otherwise(0)
    splits = rows.withColumn("__bad", worst).groupBy("file_path", "__split").agg(F.count(F.lit(1)).alias("n"), F.max("__bad").alias("bad"), F.min_by("__o", "__at").alias("first"), F.max_by("__o", "__at").alias("last"))
    along = Window.partitionBy("file_path").orderBy("__split")
    met = splits.withColumn("bad", F.greatest("bad", (F.col("first") <= F.lag("last").over(along)).cast("int")))
    reason = F.get(F.array(F.lit(None), F.lit("ordinal_order"), F.lit("no_ordinal"), F.lit("no_json")), F.max("bad"))
    files = met.groupBy("file_path").agg(F.sum("n").alias("lines"), reason.alias("reason"))
    sound = files.where("reason is null").select("file_path")
    return rows.join(sound, "file_path", "left_semi").select("__row.*", "file_path").drop("__corrupt"), files


def write_records(rows: DataFrame, path: str, by: tuple[str, ...] = ("event_day", "kind")) -> None:
    """Sorted, compressed Parquet by day and kind. Rows of a busy day are dealt over tasks by a hash of their id."""
    spread = F.pmod(F.xxhash64("record_id"), F.lit(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)))
    order = [F.col("project_id"), F.col("service").asc_nulls_first(), F.col("event_time_us"), F.col("record_id")]
    dealt = rows.repartition(*(F.col(c) for c in by), spread).sortWithinPartitions(*(F.col(c) for c in by), *order)
    dealt.write.partitionBy(*by).option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def write_payloads(rows: DataFrame, path: str) -> None:
    rows.select("record_id", "raw_json", "envelope_sdk_json", "normalization_warnings_json", "canonical_metadata_json").write.option("compression", "zstd").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls; decimals go as text, so that no reader rounds them."""
    exact = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in rows.schema]
    rows.select(*exact).write.option("ignoreNullFields", "false").json(path)
