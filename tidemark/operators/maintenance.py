"""Table maintenance: manifests, pruning, compaction, retention, audits. Reports and rewrites, no deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import width_bucket

MIB = 1 << 20
#: Small files are below this; a compaction takes at least / at most so many, up to so many bytes.
SMALL, LEAST_FILES, MOST_FILES, TARGET, CAP = 8 * MIB, 8, 128, 32 * MIB, 256 * MIB
TIERS = [64 << 10, 256 << 10, MIB, 2 * MIB, 4 * MIB]


def prune(manifest: DataFrame, generation: int, start_us: int, end_us: int, kinds: list[str], projects: list[int], floor_us: int) -> DataFrame:
    """Files that a dataset can touch: valid at the generation, overlapping in time, above the floor, of its kinds and projects."""
    valid = (F.col("valid_from") <= generation) & (F.col("valid_to").isNull() | (F.col("valid_to") > generation))
    overlap = (F.col("min_event_time_us") < end_us) & (F.col("max_event_time_us") >= start_us)
    return manifest.where(valid & overlap & F.col("kind").isin(*kinds) & (F.col("max_received_time_us") >= floor_us) & F.arrays_overlap("project_ids", F.array(*(F.lit(p).cast("bigint") for p in projects))))


def compaction_candidates(manifest: DataFrame, small: int = SMALL, least: int = LEAST_FILES, most: int = MOST_FILES, target: int = TARGET, cap: int = CAP) -> DataFrame:
    """(lane, kind, tier, files, bytes, file_ids): per cohort the ordered prefix of small files worth compacting."""
    w = Window.partitionBy("lane_id", "kind", "tier").orderBy("valid_from", "file_id")
    f = manifest.where((F.col("bytes") < small) & F.col("valid_to").isNull()).withColumn("tier", width_bucket(F.col("bytes"), TIERS))
    f = f.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chosen = f.where((F.col("place") <= most) & (F.col("before") < target) & (F.col("before") + F.col("bytes") <= cap))
    return chosen.groupBy("lane_id", "kind", "tier").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total_bytes"), F.array_sort(F.collect_list("file_id")).alias("file_ids")).where(F.col("files") >= least)


def rewrite(rows: DataFrame, path: str, by: tuple[str, ...] = ("event_day", "kind")) -> None:
    """Rows as sorted, compressed Parquet, one directory per day and kind. Busy days spread over several files by id."""
    from tidemark.sources.io import write_records

    write_records(rows, path, by)


def verify_inputs(inputs: DataFrame, analytics: DataFrame, payloads: DataFrame, scope) -> DataFrame:
    """(input, records, payloads, problem) of every input pair of a compaction: null if both roles hold exactly the ids
    that ``inputs`` (input, identity_sha256) states and all its rows are in ``scope``, a condition on ``analytics``.

    Both roles carry ``input``, the pair that a row's file belongs to. Problems, the first that holds: missing (a role
    has no rows), scope, identity, count.
    """
    from tidemark.operators.aggregates import with_ordered_hash

    a = analytics.groupBy("input").agg(F.count(F.lit(1)).alias("records"), F.bool_and(F.coalesce(scope, F.lit(False))).alias("scoped"))
    p = payloads.groupBy("input").agg(F.count(F.lit(1)).alias("payloads"))
    both = inputs.join(with_ordered_hash(a, analytics, ["input"], "record_id", "a_sha"), "input", "left").join(with_ordered_hash(p, payloads, ["input"], "record_id", "p_sha"), "input", "left")
    right = lambda c: F.coalesce(F.col(c) == F.col("identity_sha256"), F.lit(False))
    problem = F.when(F.col("records").isNull() | F.col("payloads").isNull(), "missing").when(~F.col("scoped"), "scope").when(~right("a_sha") | ~right("p_sha"), "identity").when(F.col("records") != F.col("payloads"), "count")
    return both.select("input", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("payloads", F.lit(0)).alias("payloads"), problem.alias("problem"))


def retention_floor(old_floor, now_us, old_days, new_days):
    """The floor never goes back: the greatest of the old one and both retentions counted from now."""
    day = 86_400_000_000
    return F.greatest(old_floor, now_us - old_days * day, now_us - new_days * day)


def expired_occurrences(occurrences: DataFrame, floor_us: int, snapshots: DataFrame) -> DataFrame:
    """(record_id) below the floor that no live snapshot of the tenant can see: it sees what its own floor lets through.

    ``snapshots``: tenant_id, floor_us, of live snapshots only.
    """
    seen = snapshots.groupBy("tenant_id").agg(F.min("floor_us").alias("seen_us"))
    below = occurrences.where(F.col("received_time_us") < floor_us).join(seen, "tenant_id", "left")
    return below.where(F.col("seen_us").isNull() | (F.col("received_time_us") < F.col("seen_us"))).select("record_id")


def unlink(transitions: DataFrame, expired: DataFrame) -> DataFrame:
    """``transitions`` without the record ids that have expired; the transitions stay."""
    gone = expired.select("record_id").distinct().withColumn("__gone", F.lit(True))
    kept = F.when(F.col("__gone").isNull(), F.col("record_id"))
    return transitions.join(gone, "record_id", "left").withColumn("record_id", kept).select(*transitions.columns)


def live_claims(claims: DataFrame, now_us: int, keep_days: int) -> DataFrame:
    """Claims that stay: not yet expired, or made within the days of deduplication and a week more."""
    old = F.col("created_us") + (keep_days + 7) * 86_400_000_000 <= now_us
    return claims.where(~F.coalesce((F.col("expires_us") <= now_us) & old, F.lit(False)))


def inventory(objects: DataFrame) -> DataFrame:
    """One row: referenced_objects, referenced_bytes and inventory_sha256, over key, size and hash of each object by key."""
    from tidemark.operators.aggregates import with_ordered_hash

    one = objects.select(F.lit(1).alias("one"), "bytes", F.concat_ws("\0", "object_id", F.col("bytes").cast("string"), "sha256").alias("line"))
    sums = one.groupBy("one").agg(F.count(F.lit(1)).alias("referenced_objects"), F.sum("bytes").alias("referenced_bytes"))
    return with_ordered_hash(sums, one, ["one"], "line", "inventory_sha256").drop("one")


def retention_candidates(manifest: DataFrame, floor_us: int) -> DataFrame:
    """Files with rows below the floor; those wholly below come first."""
    below = manifest.where(F.col("min_received_time_us") < floor_us)
    return below.withColumn("expired", F.col("max_received_time_us") < floor_us).select("file_id", "expired", "min_received_time_us", "row_count")


def unreferenced(objects: DataFrame, references: list[DataFrame], older_than_us: int) -> DataFrame:
    """Objects that no reference names, old enough to go."""
    left = objects.where(F.col("created_us") < older_than_us)
    for r in references:
        left = left.join(r.select("object_id"), "object_id", "left_anti")
    return left


def audit(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """(object_id, problem): referenced objects that are missing from the listing, or differ in size or hash."""
    joined = expected.join(listed.select("object_id", F.col("bytes").alias("b"), F.col("sha256").alias("h")), "object_id", "left")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("h") != F.col("sha256"), "hash")
    return joined.withColumn("problem", problem).where("problem is not null").select("object_id", "problem")
