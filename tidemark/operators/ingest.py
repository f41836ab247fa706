"""Acceptance: duplicates and conflicts, receipts and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

KEY = ["project_id", "kind", "source_event_id"]
DAY_US = 86_400_000_000


def classify(candidates: DataFrame, claims: DataFrame, order: list[str]) -> DataFrame:
    """``candidates`` with ``class``: accepted, duplicate or conflict.

    The first candidate of a key wins unless an unexpired claim holds the key;
    the others are duplicates of the winner's hash or conflicts. Rows without
    source id are always accepted. Winners come from an aggregate, so a key
    with very many rows is reduced before it is shuffled.
    """
    named = candidates.where("source_event_id is not null")
    winner = named.groupBy(*KEY).agg(F.min(F.struct(*order, F.col("payload_sha256").alias("first_hash"), F.col("record_id").alias("first_id"), F.col("received_time_us").alias("at"))).alias("w"))
    held = claims.select(*KEY, F.col("payload_sha256").alias("claim_hash"), "expires_us")
    winner = winner.join(held, KEY, "left").select(*KEY, F.when(F.col("expires_us") > F.col("w.at"), F.col("claim_hash")).alias("claim_hash"), F.col("w.first_hash").alias("first_hash"), F.col("w.first_id").alias("first_id"))
    joined = named.join(winner, KEY)
    wins = F.col("claim_hash").isNull() & (F.col("record_id") == F.col("first_id"))
    same = F.col("payload_sha256") == F.coalesce("claim_hash", "first_hash")
    known = joined.withColumn("class", F.when(wins, "accepted").when(same, "duplicate").otherwise("conflict")).select(*candidates.columns, "class")
    return known.unionByName(candidates.where("source_event_id is null").withColumn("class", F.lit("accepted")))


def new_claims(classified: DataFrame, retention_days: int) -> DataFrame:
    """Claims of the accepted rows: they expire a week after the retention."""
    return classified.where("class = 'accepted' and source_event_id is not null").select(*KEY, "payload_sha256", (F.col("received_time_us") + (retention_days + 7) * DAY_US).alias("expires_us"))


def claims_after(claims: DataFrame, fresh: DataFrame) -> DataFrame:
    """The claims table after a batch: a fresh claim replaces an (expired) one of its key."""
    return claims.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh)


def counts(classified: DataFrame, keys: list[str]) -> DataFrame:
    return classified.groupBy(*keys).agg(*(F.count_if(F.col("class") == c).alias(f"{n}_count") for c, n in (("accepted", "accepted"), ("duplicate", "duplicate"), ("conflict", "conflict"))), F.count(F.lit(1)).alias("records"))


def runs(rows: DataFrame, part: list[str], position: str, cls: str) -> DataFrame:
    """Runs of equal classes at adjacent positions: (part, class, first, last)."""
    w = Window.partitionBy(*part).orderBy(position)
    new = F.coalesce(((F.lag(cls).over(w) != F.col(cls)) | (F.lag(position).over(w) != F.col(position) - 1)).cast("int"), F.lit(1))
    marked = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*part, "__run", cls).agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("__run")


def ranges(classified: DataFrame, part: list[str], position: str) -> DataFrame:
    """Per acceptance, the sorted [first, last] ranges of each class."""
    r = runs(classified, part, position, "class")
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col("class") == c, F.array("first", "last")))).alias(c)
    return r.groupBy(*part).agg(pick("accepted"), pick("duplicate"), pick("conflict"))


def differences(expected: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose counts disagree; a key that one side lacks counts 0 there."""
    e, f = expected.select(*keys, F.col(column).alias("expected")), found.select(*keys, F.col(column).alias("found"))
    joined = e.join(f, keys, "full_outer").fillna(0, ["expected", "found"])
    return joined.where("expected != found")


def limit_reason(bytes_: Column, attributes: Column, most_bytes: int = 1 << 20, most_attributes: int = 1000) -> Column:
    """Why a record is rejected, or null."""
    return F.when(bytes_ > most_bytes, "record_too_large").when(attributes > most_attributes, "too_many_attributes")


def request_limits(records: DataFrame, request: list[str], bytes_: Column, attributes: Column, most_records: int = 10_000, most_total: int = 20 << 20, most_bytes: int = 1 << 20, most_attributes: int = 1000) -> DataFrame:
    """Per request: records, total_bytes (with a comma between records) and reason, null if it is accepted. One record
    beyond its limits rejects the request as a whole."""
    sums = records.groupBy(*request).agg(F.count(F.lit(1)).alias("records"), (F.coalesce(F.sum(bytes_), F.lit(0)) + F.count(F.lit(1)) - 1).alias("total_bytes"), F.max(bytes_).alias("__b"), F.max(attributes).alias("__a"))
    reason = (
        F.when(F.col("__a") > most_attributes, "too_many_attributes").when(F.col("records") > most_records, "too_many_records")
        .when(F.col("__b") > most_bytes, "record_too_large").when(F.col("total_bytes") > most_total, "request_too_large")
    )
    return sums.select(*request, "records", "total_bytes", reason.alias("reason"))


def dedupe_hash(kind: Column, source_event_id: Column, raw: Column) -> Column:
    """sha256 that tells payloads of one source id apart: kind, id and the raw object without its event_id, in canonical form.

    Null for logs, and for records without a valid source id or a raw object.
    """
    own = S.event_id(source_event_id)
    body = F.when(F.ltrim(raw).startswith("{"), S.json_canonical(raw, "event_id"))
    text = F.concat(F.lit('{"version":1,"kind":"'), kind, F.lit('","source_event_id":"'), own, F.lit('","raw":'), body, F.lit("}"))
    return F.when(kind.isin("error", "transaction"), F.sha2(text, 256))
