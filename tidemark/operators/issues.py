"""Issues: fingerprints, state per issue, transitions and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.rows import running

ISSUE = ["project_id", "issue_id"]
MOMENT = ("event_time_us", "event_time_ns_remainder", "record_id")


def fingerprint(project_id: Column, raw: Column, message: Column, template: Column) -> Column:
    """sha256 of the group as JSON text: the project, then a custom fingerprint, where {{default}} stands for the rest, or
    that rest: all exception types with the last eight frames of the last exception (those in the app, if any are),
    else its type and value, else the message template, else the message."""
    text = lambda c: F.coalesce(c, F.lit(""))
    said = F.to_json(F.array(F.lit("message"), F.coalesce(template, message, F.lit(""))))

    def stack(types: Column, every: Column) -> Column:
        chosen = S.let(F.filter(every, lambda f: F.coalesce(f["in_app"], F.lit(False))), lambda own: F.when(F.size(own) > 0, own).otherwise(every))
        last = S.let(chosen, lambda c: F.slice(c, F.greatest(F.size(c) - 7, F.lit(1)), F.lit(8)))
        frames = F.transform(last, lambda f: F.array(text(f["module"]), text(f["function"]), F.replace(text(f["filename"]), F.lit("\\"), F.lit("/"))))
        return F.concat(F.lit('["stack",'), F.to_json(types), F.lit(","), F.to_json(frames), F.lit("]"))

    def thrown(chain: Column, last: Column) -> Column:
        every = F.filter(F.coalesce(last["stacktrace"]["frames"], F.array().cast("array<struct<module:string,function:string,filename:string,in_app:boolean>>")), lambda f: f.isNotNull())
        bare = F.to_json(F.array(F.lit("exception"), text(last["type"]), text(last["value"])))
        return S.let(every, lambda e: F.when(F.size(e) > 0, stack(F.transform(chain, lambda x: text(x["type"])), e)).otherwise(bare))

    default = S.let(S.exceptions(raw), lambda chain: F.when(F.coalesce(F.size(chain), F.lit(0)) <= 0, said).otherwise(S.let(F.element_at(chain, -1), lambda last: thrown(chain, last))))

    def named(custom: Column, default: Column) -> Column:
        return F.transform(custom, lambda p: F.when(p.isin("{{default}}", "{{ default }}"), F.concat(F.lit('["default",'), default, F.lit("]"))).otherwise(F.to_json(F.array(F.lit("literal"), p))))

    def grouped(p: Column) -> Column:
        # Only a list of nothing but strings counts.
        listed = lambda c: F.when((F.size(c) > 0) & (F.to_json(c) == p["given"]), F.concat(F.lit('["custom",['), F.array_join(named(c, p["default"]), ","), F.lit("]]"))).otherwise(p["default"])
        return F.when(p["given"].isNull(), p["default"]).otherwise(S.let(F.from_json(p["given"], "array<string>"), listed))

    group = S.let(F.struct(default.alias("default"), F.when(S.mentions(raw, "fingerprint"), F.get_json_object(raw, "$.fingerprint")).alias("given")), grouped)
    return F.sha2(F.concat(F.lit('["grouping-v1",'), F.to_json(F.array(project_id.cast("string"))), F.lit(","), group, F.lit("]")), 256)


def title(message: Column, kind: Column, value: Column) -> Column:
    """The message; without one, type and value of the exception; 512 characters."""
    said = lambda c: F.nullif(c, F.lit(""))
    return S.truncate_runes(F.coalesce(said(message), F.concat_ws(": ", said(kind), said(value))))


def summarise(occurrences: DataFrame) -> DataFrame:
    """State per issue: count, first and last occurrence by (time, ns, id), last received, title of the first."""
    moment = F.struct(*MOMENT)
    return occurrences.groupBy(*ISSUE).agg(F.count(F.lit(1)).alias("occurrences"), F.min(moment).alias("first"), F.max(moment).alias("last"), F.max("received_time_us").alias("last_received_us"), F.min_by("message", moment).alias("title"))


def upsert(state: DataFrame, known_ids: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The state after more occurrences; a record that is known already changes nothing."""
    fresh = summarise(occurrences.join(known_ids.select("record_id"), "record_id", "left_anti").dropDuplicates(["record_id"]))
    both = state.unionByName(fresh)
    return both.groupBy(*ISSUE).agg(F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("last_received_us").alias("last_received_us"), F.min_by("title", "first").alias("title"))


def transitions(state: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(project, issue, type, record_id, revision): created for new issues; regressed for resolved ones at the first row,
    in append order, beyond the cut that the resolution took of its lane.

    ``state``: project, issue, status, revision, resolved_cut array<bigint> (by lane).
    """
    order = F.struct("batch_seq", "lane_id", "record_ordinal", "record_id")
    joined = occurrences.join(state, ISSUE, "left")
    beyond = (F.col("status") == "resolved") & (F.col("batch_seq") > F.get("resolved_cut", F.col("lane_id")))
    hit = joined.where(F.col("status").isNull() | beyond)
    first = hit.groupBy(*ISSUE).agg(F.min_by(F.struct("record_id", "status", "revision"), order).alias("x"))
    return first.select(*ISSUE, F.when(F.col("x.status").isNull(), "created").otherwise("regressed").alias("type"), F.col("x.record_id").alias("record_id"), (F.coalesce("x.revision", F.lit(0)) + 1).alias("revision"))


def apply_actions(actions: DataFrame, order: str) -> DataFrame:
    """``actions`` (issue_id, target) with the revision after each; an action into the state that holds changes nothing.

    An issue starts unresolved. Each action sets its state whatever came before, so the fold is a comparison with the
    target before, and a sum of the changes: two scans over ranges, however many actions one issue has.
    """
    before = running(actions, ["issue_id"], [F.col(order)], F.col("target"), "__before", "last", before=True)
    changed = before.withColumn("changed", (F.coalesce("__before", F.lit("unresolved")) != F.col("target")).cast("int")).drop("__before")
    summed = running(changed, ["issue_id"], [F.col(order)], F.col("changed"), "revision")
    return summed.withColumn("revision", F.col("revision") + 1)
