"""Alerts: minute-aligned sliding counts, cooldown, completeness and issue decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.rows import running

MINUTE = 60_000_000


def first_window_end(created_us: Column, window_seconds: Column) -> Column:
    """The next full minute after creation, and one window more."""
    return (F.floor(created_us / MINUTE) + 1) * MINUTE + window_seconds.cast("bigint") * 1_000_000


def due_windows(alerts: DataFrame, until_us: int) -> DataFrame:
    """(alert columns, window_end_us): every minute from the first window's end."""
    first = first_window_end(F.col("created_us"), F.col("window_seconds"))
    due = alerts.where(first <= until_us)
    return due.withColumn("window_end_us", F.explode(F.sequence(first.cast("bigint"), F.lit(until_us).cast("bigint"), F.lit(MINUTE).cast("bigint"))))


def window_counts(windows: DataFrame, records: DataFrame) -> DataFrame:
    """``windows`` with ``observed``: records of the project received in [end - length, end); windows without any count 0.

    Records shrink to counts per project and minute first; running sums over
    the minutes then give any window as a difference of two looked-up values,
    so no row is copied into the windows it falls in.
    """
    minutes = records.groupBy("project_id", F.floor(F.col("received_time_us") / MINUTE).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    edges = windows.select("project_id", F.floor(F.col("window_end_us") / MINUTE).alias("hi"), F.floor((F.col("window_end_us") - F.col("window_seconds").cast("bigint") * 1_000_000) / MINUTE).alias("lo"))
    asked = edges.select("project_id", F.explode(F.array("hi", "lo")).alias("minute")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    # Rows of one project and day are summed in order; the days' totals are added up beside them.
    both = minutes.unionByName(asked).groupBy("project_id", "minute").agg(F.sum("n").alias("n")).withColumn("day", F.floor(F.col("minute") / 1440))
    in_day = Window.partitionBy("project_id", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("project_id", "day").agg(F.sum("n").alias("day_n"))
    before = days.withColumn("base", F.coalesce(F.sum("day_n").over(Window.partitionBy("project_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("day_n")
    total = both.withColumn("part", F.coalesce(F.sum("n").over(in_day), F.lit(0))).join(before, ["project_id", "day"]).select("project_id", "minute", (F.col("base") + F.col("part")).alias("until"))
    keyed = windows.withColumn("hi", F.floor(F.col("window_end_us") / MINUTE)).withColumn("lo", F.floor((F.col("window_end_us") - F.col("window_seconds").cast("bigint") * 1_000_000) / MINUTE))
    up = total.select("project_id", F.col("minute").alias("hi"), F.col("until").alias("u"))
    down = total.select("project_id", F.col("minute").alias("lo"), F.col("until").alias("v"))
    return keyed.join(up, ["project_id", "hi"]).join(down, ["project_id", "lo"]).withColumn("observed", F.col("u") - F.col("v")).drop("hi", "lo", "u", "v")


def breached(observed: Column, operator: Column, threshold: Column) -> Column:
    return F.when(operator == "gt", observed > threshold).when(operator == "ge", observed >= threshold).when(operator == "lt", observed < threshold).when(operator == "le", observed <= threshold).otherwise(F.raise_error(F.lit("unknown operator")).cast("boolean"))


def with_cooldown(hits: DataFrame, keys: list[str], at: str, cooldown: str) -> DataFrame:
    """(keys, fired array): in order, a hit fires if the cooldown since the last one that fired is over.

    Only the hits' times are gathered, per alert: eight bytes for each window that is over its threshold.
    """
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("fired"))

    def step(acc: Column, t: Column) -> Column:
        go = acc["last"].isNull() | (t - acc["last"] >= F.col("__cool"))
        return F.struct(F.when(go, t).otherwise(acc["last"]).alias("last"), F.when(go, F.concat(acc["fired"], F.array(t))).otherwise(acc["fired"]).alias("fired"))

    gathered = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(at).cast("bigint"))).alias("__t"), F.first(F.col(cooldown).cast("bigint") * 1_000_000).alias("__cool"))
    return gathered.select(*keys, F.aggregate("__t", start, step)["fired"].alias("fired"))


def decisions(pending: DataFrame, enabled: Column, cooldown: Column) -> DataFrame:
    """``pending`` (alert_id, lane_id, batch_seq, record_id, received_time_us and more) with ``decision``: disabled, sent or cooldown.

    An alert's transitions are taken by lane, sequence and id. Evaluation times never go back, and of rows that share
    the time of a firing the first one is sent; without a cooldown (0 seconds) all are.
    """
    order = [F.col(c) for c in ("lane_id", "batch_seq", "record_id")]
    rows = pending.withColumn("__enabled", F.coalesce(enabled, F.lit(False))).withColumn("__cooldown", cooldown.cast("bigint"))
    rows = running(rows, ["alert_id"], order, F.col("received_time_us"), "__so_far", "max", before=True)
    rows = rows.withColumn("__at", F.greatest("__so_far", "received_time_us")).withColumn("__new", F.coalesce(F.col("__at") > F.col("__so_far"), F.lit(True))).drop("__so_far")
    hits = rows.where("__enabled and __new and __cooldown > 0")
    fired = with_cooldown(hits, ["alert_id"], "__at", "__cooldown").select("alert_id", F.explode("fired").alias("__at")).withColumn("__fired", F.lit(True))
    sent = (F.col("__cooldown") <= 0) | (F.col("__fired") & F.col("__new"))
    decided = F.when(~F.col("__enabled"), "disabled").when(sent, "sent").otherwise("cooldown")
    return rows.join(fired, ["alert_id", "__at"], "left").withColumn("decision", decided).select(*pending.columns, "decision")


def complete(windows: DataFrame, lanes: DataFrame) -> DataFrame:
    """Windows with ``state``: ready when every lane has published its reserved cut, failed when the retention floor has passed the start, else waiting.

    ``lanes``: window_end_us, lane_id, cut, published.
    """
    done = lanes.groupBy("window_end_us").agg(F.bool_and(F.col("published") >= F.col("cut")).alias("done"))
    return windows.join(done, "window_end_us", "left").withColumn("state", F.when(F.col("floor_us") > F.col("window_start_us"), "failed").when(F.col("done"), "ready").otherwise("waiting")).drop("done")


def barrier(rows: DataFrame) -> DataFrame:
    """Received times that never go back within a lane, in append order; a busy lane is scanned in ranges."""
    lifted = running(rows, ["lane_id"], [F.col("batch_seq"), F.col("record_ordinal")], F.col("received_time_us"), "__lifted", "max")
    return lifted.withColumn("received_time_us", F.col("__lifted")).drop("__lifted")
