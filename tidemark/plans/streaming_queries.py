"""Streaming queries over the event files; where the batch result is the same, its SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.registry import query
from tidemark.sources.adapters import RECORDS_SQL, records, records_of, table
from tidemark.plans.pipeline_queries import _ALERTS, _COOLDOWN_SQL, _UNTIL, alerts
from tidemark.streaming import jobs as J
from tidemark.streaming import state as K


def _stream(spark, d):
    return J.stream_records(spark, f"{d}/events.parquet")


def _in_files(spark, d):
    """The events dealt over four files, so that a stream takes several micro-batches that overlap in time."""
    path = J.shared_path(spark, "arrivals")
    table(spark, d, "events").repartition(4, "event_id").write.parquet(path)
    return J.stream_records(spark, path)


def _in_order(spark, d, start, derived=None):
    """``start(stream, out)`` over events that arrive in append order, in four parts: a stop after each, and a start from the checkpoint.

    A part is one micro-batch, however many files it was written in, as rows of a lane must come in order and files of a part do not.
    ``derived`` takes the records of a part to other rows, which arrive beside them, in a stream of their own.
    """
    e, paths, out = table(spark, d, "events"), [J.shared_path(spark, n) for n in ("arrivals", "beside")], J.shared_path(spark, "resumed")
    # Parts end with a sequence, so that rows of one come before all rows of the next.
    last = e.agg(F.max(F.floor(F.col("event_id") / 128))).first()[0] or 0
    for part in range(4):
        rows = e.where((F.floor(F.col("event_id") / 128) * 4 >= part * (last + 1)) & (F.floor(F.col("event_id") / 128) * 4 < (part + 1) * (last + 1)))
        rows.write.mode("append").parquet(paths[0])
        streams = [J.stream_records(spark, paths[0], None)]
        if derived:
            beside = derived(records_of(rows))
            beside.write.mode("append").parquet(paths[1])
            streams.append(spark.readStream.schema(beside.schema).parquet(paths[1]))
        found = start(*streams, out)
    return found


@query("st_ingest", f"{RECORDS_SQL} select record_id, kind, project_id from records")
def _ingest(spark, d):
    return J.run_to_table(_stream(spark, d).select("record_id", "kind", "project_id"), name="ingest")


@query("st_seq", f"{RECORDS_SQL} select lane_id, count(*) as n, true as contiguous, true as in_order from records group by 1")
def _seq(spark, d):
    """Ordinals of each lane and micro-batch run from 0 without gaps, and received times never go back from batch to batch."""
    path = J.run_batches(_in_files(spark, d).select("lane_id", "record_id", "received_time_us"), J.write_sequence, "sequence")
    rows = spark.read.schema("lane_id int, record_id string, received_time_us bigint, stream_seq bigint, stream_ordinal int").option("basePath", path).parquet(f"{path}/batch=*")
    per = rows.groupBy("lane_id", "stream_seq").agg(F.count(F.lit(1)).alias("n"), F.max("stream_ordinal").alias("top"), F.min("received_time_us").alias("lo"), F.max("received_time_us").alias("hi"))
    per = per.withColumn("before", F.lag("hi").over(Window.partitionBy("lane_id").orderBy("stream_seq")))
    return per.groupBy("lane_id").agg(F.sum("n").alias("n"), F.bool_and(F.col("top") == F.col("n") - 1).alias("contiguous"), F.bool_and(F.coalesce(F.col("lo") >= F.col("before"), F.lit(True))).alias("in_order"))


POSITIONS = [(2 + lane // 4, 64) for lane in range(16)]
CUTS = [20 + lane for lane in range(16)]


@query("st_live_tail", f"{RECORDS_SQL} select record_id, lane_id, batch_seq, record_ordinal from records where (batch_seq > 2 + lane_id // 4 or (batch_seq = 2 + lane_id // 4 and record_ordinal > 64)) and batch_seq <= 20 + lane_id order by lane_id, batch_seq, record_ordinal, record_id limit 101")
def _tail(spark, d):
    return J.live_page(records(spark, d), POSITIONS, CUTS).select("record_id", "lane_id", "batch_seq", "record_ordinal")


@query("st_live_init", f"{RECORDS_SQL} select lane_id, max(batch_seq) as batch_seq from records where received_time_us <= (select max(received_time_us) from records) - 900000000 group by 1")
def _init(spark, d):
    """Positions a quarter of an hour before the newest row: how far back a tail may catch up."""
    r = records(spark, d)
    newest = r.agg((F.max("received_time_us") - 900_000_000).alias("limit"))
    return r.crossJoin(F.broadcast(newest)).where("received_time_us <= limit").groupBy("lane_id").agg(F.max("batch_seq").alias("batch_seq"))


@query("st_resume", f"{RECORDS_SQL} select count(*) as n, count(distinct record_id) as ids, count(*) as after_replay from records")
def _resume(spark, d):
    """Half of the events, a stop, the other half and a start from the same checkpoint, then a start with nothing new:
    the table holds each record once. A reader that replays the table drops what it saw by id."""
    e, source, out = table(spark, d, "events"), J.shared_path(spark, "arrivals"), J.shared_path(spark, "resume")
    middle = e.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("bigint")).cast("timestamp_ntz")).first()[0]
    early = F.coalesce(F.col("ts") < F.lit(middle), F.lit(False))
    start = lambda: J.run_to_table(J.stream_records(spark, source).select("record_id"), out=out)
    e.where(early).write.parquet(source)
    start()
    e.where(~early).write.mode("append").parquet(source)
    start()
    rows = start()
    replayed = rows.unionAll(rows).dropDuplicates(["record_id"]).agg(F.count(F.lit(1)).alias("after_replay"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids")).join(replayed)


@query("sink_rows_stream", f"{RECORDS_SQL} select record_id, event_time_us from records where level = 'error'")
def _rows(spark, d):
    return J.run_to_table(_stream(spark, d).where("level = 'error'").select("record_id", "event_time_us"), name="rows")


@query("sink_outbox", f"{RECORDS_SQL} select distinct project_id, received_time_us // 3600000000 as hour from records where level = 'error'")
def _outbox(spark, d):
    """Decisions of three micro-batches and a restart; each hour of a project is sent once."""

    def start(rows, out):
        decided = rows.where("level = 'error'").select("project_id", F.floor(F.col("received_time_us") / 3_600_000_000).alias("hour"))
        with K.rocksdb(spark):
            return J.run_to_table(K.once(decided, ["project_id", "hour"], 30 * 86_400_000), out=out)

    return _in_order(spark, d, start)


@query("st_sliding_count")
def _sliding(spark, d):
    return J.run_to_table(J.sliding_counts(_stream(spark, d), "5 minutes"), name="sliding")


@query("st_tumbling_histogram", f"{RECORDS_SQL} select received_time_us - received_time_us % 3600000000 as bucket, kind, count(*) as n from records group by 1, 2")
def _tumbling(spark, d):
    """Complete mode through batches: every bucket, the open ones too."""
    counts = _stream(spark, d).groupBy((F.col("received_time_us") - F.pmod("received_time_us", F.lit(3_600_000_000))).alias("bucket"), "kind").agg(F.count(F.lit(1)).alias("n"))
    out = J.shared_path(spark, "tumbling")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


@query("st_dedupe", f"""{RECORDS_SQL}, w as (select *, first_value(event_type) over (partition by project_id, kind, source_event_id order by batch_seq, record_ordinal, record_id) as first_type, row_number() over (partition by project_id, kind, source_event_id order by batch_seq, record_ordinal, record_id) as i from records)
  select record_id, case when i = 1 then 'accepted' when event_type = first_type then 'duplicate' else 'conflict' end as class from w""")
def _dedupe(spark, d):
    """Claims of 37 days, longer than the events span; the stream stops and starts again between its parts."""

    def start(rows, out):
        hashed = rows.withColumn("payload_sha256", F.sha2(F.element_at("search_values", 1), 256))
        with K.rocksdb(spark):
            return J.run_to_table(K.classify(hashed, 37 * 86_400_000_000), out=out)

    return _in_order(spark, d, start)


@query("st_dedupe_expiry", f"""{RECORDS_SQL.replace("with records", "with recursive records", 1)}, rows as (select *, row_number() over (partition by project_id, kind, source_event_id order by batch_seq, record_ordinal, record_id) as i from records),
  fold as (
    select project_id, kind, source_event_id, i, record_id, event_type as held, received_time_us + 120000000 as until_us, 'accepted' as class from rows where i = 1
    union all select r.project_id, r.kind, r.source_event_id, r.i, r.record_id, case when f.until_us <= r.received_time_us then r.event_type else f.held end, case when f.until_us <= r.received_time_us then r.received_time_us + 120000000 else f.until_us end,
      case when f.until_us <= r.received_time_us then 'accepted' when f.held = r.event_type then 'duplicate' else 'conflict' end
    from fold f join rows r on r.project_id = f.project_id and r.kind = f.kind and r.source_event_id = f.source_event_id and r.i = f.i + 1)
  select record_id, class from fold""")
def _dedupe_expiry(spark, d):
    """Claims of two minutes: a row that comes later than that is accepted and claims the key anew."""

    def start(rows, out):
        hashed = rows.withColumn("payload_sha256", F.sha2(F.element_at("search_values", 1), 256))
        with K.rocksdb(spark):
            return J.run_to_table(K.classify(hashed, 120_000_000), out=out)

    return _in_order(spark, d, start)


_ACTED = f"""{RECORDS_SQL.replace("with records", "with recursive records", 1)},
  acted as (select project_id, issue_id, batch_seq, event_id as action_id, ['resolved', 'ignored', 'reopened'][(event_id % 3 + 1)::int] as action from records where issue_id is not null and event_id % 4 = 0),
  items as (select *, row_number() over (partition by project_id, issue_id order by batch_seq, act, lane_id, record_ordinal, action_id) as i, sum(1 - act) over (partition by project_id, issue_id order by batch_seq, act, lane_id, record_ordinal, action_id) as seen
    from (select project_id, issue_id, batch_seq, 0 as act, lane_id, record_ordinal, record_id, null as action, null as action_id from records where issue_id is not null
      union all select project_id, issue_id, batch_seq, 1, null, null, null, action, action_id from acted)),
  fold as (
    select project_id, issue_id, i, 'unresolved' as status, 1::bigint as revision, null::bigint as cut, 'created' as type, record_id, seen from items where i = 1
    union all select n.project_id, n.issue_id, n.i,
      case when n.act = 1 then case n.action when 'reopened' then 'unresolved' else n.action end when f.status = 'resolved' and n.batch_seq > f.cut + n.lane_id % 3 then 'unresolved' else f.status end,
      f.revision + case when n.act = 1 then (f.status <> case n.action when 'reopened' then 'unresolved' else n.action end)::int else (f.status = 'resolved' and n.batch_seq > f.cut + n.lane_id % 3)::int end,
      case when n.act = 1 and n.action = 'resolved' and f.status <> 'resolved' then n.batch_seq else f.cut end,
      case when n.act = 1 then case when f.status <> case n.action when 'reopened' then 'unresolved' else n.action end then n.action end when f.status = 'resolved' and n.batch_seq > f.cut + n.lane_id % 3 then 'regressed' end, n.record_id, n.seen
    from fold f join items n on n.project_id = f.project_id and n.issue_id = f.issue_id and n.i = f.i + 1)
  select project_id, issue_id, revision, type, record_id, seen::bigint as occurrences from fold where type is not null"""


@query("st_issue_transitions", _ACTED)
def _issue_transitions(spark, d):
    """Occurrences and actions as two streams; actions arrive between the micro-batches, and a resolution's cut lies up to two sequences ahead."""

    def actions(rows):
        acted = rows.where("issue_id is not null and event_id % 4 = 0")
        name = F.get(F.array(F.lit("resolved"), F.lit("ignored"), F.lit("reopened")), (F.col("event_id") % 3).cast("int"))
        cut = F.array(*(F.col("batch_seq") + lane % 3 for lane in range(K.LANES)))
        return acted.select("project_id", "issue_id", "batch_seq", F.col("event_id").alias("action_id"), name.alias("action"), cut.alias("cut"))

    def start(rows, acts, out):
        with K.rocksdb(spark):
            return J.run_to_table(K.issue_transitions(rows, acts), out=out)

    return _in_order(spark, d, start, derived=actions)


def _evaluated(spark, d):
    """Every window that the stream's received times have passed, over a stop and a restart."""
    rules = J.shared_path(spark, "rules")
    alerts(spark, d).withColumn("cooldown_seconds", F.lit(900)).write.parquet(rules)

    def start(rows, out):
        with K.rocksdb(spark, without_data=True):
            return J.run_to_table(K.alert_evaluations(rows, spark.read.parquet(rules)), out=out)

    return _in_order(spark, d, start).where(F.col("window_end_us") <= _UNTIL)


@query("st_alert_windows", f"{_ALERTS} select alert_id, window_end_us, observed, hit from hits")
def _alert_windows(spark, d):
    return _evaluated(spark, d).select("alert_id", "window_end_us", "observed", "hit")


@query("st_alert_cooldown", _COOLDOWN_SQL)
def _alert_cooldown(spark, d):
    return _evaluated(spark, d).where("fired").select("alert_id", F.col("window_end_us").alias("fired_us"))


@query("st_issue_state", f"""{RECORDS_SQL}, state as (select project_id, issue_id, case when project_id % 2 = 0 then 'resolved' else 'ignored' end as status, 3 as revision from (select distinct project_id, issue_id, exception_type from records where issue_id is not null) where exception_type <> 'E1'),
  hit as (select r.*, s.status, s.revision, s.status is null or (s.status = 'resolved' and batch_seq > 5 + lane_id) as hit from records r left join state s using (project_id, issue_id) where issue_id is not null)
  select project_id, issue_id, count(*) as occurrences, min(event_time_us) as first_us, max(event_time_us) as last_us, case when not bool_or(hit) then null when max(status) is null then 'created' else 'regressed' end as type,
  min_by(record_id, (batch_seq, lane_id, record_ordinal, record_id)) filter (where hit) as record_id, (coalesce(max(revision), 0) + bool_or(hit)::int)::int as revision from hit group by 1, 2""")
def _issues(spark, d):
    """Issues of E1 are new to the stream; of the others, projects of even number are resolved, the rest ignored."""
    found = records(spark, d).where("issue_id is not null and exception_type != 'E1'").select("project_id", "issue_id").distinct()
    known = found.select("project_id", "issue_id", F.when(F.col("project_id") % 2 == 0, "resolved").otherwise("ignored").alias("status"), F.lit(3).alias("revision"), F.sequence(F.lit(5).cast("bigint"), F.lit(20).cast("bigint")).alias("resolved_cut"))
    path = J.shared_path(spark, "known")
    known.write.parquet(path)
    states = J.issue_states(_in_files(spark, d), spark.read.parquet(path))
    out = J.run_batches(states, lambda df, i, to: df.write.mode("overwrite").parquet(f"{to}/batch={i}"), "issues", "update")
    return J.latest_states(spark.read.option("basePath", out).parquet(f"{out}/batch=*"))


@query("st_late_data", f"{RECORDS_SQL} select kind, count(*) as n from records group by 1")
def _late(spark, d):
    """No record is too late: rows pass whatever their event time is."""
    passed = J.run_to_table(_stream(spark, d).withWatermark("received", "10 minutes").select("record_id", "kind"), name="late")
    return passed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


