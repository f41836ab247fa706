"""Queries of acceptance, issues, alerts, maintenance, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import aggregates as A
from tidemark.operators import alerts as L
from tidemark.operators import ingest as I
from tidemark.operators import issues as S
from tidemark.operators import maintenance as M
from tidemark.operators import rows as R
from tidemark.functions import scalars
from tidemark.plans.registry import query
from tidemark.plans.search_queries import DAY, START
from tidemark.sources.adapters import RECORDS_SQL, records, table
from tidemark.sources.io import read_files, read_json_lines, read_staged, shared_path, write_json_lines, write_payloads, write_records

# --- acceptance ---------------------------------------------------------------------------------

_CLAIMS = f"""{RECORDS_SQL}, cand as (select *, case when event_id % 11 = 3 then null else source_event_id end as sid, sha256(event_type) as hash from records),
  claims as (select project_id, kind, sid, min(hash) as hash, max(received_time_us) + (event_id_mod) * 0 as expires from (select *, 0 as event_id_mod from cand where event_id % 9 = 0 and sid is not null) group by project_id, kind, sid, event_id_mod),
  firsts as (select project_id, kind, sid, min(struct_pack(b := batch_seq, o := record_ordinal, r := record_id, h := hash, t := received_time_us)) as w from cand where sid is not null group by all),
  win as (select f.project_id, f.kind, f.sid, case when c.expires > f.w.t then c.hash end as ch, f.w.h as fh, f.w.r as fr from firsts f left join claims c using (project_id, kind, sid)),
  classified as (select c.*, case when c.sid is null then 'accepted' when w.ch is null and c.record_id = w.fr then 'accepted' when c.hash = coalesce(w.ch, w.fh) then 'duplicate' else 'conflict' end as class
    from cand c left join win w on w.project_id = c.project_id and w.kind = c.kind and w.sid = c.sid)
"""


def candidates(spark, d):
    r = records(spark, d)
    sid = F.when(F.col("event_id") % 11 != 3, F.col("source_event_id"))
    return r.select("record_id", "project_id", "kind", sid.alias("source_event_id"), F.sha2(F.element_at("search_values", 1), 256).alias("payload_sha256"), "received_time_us", "batch_seq", "record_ordinal", "lane_id", "event_id")


def claims(spark, d):
    named = candidates(spark, d).where("event_id % 9 = 0 and source_event_id is not null")
    return named.groupBy(*I.KEY).agg(F.min("payload_sha256").alias("payload_sha256"), F.max("received_time_us").alias("expires_us"))


def classified(spark, d):
    return I.classify(candidates(spark, d), claims(spark, d), ["batch_seq", "record_ordinal", "record_id"])


@query("dedupe_classify", f"{_CLAIMS} select record_id, class from classified")
def _classify(spark, d):
    return classified(spark, d).select("record_id", "class")


_DEDUPE_RAW = """'{' || case when event_id % 2 = 0 then '"exception":{"values":[{"type":"Base","value":"v"},{"mechanism":{"handled":' || case when event_id % 4 = 0 then 'true' else 'false' end || '},"stacktrace":{"frames":[{"filename":"a.py","function":"f","in_app":true,"module":"m' || user_id % 3 || '"}]},"type":"E' || user_id % 5 || '","value":"' || event_type || ' failed"}]},' else '' end
    || '"level":"' || event_type || '",' || case when event_id % 3 = 0 then '"logentry":{"formatted":"took ' || event_id % 50 || '","message":"took %s"},' when event_id % 5 = 0 then '"message":"plain ' || event_id % 11 || '",' else '' end
    || '"tags":{"a.b":"x' || event_id || '","service.name":"svc-' || user_id % 7 || '"},"user":{"id":' || user_id || ',"password":"p' || user_id || '"}}'"""


@query("dedupe_hash", f"""select event_id, case when event_id % 3 < 2 and event_id % 7 > 0 then sha256('{{"version":1,"kind":"' || case event_id % 3 when 0 then 'error' else 'transaction' end || '","source_event_id":"' || md5(event_id::varchar) || '","raw":' || {_DEDUPE_RAW} || '}}') end as hash from events""")
def _hash(spark, d):
    """Errors, transactions and logs in turn; every seventh has no valid id, and ids come with hyphens and capitals."""
    from tidemark.plans.scalar_queries import raw_events

    own = F.upper(F.md5(F.col("event_id").cast("string")))
    source = F.when(F.col("event_id") % 7 == 0, "not-an-id").otherwise(F.concat(F.substring(own, 1, 8), F.lit("-"), F.substring(own, 9, 24)))
    kind = F.get(F.array(*map(F.lit, ("error", "transaction", "log"))), (F.col("event_id") % 3).cast("int"))
    return raw_events(spark, d).select("event_id", I.dedupe_hash(kind, source, F.col("raw")).alias("hash"))


@query("dedupe_expiry", f"""{_CLAIMS}, fresh as (select project_id, kind, sid, hash, received_time_us + 37 * 86400000000 as expires from classified where class = 'accepted' and sid is not null)
  select kind, count(*) as claims, max(expires) as latest from (select * from fresh union all select project_id, kind, sid, hash, expires from claims c where not exists (select 1 from fresh f where f.project_id = c.project_id and f.kind = c.kind and f.sid = c.sid)) group by 1""")
def _expiry(spark, d):
    after = I.claims_after(claims(spark, d), I.new_claims(classified(spark, d), 30))
    return after.groupBy("kind").agg(F.count(F.lit(1)).alias("claims"), F.max("expires_us").alias("latest"))


_COUNTS = "select batch_seq, count(*) filter (where class = 'accepted') as accepted_count, count(*) filter (where class = 'duplicate') as duplicate_count, count(*) filter (where class = 'conflict') as conflict_count, count(*) as records from classified group by 1"


@query("receipt_counts", f"{_CLAIMS} {_COUNTS}")
def _receipt_counts(spark, d):
    return I.counts(classified(spark, d), ["batch_seq"])


@query("receipt_ranges", f"""{_CLAIMS}, m as (select batch_seq, record_ordinal, class, case when lag(class) over w = class and lag(record_ordinal) over w = record_ordinal - 1 then 0 else 1 end as new from classified window w as (partition by batch_seq order by record_ordinal)),
  g as (select *, sum(new) over (partition by batch_seq order by record_ordinal) as run from m), r as (select batch_seq, class, min(record_ordinal) as a, max(record_ordinal) as b from g group by batch_seq, run, class)
  select batch_seq, coalesce(list([a, b] order by a) filter (where class = 'accepted'), []) as accepted, coalesce(list([a, b] order by a) filter (where class = 'duplicate'), []) as duplicate, coalesce(list([a, b] order by a) filter (where class = 'conflict'), []) as conflict from r group by 1""")
def _receipt_ranges(spark, d):
    return I.ranges(classified(spark, d), ["batch_seq"], "record_ordinal")


@query("select_accepted", f"{_CLAIMS} select record_id from classified where class = 'accepted'")
def _accepted(spark, d):
    return classified(spark, d).where("class = 'accepted'").select("record_id")


@query("reconcile_receipts", f"{_CLAIMS}, e as (select batch_seq, count(*) as n from classified where class = 'accepted' group by 1), f as (select batch_seq, count(*) as n from classified where class = 'accepted' and event_id % 1000 <> 5 group by 1) select batch_seq, coalesce(e.n, 0) as expected, coalesce(f.n, 0) as found from e full join f using (batch_seq) where coalesce(e.n, 0) <> coalesce(f.n, 0)")
def _reconcile(spark, d):
    c = classified(spark, d).where("class = 'accepted'")
    n = lambda x: x.groupBy("batch_seq").agg(F.count(F.lit(1)).alias("n"))
    return I.differences(n(c), n(c.where("event_id % 1000 != 5")), ["batch_seq"], "n")


@query("limit_gate", "select doc_id, case when strlen(text) > 20000 then 'record_too_large' when len(string_split(text, ' ')) > 1000 then 'too_many_attributes' end as reason from documents")
def _gate(spark, d):
    reason = I.limit_reason(F.octet_length("text"), F.size(F.split("text", " ")), most_bytes=20_000)
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("limit_requests", """with r as (select doc_id // 16 as request, count(*) as records, coalesce(sum(strlen(text)), 0) + count(*) - 1 as total_bytes, max(strlen(text)) as b, max(len(string_split(text, ' '))) as a from documents group by 1)
  select request, records, total_bytes, case when a > 1000 then 'too_many_attributes' when b > 5000 then 'record_too_large' when total_bytes > 16000 then 'request_too_large' end as reason from r""")
def _limit_requests(spark, d):
    """Documents as requests of sixteen, with limits low enough to meet."""
    docs = table(spark, d, "documents").withColumn("request", F.floor(F.col("doc_id") / 16))
    return I.request_limits(docs, ["request"], F.octet_length("text"), F.size(F.split("text", " ")), most_total=16_000, most_bytes=5_000)


# --- issues -------------------------------------------------------------------------------------

_ISSUES = "select project_id, issue_id, count(*) as occurrences, min(event_time_us) as first_us, max(event_time_us) as last_us, max(received_time_us) as last_received_us, min_by(message, (event_time_us, event_time_ns_remainder, record_id)) as title from records where issue_id is not null group by all"


def occurrences(spark, d):
    return records(spark, d).where("issue_id is not null")


def _flat(state):
    return state.select("project_id", "issue_id", "occurrences", F.col("first.event_time_us").alias("first_us"), F.col("last.event_time_us").alias("last_us"), "last_received_us", "title")


@query("agg_issue", f"{RECORDS_SQL} {_ISSUES}")
def _issue(spark, d):
    return _flat(S.summarise(occurrences(spark, d)))


@query("issue_upsert", f"{RECORDS_SQL} {_ISSUES}")
def _upsert(spark, d):
    """Old state, then a batch that repeats a part of it: the result is the state over all rows."""
    o = occurrences(spark, d)
    old = o.where("event_id % 3 != 0")
    return _flat(S.upsert(S.summarise(old), old, o.where("event_id % 3 = 0 or event_id % 2 = 0")))


@query("issue_title", f"{RECORDS_SQL} select record_id, substr(case when event_id % 3 = 0 then coalesce(exception_type, '') when message <> '' then message else coalesce(exception_type, '') end, 1, 512) as title from records")
def _title(spark, d):
    """The message comes first; every third record has none, and no value either."""
    r = records(spark, d)
    return r.select("record_id", S.title(F.when(F.col("event_id") % 3 != 0, F.col("message")), F.col("exception_type"), F.lit("")).alias("title"))


_FINGERPRINT = """select event_id, sha256('["grouping-v1",["' || user_id % 4 || '"],' || case
    when event_id % 2 = 0 then '["stack",["Base","E' || user_id % 5 || '"],[["m' || user_id % 3 || '","f","a.py"]]]'
    when event_id % 3 = 0 then '["message","took %s"]' when event_id % 5 = 0 then '["message","plain ' || event_id % 11 || '"]' else '["message",""]' end || ']') as issue_id from events"""


@query("issue_fingerprint", _FINGERPRINT)
def _fingerprint(spark, d):
    from tidemark.plans.scalar_queries import raw_events

    # What is said is read only where the fingerprint asks for it.
    said = scalars.let(scalars.event_told(F.col("raw")), lambda t: F.coalesce(t["template"], t["message"]))
    return raw_events(spark, d).select("event_id", S.fingerprint(F.col("user_id") % 4, F.col("raw"), said, F.lit(None)).alias("issue_id"))


@query("issue_transitions", f"""{RECORDS_SQL}, state as (select project_id, issue_id, case when project_id % 2 = 0 then 'resolved' else 'ignored' end as status, 3 as revision from (select distinct project_id, issue_id, exception_type from records where issue_id is not null) where exception_type <> 'E1'),
  hit as (select r.*, s.status, s.revision from records r left join state s using (project_id, issue_id) where issue_id is not null and (s.status is null or (s.status = 'resolved' and batch_seq > 5 + lane_id)))
  select project_id, issue_id, case when min_by(coalesce(status, 'none'), (batch_seq, lane_id, record_ordinal, record_id)) = 'none' then 'created' else 'regressed' end as type, min_by(record_id, (batch_seq, lane_id, record_ordinal, record_id)) as record_id, (coalesce(max(revision), 0) + 1)::int as revision from hit group by 1, 2""")
def _transitions(spark, d):
    o = occurrences(spark, d)
    state = o.where("exception_type != 'E1'").select("project_id", "issue_id").distinct()
    state = state.select("project_id", "issue_id", F.when(F.col("project_id") % 2 == 0, "resolved").otherwise("ignored").alias("status"), F.lit(3).alias("revision"), F.sequence(F.lit(5).cast("bigint"), F.lit(20).cast("bigint")).alias("resolved_cut"))
    return S.transitions(state, o)


@query("issue_actions", """with a as (select event_id, user_id % 50 as issue_id, case event_type when 'click' then 'resolved' when 'view' then 'ignored' else 'unresolved' end as target from events),
  c as (select *, (coalesce(lag(target) over (partition by issue_id order by event_id), 'unresolved') <> target)::int as changed from a)
  select event_id, issue_id, target, changed, (1 + sum(changed) over (partition by issue_id order by event_id))::bigint as revision from c""")
def _actions(spark, d):
    target = F.when(F.col("event_type") == "click", "resolved").when(F.col("event_type") == "view", "ignored").otherwise("unresolved")
    return S.apply_actions(table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("issue_id"), target.alias("target")), "event_id")


@query("page_issues", f"{RECORDS_SQL}, i as ({_ISSUES}) select issue_id, project_id, last_received_us from i where (last_received_us, issue_id) < ((select max(last_received_us) from i), 'f') order by last_received_us desc, issue_id desc limit 6")
def _page_issues(spark, d):
    state = S.summarise(occurrences(spark, d))
    top = state.agg(F.max("last_received_us").alias("top"))
    rest = state.crossJoin(F.broadcast(top)).where(F.struct("last_received_us", "issue_id") < F.struct("top", F.lit("f")))
    return rest.orderBy(F.desc("last_received_us"), F.desc("issue_id")).limit(6).select("issue_id", "project_id", "last_received_us")


@query("page_occurrences", f"{RECORDS_SQL} select record_id, event_time_us, event_time_ns_remainder, received_time_us >= {START + DAY} as retained from records where issue_id is not null order by event_time_us desc, event_time_ns_remainder desc, record_id desc limit 51")
def _page_occurrences(spark, d):
    o = R.page(occurrences(spark, d), R.EVENT_ORDER, 50)
    return o.select("record_id", "event_time_us", "event_time_ns_remainder", (F.col("received_time_us") >= START + DAY).alias("retained"))


# --- alerts -------------------------------------------------------------------------------------

_UNTIL = START + DAY


def alerts(spark, d):
    """One rule per project and window length that the records show."""
    p = records(spark, d).select("project_id").distinct()
    a = p.withColumn("window_seconds", F.explode(F.array(F.lit(300), F.lit(3600))))
    return a.select((F.col("project_id") * 10 + (F.col("window_seconds") > 300).cast("int")).alias("alert_id"), "project_id", "window_seconds", (F.lit(START) + F.col("project_id") * 1_000_001).alias("created_us"), F.when(F.col("window_seconds") > 300, "ge").otherwise("lt").alias("operator"), F.when(F.col("window_seconds") > 300, 15).otherwise(1).alias("threshold"))


_ALERTS = f"""{RECORDS_SQL}, alerts as (select project_id * 10 + (w > 300)::int as alert_id, project_id, w::bigint as window_seconds, {START} + project_id * 1000001 as created_us from (select distinct project_id from records), (values (300), (3600)) v(w)),
  due as (select alert_id, project_id, window_seconds, unnest(range((created_us // 60000000 + 1) * 60000000 + window_seconds * 1000000, {_UNTIL} + 1, 60000000)) as window_end_us from alerts),
  counted as (select due.*, (select count(*) from records r where r.project_id = due.project_id and r.received_time_us >= due.window_end_us - due.window_seconds * 1000000 and r.received_time_us < due.window_end_us) as observed from due),
  hits as (select *, case when window_seconds > 300 then observed >= 15 else observed < 1 end as hit from counted)
"""


def counted(spark, d):
    return L.window_counts(L.due_windows(alerts(spark, d), _UNTIL), records(spark, d))


@query("alert_windows", f"{_ALERTS} select alert_id, window_end_us from due")
def _windows(spark, d):
    return L.due_windows(alerts(spark, d), _UNTIL).select("alert_id", "window_end_us")


@query("alert_threshold_count", f"{_ALERTS} select alert_id, window_end_us, observed from counted")
def _threshold(spark, d):
    return counted(spark, d).select("alert_id", "window_end_us", "observed")


@query("alert_compare", f"{_ALERTS} select alert_id, window_end_us, hit from hits")
def _compare(spark, d):
    return counted(spark, d).select("alert_id", "window_end_us", L.breached(F.col("observed"), F.col("operator"), F.col("threshold")).alias("hit"))


_COOLDOWN_SQL = f"""{_ALERTS.replace("with records", "with recursive records", 1)}, fire as (
   select alert_id, min(window_end_us) as fired_us from hits where hit group by 1
   union all select f.alert_id, (select min(h.window_end_us) from hits h where h.hit and h.alert_id = f.alert_id and h.window_end_us >= f.fired_us + 900000000) as fired_us from fire f where f.fired_us is not null)
  select alert_id, fired_us from fire where fired_us is not null"""


@query("alert_cooldown", _COOLDOWN_SQL)
def _cooldown(spark, d):
    hits = counted(spark, d).where(L.breached(F.col("observed"), F.col("operator"), F.col("threshold"))).withColumn("cooldown", F.lit(900).cast("bigint"))
    return L.with_cooldown(hits, ["alert_id"], "window_end_us", "cooldown").select("alert_id", F.explode("fired").alias("fired_us"))


@query("alert_completeness", f"""{RECORDS_SQL}, lanes as (select received_time_us // {DAY} * {DAY} + {DAY} as window_end_us, lane_id, max(batch_seq) as cut, max(batch_seq) filter (where event_id % 1000 <> 999) as published from records group by 1, 2)
  select window_end_us, case when {START} > window_end_us - {DAY} then 'failed' when bool_and(coalesce(published, 0) >= cut) then 'ready' else 'waiting' end as state from lanes group by 1""")
def _completeness(spark, d):
    end = A.bucket(F.col("received_time_us"), DAY) + DAY
    lanes = records(spark, d).groupBy(end.alias("window_end_us"), "lane_id").agg(F.max("batch_seq").alias("cut"), F.coalesce(F.max(F.when(F.col("event_id") % 1000 != 999, F.col("batch_seq"))), F.lit(0)).alias("published"))
    windows = lanes.select("window_end_us").distinct().select("window_end_us", (F.col("window_end_us") - DAY).alias("window_start_us"), F.lit(START).alias("floor_us"))
    return L.complete(windows, lanes).select("window_end_us", "state")


@query("alert_barrier", f"{RECORDS_SQL} select record_id, max(received_time_us) over (partition by lane_id order by batch_seq, record_ordinal) as received_time_us from records")
def _barrier(spark, d):
    return L.barrier(records(spark, d)).select("record_id", "received_time_us")


_TRANS = f"""{RECORDS_SQL}, trans as (select project_id, issue_id, case when event_id % 2 = 0 then 'created' else 'regressed' end as type, lane_id, batch_seq, record_id, received_time_us from records where issue_id is not null and event_id % 3 = 0),
  rules as (select project_id * 100 as alert_id, project_id, case when project_id % 2 = 0 then ['created'] else ['created', 'regressed'] end as events from (select distinct project_id from records)),
  pending as (select a.alert_id, t.* from trans t join rules a using (project_id) where list_contains(a.events, t.type) and t.batch_seq > 2 + t.lane_id)
"""


def pending(spark, d):
    t = occurrences(spark, d).where("event_id % 3 = 0").withColumn("type", F.when(F.col("event_id") % 2 == 0, "created").otherwise("regressed"))
    rules = records(spark, d).select("project_id").distinct().select((F.col("project_id") * 100).alias("alert_id"), "project_id", F.when(F.col("project_id") % 2 == 0, F.array(F.lit("created"))).otherwise(F.array(F.lit("created"), F.lit("regressed"))).alias("events"), F.sequence(F.lit(2).cast("bigint"), F.lit(17).cast("bigint")).alias("enabled_cut"))
    return t.join(rules, "project_id").where(F.array_contains("events", F.col("type")) & (F.col("batch_seq") > F.get("enabled_cut", F.col("lane_id"))))


@query("join_issue_alerts", f"{_TRANS} select alert_id, record_id, type from pending")
def _issue_alerts(spark, d):
    return pending(spark, d).select("alert_id", "record_id", "type")


@query("anti_evaluated", f"{_TRANS} select alert_id, record_id from pending p where not exists (select 1 from records e where e.record_id = p.record_id and e.event_id % 4 = 0)")
def _evaluated(spark, d):
    done = occurrences(spark, d).where("event_id % 4 = 0").select("record_id")
    return pending(spark, d).join(done, "record_id", "left_anti").select("alert_id", "record_id")


@query("alert_issue_decisions", f"""{_TRANS.replace("with records", "with recursive records", 1)}, timed as (select *, max(received_time_us) over (partition by alert_id order by lane_id, batch_seq, record_id) as at_us from pending),
  ranked as (select *, row_number() over (partition by alert_id, at_us order by lane_id, batch_seq, record_id) as i from timed), fire as (
   select alert_id, min(at_us) as fired_us from timed group by 1
   union all select f.alert_id, (select min(h.at_us) from timed h where h.alert_id = f.alert_id and h.at_us >= f.fired_us + 3600000000) as fired_us from fire f where f.fired_us is not null)
  select r.alert_id, r.record_id, case when r.alert_id % 300 = 0 then 'disabled' when i = 1 and exists (select 1 from fire f where f.alert_id = r.alert_id and f.fired_us = r.at_us) then 'sent' else 'cooldown' end as decision from ranked r""")
def _decisions(spark, d):
    return L.decisions(pending(spark, d), F.col("alert_id") % 300 != 0, F.lit(3600)).select("alert_id", "record_id", "decision")


@query("alert_body", f"""{_ALERTS} select alert_id, window_end_us, '{{"alert":' || alert_id || ',"window_end_us":' || window_end_us || ',"count":' || observed || '}}' as body from hits where hit""")
def _body(spark, d):
    hits = counted(spark, d).where(L.breached(F.col("observed"), F.col("operator"), F.col("threshold")))
    return hits.select("alert_id", "window_end_us", F.to_json(F.struct(F.col("alert_id").alias("alert"), F.col("window_end_us"), F.col("observed").alias("count"))).alias("body"))


# --- manifests, maintenance, interval joins ------------------------------------------------------

_MANIFEST = f"""{RECORDS_SQL}, manifest as (select lane_id || '-' || (event_time_us // {DAY}) || '-' || kind as file_id, lane_id, event_time_us // {DAY} as day, kind, count(*) as row_count, (count(*) * 9700 + lane_id)::bigint as bytes,
    min(event_time_us) as min_event_time_us, max(event_time_us) as max_event_time_us, min(received_time_us) as min_received_time_us, max(received_time_us) as max_received_time_us, list_sort(list(distinct project_id)) as project_ids,
    min(batch_seq) as valid_from, case when lane_id % 5 = 4 then min(batch_seq) + 20 end as valid_to from records group by lane_id, event_time_us // {DAY}, kind)
"""


def manifest(spark, d):
    r = records(spark, d).withColumn("day", F.floor(F.col("event_time_us") / DAY))
    m = r.groupBy("lane_id", "day", "kind").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("event_time_us").alias("min_event_time_us"), F.max("event_time_us").alias("max_event_time_us"), F.min("received_time_us").alias("min_received_time_us"),
        F.max("received_time_us").alias("max_received_time_us"), F.array_sort(F.collect_set("project_id")).alias("project_ids"), F.min("batch_seq").alias("valid_from"),
    )
    return m.withColumn("file_id", F.concat_ws("-", "lane_id", "day", "kind")).withColumn("bytes", F.col("row_count") * 9700 + F.col("lane_id")).withColumn("valid_to", F.when(F.col("lane_id") % 5 == 4, F.col("valid_from") + 20))


@query("join_generation_interval", f"{_MANIFEST}, lanes as (select lane_id, max(batch_seq) // 2 as generation from records group by 1) select file_id from manifest join lanes using (lane_id) where valid_from <= generation and (valid_to is null or generation < valid_to)")
def _generation(spark, d):
    lanes = records(spark, d).groupBy("lane_id").agg(F.floor(F.max("batch_seq") / 2).alias("generation"))
    return manifest(spark, d).join(lanes, "lane_id").where("valid_from <= generation and (valid_to is null or generation < valid_to)").select("file_id")


@query("join_range_overlap", f"{_MANIFEST} select file_id from manifest where min_event_time_us < {START + 2 * DAY} and max_event_time_us >= {START + DAY}")
def _overlap(spark, d):
    return manifest(spark, d).where(f"min_event_time_us < {START + 2 * DAY} and max_event_time_us >= {START + DAY}").select("file_id")


@query("manifest_prune", f"{_MANIFEST} select file_id from manifest where valid_from <= 30 and (valid_to is null or valid_to > 30) and min_event_time_us < {START + 2 * DAY} and max_event_time_us >= {START} and kind in ('log') and max_received_time_us >= {START + DAY // 2} and list_has_any(project_ids, [2, 3])")
def _prune(spark, d):
    return M.prune(manifest(spark, d), 30, START, START + 2 * DAY, ["log"], [2, 3], START + DAY // 2).select("file_id")


@query("first_page_bound", f"""{_MANIFEST}, seen as (select *, sum(row_count) over (order by min_event_time_us desc, file_id rows unbounded preceding) as seen from manifest)
  select file_id from manifest where max_event_time_us >= coalesce((select max(min_event_time_us) from seen where seen >= 101), -9223372036854775808)""")
def _first_page(spark, d):
    return R.first_page_files(manifest(spark, d), 100).select("file_id")


@query("compaction_candidates", f"""{_MANIFEST}, f as (select *, (bytes >= 65536)::int + (bytes >= 262144)::int + (bytes >= 1048576)::int + (bytes >= 2097152)::int + (bytes >= 4194304)::int as tier from manifest where bytes < 8388608 and valid_to is null),
  w as (select *, row_number() over p as place, coalesce(sum(bytes) over (partition by lane_id, kind, tier order by valid_from, file_id rows between unbounded preceding and 1 preceding), 0) as before from f window p as (partition by lane_id, kind, tier order by valid_from, file_id))
  select lane_id, kind, tier, count(*) as files, sum(bytes)::bigint as total_bytes, array_to_string(list(file_id order by file_id), ',') as file_ids from w where place <= 128 and before < 33554432 and before + bytes <= 268435456 group by 1, 2, 3 having count(*) >= 2""")
def _candidates(spark, d):
    c = M.compaction_candidates(manifest(spark, d), least=2)
    return c.withColumn("file_ids", F.array_join("file_ids", ","))


@query("retention_floor", f"select event_id, greatest({START}, epoch_us(ts) - 30 * {DAY}, epoch_us(ts) - (1 + event_id % 20) * {DAY}) as floor from events")
def _floor(spark, d):
    now = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", M.retention_floor(F.lit(START), now, F.lit(30), 1 + F.col("event_id") % 20).alias("floor"))


@query("retention_candidates", f"{_MANIFEST} select file_id, max_received_time_us < {START + DAY} as expired, min_received_time_us, row_count from manifest where min_received_time_us < {START + DAY}")
def _retention(spark, d):
    return M.retention_candidates(manifest(spark, d), START + DAY)


@query("retention_rewrite", f"{RECORDS_SQL} select kind, count(*) as n, min(received_time_us) as oldest, count(*) as payloads from records where received_time_us >= {START + DAY} group by 1")
def _retention_rewrite(spark, d):
    """Rows at or above the floor are rewritten, payloads by the ids that stay."""
    path = shared_path(spark, "retained")
    kept = records(spark, d).where(F.col("received_time_us") >= START + DAY).withColumn("event_day", scalars.event_day(F.col("event_time_us")))
    write_records(kept.select("event_day", "kind", "project_id", "service", "event_time_us", "record_id", "received_time_us"), path)
    back = read_files(spark, "project_id bigint, service string, event_time_us bigint, record_id string, received_time_us bigint, event_day date, kind string", [path])
    paid = payloads(spark, d).join(back.select("record_id", "kind"), "record_id").groupBy("kind").agg(F.count(F.lit(1)).alias("payloads"))
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("received_time_us").alias("oldest")).join(paid, "kind")


_EXPIRED = f"{RECORDS_SQL}, expired as (select record_id from records where issue_id is not null and received_time_us < {START + DAY} and received_time_us < (select min(received_time_us) + {DAY // 2} from records))"


def expired(spark, d):
    """Occurrences of the first day, but for those that a snapshot from half a day after the first record on still sees."""
    snapshots = records(spark, d).groupBy("tenant_id").agg((F.min("received_time_us") + DAY // 2).alias("floor_us"))
    return M.expired_occurrences(occurrences(spark, d), START + DAY, snapshots)


@query("retention_cleanup", f"{_EXPIRED} select record_id from records where issue_id is not null and record_id not in (select record_id from expired)")
def _cleanup(spark, d):
    return occurrences(spark, d).join(expired(spark, d), "record_id", "left_anti").select("record_id")


@query("retention_links", f"{_EXPIRED}, first as (select project_id, issue_id, min_by(record_id, (batch_seq, lane_id, record_ordinal, record_id)) as record_id from records where issue_id is not null group by 1, 2) select project_id, issue_id, e.record_id is null as linked, case when e.record_id is null then f.record_id end as record_id from first f left join expired e using (record_id)")
def _links(spark, d):
    """The transitions that created the issues keep their rows and lose the ids of expired occurrences."""
    order = F.struct("batch_seq", "lane_id", "record_ordinal", "record_id")
    made = occurrences(spark, d).groupBy("project_id", "issue_id").agg(F.min_by("record_id", order).alias("record_id"))
    return M.unlink(made, expired(spark, d)).withColumn("linked", F.col("record_id").isNotNull())


_NOW = START + 40 * DAY


@query("retention_claims", f"{RECORDS_SQL}, c as (select project_id, kind, source_event_id, min(received_time_us) as created_us, max(received_time_us) + 37 * {DAY} as expires_us from records group by 1, 2, 3) select * from c where not (expires_us <= {_NOW} and created_us + 37 * {DAY} <= {_NOW})")
def _claims_kept(spark, d):
    made = records(spark, d).groupBy("project_id", "kind", "source_event_id").agg(F.min("received_time_us").alias("created_us"), (F.max("received_time_us") + 37 * DAY).alias("expires_us"))
    return M.live_claims(made, _NOW, 30)


@query("except_expired", f"{RECORDS_SQL} select record_id from records where not (received_time_us < {START + DAY} and event_id % 2 = 0)")
def _except(spark, d):
    r = records(spark, d)
    return r.join(r.where((F.col("received_time_us") < START + DAY) & (F.col("event_id") % 2 == 0)).select("record_id"), "record_id", "left_anti").select("record_id")


@query("union_cleanup_candidates", f"""{_CLAIMS} select 'occurrence' as what, record_id as id from records where issue_id is not null and received_time_us < {START + DAY}
  union all select 'claim', project_id || '/' || kind || '/' || sid from claims where expires < {START + DAY} union all select 'transition', record_id from records where issue_id is not null and event_id % 3 = 0 and received_time_us < {START + DAY}""")
def _union(spark, d):
    o = occurrences(spark, d).where(F.col("received_time_us") < START + DAY)
    c = claims(spark, d).where(F.col("expires_us") < START + DAY).select(F.lit("claim").alias("what"), F.concat_ws("/", "project_id", "kind", "source_event_id").alias("id"))
    return o.select(F.lit("occurrence").alias("what"), F.col("record_id").alias("id")).union(c).union(o.where("event_id % 3 = 0").select(F.lit("transition").alias("what"), F.col("record_id").alias("id")))


@query("gc_eligible", f"{_MANIFEST} select file_id as object_id from manifest where valid_from < 40 and lane_id % 5 <> 4 and lane_id % 3 <> 0")
def _gc(spark, d):
    m = manifest(spark, d).withColumn("object_id", F.col("file_id")).withColumn("created_us", F.col("valid_from"))
    return M.unreferenced(m, [m.where("lane_id % 5 = 4"), m.where("lane_id % 3 = 0")], 40).select("object_id")


@query("record_expired", f"{RECORDS_SQL} select record_id, received_time_us < {START + DAY} as expired from records")
def _expired(spark, d):
    return records(spark, d).select("record_id", (F.col("received_time_us") < START + DAY).alias("expired"))


@query("object_audit", f"{_MANIFEST} select file_id as object_id, case when lane_id = 2 then 'missing' when lane_id = 5 then 'size' else 'hash' end as problem from manifest where lane_id in (2, 5, 7)")
def _audit(spark, d):
    m = manifest(spark, d).select(F.col("file_id").alias("object_id"), "bytes", F.sha2("file_id", 256).alias("sha256"), "lane_id")
    listed = m.where("lane_id != 2").withColumn("bytes", F.when(F.col("lane_id") == 5, F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn("sha256", F.when(F.col("lane_id") == 7, F.lit("x")).otherwise(F.col("sha256")))
    return M.audit(m, listed)


@query("object_inventory", f"{_MANIFEST} select count(*) as referenced_objects, sum(bytes)::bigint as referenced_bytes, sha256(string_agg(file_id || chr(0) || bytes || chr(0) || sha256(file_id), chr(10) order by file_id || chr(0) || bytes || chr(0) || sha256(file_id))) as inventory_sha256 from manifest")
def _inventory(spark, d):
    return M.inventory(manifest(spark, d).select(F.col("file_id").alias("object_id"), "bytes", F.sha2("file_id", 256).alias("sha256")))


@query("join_compact_layout", f"{RECORDS_SQL} select record_id, props as raw_json, project_id, service from records where received_time_us >= {START + DAY}")
def _layout(spark, d):
    keys = records(spark, d).where(F.col("received_time_us") >= START + DAY).select("record_id", "project_id", "service")
    return payloads(spark, d).join(keys, "record_id").select("record_id", "raw_json", "project_id", "service")


@query("semi_project", "select s_suppkey from supplier where exists (select 1 from nation where n_nationkey = s_nationkey and n_regionkey in (1, 3))")
def _semi(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey in (1, 3)"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("all_projects_selected", f"{_MANIFEST} select file_id from manifest where list_has_all([1, 2, 3], project_ids)")
def _division(spark, d):
    """Every project of the file is selected: none of them is outside the selection."""
    pairs = manifest(spark, d).select("file_id", F.explode("project_ids").alias("project_id"))
    outside = pairs.where("project_id not in (1, 2, 3)").select("file_id")
    return pairs.select("file_id").distinct().join(outside, "file_id", "left_anti")


_OUT = "(select conv_id, turn, role as category, case when turn % 2 = 0 then 'queue_overflow' else 'rate_limit' end as reason, length(text) % 10 as quantity, turn % 3 = 0 as approximate from conversations)"


def outcomes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("category"), F.when(F.col("turn") % 2 == 0, "queue_overflow").otherwise("rate_limit").alias("reason"), (F.length("text") % 10).alias("quantity"), (F.col("turn") % 3 == 0).alias("approximate"))


@query("agg_outcomes", f"select category, reason, sum(quantity)::bigint as quantity, bool_or(approximate) as approximate from {_OUT} group by all")
def _outcomes(spark, d):
    return outcomes(spark, d).groupBy("category", "reason").agg(F.sum("quantity").alias("quantity"), F.bool_or("approximate").alias("approximate"))


@query("join_outcomes_receipts", f"select reason, sum(quantity)::bigint as quantity from {_OUT} o join (select conv_id, max(turn) as last from conversations group by 1) r using (conv_id) where r.last >= 4 group by 1")
def _outcome_receipts(spark, d):
    receipts = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).where("last >= 4")
    return outcomes(spark, d).join(receipts, "conv_id").groupBy("reason").agg(F.sum("quantity").alias("quantity"))


@query("cross_floor", f"{RECORDS_SQL} select record_id, received_time_us >= floor as retained from records, (select max(received_time_us) - {DAY} as floor from records)")
def _cross(spark, d):
    r = records(spark, d)
    return r.crossJoin(F.broadcast(r.agg((F.max("received_time_us") - DAY).alias("floor")))).select("record_id", (F.col("received_time_us") >= F.col("floor")).alias("retained"))


@query("agg_ingest_health", f"""{_CLAIMS}, t as (select count(*) filter (where class = 'accepted') as accepted, count(*) filter (where class = 'duplicate') as duplicates, count(*) filter (where class = 'conflict') as conflicts, count(*) filter (where class = 'accepted' and batch_seq <= 30) as published from classified),
  o as (select sum(quantity)::bigint as drops from {_OUT}), u as (select min(received_time_us) as oldest_unpublished from classified where class = 'accepted' and batch_seq > 30) select * from t, o, u""")
def _health(spark, d):
    c = classified(spark, d)
    ok = F.col("class") == "accepted"
    t = c.agg(F.count_if(ok).alias("accepted"), F.count_if(F.col("class") == "duplicate").alias("duplicates"), F.count_if(F.col("class") == "conflict").alias("conflicts"), F.count_if(ok & (F.col("batch_seq") <= 30)).alias("published"), F.min(F.when(ok & (F.col("batch_seq") > 30), F.col("received_time_us"))).alias("oldest_unpublished"))
    return t.crossJoin(outcomes(spark, d).agg(F.sum("quantity").alias("drops")))


# --- sources and sinks ---------------------------------------------------------------------------


def payloads(spark, d):
    from tidemark.sources.adapters import payloads as own

    return own(spark, d)


@query("src_parquet", "select event_type, count(*) as n from events group by 1")
def _parquet(spark, d):
    return read_files(spark, "event_id bigint, event_type string", [f"{d}/events.parquet"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_payload", f"{RECORDS_SQL} select record_id, props as raw_json from records")
def _payload(spark, d):
    return payloads(spark, d).join(records(spark, d).select("record_id"), "record_id").select("record_id", "raw_json")


@query("src_provenance", "select event_type, count(*) as n, 1::bigint as files from events group by 1")
def _provenance(spark, d):
    r = read_files(spark, "event_id bigint, event_type string", [f"{d}/events.parquet"], provenance=True)
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.regexp_extract("file_path", "([^/]+[.]parquet)", 1)).alias("files"))


_BACK = f"{RECORDS_SQL} select record_id, kind, project_id, event_time_us from records"


@query("sink_records", _BACK)
def _sink_records(spark, d):
    path = shared_path(spark, "records")
    r = records(spark, d).withColumn("event_day", scalars.event_day(F.col("event_time_us"))).select("event_day", "kind", "project_id", "service", "event_time_us", "record_id")
    write_records(r, path)
    return read_files(spark, "project_id bigint, service string, event_time_us bigint, record_id string, event_day date, kind string", [path]).select("record_id", "kind", "project_id", "event_time_us")


@query("sink_payload", f"{RECORDS_SQL} select record_id, props as raw_json from records")
def _sink_payload(spark, d):
    path = shared_path(spark, "payloads")
    write_payloads(payloads(spark, d), path)
    return read_files(spark, "record_id string, raw_json string", [path])


@query("sink_jsonl", "select l_returnflag, l_linestatus, sum(round(l_extendedprice * 100)::hugeint)::varchar as total from lineitem group by all")
def _sink_jsonl(spark, d):
    """Exact totals survive as text."""
    path = shared_path(spark, "export")
    total = F.sum(F.round(F.col("l_extendedprice") * 100).cast("decimal(28,0)")).alias("total")
    write_json_lines(table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(total), path)
    return read_json_lines(spark, "l_returnflag string, l_linestatus string, total string", path)


_STAGED = """with staged as (select event_id % 5 as stage, event_id, row_number() over (partition by event_id % 5 order by event_id) as i, count(*) over (partition by event_id % 5) as n from events)
  select stage, n as lines, case when n > 1 then case stage when 1 then 'ordinal_order' when 2 then 'no_ordinal' when 3 then 'no_json' end end as reason, case when stage in (0, 4) or n = 1 then n else 0 end as rows from staged group by all"""


@query("src_jsonl_checked", _STAGED)
def _jsonl_checked(spark, d):
    """Five staged files: the last line of one repeats its first ordinal, that of another has none, that of a third is cut off; their files give no rows."""
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 5).alias("stage"))
    ends = e.groupBy("stage").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    last = (F.col("event_id") == F.col("hi")) & (F.col("hi") > F.col("lo"))
    ordinal = F.when(last & (F.col("stage") == 1), F.col("lo")).when(last & (F.col("stage") == 2), None).otherwise(F.col("event_id"))
    line = F.to_json(F.struct(ordinal.alias("ordinal"), "event_type"))
    line = F.when(last & (F.col("stage") == 3), F.substring(line, 1, 9)).otherwise(line)
    path = shared_path(spark, "staged")
    rows = e.join(F.broadcast(ends), "stage").select("stage", "event_id", line.alias("value")).repartition("stage").sortWithinPartitions("stage", "event_id")
    rows.select("stage", "value").write.partitionBy("stage").text(path)
    found, files = read_staged(spark, "ordinal bigint, event_type string", path)
    stage = F.regexp_extract("file_path", "stage=([0-9]+)", 1).cast("bigint").alias("stage")
    held = found.groupBy(stage).agg(F.count(F.lit(1)).alias("rows"))
    return files.select(stage, "lines", "reason").join(held, "stage", "left").select("stage", "lines", "reason", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("src_jsonl", "select event_id, event_type, value from events")
def _src_jsonl(spark, d):
    path = shared_path(spark, "stage")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return read_json_lines(spark, "event_id bigint, event_type string, value double", path)


@query("manifest_build", f"{RECORDS_SQL} select ts::date as event_day, kind, count(*) as row_count, min(event_time_us) as min_event_time_us, max(event_time_us) as max_event_time_us, sha256(string_agg(record_id, chr(10) order by record_id)) as identity_sha256 from records group by all")
def _manifest_build(spark, d):
    """A row per file of a written table; here each day and kind adds up its files."""
    path = shared_path(spark, "bundles")
    r = records(spark, d).withColumn("event_day", scalars.event_day(F.col("event_time_us"))).select("event_day", "kind", "project_id", "service", "event_time_us", "record_id")
    write_records(r, path)
    back = read_files(spark, "project_id bigint, service string, event_time_us bigint, record_id string, event_day date, kind string", [path], provenance=True)
    files = back.groupBy("file_path", "event_day", "kind").agg(F.count(F.lit(1)).alias("row_count"), F.min("event_time_us").alias("lo"), F.max("event_time_us").alias("hi"))
    sums = files.groupBy("event_day", "kind").agg(F.sum("row_count").alias("row_count"), F.min("lo").alias("min_event_time_us"), F.max("hi").alias("max_event_time_us"))
    return A.with_ordered_hash(sums, back, ["event_day", "kind"], "record_id", "identity_sha256")


@query("compact_rewrite", f"{RECORDS_SQL} select kind, count(*) as n, sha256(string_agg(record_id, chr(10) order by record_id)) as identity_sha256 from records group by 1")
def _compact(spark, d):
    """Small files in, one sorted file per kind out, with the same ids."""
    small, large = shared_path(spark, "small"), shared_path(spark, "large")
    r = records(spark, d).withColumn("event_day", scalars.event_day(F.col("event_time_us"))).select("event_day", "kind", "project_id", "service", "event_time_us", "record_id")
    write_records(r, small)
    schema = "project_id bigint, service string, event_time_us bigint, record_id string, event_day date, kind string"
    M.rewrite(read_files(spark, schema, [small]), large, ("kind",))
    back = read_files(spark, schema, [large])
    return A.with_ordered_hash(back.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), back, ["kind"], "record_id", "identity_sha256")


@query("compact_verify", f"""{RECORDS_SQL} select kind || '/' || ts::date as input, count(*) as records, count(*) filter (where event_id <> 7) as payloads,
  case when bool_and(event_id = 7) then 'missing' when bool_or(event_id = 7) then 'identity' end as problem from records group by 1""")
def _verify(spark, d):
    """Pairs of records and payloads by kind and day, checked file side by file side; the payload of event 7 was lost."""
    r = records(spark, d).withColumn("event_day", scalars.event_day(F.col("event_time_us")))
    left, right = shared_path(spark, "analytics"), shared_path(spark, "paired")
    write_records(r.select("event_day", "kind", "project_id", "service", "event_time_us", "record_id"), left)
    r.where("event_id != 7").select("event_day", "kind", "record_id").write.partitionBy("event_day", "kind").parquet(right)
    named = F.concat_ws("/", "kind", "event_day")
    stated = r.select(named.alias("input"), "record_id")
    inputs = A.ordered_hashes(stated, ["input"], "record_id", "identity_sha256")
    analytics = read_files(spark, "project_id bigint, event_time_us bigint, record_id string, event_day date, kind string", [left]).withColumn("input", named)
    paired = read_files(spark, "record_id string, event_day date, kind string", [right]).withColumn("input", named)
    scope = (scalars.event_day(F.col("event_time_us")) == F.col("event_day")) & (F.col("project_id") > 0) & F.col("kind").isin("error", "log", "transaction")
    return M.verify_inputs(inputs, analytics, paired, scope)
