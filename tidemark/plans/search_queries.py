"""Queries of scope, predicates, projections, orders and paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators import rows as R
from tidemark.plans.registry import query
from tidemark.sources.adapters import RECORDS_SQL, payloads, records, stored_records, table

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01
SCOPE = P.Scope(1, (1, 2, 3), ("error", "log"), START, START + 12 * DAY)
SCOPE_SQL = f"tenant_id = 1 and project_id in (1, 2, 3) and kind in ('error', 'log') and event_time_us >= {START} and event_time_us < {START + 12 * DAY}"
CUTS = tuple(1 + 3 * lane for lane in range(16))

def K() -> Column:
    return P.attr("attributes", "/k", "integer")

def VALUE() -> Column:
    return P.attr("attributes", "/value", "double")

def FLAG() -> Column:
    return P.attr("attributes", "/flag", "boolean")

def TYPE() -> Column:
    return P.attr("tags", "/event_type", "string")



def _pred(name: str, where: Callable[[], Column], sql: str) -> None:
    """Registers a predicate over the scoped records."""
    query(name, f"{RECORDS_SQL} select record_id, kind from records where {SCOPE_SQL} and ({sql})")(lambda spark, d: SCOPE.apply(stored_records(spark, d)).where(where()).select("record_id", "kind"))


_pred("scope_filter", lambda: P.constant(True), "true")
_pred("pred_constant", lambda: P.any_of(P.constant(False), P.not_(P.constant(True))), "false")
_pred("pred_field", lambda: P.eq(P.field("environment"), "prod"), "environment = 'prod'")
_pred("pred_attr", lambda: K().isNotNull(), "k is not null")
_pred("pred_eq", lambda: P.eq(K(), 7), "k = 7")
_pred("pred_ne", lambda: P.ne(K(), 7), "k <> 7")
_pred("pred_lt", lambda: P.lt(K(), 20), "k < 20")
_pred("pred_le", lambda: P.le(VALUE(), 20.5), "value <= 20.5")
_pred("pred_gt", lambda: P.gt(K(), 50), "k > 50")
_pred("pred_ge", lambda: P.ge(P.field("severity_number"), 13), "severity_number >= 13")
_pred("pred_and", lambda: P.all_of(P.gt(K(), 10), P.lt(VALUE(), 50.0), P.eq(FLAG(), True)), "k > 10 and value < 50 and user_id % 2 = 0")
_pred("pred_or", lambda: P.any_of(P.eq(K(), 1), P.eq(K(), 2), P.eq(TYPE(), "signup")), "coalesce(k in (1, 2), false) or event_type = 'signup'")
_pred("pred_not", lambda: P.not_(P.eq(K(), 7)), "not coalesce(k = 7, false)")
_pred("pred_in", lambda: P.in_(P.field("service"), ["svc-1", "svc-4"]), "service in ('svc-1', 'svc-4')")
_pred("pred_contains", lambda: P.contains(P.field("message"), "by user 1_"), "contains(message, 'by user 1_')")
_pred("pred_starts_with", lambda: P.starts_with(P.field("message"), "click by"), "starts_with(message, 'click by')")
_pred("pred_ends_with", lambda: P.ends_with(P.field("message"), "7"), "suffix(message, '7')")
_pred("pred_icontains", lambda: P.icontains(P.field("message"), "BY USER 12"), "contains(lower(message), lower('BY USER 12'))")
_pred("pred_matches", lambda: P.matches(P.field("message"), r"(view|error) by user \d*5$"), r"regexp_matches(message, '(view|error) by user \d*5$')")
_pred("pred_text", lambda: P.text("user 42"), "contains(event_type, 'user 42') or contains('user ' || user_id, 'user 42')")
_pred("pred_exists", lambda: P.exists("attributes", "/k"), "k_type <> 'missing'")
_pred("pred_is_null", lambda: P.is_null("attributes", "/k"), "k_type = 'null'")
_pred("pred_array_contains", lambda: P.array_contains("attributes", "/features", "string", "click"), "event_id % 3 = 0 and event_type = 'click'")
_pred("pred_attr_ops", lambda: P.all_of(P.starts_with(TYPE(), "si"), P.contains(TYPE(), "gn"), P.matches(TYPE(), "up$")), "event_type = 'signup'")


@query("scope_lane_cut", f"{RECORDS_SQL} select record_id, lane_id from records where {SCOPE_SQL} and batch_seq <= 1 + 3 * lane_id")
def _lane_cut(spark, d):
    cuts = spark.range(16).select(F.col("id").cast("int").alias("lane_id"), (1 + 3 * F.col("id")).alias("cut_seq"))
    return P.lane_cut(SCOPE.apply(stored_records(spark, d)), cuts).select("record_id", "lane_id")


LISTED = "project_id, record_id, kind, event_time_us, event_time_ns_remainder, received_time_us, lane_id, batch_seq, record_ordinal, level, severity_number, message, service, environment, release, trace_id, issue_id"


@query("proj_list", f"{RECORDS_SQL} select {LISTED} from records where {SCOPE_SQL}")
def _list(spark, d):
    return R.list_projection(SCOPE.apply(stored_records(spark, d)))


@query(
    "proj_message_preview",
    # The longest prefix of whole characters within the limit.
    """select doc_id, case when strlen(text) <= 2048 then text else (select substr(text, 1, max(n)) from (select unnest(range(2048 // 4, 2049)) as n) where strlen(substr(text, 1, n)) <= 2048) end as message,
       strlen(text) > 2048 as truncated from documents""",
)
def _preview(spark, d):
    text, cut = R.preview(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("message"), cut.alias("truncated"))


DETAIL_ID = "sha256('rec-77')"


@query("proj_detail", f"""{RECORDS_SQL} select record_id, project_id, kind, event_time_us, event_time_ns_remainder, received_time_us, source_event_id, props as raw_json,
  null::varchar as envelope_sdk_json, '[]' as normalization_warnings_json, '{{"event_id":' || event_id || '}}' as canonical_metadata_json from records where record_id = {DETAIL_ID}""")
def _detail(spark, d):
    import hashlib

    return R.detail(records(spark, d), payloads(spark, d), hashlib.sha256(b"rec-77").hexdigest())


@query("join_detail", "select o.o_orderkey, o.o_orderdate::date as day, l.l_linenumber, l.l_quantity from orders o join lineitem l on l.l_orderkey = o.o_orderkey where o.o_orderstatus = 'F' and o.o_totalprice > 100000")
def _join_detail(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


_EVENT = "event_time_us desc, event_time_ns_remainder desc, record_id desc"
_RECEIVED = "received_time_us desc, lane_id desc, batch_seq desc, record_ordinal desc, record_id desc"
_ROW = "record_id, event_time_us, event_time_ns_remainder"


@query("rows_event_desc", f"{RECORDS_SQL} select {_ROW} from records where {SCOPE_SQL} order by {_EVENT} limit 101")
def _rows_event(spark, d):
    return R.page(SCOPE.apply(stored_records(spark, d)), R.EVENT_ORDER, 100).select("record_id", "event_time_us", "event_time_ns_remainder")


@query("rows_received_desc", f"{RECORDS_SQL} select record_id, received_time_us, lane_id, batch_seq, record_ordinal from records where {SCOPE_SQL} order by {_RECEIVED} limit 101")
def _rows_received(spark, d):
    return R.page(SCOPE.apply(stored_records(spark, d)), R.RECEIVED_ORDER, 100).select("record_id", "received_time_us", "lane_id", "batch_seq", "record_ordinal")


LAST = (START + 6 * DAY, 500, "8")


@query("rows_keyset", f"{RECORDS_SQL} select {_ROW} from records where {SCOPE_SQL} and (event_time_us, event_time_ns_remainder, record_id) < ({LAST[0]}, {LAST[1]}, '{LAST[2]}') order by {_EVENT} limit 51")
def _keyset(spark, d):
    last = (LAST[0], LAST[1], LAST[2])
    return R.page(SCOPE.apply(stored_records(spark, d)), R.EVENT_ORDER, 50, last).select("record_id", "event_time_us", "event_time_ns_remainder")


@query("rows_has_more", f"""{RECORDS_SQL}, p as (select {_ROW} from records where {SCOPE_SQL} order by {_EVENT} limit 21), q as (select *, row_number() over (order by {_EVENT}) as i, count(*) over () as n from p)
  select {_ROW}, n > 20 as has_more, i = least(n, 20) as is_last from q where i <= 20""")
def _has_more(spark, d):
    paged = R.page(SCOPE.apply(stored_records(spark, d)), R.EVENT_ORDER, 20).select("record_id", "event_time_us", "event_time_ns_remainder")
    return R.with_more(paged, R.EVENT_ORDER, 20)


@query("live_asc", f"{RECORDS_SQL} select record_id, lane_id, batch_seq, record_ordinal from records where {SCOPE_SQL} and batch_seq > 1 + lane_id order by lane_id, batch_seq, record_ordinal, record_id limit 101")
def _live(spark, d):
    rows = SCOPE.apply(stored_records(spark, d)).where("batch_seq > 1 + lane_id")
    return R.page(rows, R.APPEND_ORDER, 100, descending=False).select("record_id", "lane_id", "batch_seq", "record_ordinal")


@query("sort_layout", f"""{RECORDS_SQL} select project_id, service, event_time_us, record_id, row_number() over (partition by kind order by project_id, service nulls first, event_time_us, record_id) as place from records""")
def _layout(spark, d):
    order = [F.col("project_id").asc(), F.col("service").asc_nulls_first(), F.col("event_time_us").asc(), F.col("record_id").asc()]
    r = records(spark, d).select("kind", "project_id", "service", "event_time_us", "record_id")
    return R.running(r, ["kind"], order, F.lit(1), "place").select("project_id", "service", "event_time_us", "record_id", "place")


@query("join_related", f"""{RECORDS_SQL}, seeds as (select * from records where event_id % 500 = 7)
  select s.record_id as seed_id, r.record_id from seeds s join records r on r.record_id <> s.record_id and r.project_id = s.project_id and
    case when s.trace_id is not null then r.trace_id = s.trace_id else r.service is not distinct from s.service and abs(r.event_time_us - s.event_time_us) <= 300000000 end""")
def _related(spark, d):
    r = stored_records(spark, d)
    return R.related(r, r.where("event_id % 500 = 7"))


@query("bench_structured", f"{RECORDS_SQL} select record_id, event_time_us from records where service = 'svc-2' and level = 'error' and k > 10 order by {_EVENT} limit 100")
def _bench_structured(spark, d):
    # The plain comparisons reach Parquet; two-valued leaves, which coalesce, do not.
    narrowed = stored_records(spark, d).where((F.col("service") == "svc-2") & (F.col("level") == "error"))
    found = narrowed.where(P.all_of(P.eq(P.field("service"), "svc-2"), P.eq(P.field("level"), "error"), P.gt(K(), 10)))
    return found.orderBy(*(F.desc(c) for c in R.EVENT_ORDER)).limit(100).select("record_id", "event_time_us")


@query("bench_text", "select doc_id, n_chars from documents where list_contains(string_split(lower(text), ' '), 'the') and list_contains(string_split(lower(text), ' '), 'of') order by n_chars desc, doc_id desc limit 100")
def _bench_text(spark, d):
    words = F.split(F.lower("text"), " ")
    found = table(spark, d, "documents").where(F.array_contains(words, "the") & F.array_contains(words, "of"))
    return found.orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(100).select("doc_id", "n_chars")


@query("bench_histogram", f"{RECORDS_SQL} select event_time_us - event_time_us % 60000000 as bucket, count(*) as n from records where {SCOPE_SQL} group by 1")
def _bench_histogram(spark, d):
    t = F.col("event_time_us")
    return SCOPE.apply(stored_records(spark, d)).groupBy((t - F.pmod(t, F.lit(60_000_000))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
