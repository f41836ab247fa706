"""Queries from raw payloads to records. The payloads are built from event rows by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import tables as TF
from tidemark.operators import normalize as N
from tidemark.plans.registry import query
from tidemark.plans.scalar_queries import raw_events
from tidemark.sources.adapters import dealt_events, table

#: Three items per envelope: an event, a log container or an unknown item, a client report.
_ENVELOPE = r"""concat('{"event_id":"', md5(string(event_id)), '"}\n{"type":"event","length":', octet_length(raw), '}\n', raw, '\n',
 if(event_id % 2 = 0, concat('{"type":"log"}\n{"version":2,"item_count":', 1 + event_id % 3, ',"items":[', array_join(transform(sequence(0, int(event_id % 3)), i -> concat('{"body":"line ', i, '","level":"warn","attributes":{"n":{"type":"integer","value":', i, '}}}')), ','), ']}\n'), '{"type":"mystery"}\nabc\n'),
 '{"type":"client_report"}\n{"discarded_events":[{"reason":"queue_overflow","category":"error","quantity":', event_id % 7, '}]}\n')"""


def envelopes(spark, d):
    return raw_events(spark, d).withColumn("data", F.expr(_ENVELOPE).cast("binary"))


def items(spark, d):
    return N.read_envelopes(envelopes(spark, d), "event_id", "data")


_ITEMS_SQL = "select event_id as id, (t.i)::int as ordinal, case t.i when 0 then 'event' when 2 then 'client_report' else case when event_id % 2 = 0 then 'log' else 'mystery' end end as type, null::varchar as problem from events, (values (0), (1), (2)) t(i)"


@query("src_envelope", _ITEMS_SQL)
def _envelope(spark, d):
    return items(spark, d).select("id", "ordinal", "type", "problem")


@query("udtf_envelope", _ITEMS_SQL)
def _envelope_lateral(spark, d):
    """The same items by a table function in SQL."""
    return TF.register(spark).sql("select e.event_id as id, i.ordinal, i.type, i.problem from {e} e, lateral envelope_items(e.data) i", e=envelopes(spark, d))


@query("src_log_container", "select event_id as id, (t.i)::int as log_ordinal, 'line ' || t.i as body, null::varchar as log_problem from events, (values (0), (1), (2)) t(i) where event_id % 2 = 0 and t.i <= event_id % 3")
def _logs(spark, d):
    return N.explode_logs(items(spark, d)).select("id", "log_ordinal", F.get_json_object("raw", "$.body").alias("body"), "log_problem")


@query("src_store_json", "select event_id, 'svc-' || (user_id % 7) as service, 'error' as record_kind from events")
def _store(spark, d):
    """Single events as plain text rows go through the same normalisation."""
    return N.normalize_events(raw_events(spark, d)).select("event_id", "service", "record_kind")


_BROKEN = """case event_id % 6 when 0 then concat('{"a":1,"a":', event_id, '}') when 1 then concat(repeat('[', 70), repeat(']', 70)) when 2 then concat('{"a":', event_id) when 3 then concat('{"a":1} ', event_id) when 4 then concat('["\\\\ud800",', event_id, ']') else raw end"""


@query("src_json_guard", "select event_id, case event_id % 6 when 0 then 'repeated_key' when 1 then 'too_deep' when 2 then 'no_json' when 3 then 'no_json' end as reject_reason from events")
def _guard(spark, d):
    return N.guard_and_scrub(raw_events(spark, d).select("event_id", F.expr(_BROKEN).alias("raw"))).select("event_id", "reject_reason")


@query("scrub_json", "select event_id, '[Filtered]' as password, user_id as user from events")
def _scrub(spark, d):
    clean = N.guard_and_scrub(raw_events(spark, d).select("event_id", "raw"))
    return clean.select("event_id", F.get_json_object("raw", "$.user.password").alias("password"), F.get_json_object("raw", "$.user.id").cast("bigint").alias("user"))


@query("scrub_assert", "select count(*) as events, 0::bigint as leaks from events")
def _assert(spark, d):
    clean = N.guard_and_scrub(raw_events(spark, d).select("event_id", "user_id", "raw"))
    leak = F.contains("raw", F.concat(F.lit('"p'), F.col("user_id"), F.lit('"')))
    return clean.agg(F.count(F.lit(1)).alias("events"), F.count_if(leak).alias("leaks"))


@query("unsupported_items", "select event_id as id, 1 as ordinal, 'mystery' as type, 3 as bytes from events where event_id % 2 <> 0")
def _unsupported(spark, d):
    return N.unsupported(items(spark, d))


@query("client_outcomes", "select event_id as id, 'error' as category, 'queue_overflow' as reason, event_id % 7 as quantity from events")
def _outcomes(spark, d):
    return N.client_outcomes(items(spark, d))


@query("normalize_events", """select event_id, md5(event_id::varchar) as source_event_id, case when event_type = 'error' then 'error' else 'unknown' end as level, null::smallint as severity_number,
  'svc-' || (user_id % 7) as service, case when event_id % 3 = 0 then 'took ' || (event_id % 50) when event_id % 5 = 0 then 'plain ' || (event_id % 11) when event_id % 2 = 0 then event_type || ' failed' else '' end as message,
  case when event_id % 2 = 0 then 'E' || (user_id % 5) end as exception_type from events""")
def _events(spark, d):
    return N.normalize_events(raw_events(spark, d)).select("event_id", "source_event_id", "level", "severity_number", "service", "message", "exception_type")


#: Attributes bare, wrapped and of a wrong type; texts and numbers in the fields that want the other.
_LOG = """concat('{"body":"', event_type, ' ', event_id, '","level":"', if(event_id % 3 = 0, 'warn', ''), '","severity_number":', if(event_id % 10 = 9, '"5"', string(event_id % 30)), ',"timestamp":', event_id, '.5,"service":"outer","release":"outer","logger":"own","span_id":"",
 "trace_id":"', if(event_id % 13 = 0, 'zz', md5(string(event_id))), '","attributes":{"bad":{"type":"integer","value":"x"},"size":{"type":"double","value":3,"unit":"byte"},"n":', user_id,
 case event_id % 3 when 0 then concat(',"service.name":{"type":"string","value":"svc-', user_id % 7, '"}') when 1 then ',"service.name":7' else '' end,
 if(event_id % 4 = 0, ',"server.name":"last","sentry.server.address":{"value":"middle"}', if(event_id % 4 = 1, ',"server.name":"last"', '')), if(event_id % 5 = 0, ',"logger.name":"attr"', ''),
 if(event_id % 6 = 1, ',"sentry.severity_text":"CRITICAL"', ''), if(event_id % 7 = 0, ',"sentry.severity_number":{"type":"integer","value":2}', ''), ',"sentry.release":"r0","sentry.sdk.name":"kit","sentry.trace.parent_span_id":"00000000000000AB","sentry.message.template":"t %s"}}')"""


def raw_logs(spark, d):
    return dealt_events(spark, d).withColumn("raw", F.expr(_LOG))


_LOG_SQL = """with named as (select *, case when event_id % 10 <> 9 and event_id % 30 between 1 and 24 then event_id % 30 when event_id % 7 = 0 then 2 end as n, case when event_id % 3 = 0 then 'warning' when event_id % 6 = 1 then 'fatal' else 'unknown' end as lvl from events)"""


@query("normalize_logs", f"""{_LOG_SQL} select event_id, event_type || ' ' || event_id as message, 't %s' as message_template, lvl as level, case when event_id % 3 = 0 then 'warn' when event_id % 6 = 1 then 'CRITICAL' else '' end as original_level,
  coalesce(n, case lvl when 'warning' then 13 when 'fatal' then 21 end)::smallint as severity_number, case event_id % 3 when 0 then 'svc-' || (user_id % 7) when 2 then 'fallback' end as service,
  case when event_id % 4 = 0 then 'middle' when event_id % 4 = 1 then 'last' end as server_name, case when event_id % 5 = 0 then 'attr' else 'own' end as logger, 'r0' as release, 'kit' as sdk_name, '1.2' as sdk_version,
  case when event_id % 13 <> 0 then md5(event_id::varchar) end as trace_id, '00000000000000ab' as span_id, event_id * 1000000 + 500000 as event_time_us from named""")
def _normalize_logs(spark, d):
    logs = N.normalize_logs(raw_logs(spark, d), "fallback", (F.lit("envelope"), F.lit("1.2")))
    return logs.select("event_id", "message", "message_template", "level", "original_level", "severity_number", "service", "server_name", "logger", "release", "sdk_name", "sdk_version", "trace_id", "span_id", "event_time_us")


@query("log_warnings", f"""{_LOG_SQL} select event_id, list_filter([case when event_id % 3 = 0 and n is not null and n not between 13 and 16 then 'severity_level_conflict' end, case when n is null then 'invalid_severity_number' end,
  case when event_id % 13 = 0 then 'invalid_trace_id' end], lambda x: x is not null) as warnings from named""")
def _log_warnings(spark, d):
    return N.normalize_logs(raw_logs(spark, d)).select("event_id", "warnings")


@query("normalize_warnings", "select event_id, list_filter([case when event_id % 4 in (0, 1) then 'event_id_conflict' end, case when event_id % 4 = 2 then 'invalid_event_id' end], lambda x: x is not null) as warnings from events")
def _warnings(spark, d):
    """The envelope names another id, the payload one that is none, or both the same one that is none."""
    e = raw_events(spark, d)
    i = F.col("event_id")
    raw = F.when((i % 4).isin(1, 2), F.replace("raw", F.md5(i.cast("string")), F.lit("nope"))).otherwise(F.col("raw"))
    outer = F.when(i % 4 == 2, F.lit("nope")).otherwise(F.md5(F.when(i % 4 == 0, i + 1).otherwise(i).cast("string")))
    return e.select("event_id", N.event_warnings(raw, outer).alias("warnings"))


_CONTAINER = r"""concat('{"ingest_settings":{"infer_ip":"', if(event_id % 3 = 0, 'always', 'never'), '"},"items":[{"body":"', case event_id % 5 when 0 then R'\ud83d' when 1 then R'😀' when 2 then R'\\ud83d' else event_type end, '"}]}')"""


@query("item_warnings", "select event_id, list_filter([case when event_id % 3 = 0 then 'inference_disabled' end, case when event_id % 5 = 0 then 'lone_surrogate_replaced' end], lambda x: x is not null) as warnings from events")
def _item_warnings(spark, d):
    return table(spark, d, "events").select("event_id", N.item_warnings(F.expr(_CONTAINER), F.lit("log")).alias("warnings"))


def _flat(rows):
    return rows.select("event_id", F.explode("attrs").alias("a")).select("event_id", "a.path", "a.value_type", F.coalesce("a.string_value", F.col("a.integer_value").cast("string"), F.col("a.double_value").cast("string"), "a.json_value").alias("value"))


_FLAT_SQL = """select event_id, '/service.name' as path, 'string' as value_type, 'svc-' || (user_id % 7) as value from events union all select event_id, '/a.b', 'string', 'x' || event_id from events
  union all select event_id, '/id', 'integer', user_id::varchar from events union all select event_id, '/password', 'string', 'p' || user_id from events"""


@query("udtf_flatten_attrs", _FLAT_SQL)
def _flatten_lateral(spark, d):
    """The same attributes by a table function in SQL."""
    return TF.register(spark).sql(
        "select e.event_id, a.path, a.value_type, coalesce(a.string_value, string(a.integer_value), string(a.double_value), a.json_value) as value from {e} e, lateral event_attributes(e.raw) a", e=raw_events(spark, d)
    )


@query("flatten_attrs_event", _FLAT_SQL)
def _flatten_event(spark, d):
    return _flat(N.with_attributes(raw_events(spark, d).select("event_id", "raw"), "event"))


@query("flatten_attrs_log", """select event_id, '/bad' as path, 'invalid' as value_type, '"x"' as value from events union all select event_id, '/size', 'double', '3.0' from events
  union all select event_id, '/service.name', 'string', 'svc-' || (user_id % 7) from events where event_id % 3 = 0 union all select event_id, '/service.name', 'integer', '7' from events where event_id % 3 = 1 union all select event_id, '/n', 'integer', user_id::varchar from events""")
def _flatten_log(spark, d):
    return _flat(N.with_attributes(raw_logs(spark, d).select("event_id", "raw"), "log")).where(F.col("path").isin("/bad", "/size", "/service.name", "/n"))


_TYPED = """concat('{"tags":{"v":', case event_id % 8 when 0 then '1' when 1 then '1.0' when 2 then '1e0' when 3 then repeat('9', 40) when 4 then 'true' when 5 then 'null' when 6 then '[]' else '{}' end, '}}')"""


@query("type_attribute", "select event_id, case event_id % 8 when 0 then 'integer' when 1 then 'double' when 2 then 'double' when 3 then 'big_integer' when 4 then 'boolean' when 5 then 'null' when 6 then 'array' else 'object' end as value_type from events")
def _type(spark, d):
    rows = N.with_attributes(table(spark, d, "events").select("event_id", F.expr(_TYPED).alias("raw")), "event")
    return rows.select("event_id", F.col("attrs")[0]["value_type"].alias("value_type"))


@query("search_values", "select event_id, list_distinct(['m' || (event_id % 3), 'svc-' || (user_id % 7), 'x' || event_id, 'p' || user_id]) is not null as found, 4 as n from events")
def _search(spark, d):
    rows = N.with_attributes(raw_events(spark, d).select("event_id", "raw"), "event")
    v = N.search_values(F.concat(F.lit("m"), F.col("event_id") % 3), F.col("attrs"))
    return rows.select("event_id", (F.get(v, F.lit(0)) == F.concat(F.lit("m"), F.col("event_id") % 3)).alias("found"), F.size(v).alias("n"))
