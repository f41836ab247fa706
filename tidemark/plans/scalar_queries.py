"""Queries of the scalar functions over columns that the driver tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions import scalars as S
from tidemark.plans.registry import query
from tidemark.sources.adapters import RECORDS_SQL, dealt_events, records, table

#: Raw levels, as events would carry them.
_RAW = "case event_id % 7 when 0 then 'WARN' when 1 then 'critical' when 2 then '' when 3 then 'Info' when 4 then 'weird' when 5 then null else event_type end"


def _events(spark, d):
    return table(spark, d, "events")


_LEVEL = """case when raw is null or raw = '' then '{0}' when lower(raw) = 'warn' then 'warning' when lower(raw) = 'critical' then 'fatal' when lower(raw) in ('info', 'error') then lower(raw) else 'unknown' end"""


@query("fn_level", f"select event_id, {_LEVEL.format('error')} as event_level, {_LEVEL.format('unknown')} as log_level from (select event_id, {_RAW} as raw from events)")
def _level(spark, d):
    raw = F.expr(_RAW)
    return _events(spark, d).select("event_id", S.level(raw, True).alias("event_level"), S.level(raw, False).alias("log_level"))


@query("fn_severity_number", "select event_id, (case when event_id % 40 between 1 and 24 then event_id % 40 when user_id % 30 between 1 and 24 then user_id % 30 end)::smallint as severity from events")
def _severity(spark, d):
    return _events(spark, d).select("event_id", S.severity_number((F.col("event_id") % 40).cast("string"), (F.col("user_id") % 30).cast("string")).alias("severity"))


@query("fn_severity_level", "select event_id, case (event_id % 24) // 4 when 0 then 'trace' when 1 then 'debug' when 2 then 'info' when 3 then 'warning' when 4 then 'error' else 'fatal' end as level from events")
def _severity_level(spark, d):
    return _events(spark, d).select("event_id", S.severity_level(F.col("event_id") % 24 + 1).alias("level"))


@query("fn_representative_severity", f"{RECORDS_SQL} select record_id, (case level when 'info' then 9 when 'warning' then 13 when 'error' then 17 end)::smallint as number from records")
def _representative(spark, d):
    return records(spark, d).select("record_id", S.representative_severity(F.col("level")).alias("number"))


@query("fn_parse_timestamp", """select event_id, case when event_id % 3 = 0 then epoch_us(ts) - epoch_us(ts) % 1000000 + event_id % 1000000 when event_id % 3 = 1 then epoch_us(ts) else -event_id * 1000 - 1 end as us,
  (case when event_id % 3 = 0 then 789 when event_id % 3 = 1 then 250 else 999 end)::smallint as ns from events""")
def _timestamp(spark, d):
    e = _events(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    rfc = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000000).cast("string"), 6, "0"), F.lit("789Z"))
    seconds = F.concat(F.floor(F.col("t") / 1000000), F.lit("."), F.lpad((F.col("t") % 1000000).cast("string"), 6, "0"), F.lit("25"))
    # Just before a millisecond before the epoch: it floors.
    early = F.concat(F.lit("-"), F.floor(F.col("event_id") / 1000), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("000001"))
    us, ns = S.parse_timestamp(F.when(F.col("event_id") % 3 == 0, rfc).when(F.col("event_id") % 3 == 1, seconds).otherwise(early))
    return e.select("event_id", us.alias("us"), ns.alias("ns"))


@query("fn_timestamp_source", f"select event_id, case when raw is null or raw = '' then 'arrival' else 'sdk' end as source from (select event_id, {_RAW} as raw from events)")
def _source(spark, d):
    return _events(spark, d).select("event_id", S.timestamp_source(F.expr(_RAW)).alias("source"))


@query("fn_event_day", f"{RECORDS_SQL} select record_id, ts::date as day from records")
def _day(spark, d):
    return records(spark, d).select("record_id", S.event_day(F.col("event_time_us")).alias("day"))


_IDS = "case event_id % 4 when 0 then upper(md5(event_id::varchar)) when 1 then '00000000-0000-0000-0000-000000000000' when 2 then 'short' else md5(event_id::varchar) end"


@query("fn_event_id", "select event_id, case when event_id % 4 in (0, 3) then md5(event_id::varchar) end as id from events")
def _event_id(spark, d):
    m = F.md5(F.col("event_id").cast("string"))
    dashed = F.concat_ws("-", *(F.substring(F.upper(m), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    raw = F.when(F.col("event_id") % 4 == 0, dashed).when(F.col("event_id") % 4 == 1, "00000000-0000-0000-0000-000000000000").when(F.col("event_id") % 4 == 2, "short").otherwise(m)
    return _events(spark, d).select("event_id", S.event_id(raw).alias("id"))


@query("fn_trace_id", f"select event_id, case when event_id % 4 in (0, 3) then lower(raw) end as id from (select event_id, {_IDS} as raw from events)")
def _trace(spark, d):
    return _events(spark, d).select("event_id", S.trace_id(F.expr(_IDS.replace("::varchar", "::string"))).alias("id"))


@query("fn_span_id", "select event_id, case when event_id % 2 = 0 then substr(md5(event_id::varchar), 1, 16) end as id from events")
def _span(spark, d):
    return _events(spark, d).select("event_id", S.span_id(F.substring(F.upper(F.md5(F.col("event_id").cast("string"))), F.lit(1), F.when(F.col("event_id") % 2 == 0, 16).otherwise(15))).alias("id"))


@query("fn_record_id", r"""select event_id, sha256(unhex(printf('%016x', 6)) || 'record'::blob || unhex(printf('%016x', strlen(event_type))) || event_type::blob || unhex(printf('%016x', strlen(event_id::varchar))) || event_id::varchar::blob) as id from events""")
def _record_id(spark, d):
    return _events(spark, d).select("event_id", S.record_id("record", F.col("event_type"), F.col("event_id").cast("string")).alias("id"))


@query("fn_lane", "select event_id, ('0x' || substr(sha256(unhex(md5(event_id::varchar))), 1, 2))::int % 16 as lane from events")
def _lane(spark, d):
    return _events(spark, d).select("event_id", S.lane(F.md5(F.col("event_id").cast("string"))).alias("lane"))


@query("fn_transition_id", """select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id
  from (select event_id, sha256(event_type || ':' || (event_id % 9)) as h from events)""")
def _transition(spark, d):
    return _events(spark, d).select("event_id", S.transition_id(F.col("event_type"), F.col("event_id") % 9).alias("id"))


@query("fn_pointer_escape", "select page_id, replace(replace(url, '~', '~0'), '/', '~1') as path from pages")
def _escape(spark, d):
    return table(spark, d, "pages").select("page_id", S.pointer_escape(F.col("url")).alias("path"))


@query("fn_pointer_valid", "select page_id, page_id % 3 <> 0 and not contains(url, '~') as valid from pages")
def _valid(spark, d):
    return table(spark, d, "pages").select("page_id", S.pointer_valid(F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("/"), F.col("url"), F.lit("~1"))).otherwise(F.concat(F.lit("/"), F.col("url"), F.lit("~2")))).alias("valid"))


@query("fn_truncate_runes", "select doc_id, substr(text, 1, 512) as head from documents")
def _runes(spark, d):
    return table(spark, d, "documents").select("doc_id", S.truncate_runes(F.col("text")).alias("head"))


@query("fn_unsupported_type", "select page_id, case when strlen(t) > 128 then substr(t, 1, 100) || '#' || substr(sha256(t), 1, 16) else t end as kind from (select page_id, repeat(url, 1 + page_id::int % 5) as t from pages)")
def _unsupported(spark, d):
    return table(spark, d, "pages").select("page_id", S.unsupported_type(F.expr("repeat(url, int(1 + page_id % 5))")).alias("kind"))


@query("fn_scrub_url", r"""select page_id, case when q = '' then url else regexp_extract(url, '^([^?#]*)', 1) || case when f = '' then '' else '?' || f end || regexp_extract(url, '(#.*)$', 1) end as url
  from (select *, array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' and not contains(p, ';') and not regexp_matches(regexp_replace(p, '%[0-9A-Fa-f]{2}', '', 'g'), '%')), lambda p: url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')))),
    lambda k: replace(url_encode(k), '%20', '+') || '=%5BFiltered%5D'), '&') as f
    from (select page_id, url, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q from (select page_id, case page_id % 4 when 0 then url || '?b=1&%C3%A9+x=2&=3&&c;d=4&~*=5#top' when 1 then url || '?&' else url end as url from pages)))""")
def _scrub(spark, d):
    made = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("?b=1&%C3%A9+x=2&=3&&c;d=4&~*=5#top"))).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("?&"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", S.scrub_url(made).alias("url"))


_KEYS = "case event_id % 6 when 0 then 'Authorization' when 1 then 'db.password' when 2 then 'tokens' when 3 then 'x_api_key' when 4 then ' Secret ' else event_type end"


@query("fn_sensitive_key", f"select event_id, regexp_matches(lower(trim({_KEYS})), '(^|[._])(authorization|cookie|password|passwd|token|secret|api_key|apikey)$') as sensitive from events")
def _sensitive(spark, d):
    return _events(spark, d).select("event_id", S.sensitive_key(F.expr(_KEYS)).alias("sensitive"))


@query("fn_limb", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (c // 1000000000 * s)::bigint as high, (c % 1000000000 * s)::bigint as low from (select *, round(l_extendedprice * 100)::hugeint * 1000003 as c, case when l_linenumber % 2 = 0 then -1 else 1 end as s from lineitem)")
def _limb(spark, d):
    x = (F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)") * 1000003 * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).cast("decimal(38,0)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", exact.limb(x, 1).cast("bigint").alias("high"), exact.limb(x, 0).cast("bigint").alias("low"))


@query("fn_round_half_even9", """with s as (select l_suppkey, sum(case when l_linenumber % 2 = 0 then -l_partkey else l_partkey end)::hugeint as n, count(*) as c from lineitem group by 1),
  q as (select *, abs(n) * 1000000000 // c as f, abs(n) * 1000000000 % c as r from s), h as (select *, f + case when 2 * r > c or (2 * r = c and f % 2 = 1) then 1 else 0 end as v from q)
  select l_suppkey, case when n < 0 and v > 0 then '-' else '' end || (v // 1000000000) || '.' || lpad((v % 1000000000)::varchar, 9, '0') as mean from h""")
def _half_even(spark, d):
    x = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).cast("decimal(38,0)")
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c"), *exact.limb_sums(x, "l"))
    return s.select("l_suppkey", exact.exact_average(F.col("c"), *(F.col(f"l{i}") for i in range(exact.LIMBS))).alias("mean"))


@query("fn_width_bucket", "select doc_id, (n_chars >= 500)::int + (n_chars >= 2000)::int + (n_chars >= 8000)::int as tier from documents")
def _bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", S.width_bucket(F.col("n_chars"), [500, 2000, 8000]).alias("tier"))


@query("fn_row_bytes", "select vec_id, strlen(label::varchar) + 32 * len(embedding) as bytes from embeddings")
def _row_bytes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.row_bytes([F.col("label").cast("string")], lists=[F.col("embedding")]).alias("bytes"))


#: A raw event as JSON, from an events row.
_RAW_JSON = """concat('{"event_id":"', md5(string(event_id)), '","level":"', event_type, '","tags":{"service.name":"svc-', user_id % 7, '","a.b":"x', event_id, '"},"user":{"id":', user_id, ',"password":"p', user_id, '"}',
 if(event_id % 2 = 0, concat(',"exception":{"values":[{"type":"Base","value":"v"},{"type":"E', user_id % 5, '","value":"', event_type, ' failed","mechanism":{"handled":', if(event_id % 4 = 0, 'true', 'false'), '},"stacktrace":{"frames":[{"module":"m', user_id % 3, '","function":"f","filename":"a.py","in_app":true}]}}]}'), ''),
 if(event_id % 3 = 0, concat(',"logentry":{"message":"took %s","formatted":"took ', event_id % 50, '"}'), if(event_id % 5 = 0, concat(',"message":"plain ', event_id % 11, '"'), '')), '}')"""


def raw_events(spark, d):
    """events with ``raw``: the event as an SDK would send it."""
    return dealt_events(spark, d).withColumn("raw", F.expr(_RAW_JSON))


@query("fn_exception", """select event_id, case when event_id % 2 = 0 then 'E' || (user_id % 5) end as type, case when event_id % 2 = 0 then event_type || ' failed' end as value, case when event_id % 2 = 0 then event_id % 4 = 0 end as handled from events""")
def _exception(spark, d):
    last = S.last_exception(F.col("raw"))
    return raw_events(spark, d).select("event_id", last["type"].alias("type"), last["value"].alias("value"), last["mechanism"]["handled"].alias("handled"))


@query("fn_event_message", """select event_id, case when event_id % 3 = 0 then 'took ' || (event_id % 50) when event_id % 5 = 0 then 'plain ' || (event_id % 11) when event_id % 2 = 0 then event_type || ' failed' else '' end as message,
  case when event_id % 3 = 0 then 'took %s' end as template from events""")
def _message(spark, d):
    return raw_events(spark, d).select("event_id", S.event_told(F.col("raw")).alias("told")).select("event_id", "told.message", "told.template")


@query("fn_json_extract", "select event_id, 'svc-' || (user_id % 7) as service, user_id as user, event_type as level from events")
def _extract(spark, d):
    parsed = F.from_json("raw", "struct<tags:map<string,string>,user:struct<id:bigint>,level:string>")
    return raw_events(spark, d).select("event_id", parsed.alias("p")).select("event_id", F.col("p.tags")["service.name"].alias("service"), F.col("p.user.id").alias("user"), F.col("p.level").alias("level"))


@query("fn_json_canonical", """select event_id, sha256('{"a":' || event_id || '.0,"b":{"c":[1,2e0,"' || event_type || '"],"d":null}}') as hash from events""")
def _canonical(spark, d):
    raw = F.expr("""concat('{ "b" : {"d":null, "c":[1, 2e0, "', event_type, '"]}, "a":', event_id, '.0 }')""")
    return _events(spark, d).select("event_id", F.sha2(S.json_canonical(raw), 256).alias("hash"))


@query("fn_list_distinct", "select conv_id, count(*) > count(distinct role) as repeated from conversations group by 1")
def _list_distinct(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return roles.select("conv_id", (F.size("roles") > F.size(F.array_distinct("roles"))).alias("repeated"))


@query("fn_range_contains", "select event_id, event_id % 128 between 3 and 9 or event_id % 128 between 40 and 77 as inside from events")
def _range(spark, d):
    ranges = F.array(F.array(F.lit(3), F.lit(9)), F.array(F.lit(40), F.lit(77)))
    return _events(spark, d).select("event_id", S.in_ranges(F.col("event_id") % 128, ranges).alias("inside"))


@query("fn_dotted_path_key", "select event_id, 'x' || event_id as value from events")
def _dotted(spark, d):
    return raw_events(spark, d).select("event_id", S.dotted_key(F.get_json_object("raw", "$.tags"), "a.b").alias("value"))
