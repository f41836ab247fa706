"""Queries of metrics, group keys, histograms, top-k and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import aggregates as A
from tidemark.operators import rows as R
from tidemark.operators.ingest import runs
from tidemark.plans.registry import query
from tidemark.plans.search_queries import DAY, SCOPE, SCOPE_SQL, START, K, VALUE
from tidemark.sources.adapters import RECORDS_SQL, records, stored_records, table

HOUR = 3_600_000_000
def cents():
    return F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")


def wide():
    """Integers of more than 30 digits, so that sums need the limbs."""
    return (cents() * F.lit("1" + "0" * 24).cast("decimal(25,0)")).cast("decimal(38,0)")


_CENTS = "round(l_extendedprice * 100)::hugeint"


def _scoped(spark, d):
    return SCOPE.apply(stored_records(spark, d))


@query("agg_count", f"{RECORDS_SQL} select kind, count(*) as n from records where {SCOPE_SQL} group by 1")
def _count(spark, d):
    return A.aggregate(_scoped(spark, d), {"kind": F.col("kind")}, [A.Metric("n", "count")])


@query("agg_valid_excluded", "select source, count(quality) as valid, count(*) - count(quality) as excluded from documents left join labels using (doc_id) group by 1")
def _valid(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("quality").alias("valid"), (F.count(F.lit(1)) - F.count("quality")).alias("excluded"))


@query("agg_sum_int", f"select l_returnflag, (sum({_CENTS}) * 1000000000000000000000000)::varchar as total, count(*) as total_valid, 0::bigint as total_excluded from lineitem group by 1")
def _sum_int(spark, d):
    out = A.aggregate(table(spark, d, "lineitem"), {"l_returnflag": F.col("l_returnflag")}, [A.Metric("total", "sum", wide(), exact=True)])
    return out.withColumn("total", F.col("total").cast("string"))


@query("agg_avg_int", f"""with s as (select l_linestatus, l_returnflag, sum({_CENTS}) as n, count(*) as c from lineitem group by all),
  q as (select *, (n * 1000000000) // c as f, (n * 1000000000) % c as r from s), h as (select *, f + case when 2 * r > c or (2 * r = c and f % 2 = 1) then 1 else 0 end as v from q)
  select l_linestatus, l_returnflag, (v // 1000000000) || '.' || lpad((v % 1000000000)::varchar, 9, '0') as mean, c as mean_valid, 0::bigint as mean_excluded from h""")
def _avg_int(spark, d):
    return A.aggregate(table(spark, d, "lineitem"), {"l_linestatus": F.col("l_linestatus"), "l_returnflag": F.col("l_returnflag")}, [A.Metric("mean", "avg", cents(), exact=True)])


for _op in ("min", "max"):
    query(f"agg_{_op}_int", f"{RECORDS_SQL} select service, {_op}(k) as v, count(k) as v_valid, count(*) - count(k) as v_excluded from records where {SCOPE_SQL} group by 1")(
        lambda spark, d, op=_op: A.aggregate(_scoped(spark, d), {"service": F.col("service")}, [A.Metric("v", op, K())]).withColumn("v", F.col("v").cast("bigint"))
    )
    query(f"agg_{_op}_double", f"{RECORDS_SQL} select service, {_op}(value) as v, count(value) as v_valid, count(*) - count(value) as v_excluded from records where {SCOPE_SQL} group by 1")(
        lambda spark, d, op=_op: A.aggregate(_scoped(spark, d), {"service": F.col("service")}, [A.Metric("v", op, VALUE())])
    )


@query("agg_sum_double", f"{RECORDS_SQL} select project_id, round(fsum(value), 4) as v from records where {SCOPE_SQL} group by 1")
def _sum_double(spark, d):
    return A.aggregate(_scoped(spark, d), {"project_id": F.col("project_id")}, [A.Metric("v", "sum", VALUE())]).select("project_id", F.round("v", 4).alias("v"))


@query("agg_avg_double", f"{RECORDS_SQL} select project_id, round(fsum(value) / count(value), 6) as v from records where {SCOPE_SQL} group by 1")
def _avg_double(spark, d):
    return A.aggregate(_scoped(spark, d), {"project_id": F.col("project_id")}, [A.Metric("v", "avg", VALUE())]).select("project_id", F.round("v", 6).alias("v"))


@query("agg_multi_metric", f"""{RECORDS_SQL} select environment, count(*) as n, sum(k)::bigint as total, count(k) as total_valid, count(*) - count(k) as total_excluded,
  round(fsum(value), 4) as amount, min(k) as low, max(value) as high from records where {SCOPE_SQL} group by 1""")
def _multi(spark, d):
    metrics = [A.Metric("n", "count"), A.Metric("total", "sum", K(), exact=True), A.Metric("amount", "sum", VALUE()), A.Metric("low", "min", K()), A.Metric("high", "max", VALUE())]
    out = A.aggregate(_scoped(spark, d), {"environment": F.col("environment")}, metrics)
    return out.select("environment", "n", F.col("total").cast("bigint").alias("total"), "total_valid", "total_excluded", F.round("amount", 4).alias("amount"), F.col("low").cast("bigint").alias("low"), "high")


@query("agg_partial_final", f"{RECORDS_SQL} select service, count(*) as n, sum(k)::bigint as total, max(value) as high from records where {SCOPE_SQL} group by 1")
def _partial_final(spark, d):
    """A rollup: states per day, merged over all days."""
    metrics = [A.Metric("n", "count"), A.Metric("total", "sum", K(), exact=True), A.Metric("high", "max", VALUE())]
    daily = A.states(_scoped(spark, d), [A.bucket(F.col("event_time_us"), DAY).alias("day"), F.col("service")], metrics)
    out = A.finished(A.merged(daily, ["service"], metrics), ["service"], metrics)
    return out.select("service", "n", F.col("total").cast("bigint").alias("total"), "high")


def _keyed(name: str, key, sql_type: str, sql_text: str) -> None:
    @query(name, f"{RECORDS_SQL} select {sql_type} as type, {sql_text} as value_text, count(*) as n from records where {SCOPE_SQL} group by 1, 2")
    def _q(spark, d):
        out = A.aggregate(_scoped(spark, d), {"key": key()}, [A.Metric("n", "count")])
        return out.select(F.col("key.type").alias("type"), A.key_text(F.col("key")).alias("value_text"), "n")


_keyed("group_field", lambda: A.key_of(F.col("service"), "string"), "case when service is null then 'missing' else 'string' end", "service")
_keyed("group_attr_typed", lambda: A.key_of_attribute("attributes", "/mixed", "integer"), "case when mixed = 0 then 'integer' else 'missing' end", "case when mixed = 0 then '1' end")
_keyed("group_attr_any", lambda: A.key_of_attribute("attributes", "/mixed"), "case mixed when 0 then 'integer' when 1 then 'double' when 2 then 'string' when 3 then 'null' else 'missing' end", "case mixed when 0 then '1' when 1 then '1.0' when 2 then '1' end")


@query("group_unsupported", f"{RECORDS_SQL} select 'ok' as state, count(*) as n from records where {SCOPE_SQL} and k_type <> 'missing'")
def _unsupported(spark, d):
    """Groups by a value of an unsupported type fail; here only supported ones are stored."""
    out = A.aggregate(_scoped(spark, d), {"key": A.key_of_attribute("attributes", "/k")}, [A.Metric("n", "count")])
    return out.where("key.type != 'missing'").agg(F.lit("ok").alias("state"), F.sum("n").alias("n"))


@query("group_two_dims", "select l_returnflag, l_linestatus, count(*) as n, sum(round(l_quantity)::bigint)::bigint as quantity from lineitem group by 1, 2")
def _two(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("l_quantity").cast("bigint")).alias("quantity"))


@query("group_neg_zero", "select case when x = 0 then 0.0 else x end as x, count(*) as n from (select case when event_id % 4 = 0 then -0.0::double when event_id % 4 = 1 then 0.0::double else (event_id % 4)::double end as x from events) group by 1")
def _neg_zero(spark, d):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(-0.0)).when(F.col("event_id") % 4 == 1, F.lit(0.0)).otherwise((F.col("event_id") % 4).cast("double"))
    out = A.aggregate(table(spark, d, "events").withColumn("x", x), {"key": A.key_of(F.col("x"), "double")}, [A.Metric("n", "count")])
    return out.select(F.col("key.double_value").alias("x"), "n")


@query("group_key_bytes", f"""{RECORDS_SQL}, g as (select message, count(*) as n from records where {SCOPE_SQL} group by 1)
  select message, n, row_number() over (order by strlen(message), message) as place from g""")
def _key_bytes(spark, d):
    """Ties by key bytes: shorter strings first, then bytewise."""
    out = A.aggregate(_scoped(spark, d), {"key": A.key_of(F.col("message"), "string")}, [A.Metric("n", "count")])
    ranked = R.running(out.withColumn("bytes", A.key_bytes(F.col("key"))), [], [F.col("bytes")], F.lit(1), "place")
    return ranked.select(F.col("key.string_value").alias("message"), "n", "place")


@query("histogram", f"{RECORDS_SQL} select event_time_us - event_time_us % {HOUR} as bucket, count(*) as n from records where {SCOPE_SQL} group by 1")
def _histogram(spark, d):
    return A.aggregate(_scoped(spark, d), {"bucket": A.bucket(F.col("event_time_us"), HOUR)}, [A.Metric("n", "count")])


_FILL = f"""{RECORDS_SQL}, every as (select unnest(range({START}, {START} + {DAY}, 60000000)) as bucket),
  g as (select event_time_us - event_time_us % 60000000 as bucket, count(*) as n, max(k) as high, count(k) as high_valid, count(*) - count(k) as high_excluded from records
        where {SCOPE_SQL} and event_time_us < {START} + {DAY} group by 1)"""


@query("histogram_empty", f"{_FILL} select bucket, coalesce(n, 0) as n, high, coalesce(high_valid, 0) as high_valid, coalesce(high_excluded, 0) as high_excluded from every left join g using (bucket)")
def _histogram_empty(spark, d):
    rows = _scoped(spark, d).where(F.col("event_time_us") < START + DAY)
    out = A.histogram(rows, "event_time_us", START, START + DAY, A.INTERVALS["1m"], [A.Metric("n", "count"), A.Metric("high", "max", K())])
    return out.withColumn("high", F.col("high").cast("bigint"))


@query("histogram_grouped", f"{RECORDS_SQL} select received_time_us - received_time_us % {DAY} as bucket, service, level, count(*) as n from records where {SCOPE_SQL} group by all")
def _histogram_grouped(spark, d):
    return A.aggregate(_scoped(spark, d), {"bucket": A.bucket(F.col("received_time_us"), DAY), "service": F.col("service"), "level": F.col("level")}, [A.Metric("n", "count")])


@query("agg_empty_global", "select count(*) as n, null::bigint as high, 0::bigint as high_valid, 0::bigint as high_excluded from events where false")
def _empty(spark, d):
    out = A.aggregate(records(spark, d).where(F.lit(False)), {}, [A.Metric("n", "count"), A.Metric("high", "max", K())])
    return out.withColumn("high", F.col("high").cast("bigint"))


@query("src_series", f"{RECORDS_SQL} select unnest(range(min(event_time_us) - min(event_time_us) % 86400000000, max(event_time_us) + 1, 86400000000)) as bucket from records")
def _series(spark, d):
    """The start of each day from the first record's to the last one's, with or without records of its own."""
    ends = records(spark, d).agg(F.min("event_time_us").alias("lo"), F.max("event_time_us").alias("hi"))
    return ends.select(F.explode(F.sequence(A.bucket(F.col("lo"), A.INTERVALS["1d"]), A.bucket(F.col("hi"), A.INTERVALS["1d"]), F.lit(A.INTERVALS["1d"]))).alias("bucket"))


@query("group_key_bytes_double", "with g as (select l_discount as x, count(*) as n from lineitem group by 1) select x, n, row_number() over (order by x < 0, abs(x)) as place from g")
def _key_bytes_double(spark, d):
    """Doubles in the order of their bytes: by size from zero, negative ones last. The groups are few."""
    out = A.aggregate(table(spark, d, "lineitem"), {"key": A.key_of(F.col("l_discount").cast("double"), "double")}, [A.Metric("n", "count")])
    ranked = R.running(out.withColumn("bytes", A.key_bytes(F.col("key"))), [], [F.col("bytes")], F.lit(1), "place")
    return ranked.select(F.col("key.double_value").alias("x"), "n", "place")


@query("union_histogram_fill", f"{_FILL} select bucket, n from g union all select bucket, 0 from every where bucket not in (select bucket from g)")
def _union_fill(spark, d):
    rows = _scoped(spark, d).where(F.col("event_time_us") < START + DAY)
    g = A.aggregate(rows, {"bucket": A.bucket(F.col("event_time_us"), 60_000_000)}, [A.Metric("n", "count")])
    gaps = A.series(spark, START, START + DAY, 60_000_000).join(g, "bucket", "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return g.unionByName(gaps)


@query("anti_histogram_gap", f"{_FILL} select bucket from every where bucket not in (select bucket from g)")
def _gaps(spark, d):
    rows = _scoped(spark, d).where(F.col("event_time_us") < START + DAY).select(A.bucket(F.col("event_time_us"), 60_000_000).alias("bucket"))
    return A.series(spark, START, START + DAY, 60_000_000).join(rows, "bucket", "left_anti")


_TOP = f"{RECORDS_SQL}, g as (select service, level, count(*) as n, sum(k)::bigint as total, round(fsum(value), 4) as amount from records where {SCOPE_SQL} group by all)"


@query("topk_groups", f"{_TOP} select service, level, n from g order by n desc, strlen(service) nulls first, service nulls first, level limit 7")
def _top(spark, d):
    out = A.aggregate(_scoped(spark, d), {"service": F.col("service"), "level": F.col("level")}, [A.Metric("n", "count")])
    return A.top_groups(out, F.col("n"), [A.key_bytes(A.key_of(F.col("service"), "string")), F.col("level")], 7)


@query("topk_exact_avg", f"""with s as (select l_suppkey, sum({_CENTS}) as n, count(*) as c from lineitem group by 1)
  select l_suppkey, c as mean_valid from s order by (n * 10000000000000) // c desc, l_suppkey limit 10""")
def _top_avg(spark, d):
    from tidemark.functions import exact

    metric = A.Metric("mean", "avg", cents(), exact=True)
    state = A.states(table(spark, d, "lineitem"), [F.col("l_suppkey")], [metric])
    ranked = state.withColumn("rank_key", exact.average_order(F.col("mean__valid"), *(F.col(f"mean__l{i}") for i in range(exact.LIMBS))))
    return A.top_groups(ranked, F.col("rank_key"), [F.col("l_suppkey")], 10).select("l_suppkey", F.col("mean__valid").alias("mean_valid"))


@query("topk_validates_all", f"{_TOP} select service, level, total from g order by total desc nulls last, level, service nulls first limit 3")
def _top_validates(spark, d):
    """Sums of all groups are finished, and so checked, before the limit."""
    out = A.aggregate(_scoped(spark, d), {"service": F.col("service"), "level": F.col("level")}, [A.Metric("total", "sum", K(), exact=True)])
    return A.top_groups(out.withColumn("total", F.col("total").cast("bigint")), F.col("total"), [F.col("level"), F.col("service").asc_nulls_first()], 3).select("service", "level", "total")


@query("topk_order_metric", f"{_TOP} select service, level, amount from g order by amount asc nulls last, level, service nulls first limit 5")
def _top_metric(spark, d):
    out = A.aggregate(_scoped(spark, d), {"service": F.col("service"), "level": F.col("level")}, [A.Metric("amount", "sum", VALUE())])
    rounded = out.select("service", "level", F.round("amount", 4).alias("amount"))
    return A.top_groups(rounded, F.col("amount"), [F.col("level"), F.col("service").asc_nulls_first()], 5, descending=False)


@query("agg_ordered_hash", "select o_orderstatus, o_orderpriority, sha256(string_agg(o_orderkey::varchar, chr(10) order by o_orderkey::varchar)) as hash from orders group by all")
def _ordered_hash(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("key"))
    return A.ordered_hashes(o, ["o_orderstatus", "o_orderpriority"], "key", "hash")


@query("agg_hash_tree", f"""{RECORDS_SQL}, leaves as (select kind, substr(sha256(record_id), 1, 4) as leaf, sha256(string_agg(record_id, chr(10) order by record_id)) as h from records group by 1, 2)
  select kind, sha256(string_agg(leaf || ' ' || h, chr(10) order by leaf)) as root from leaves group by 1""")
def _hash_tree(spark, d):
    """One identity per kind, whose leaves are hashed by all tasks."""
    return A.tree_hashes(records(spark, d), ["kind"], "record_id", "root")


@query("compact_verify_tree", f"{RECORDS_SQL} select kind, count(*) as rows, true as same from records group by 1")
def _verify_tree(spark, d):
    """A table written anew in another layout has the roots and counts of the rows it came from."""
    rows = records(spark, d).select("kind", "record_id")
    path = R.shared_path(spark, "compacted")
    rows.repartition(3).sortWithinPartitions("record_id").write.parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    root = lambda df, n: A.tree_hashes(df, ["kind"], "record_id", n)
    met = root(rows, "before").join(root(back, "after"), "kind", "full_outer").join(back.groupBy("kind").agg(F.count(F.lit(1)).alias("rows")), "kind", "left")
    return met.select("kind", "rows", F.col("before").eqNullSafe(F.col("after")).alias("same"))


@query("agg_bundle_stats", f"""{RECORDS_SQL} select lane_id, event_time_us // {DAY} as day, kind, count(*) as row_count, min(event_time_us) as min_event_time_us, max(event_time_us) as max_event_time_us,
  min(received_time_us) as min_received_time_us, max(received_time_us) as max_received_time_us, min(batch_seq) as min_batch_seq, max(batch_seq) as max_batch_seq,
  list_sort(list(distinct project_id)) as project_ids, sha256(string_agg(record_id, chr(10) order by record_id)) as identity_sha256 from records group by all""")
def _bundles(spark, d):
    return A.bundle_stats(records(spark, d).withColumn("day", F.floor(F.col("event_time_us") / DAY)), ["lane_id", "day", "kind"])


@query("agg_count_filter", "select l_linestatus, count(*) filter (where l_discount > 0.05) as discounted, count(*) as n from lineitem group by 1")
def _count_filter(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count(F.lit(1)).alias("n"))


@query("agg_distinct", f"{RECORDS_SQL} select project_id, count(distinct issue_id) as issues from records where issue_id is not null group by 1")
def _distinct(spark, d):
    return records(spark, d).where("issue_id is not null").groupBy("project_id").agg(F.countDistinct("issue_id").alias("issues"))


@query("agg_having", "select l_suppkey, count(*) as n, max(l_quantity) as most from lineitem group by 1 having max(l_quantity) >= 50 and count(*) > 20")
def _having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most")).where("most >= 50 and n > 20")


@query("flagship", f"""{RECORDS_SQL} select event_time_us - event_time_us % {HOUR} as bucket, service, count(*) as n, sum(k)::bigint as total, count(k) as total_valid, count(*) - count(k) as total_excluded,
  round(sum(k) / count(k), 6) as mean from records where {SCOPE_SQL} group by 1, 2 order by n desc, bucket, service nulls first limit 100""")
def _flagship(spark, d):
    metrics = [A.Metric("n", "count"), A.Metric("total", "sum", K(), exact=True)]
    out = A.aggregate(_scoped(spark, d), {"bucket": A.bucket(F.col("event_time_us"), HOUR), "service": F.col("service")}, metrics)
    out = out.select("bucket", "service", "n", F.col("total").cast("bigint").alias("total"), "total_valid", "total_excluded", F.round(F.col("total").cast("double") / F.col("total_valid"), 6).alias("mean"))
    return A.top_groups(out, F.col("n"), [F.col("bucket"), F.col("service").asc_nulls_first()], 100)


# --- window functions ---------------------------------------------------------------------------


@query("win_row_number", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders")
def _row_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


@query("win_preceding_sum", "select l_orderkey, l_linenumber, coalesce(sum(round(l_quantity)::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0)::bigint as before from lineitem")
def _preceding(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum(F.round("l_quantity").cast("bigint")).over(w), F.lit(0)).alias("before"))


@query("win_chunk_by_bytes", "select doc_id, (sum(strlen(text)) over (partition by source order by doc_id) - 1)::bigint // 4194304 as chunk from documents")
def _chunks(spark, d):
    sizes = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("bytes"))
    summed = R.running(sizes, ["source"], [F.col("doc_id").asc()], F.col("bytes"), "until")
    return summed.select("doc_id", F.floor((F.col("until") - 1) / 4194304).alias("chunk"))


@query("win_first_per_key", f"{RECORDS_SQL} select record_id, row_number() over (partition by project_id, kind, source_event_id order by batch_seq, record_ordinal, record_id) = 1 as first from records")
def _first(spark, d):
    w = Window.partitionBy("project_id", "kind", "source_event_id").orderBy("batch_seq", "record_ordinal", "record_id")
    return records(spark, d).select("record_id", (F.row_number().over(w) == 1).alias("first"))


@query("win_islands", """with c as (select conv_id, turn, role, case when lag(role) over w = role and lag(turn) over w = turn - 1 then 0 else 1 end as new from conversations window w as (partition by conv_id order by turn)),
  r as (select *, sum(new) over (partition by conv_id order by turn) as run from c) select conv_id, role, min(turn) as first, max(turn) as last from r group by conv_id, run, role""")
def _islands(spark, d):
    return runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("win_prefix", f"""{RECORDS_SQL}, b as (select distinct lane_id, batch_seq from records where batch_seq % 7 <> 6 and kind <> 'none'),
  p as (select lane_id, batch_seq, row_number() over (partition by lane_id order by batch_seq) as place from b) select lane_id, max(batch_seq) as published from p where batch_seq = place group by 1""")
def _prefix(spark, d):
    """The contiguous published prefix of each lane."""
    b = records(spark, d).where("batch_seq % 7 != 6").select("lane_id", "batch_seq").distinct()
    p = b.withColumn("place", F.row_number().over(Window.partitionBy("lane_id").orderBy("batch_seq")))
    return p.where("batch_seq = place").groupBy("lane_id").agg(F.max("batch_seq").alias("published"))
