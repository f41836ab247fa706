import pytest
from oracle import assert_same

from tidemark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sliding_windows_closed_by_the_watermark_are_exact(spark):
    """All windows that end by the watermark, and no others, with all their records."""
    from collections import Counter

    from tidemark.sources.adapters import records

    rows = records(spark, SF).select("project_id", "received_time_us").collect()
    minute, mark = 60_000_000, max(t for _, t in rows) - 600_000_000
    every = Counter((p, (t // minute + i) * minute) for p, t in rows for i in range(1, 6))
    got = {(r["project_id"], r["window_end_us"]): r["n"] for r in QUERIES["st_sliding_count"](spark, SF).collect()}
    assert got == {k: n for k, n in every.items() if k[1] <= mark}


@pytest.mark.parametrize("name", ["record_expired", "src_payload"])
def test_every_record_has_its_row(spark, name):
    from tidemark.sources.adapters import records

    assert QUERIES[name](spark, SF).select("record_id").distinct().count() == records(spark, SF).select("record_id").distinct().count()


def test_search_filters_reach_parquet(spark):
    plan = QUERIES["bench_structured"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(service,svc-2)" in pushed and "EqualTo(level,error)" in pushed


def test_searches_see_a_table_that_was_written_anew(spark, tmp_path):
    from tidemark.sources.adapters import stored_records

    events = spark.read.parquet(f"{SF}/events.parquet")
    for n in (10, 700, 20):
        events.limit(n).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert stored_records(spark, str(tmp_path)).count() == n
    assert stored_records(spark, str(tmp_path)).inputFiles() == stored_records(spark, str(tmp_path)).inputFiles()


def test_stored_records_are_made_behind_the_shuffle(spark):
    """What is shuffled are events, not the records that are made of them; files hold ranges of time, each in order."""
    from pyspark.sql import functions as F

    from tidemark.sources.adapters import records, records_by_time, stored_records, table

    rows = records_by_time(table(spark, SF, "events"), 3)
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "sha2" in above and "sha2" not in below
    t = [r[0] for r in rows.select("event_time_us").collect()]
    assert t == sorted(t) and rows.rdd.getNumPartitions() == 3
    stored = stored_records(spark, SF)
    spans = sorted(tuple(r)[1:] for r in stored.groupBy(F.col("_metadata.file_path")).agg(F.min("event_time_us"), F.max("event_time_us")).collect())
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert stored.exceptAll(records(spark, SF)).isEmpty() and stored.count() == records(spark, SF).count()


def test_payload_rows_are_dealt_over_all_cores(spark):
    """One part of a Parquet file holds all events here; the work on their payloads is still every core's."""
    from tidemark.plans.scalar_queries import raw_events
    from tidemark.sources.adapters import table

    assert table(spark, SF, "events").rdd.getNumPartitions() == 1
    rows = [len(p) for p in raw_events(spark, SF).select("event_id").rdd.glom().collect()]
    assert len(rows) >= spark.sparkContext.defaultParallelism and sum(rows) == table(spark, SF, "events").count() and max(rows) < sum(rows) / 4


def test_raw_logs_are_dealt_over_all_cores(spark):
    from tidemark.plans.ingest_queries import raw_logs

    assert raw_logs(spark, SF).select("event_id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
