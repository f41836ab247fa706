"""Row search: orders, keyset paging, details and related records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.io import shared_path
from tidemark.sources.schema import DETAIL_COLUMNS, LIST_COLUMNS

EVENT_ORDER = ("event_time_us", "event_time_ns_remainder", "record_id")
RECEIVED_ORDER = ("received_time_us", "lane_id", "batch_seq", "record_ordinal", "record_id")
APPEND_ORDER = ("lane_id", "batch_seq", "record_ordinal", "record_id")


def after(order: tuple[str, ...], last: tuple) -> Column:
    """Rows that follow ``last`` in a descending order. The leading comparison alone prunes row groups."""
    tuple_order = F.struct(*order) < F.struct(*(F.lit(v).alias(c) for c, v in zip(order, last)))
    return (F.col(order[0]) <= last[0]) & tuple_order


def page(rows: DataFrame, order: tuple[str, ...], size: int, last: tuple | None = None, descending: bool = True) -> DataFrame:
    """The next ``size`` rows plus one, in order; the extra row tells that more follow."""
    if not 1 <= size <= 1000:
        raise ValueError("a page has between 1 and 1000 rows")
    if last is not None:
        rows = rows.where(after(order, last))
    return rows.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c in order)).limit(size + 1)


def with_more(paged: DataFrame, order: tuple[str, ...], size: int) -> DataFrame:
    """A page without its extra row; ``has_more`` and ``is_last`` (the row whose key opens the next page) on each row.

    Runs on at most ``size`` + 1 rows.
    """

    w = Window.partitionBy(F.lit(0)).orderBy(*(F.col(c).desc() for c in order))
    every = Window.partitionBy(F.lit(0))
    out = paged.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(every))
    out = out.where(F.col("__i") <= size)
    return out.withColumn("has_more", F.col("__n") > size).withColumn("is_last", F.col("__i") == F.least("__n", F.lit(size))).drop("__i", "__n")


def list_projection(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in LIST_COLUMNS if c in rows.columns))


def preview(message: Column, most: int = 2048) -> tuple[Column, Column]:
    """(message cut to ``most`` bytes at a character boundary, whether it was cut)."""
    raw = F.encode(message, "UTF-8")
    # A byte that opens a character of n bytes must have n - 1 bytes behind it: step back over an incomplete one.
    lead = [F.conv(F.hex(F.substring(raw, most + 1 - i, 1)), 16, 10).cast("int") for i in range(4)]
    back = F.lit(0)
    opened = F.lit(False)
    inside = lead[0].between(128, 191)  # the first byte left out continues a character
    for i in (1, 2, 3):
        here = inside & ~opened & (lead[i] >= 192)
        back = F.when(here, F.lit(i)).otherwise(back)
        opened = opened | here
    size = F.octet_length(message)
    text = F.when(size <= most, message).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "UTF-8"))
    return text, size > most


def detail(records: DataFrame, payloads: DataFrame, record_id: str) -> DataFrame:
    """One record with its payload: none or one row; two are corruption and fail."""
    one = records.where(F.col("record_id") == record_id).join(payloads.where(F.col("record_id") == record_id), "record_id").limit(2)
    n = F.count(F.lit(1)).over(_all())
    checked = one.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("the record is stored twice")).cast("boolean")).otherwise(F.lit(True))).drop("__n")
    return checked.select(*(c for c in DETAIL_COLUMNS if c in checked.columns))


def _all():

    return Window.partitionBy(F.lit(0))


def related(records: DataFrame, seeds: DataFrame, within_us: int = 300_000_000) -> DataFrame:
    """(seed_id, record_id): records of the seed's trace; for seeds without trace, records of the same project and
    service (null is a service of its own) within ``within_us``.

    The range join is keyed by time slices, so a busy service is spread over them.
    """
    r = records.select("record_id", "project_id", "service", "trace_id", "event_time_us")
    s = seeds.select(*(F.col(c).alias(f"s_{c}") for c in r.columns))
    by_trace = s.where("s_trace_id is not null").join(r, (F.col("s_trace_id") == F.col("trace_id")) & (F.col("s_project_id") == F.col("project_id")))
    cell = F.floor(F.col("event_time_us") / within_us)
    near = s.where("s_trace_id is null").withColumn("s_cell", F.explode(F.array(*(F.floor(F.col("s_event_time_us") / within_us) + d for d in (-1, 0, 1)))))
    same = (F.col("s_cell") == F.col("cell")) & (F.col("s_project_id") == F.col("project_id")) & F.col("s_service").eqNullSafe(F.col("service"))
    by_time = near.join(r.withColumn("cell", cell), same & (F.abs(F.col("event_time_us") - F.col("s_event_time_us")) <= within_us))
    pick = [F.col("s_record_id").alias("seed_id"), "record_id"]
    return by_trace.select(*pick).union(by_time.select(*pick)).where("seed_id != record_id")


def first_page_files(manifest: DataFrame, size: int) -> DataFrame:
    """The files that can hold the newest ``size`` rows and one more.

    Files by descending smallest time; once enough rows stand above a smallest
    time, files whose largest time is below it cannot matter. Ties stay.
    """

    w = Window.orderBy(F.col("min_event_time_us").desc(), "file_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = manifest.withColumn("__rows", F.sum("row_count").over(w))
    bound = seen.where(F.col("__rows") >= size + 1).agg(F.max("min_event_time_us").alias("__bound"))
    return manifest.crossJoin(F.broadcast(bound)).where("__bound is null or max_event_time_us >= __bound").drop("__bound")


#: How a scan goes on within a range, sums up a range, and joins what came before a row with what its own range adds.
_SCANS = {
    "sum": (lambda x, w: F.sum(x).over(w), lambda x, order: F.sum(x), lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "max": (lambda x, w: F.max(x).over(w), lambda x, order: F.max(x), lambda before, own: F.greatest(before, own)),
    "last": (lambda x, w: F.last(x, ignorenulls=True).over(w), lambda x, order: F.max_by(x, F.when(x.isNotNull(), F.struct(*order))), lambda before, own: F.coalesce(own, before)),
}


def running(rows: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str, scan: str = "sum", before: bool = False) -> DataFrame:
    """``rows`` with ``name``: the sum, maximum or last value of ``amount`` over the key's rows up to this one, or, with
    ``before``, up to the one before it, in an order without ties (an ascending one for the last value).

    Rows are dealt by ranges of key and order, so a key with a third of all rows fills as many tasks as its rows need;
    each range is scanned on its own, and what the ranges before it come to, one value per range and key, is joined to
    it. Without keys the ranges of all rows follow each other. Integers are summed as 64-bit ones.
    """
    along, total, joined = _SCANS[scan]
    every = [F.col(k).asc_nulls_first() for k in keys] + order
    dealt = rows.withColumn("__amount", amount.cast("bigint") if scan == "sum" else amount).repartitionByRange(*every).withColumn("__part", F.spark_partition_id())
    path = shared_path(rows.sparkSession, "ranges")
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    own = along("__amount", Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    totals = dealt.groupBy("__part", *keys).agg(total(F.col("__amount"), order).alias("__total"))
    earlier = along("__total", Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__{k}") for k in keys), earlier.alias("__before"))
    met = F.col("__part") == F.col("__p")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return dealt.withColumn("__own", own).join(starts, met).select(*rows.columns, joined(F.col("__before"), F.col("__own")).alias(name))
