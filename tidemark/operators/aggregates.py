"""Grouped aggregates: typed keys, exact metrics, histograms with empty buckets, global top-k.

Every aggregate is one ``groupBy().agg()``: partial sums on the map side, merged
by the shuffle. Groups are ranked only after the merge, never locally.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exact
from tidemark.functions.predicates import stored_one

INTERVALS = {"1s": 1_000_000, "10s": 10_000_000, "1m": 60_000_000, "5m": 300_000_000, "1h": 3_600_000_000, "1d": 86_400_000_000}
_NAME = re.compile(r"^[a-z][a-z0-9_]{0,31}$")


def bucket(time_us: Column, interval_us: int) -> Column:
    """Start of the interval; right before the epoch, too."""
    return time_us - F.pmod(time_us, F.lit(interval_us))


def starts(start_us: int, end_us: int, interval_us: int) -> list[int]:
    """First and last bucket start of the buckets that [start, end) meets; at most 2,000 of them."""
    first, last = start_us - start_us % interval_us, (end_us - 1) - (end_us - 1) % interval_us
    if (last - first) // interval_us + 1 > 2000:
        raise ValueError("more than 2,000 buckets")
    return [first, last]


def series(spark, start_us: int, end_us: int, interval_us: int) -> DataFrame:
    """(bucket): all bucket starts that [start, end) meets."""
    first, last = starts(start_us, end_us, interval_us)
    return spark.range(first, last + 1, interval_us, 1).select(F.col("id").alias("bucket"))


def key_of(value: Column, value_type: str) -> Column:
    """A typed group key of a fixed field: null is the type missing. -0.0 groups as 0.0."""
    if value_type == "double":
        value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    slot = {"string": "string_value", "integer": "integer_value", "double": "double_value", "boolean": "boolean_value"}
    kinds = {"string": "string", "integer": "decimal(38,0)", "double": "double", "boolean": "boolean"}
    fields = [(value if t == value_type else F.lit(None)).cast(kinds[t]).alias(n) for t, n in slot.items()]
    return F.struct(F.when(value.isNull(), "missing").otherwise(value_type).alias("type"), *fields)


def key_of_attribute(namespace: str, path: str, value_type: str | None = None) -> Column:
    """A typed group key of an attribute. With a type, other types are missing; without, any stored scalar keeps
    its type: integer 1, double 1.0, string "1", null and missing are five groups, other types an error."""
    one = stored_one(namespace, path)
    if value_type is not None:
        slot = {"string": "string_value", "integer": "integer_value", "double": "double_value", "boolean": "boolean_value"}[value_type]
        return key_of(F.when(one["value_type"] == value_type, one[slot]), value_type)
    bad = one["value_type"].isin("array", "object", "invalid", "big_integer")
    kind = F.when(one.isNull(), "missing").when(bad, F.raise_error(F.concat(F.lit("no groups by values of type "), one["value_type"]))).otherwise(one["value_type"])
    double = F.when(one["double_value"] == 0, F.lit(0.0)).otherwise(one["double_value"])
    return F.struct(kind.alias("type"), one["string_value"].alias("string_value"), one["integer_value"].alias("integer_value"), double.alias("double_value"), one["boolean_value"].alias("boolean_value"))


def key_text(key: Column) -> Column:
    """The key's value as text, for output."""
    return F.coalesce(key["string_value"], key["integer_value"].cast("string"), key["double_value"].cast("string"), key["boolean_value"].cast("string"))


@F.pandas_udf(T.BinaryType())
def _double_bytes(values: pd.Series) -> pd.Series:
    """The eight big-endian bytes of each double; zero has no sign."""
    x = values.to_numpy(np.float64, na_value=np.nan)
    raw = np.where(x == 0, 0.0, x).astype(">f8").tobytes()
    return pd.Series([raw[i : i + 8] for i in range(0, len(raw), 8)])


def key_bytes(key: Column) -> Column:
    """Bytes that order groups: a type tag (b < d < i < m < n < s), then the value; strings and integers behind the
    varint of their length, doubles as their eight big-endian bytes. Runs on reduced groups."""

    def sized(text: Column) -> Column:
        raw = F.encode(text, "UTF-8")
        n = F.octet_length(raw)
        one = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
        varint = F.when(n < 128, one(n)).when(n < 16384, F.concat(one(128 + n % 128), one(F.floor(n / 128)))).otherwise(F.concat(one(128 + n % 128), one(128 + F.floor(n / 128) % 128), one(F.floor(n / 16384))))
        return F.concat(varint, raw)

    tag = lambda c: F.encode(F.lit(c), "UTF-8")
    return (
        F.when(key["type"] == "boolean", F.concat(tag("b"), F.when(key["boolean_value"], F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))))
        .when(key["type"] == "double", F.concat(tag("d"), _double_bytes(key["double_value"])))
        .when(key["type"] == "integer", F.concat(tag("i"), sized(key["integer_value"].cast("string"))))
        .when(key["type"] == "missing", tag("m"))
        .when(key["type"] == "null", tag("n"))
        .otherwise(F.concat(tag("s"), sized(key["string_value"])))
    )


@dataclass(frozen=True)
class Metric:
    """One named metric: count, or sum / avg / min / max of an integer or double operand."""

    name: str
    op: str
    operand: Column | None = None
    exact: bool = False

    @property
    def binned(self) -> bool:
        """Whether it sums doubles: they are added exactly, by bins of their exponents."""
        return self.op in ("sum", "avg") and not self.exact

    def state(self) -> list[Column]:
        """Aggregates that merge by addition or comparison; ``states`` adds the columns that sums take. Those of sums of doubles hold for one bin."""
        n, x = self.name, self.operand
        if self.op == "count":
            return [F.count(F.lit(1)).alias(f"{n}__n")]
        parts = [F.count(x).alias(f"{n}__valid"), (F.count(F.lit(1)) - F.count(x)).alias(f"{n}__excluded")]
        if self.op in ("sum", "avg"):
            if self.exact:
                return parts + exact.limb_sums((F.col(f"{n}__small"), F.col(f"{n}__text")), f"{n}__l")
            return [*parts, F.count_if(x.isNotNull() & exact.double_bin(x).isNull()).alias(f"{n}__bad"), *(F.sum(p).alias(f"{n}__p{j}") for j, p in enumerate(exact.double_pieces(x)))]
        return [*parts, (F.min(x) if self.op == "min" else F.max(x)).alias(f"{n}__value")]

    def collect(self) -> list[Column]:
        """States of whole groups from those of their bins."""
        n = self.name
        if not self.binned:
            return self.merge()
        some = F.struct(F.col(f"{n}__bin").alias("bin"), *(F.col(f"{n}__p{j}").alias(f"p{j}") for j in range(exact.PIECES)))
        return [*(F.sum(f"{n}__{p}").alias(f"{n}__{p}") for p in ("valid", "excluded", "bad")), F.collect_list(F.when(F.col(f"{n}__bin").isNotNull(), some)).alias(f"{n}__bins")]

    def merge(self) -> list[Column]:
        """The same states, merged from states. A sum of doubles has a few bins a state."""
        n = self.name
        if self.op == "count":
            return [F.sum(f"{n}__n").alias(f"{n}__n")]
        parts = [F.sum(f"{n}__{p}").alias(f"{n}__{p}") for p in ("valid", "excluded")]
        if self.op in ("sum", "avg"):
            if self.exact:
                return parts + [F.sum(c).alias(c) for c in (f"{n}__l{i}" for i in range(exact.LIMBS))]
            return [*parts, F.sum(f"{n}__bad").alias(f"{n}__bad"), F.flatten(F.collect_list(f"{n}__bins")).alias(f"{n}__bins")]
        return [*parts, (F.min if self.op == "min" else F.max)(f"{n}__value").alias(f"{n}__value")]

    def final(self) -> list[Column]:
        n = self.name
        if self.op == "count":
            return [F.coalesce(F.col(f"{n}__n"), F.lit(0)).alias(n)]
        parts = [F.coalesce(F.col(f"{n}__{p}"), F.lit(0)).alias(f"{n}_{p}") for p in ("valid", "excluded")]
        limbs = [F.col(f"{n}__l{i}") for i in range(exact.LIMBS)]
        some = F.col(f"{n}__valid") > 0
        if self.binned:
            bad = F.raise_error(F.lit("a sum of doubles has values that are not finite")).cast("double")
            total = F.when(F.col(f"{n}__bad") > 0, bad).otherwise(exact.finish_double(F.col(f"{n}__bins")))
            value = total if self.op == "sum" else F.when(some, total / F.col(f"{n}__valid"))
        elif self.op == "sum":
            value = F.when(some, exact.finish_sum(limbs))
        elif self.op == "avg":
            value = exact.exact_average(F.col(f"{n}__valid"), *limbs)
        else:
            value = F.col(f"{n}__value")
        return [value.alias(n), *parts]


def states(rows: DataFrame, keys: list[Column], metrics: list[Metric]) -> DataFrame:
    """Mergeable states per group: the rows of an incremental rollup."""
    if len(metrics) > 8 or len({m.name for m in metrics}) < len(metrics) or not all(_NAME.match(m.name) for m in metrics):
        raise ValueError("up to 8 metrics with different names of small letters, digits and underscores")
    # What an operand is taken apart into is worked out once a row, as columns of their own.
    apart = {f"{m.name}__x": m.operand for m in metrics if m.binned}
    for m in metrics:
        if m.op in ("sum", "avg") and m.exact:
            apart |= dict(zip((f"{m.name}__small", f"{m.name}__text"), exact.parts(m.operand)))
    rows = rows.withColumns(apart) if apart else rows
    metrics = [replace(m, operand=F.col(f"{m.name}__x")) if m.binned else m for m in metrics]
    # Sums of doubles are grouped by their bins, too; the few bins of each group then come together.
    bins = [exact.double_bin(m.operand).alias(f"{m.name}__bin") for m in metrics if m.binned]
    fine = rows.groupBy(*keys, *bins).agg(*(c for m in metrics for c in m.state()))
    return fine.groupBy(*fine.columns[: len(keys)]).agg(*(c for m in metrics for c in m.collect())) if bins else fine


def merged(partial: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    return partial.groupBy(*keys).agg(*(c for m in metrics for c in m.merge()))


def finished(state: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    return state.select(*keys, *(c for m in metrics for c in m.final()))


def aggregate(rows: DataFrame, keys: dict[str, Column], metrics: list[Metric]) -> DataFrame:
    """Metrics per group of up to two dimensions (and a bucket). Without keys, one row even for no input."""
    return finished(states(rows, [c.alias(n) for n, c in keys.items()], metrics), list(keys), metrics)


def histogram(rows: DataFrame, time: str, start_us: int, end_us: int, interval_us: int, metrics: list[Metric]) -> DataFrame:
    """Metrics per bucket, the empty buckets of [start, end) included."""
    state = states(rows, [bucket(F.col(time), interval_us).alias("bucket")], metrics)
    every = series(rows.sparkSession, start_us, end_us, interval_us)
    return finished(every.join(F.broadcast(state), "bucket", "left"), ["bucket"], metrics)


def top_groups(groups: DataFrame, metric: Column, tie: list[Column], k: int, descending: bool = True) -> DataFrame:
    """The ``k`` first groups by a metric of all groups: null last in both directions, ties by key ascending."""
    if not 1 <= k <= 1000:
        raise ValueError("k is between 1 and 1000")
    return groups.orderBy(metric.desc_nulls_last() if descending else metric.asc_nulls_last(), *tie).limit(k)


def bundle_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per bundle: rows, ranges of the three positions, sorted projects and the hash of its ordered ids."""
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), *(f(c).alias(f"{n}_{c}") for c in ("event_time_us", "received_time_us", "batch_seq") for n, f in (("min", F.min), ("max", F.max))),
        F.array_sort(F.collect_set("project_id")).alias("project_ids"),
    )
    return with_ordered_hash(stats, rows, keys, "record_id", "identity_sha256")


#: Bytes of text that a block of sorted values holds, about, before it is compressed.
BLOCK_BYTES = 16 << 10


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[int, int]]:
    """[first, end) of each run of rows with equal keys."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, bool)
    for c in batch.columns[:n_keys]:
        new[1:] |= np.diff(np.asarray(c.dictionary_encode(null_encoding="encode").indices)) != 0
    begins = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    yield from zip(begins, begins[1:])


def _pack(n_keys: int, fields: list[str]):
    """Rows sorted by keys, then value, as compressed blocks of values, one per line, with their first and last value; a run
    of nulls is an empty block."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            at, blocks = [], []
            for lo, hi in _runs(batch, n_keys):
                values = batch.column(n_keys).slice(lo, hi - lo).drop_null().to_pylist()
                step = max(1, BLOCK_BYTES * len(values) // (sum(map(len, values)) + len(values) + 1))
                for part in [values[i : i + step] for i in range(0, len(values), step)]:
                    text = "\n".join(part).encode()
                    blocks.append((part[0], part[-1], len(text), codec.compress(text, asbytes=True)))
                if not values:
                    blocks.append((None, None, None, None))
                at += [lo] * (len(blocks) - len(at))
            packed = [pa.array(list(c), k) for c, k in zip(zip(*blocks) if blocks else [()] * 4, kinds)]
            yield pa.record_batch([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:n_keys]), *packed], fields)

    return run


def _stream_hashes(n_keys: int, fields: list[str]):
    """Streams blocks sorted by keys, then values: each group's keys and the hash of its values, one block unpacked at a time."""

    def run(batches):
        codec, key, digest, some = pa.Codec("zstd"), None, None, False
        for batch in batches:
            for lo, hi in _runs(batch, n_keys):
                at = batch.slice(lo, 1)
                if key is None or [c.slice(0, 1).to_pylist() for c in at.columns[:n_keys]] != [c.to_pylist() for c in key.columns]:
                    if key is not None:
                        yield row(key, digest, some)
                    key, digest, some = at.select(fields[:n_keys]), hashlib.sha256(), False
                for size, block in zip(batch.column("__bytes").slice(lo, hi - lo).to_pylist(), batch.column("__block").slice(lo, hi - lo)):
                    if size is not None:
                        digest.update(b"\n" * some + (codec.decompress(block.as_buffer(), size, asbytes=True) if size else b""))
                        some = True
        if key is not None:
            yield row(key, digest, some)

    def row(key, digest, some):
        return pa.record_batch([*key.columns, pa.array([digest.hexdigest() if some else None], pa.string())], fields)

    return run


def packed(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, __first, __last, __bytes, __block): each group's values as sorted, compressed blocks. All tasks sort a range each;
    as equal values share a range, blocks in the order of first and last value are the group's values in order."""
    src = rows.select(*keys, F.col(column).cast("string").alias("__value"))
    more = [("__first", T.StringType()), ("__last", T.StringType()), ("__bytes", T.LongType()), ("__block", T.BinaryType())]
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(n, t) for n, t in more)])
    return src.repartitionByRange(*keys, "__value").sortWithinPartitions(*keys, "__value").mapInArrow(_pack(len(keys), [*keys, *(n for n, _ in more)]), schema)


def ordered_hashes(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, name): sha256 of each group's values in order, one per line, nulls left out.

    The hash of a sequence takes its values one after another, so a group's values
    stream through one task, but packed and sorted by all tasks before; no group
    is held in memory, whatever its size.
    """
    blocks = packed(rows, keys, column)
    schema = T.StructType([*blocks.schema.fields[: len(keys)], T.StructField(name, T.StringType())])
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "__first", "__last").mapInArrow(_stream_hashes(len(keys), [*keys, name]), schema)


def with_ordered_hash(groups: DataFrame, rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``groups``, one row per ``keys`` of ``rows``, with the group's ordered hash."""
    hashes = ordered_hashes(rows, keys, column, name).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return groups.join(hashes, same).drop(*(f"__{k}" for k in keys))


def tree_hashes(rows: DataFrame, keys: list[str], column: str, name: str, digits: int = 4) -> DataFrame:
    """(keys, name): the root of a hash tree over each group's values, the same for any order, layout and number of tasks.

    A value's leaf is the first hex ``digits`` of its sha256, so the values decide
    where the tree is cut. A leaf's hash is sha256 of its sorted values, one per
    line, the root's that of its leaves' names and hashes, sorted, one per line.
    Repeated values count as often as they stand; nulls are left out; a group of
    nulls has a null root. A group is spread over 16**digits leaves; of 10**10
    values each has about 150,000 with four digits.
    """
    value = F.col(column).cast("string")
    leaves = rows.select(*keys, value.alias("__v"), F.substring(F.sha2(value, 256), 1, digits).alias("__leaf")).groupBy(*keys, "__leaf")
    hashed = leaves.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__v")), "\n"), 256).alias("__h"))
    line = F.when(F.col("__leaf").isNotNull(), F.concat_ws(" ", "__leaf", "__h"))
    gathered = hashed.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("__lines"))
    return gathered.select(*keys, F.when(F.size("__lines") > 0, F.sha2(F.array_join("__lines", "\n"), 256)).alias(name))
