"""Keyed state machines of running streams: claims of source ids, issues, alert windows, and an outbox.

All run on ``transformWithState`` with the RocksDB provider, so state lives on
disk beside its executor and in the checkpoint, and a restart goes on from
there. Each processor's state per key is small and bounded, whatever the key's
rows number.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ingest import KEY

LANES = 16
#: Buckets of keys that share one state, and tables of claims that a bucket's list may hold before they are merged.
BUCKETS, MOST_TABLES = 256, 32
MINUTE = 60_000_000


@contextmanager
def rocksdb(spark: SparkSession, without_data: bool = False):
    """Streams that start inside keep their state in RocksDB; the session's own settings come back afterwards.

    ``without_data``: whether micro-batches without rows run, as event-time timers
    need. State that ages by the clock asks for one after another, so that a run
    over what is available now would not end.
    """
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(without_data).lower(),
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- claims ----------------------------------------------------------------------------------


class Claims(StatefulProcessor):
    """The claims of one bucket of keys: of each key the winner's hash, and the received time until which it holds.

    What a row is follows from received times alone, so a stream that is replayed or
    late decides alike. The state is a list with a packed table of claims for each
    micro-batch that made some, so a bucket is read and added to as a whole, and a
    call of the state serves many keys. Its TTL, which runs by the clock, only frees
    what is over: it is the claim's life and the backlog that a stream may have.
    Where the list gets long its tables are merged, without claims that were over
    for the backlog at the newest row's time.
    """

    def __init__(self, keep_us: int, backlog_ms: int):
        self._keep_us, self._backlog_us, self._ttl_ms = keep_us, backlog_ms * 1000, keep_us // 1000 + backlog_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._claims = handle.getListState("claims", "claims binary", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = pd.concat(list(rows), ignore_index=True)
        items = items.sort_values(["batch_seq", "record_ordinal", "record_id"], kind="stable", ignore_index=True)
        digests = items["payload_sha256"].astype(object).where(items["payload_sha256"].notna(), None).tolist()
        times, classes = items["received_time_us"].tolist(), []
        tables = [_unpacked(t) for (t,) in self._claims.get()]
        held, fresh = {}, {}
        for t in tables:
            held.update(t)
        for k, digest, t in zip(items["key"].tolist(), digests, times):
            claim = held.get(k)
            if claim is None or claim[1] <= t:
                held[k] = fresh[k] = (digest, t + self._keep_us)
                classes.append("accepted")
            else:
                classes.append("duplicate" if claim[0] == digest else "conflict")
        if len(tables) >= MOST_TABLES:
            newest = max(times)
            self._claims.put([(_packed({k: c for k, c in held.items() if c[1] + self._backlog_us > newest}),)])
        elif fresh:
            self._claims.appendValue((_packed(fresh),))
        yield pd.DataFrame({"record_id": items["record_id"], "class": classes})

    def close(self) -> None:
        pass


def _packed(claims: dict[str, tuple[str | None, int]]) -> bytes:
    digests, ends = zip(*claims.values()) if claims else ((), ())
    columns = [pa.array(list(claims), pa.string()), pa.array(digests, pa.string()), pa.array(ends, pa.int64())]
    batch = pa.record_batch(columns, ["key", "payload_sha256", "expires_us"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, tuple[str | None, int]]:
    keys, digests, ends = (c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)
    return dict(zip(keys, zip(digests, ends)))


def classify(stream: DataFrame, keep_us: int, backlog_ms: int = 86_400_000) -> DataFrame:
    """(record_id, class): accepted, duplicate or conflict per record, as rows come.

    ``stream``: project_id, kind, source_event_id, record_id, batch_seq,
    record_ordinal, received_time_us, payload_sha256. The first row of a key is
    accepted and claims it for ``keep_us`` of received time; within that, rows of the
    same hash are duplicates and others conflicts; the first one after it is
    accepted and claims the key anew. Rows of a key in one micro-batch are taken
    in append order. Rows without a source id are accepted and touch no state.
    Keys are dealt over ``BUCKETS`` by their hash, each with the state of its keys.
    """
    named = stream.where("source_event_id is not null")
    # JSON tells keys apart, nulls included.
    keyed = named.select(F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket"), F.to_json(F.struct(*KEY)).alias("key"), "record_id", "batch_seq", "record_ordinal", "received_time_us", "payload_sha256")
    classes = keyed.groupBy("bucket").transformWithStateInPandas(Claims(keep_us, backlog_ms), "record_id string, class string", "Append", "ProcessingTime")
    return classes.unionByName(stream.where("source_event_id is null").select("record_id", F.lit("accepted").alias("class")))


# --- issues ----------------------------------------------------------------------------------

ISSUE_ITEMS = "project_id bigint, issue_id string, batch_seq bigint, lane_id int, record_ordinal int, record_id string, event_time_us bigint, action string, action_id bigint, cut array<bigint>"
TRANSITIONS = "project_id bigint, issue_id string, revision bigint, type string, record_id string, occurrences bigint"
_TARGET = {"resolved": "resolved", "ignored": "ignored", "reopened": "unresolved"}


class Issue(StatefulProcessor):
    """One issue: status, revision, the cut of its resolution, counts and times, and how far its lanes were read.

    A lane's rows come in order, so a row at or before the lane's mark was counted
    before, and a replay changes nothing; so it is with actions and their ids.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._issue = handle.getValueState(
            "issue",
            "status string, revision bigint, cut array<bigint>, occurrences bigint, first_us bigint, last_us bigint, mark_seq array<bigint>, mark_ordinal array<bigint>, last_action bigint",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._issue.get()
        status, revision, cut, count, first, last, mark_seq, mark_ordinal, last_action = held or (None, 0, None, 0, None, None, [0] * LANES, [-1] * LANES, -1)
        items = pd.concat(list(rows), ignore_index=True)
        acts = items["action"].notna()
        # Rows of a sequence come before the actions taken at it.
        items = items.assign(act=acts).sort_values(["batch_seq", "act", "lane_id", "record_ordinal", "action_id"], kind="stable")
        acts = items["act"].to_numpy()
        seq, lane, ordinal = (items[c].fillna(0).to_numpy(np.int64) for c in ("batch_seq", "lane_id", "record_ordinal"))
        mark_seq, mark_ordinal = np.array(mark_seq, np.int64), np.array(mark_ordinal, np.int64)
        new = ~acts & ((seq > mark_seq[lane]) | ((seq == mark_seq[lane]) & (ordinal > mark_ordinal[lane])))
        if new.any():
            # A row that comes twice in one micro-batch counts once.
            twice = items[new].duplicated(["batch_seq", "lane_id", "record_ordinal"]).to_numpy()
            new[np.flatnonzero(new)[twice]] = False
        at, ids, out = np.flatnonzero(new), items["record_id"].to_numpy(), []
        # Runs of rows between one action and the next, each looked at as a whole.
        stops = np.flatnonzero(acts & (items["action_id"].fillna(-1).to_numpy(np.int64) > last_action)).tolist()
        begun = 0
        for stop in [*stops, len(items)]:
            here = at[np.searchsorted(at, begun) : np.searchsorted(at, stop)]
            begun = stop
            hit = 0 if status is None else None
            if status == "resolved" and len(here):
                beyond = np.flatnonzero(seq[here] > np.asarray(cut, np.int64)[lane[here]])
                hit = int(beyond[0]) if len(beyond) else None
            if len(here) and hit is not None:
                revision, kind = revision + 1, "created" if status is None else "regressed"
                status, cut = "unresolved", None
                out.append((revision, kind, ids[here[hit]], count + hit + 1))
            count += len(here)
            if stop < len(items):
                row = items.iloc[stop]
                last_action = max(last_action, int(row["action_id"]))
                target = _TARGET.get(row["action"])
                if status is not None and target and target != status:
                    status, revision, cut = target, revision + 1, [int(x) for x in row["cut"]] if target == "resolved" else None
                    out.append((revision, row["action"], None, count))
        if len(at):
            times = items["event_time_us"].to_numpy()[at].astype(np.int64)
            first, last = min(int(times.min()), times[0] if first is None else first), max(int(times.max()), times[0] if last is None else last)
            for j in range(LANES):
                mine = at[lane[at] == j]
                if len(mine):
                    mark_seq[j], mark_ordinal[j] = seq[mine[-1]], ordinal[mine[-1]]
        if status is not None:
            self._issue.update((status, int(revision), cut, int(count), int(first), int(last), mark_seq.tolist(), mark_ordinal.tolist(), int(last_action)))
        yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["project_id", "issue_id", "revision", "type", "record_id", "occurrences"])

    def close(self) -> None:
        pass


def issue_transitions(occurrences: DataFrame, actions: DataFrame) -> DataFrame:
    """Each transition once, as both streams run: project_id, issue_id, revision, type, record_id (null for actions), occurrences.

    ``occurrences``: project_id, issue_id, batch_seq, lane_id, record_ordinal,
    record_id, event_time_us. ``actions``: project_id, issue_id, action_id, action
    (resolved, ignored, reopened), batch_seq (at which it was taken), cut
    array<bigint> (by lane: what had been accepted then). An issue starts with its
    first occurrence; a resolved one regresses with the first occurrence beyond
    the cut of its lane; each change of status raises the revision by one; an
    action into the status that holds, or on an issue that is not there, changes
    nothing. Items that arrive together are taken by sequence, rows before
    actions. ``occurrences`` counts those seen up to the transition. Rows of a lane,
    and actions by id, come in order; what is repeated changes nothing.
    """
    empty = {f.split()[0]: f.split()[1] for f in ISSUE_ITEMS.split(", ")}
    fill = lambda df: df.where("issue_id is not null").select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    items = fill(occurrences).unionByName(fill(actions))
    return items.groupBy("project_id", "issue_id").transformWithStateInPandas(Issue(), TRANSITIONS, "Append", "None")


# --- alert windows ---------------------------------------------------------------------------

EVALUATIONS = "alert_id bigint, window_end_us bigint, observed bigint, hit boolean, fired boolean"
_COMPARE = {"gt": np.greater, "ge": np.greater_equal, "lt": np.less, "le": np.less_equal}


class AlertWindows(StatefulProcessor):
    """One alert rule: counts of the minutes that open windows still need, the next window's end, and the last firing.

    A timer stands at the end of the next window. When the watermark of received
    times passes it, all windows that end by then are evaluated in order, those
    without any record included, and the timer moves on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rule = handle.getValueState("rule", "window_us bigint, operator string, threshold bigint, cooldown_us bigint")
        self._open = handle.getValueState("open", "next_end_us bigint, fired_us bigint, minutes array<bigint>, counts array<bigint>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._rule.update((int(r["window_seconds"]) * 1_000_000, str(r["operator"]), int(r["threshold"]), int(r["cooldown_seconds"]) * 1_000_000))
        first = (int(r["created_us"]) // MINUTE + 1) * MINUTE + int(r["window_seconds"]) * 1_000_000
        self._open.update((first, None, [], []))
        self._handle.registerTimer(first // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._open.get()
        if held is not None:  # else the rule is not known
            next_end, fired, minutes, counts = held
            got = pd.concat([*rows, pd.DataFrame({"minute": minutes, "n": counts})]).astype({"minute": "int64", "n": "int64"}).groupby("minute")["n"].sum()
            window_us = self._rule.get()[0]
            got = got[got.index * MINUTE >= next_end - window_us]
            self._open.update((next_end, fired, got.index.tolist(), got.tolist()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window_us, operator, threshold, cooldown_us = self._rule.get()
        next_end, fired, minutes, counts = self._open.get()
        ends = np.arange(next_end, timerValues.getCurrentWatermarkInMs() * 1000 + 1, MINUTE, dtype=np.int64)
        if len(ends):
            minutes, counts = np.asarray(minutes, np.int64), np.asarray(counts, np.int64)
            so_far = np.concatenate([[0], np.cumsum(counts)])
            observed = so_far[np.searchsorted(minutes * MINUTE, ends)] - so_far[np.searchsorted(minutes * MINUTE, ends - window_us)]
            hit, fires = _COMPARE[operator](observed, threshold), np.zeros(len(ends), bool)
            for i in np.flatnonzero(hit).tolist():
                if fired is None or ends[i] - fired >= cooldown_us:
                    fired, fires[i] = int(ends[i]), True
            next_end = int(ends[-1]) + MINUTE
            kept = minutes * MINUTE >= next_end - window_us
            self._open.update((next_end, fired, minutes[kept].tolist(), counts[kept].tolist()))
            yield pd.DataFrame({"alert_id": key[0], "window_end_us": ends, "observed": observed, "hit": hit, "fired": fires})
        self._handle.registerTimer(next_end // 1000)

    def close(self) -> None:
        pass


def _by_minute(batches):
    """Rows of an Arrow batch as counts per alert and minute, so that a busy project sends its minutes to the state, not its rows."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["alert_id", "minute"]).aggregate([("received", "max"), ("minute", "count")])
        t = t.select(["alert_id", "minute", "received_max", "minute_count"]).rename_columns(["alert_id", "minute", "received", "n"])
        yield from t.to_batches()


def alert_evaluations(stream: DataFrame, rules: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Every window of every rule once, as the stream's received times pass its end: alert_id, window_end_us, observed, hit, fired.

    ``stream``: project_id, received_time_us, and what the rules' filter left.
    ``rules`` (few, read when the stream first starts): alert_id, project_id,
    window_seconds, operator, threshold, cooldown_seconds, created_us. Windows end
    on full minutes, the first one a window's length after the first full minute
    after the rule's creation. ``delay`` is how far lanes' received times may be
    apart; a row that comes later than that, behind a closed window, is left out.
    """
    known = rules.select("alert_id", "project_id")
    rows = stream.join(F.broadcast(known), "project_id").select("alert_id", F.floor(F.col("received_time_us") / MINUTE).alias("minute"), F.timestamp_micros("received_time_us").alias("received"))
    minutes = rows.mapInArrow(_by_minute, "alert_id bigint, minute bigint, received timestamp, n bigint").withWatermark("received", delay)
    return minutes.groupBy("alert_id").transformWithStateInPandas(AlertWindows(), EVALUATIONS, "Append", "EventTime", initialState=rules.groupBy("alert_id"))


# --- outbox ----------------------------------------------------------------------------------


class FirstOnly(StatefulProcessor):
    """Whether a key was sent; forgotten a horizon after it was last seen."""

    def __init__(self, horizon_ms: int):
        self._horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sent = handle.getValueState("sent", "sent boolean", self._horizon_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._sent.exists()
        self._sent.update((True,))
        if not known:
            yield next(rows)

    def close(self) -> None:
        pass


def once(decisions: DataFrame, keys: list[str], horizon_ms: int) -> DataFrame:
    """The first decision of each key; later ones are left out for ``horizon_ms`` after the key was last seen.

    Memory is the keys of the horizon, and a micro-batch costs what its own keys do, however many came before.
    """
    return decisions.groupBy(*keys).transformWithState(FirstOnly(horizon_ms), decisions.schema, "Append", "ProcessingTime")
