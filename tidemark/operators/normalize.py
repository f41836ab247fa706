"""Raw SDK payloads to records: envelopes, guards, scrubbing, attributes and normalised columns.

Built-in functions do the column work. JSON whose number spelling or key order
matters goes through small per-row helpers over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote_plus, unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions import scalars as S
from tidemark.sources.schema import ATTRIBUTE

#: Item types that carry one event; envelopes hold at most one such item.
EVENT_TYPES = ("event", "transaction")
DEPTH, NODES = 64, 20_000


# --- envelopes ----------------------------------------------------------------------------------


def parse_envelope(data: bytes) -> Iterator[tuple[int, str, str, bytes, str | None]]:
    """(ordinal, header, type, payload, problem) of each item: a header line, then items of a header line and a payload
    of declared length or up to the next newline."""
    head, _, rest = data.partition(b"\n")
    try:
        json.loads(head)
    except ValueError:
        yield 0, "", "", b"", "envelope_header"
        return
    ordinal, events = 0, 0
    while rest.strip(b"\n"):
        line, _, rest = rest.lstrip(b"\n").partition(b"\n") if rest[:1] == b"\n" else rest.partition(b"\n")
        try:
            header = json.loads(line)
            kind = header["type"]
        except (ValueError, KeyError, TypeError):
            yield ordinal, "", "", b"", "item_header"
            return
        if "length" in header:
            n = header["length"]
            if not isinstance(n, int) or n < 0 or n > len(rest):
                yield ordinal, "", str(kind), b"", "item_length"
                return
            payload, rest = rest[:n], rest[n:]
        else:
            payload, _, rest = rest.partition(b"\n")
        events += kind in EVENT_TYPES
        yield ordinal, head.decode("utf-8", "replace"), str(kind), payload, "second_event" if kind in EVENT_TYPES and events > 1 else None
        ordinal += 1


def read_envelopes(envelopes: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, ordinal, header, type, payload, problem): one row per item of binary envelopes."""

    def run(batches):
        for batch in batches:
            rows = [(i.as_py(), *item) for i, d in zip(batch.column(0), batch.column(1)) for item in parse_envelope(d.as_py() or b"")]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            cols[4] = [p.decode("utf-8", "replace") for p in cols[4]]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["id", "ordinal", "header", "type", "payload", "problem"])

    return envelopes.select(F.col(id_col).cast("bigint"), F.col(data_col).cast("binary")).mapInArrow(run, "id long, ordinal int, header string, type string, payload string, problem string")


def explode_logs(items: DataFrame) -> DataFrame:
    """Log containers as one row per log (id, ordinal, log_ordinal, raw); a wrong item_count marks the container's rows."""
    parsed = F.from_json("payload", "struct<version:int,item_count:int,items:array<string>>")
    logs = items.where("type = 'log'").withColumn("c", parsed)
    n = F.coalesce(F.size("c.items"), F.lit(0))
    problem = F.when(F.coalesce("c.version", F.lit(1)) > 2, "log_version").when(F.col("c.item_count").isNotNull() & (F.col("c.item_count") != n), "item_count")
    return logs.withColumn("log_problem", problem).select("id", "ordinal", "log_problem", F.posexplode("c.items").alias("log_ordinal", "raw"))


def unsupported(items: DataFrame, known: tuple[str, ...] = (*EVENT_TYPES, "log", "client_report")) -> DataFrame:
    """Items of other types are listed with their size, not dropped."""
    return items.where(~F.col("type").isin(*known)).select("id", "ordinal", S.unsupported_type(F.col("type")).alias("type"), F.octet_length("payload").alias("bytes"))


def client_outcomes(items: DataFrame) -> DataFrame:
    """Drops that clients report: (id, category, reason, quantity)."""
    drops = F.from_json(F.col("payload"), "struct<discarded_events:array<struct<reason:string,category:string,quantity:bigint>>>")["discarded_events"]
    return items.where("type = 'client_report'").select("id", F.explode(drops).alias("x")).select("id", "x.category", "x.reason", "x.quantity")


# --- guards and scrubbing -------------------------------------------------------------------------


class _Repeated(ValueError):
    pass


_SURROGATE = re.compile("[\ud800-\udfff]")


def guarded(text: str | None) -> tuple[object, str | None]:
    """(value, problem): why a document is refused (repeated key, too deep, too many nodes, no JSON), or null.

    Keys are no nodes. Lone surrogates are replaced later, not refused.
    """
    if text is None:
        return None, "empty"

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise _Repeated
        return dict(items)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=_refuse)
    except _Repeated:
        return None, "repeated_key"
    except RecursionError:
        return None, "too_deep"
    except ValueError:
        return None, "no_json"
    # Level by level: how many there are is the depth.
    level, depth, nodes = [value], 0, 0
    while level:
        depth, nodes = depth + 1, nodes + len(level)
        if depth > DEPTH:
            return None, "too_deep"
        if nodes > NODES:
            return None, "too_many_nodes"
        level = [v for c in level if isinstance(c, (dict, list)) for v in (c.values() if isinstance(c, dict) else c)]
    return value, None


def _refuse(constant: str):
    raise ValueError(constant)


_SECRET = re.compile(rf"(^|[._])({'|'.join(S.SECRET_WORDS)})$")
_QUERY = re.compile(r"([^?#]*)\?([^#]+)(#.*)?", re.S)
_BROKEN = re.compile("%(?![0-9A-Fa-f]{2})")


def scrub_url_text(url: str) -> str:
    """The rule of ``scalars.scrub_url`` for one text."""
    parts = _QUERY.fullmatch(url)
    if parts is None:
        return url
    told = (p for p in parts[2].split("&") if p and ";" not in p and not _BROKEN.search(p))
    keys = sorted((unquote_plus(p.split("=", 1)[0]) for p in told), key=lambda k: k.encode("utf-8", "surrogatepass"))
    filtered = "&".join(f"{quote_plus(k, errors='replace')}=%5BFiltered%5D" for k in keys)
    return f"{parts[1]}{'?' if filtered else ''}{filtered}{parts[3] or ''}"


def scrub_value(value, key: str = ""):
    """Values of secret keys filtered at any depth, header lists and query values of URLs too."""
    name = key.strip().lower()
    if _SECRET.search(name) or name == "set-cookie":
        return S.FILTERED
    if isinstance(value, dict):
        return {k: scrub_value(v, k) for k, v in value.items()}
    if isinstance(value, list):
        if len(value) == 2 and isinstance(value[0], str) and (_SECRET.search(value[0].strip().lower()) or value[0].strip().lower() == "set-cookie"):
            return [value[0], S.FILTERED]
        return [scrub_value(v) for v in value]
    if isinstance(value, str) and (name == "url" or name.endswith("_url")):
        return scrub_url_text(value)
    return value


def guard_and_scrub(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``reject_reason``, and the raw text scrubbed where there is none, lone surrogates replaced."""
    names = rows.columns
    at = names.index(raw)

    def one(text):
        value, problem = guarded(text)
        if problem:
            return text, problem
        return _SURROGATE.sub("\ufffd", json.dumps(scrub_value(value), ensure_ascii=False, separators=(",", ":"))), None

    def run(batches):
        for batch in batches:
            done = [one(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in done], batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.record_batch([*columns, pa.array([p for _, p in done], pa.string())], [*names, "reject_reason"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("reject_reason", StringType())]))


# --- attributes ------------------------------------------------------------------------------------


class _Token(str):
    """A number as it is spelled."""


#: Made once: a decoder of its own for each text would cost more than most texts.
_DECODER = json.JSONDecoder(parse_int=_Token, parse_float=_Token)
_FRACTION = re.compile("[.eE]")


def _decoded(text: str):
    if text.startswith("\ufeff"):
        raise ValueError("byte order mark")
    return _DECODER.decode(text)


def _typed(namespace: str, path: str, value, unit: str | None = None) -> dict:
    out = dict.fromkeys(("string_value", "integer_value", "double_value", "boolean_value", "json_value"))
    out |= {"namespace": namespace, "path": path, "unit": unit}
    if value is None:
        return out | {"value_type": "null"}
    if isinstance(value, bool):
        return out | {"value_type": "boolean", "boolean_value": value}
    if isinstance(value, _Token):
        if _FRACTION.search(value):
            return out | {"value_type": "double", "double_value": float(value)}
        if len(value.lstrip("-")) > 38:
            return out | {"value_type": "big_integer", "json_value": str(value)}
        return out | {"value_type": "integer", "integer_value": str(value)}
    if isinstance(value, str):
        return out | {"value_type": "string", "string_value": value}
    return out | {"value_type": "array" if isinstance(value, list) else "object", "json_value": json.dumps(value, ensure_ascii=False, separators=(",", ":"))}


def _escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def leaves(namespace: str, value, path: str = "") -> Iterator[dict]:
    """One attribute per leaf, by RFC 6901 path; arrays by index; empty containers stay."""
    if isinstance(value, dict) and value:
        for k in sorted(value):
            yield from leaves(namespace, value[k], f"{path}/{_escape(k)}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(namespace, v, f"{path}/{i}")
    elif path:
        yield _typed(namespace, path, value)


def event_attributes(text: str | None) -> list[dict]:
    try:
        raw = _decoded(text or "null")
    except ValueError:
        return []
    if not isinstance(raw, dict):
        return []
    return [a for ns in ("tags", "extra", "contexts", "user", "request", "sdk") if isinstance(raw.get(ns), (dict, list)) for a in leaves(ns, raw[ns])]


_DECLARED = {"string": "string", "integer": "integer", "double": "double", "boolean": "boolean"}


def log_attributes(text: str | None) -> list[dict]:
    """One attribute per key of a log's attributes; {type, value, unit} wrappers declare a type, and a value of another type is invalid."""
    try:
        raw = _decoded(text or "null")
    except ValueError:
        return []
    found = raw.get("attributes") if isinstance(raw, dict) else None
    out = []
    for key in sorted(found) if isinstance(found, dict) else ():
        value, declared, unit = found[key], None, None
        if isinstance(value, dict) and "value" in value and "type" in value:
            declared, unit, value = value["type"], value.get("unit"), value["value"]
        one = _typed("attributes", "/" + _escape(key), value, unit)
        if declared == "double" and one["value_type"] == "integer":
            one |= {"value_type": "double", "integer_value": None, "double_value": float(value)}
        if declared is not None and _DECLARED.get(declared) != one["value_type"]:
            one = _typed("attributes", "/" + _escape(key), value, unit) | {"value_type": "invalid", "json_value": json.dumps(value)}
            one |= dict.fromkeys(("string_value", "integer_value", "double_value", "boolean_value"))
        out.append(one)
    return out


def with_attributes(rows: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """``rows`` with ``attrs``: flattened event payloads or log attributes."""
    flatten = event_attributes if kind == "event" else log_attributes
    at, names = rows.columns.index(raw), rows.columns
    one = pa.struct([("namespace", pa.string()), ("path", pa.string()), ("value_type", pa.string()), ("string_value", pa.string()), ("integer_value", pa.string()), ("double_value", pa.float64()), ("boolean_value", pa.bool_()), ("json_value", pa.string()), ("unit", pa.string())])

    def run(batches):
        for batch in batches:
            found = [flatten(t) for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(one))], [*names, "attrs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    flat = rows.mapInArrow(run, f"{schema}, attrs array<{ATTRIBUTE.replace('decimal(38,0)', 'string')}>")
    return flat.withColumn("attrs", F.col("attrs").cast(f"array<{ATTRIBUTE}>"))


def search_values(message: Column, attrs: Column) -> Column:
    """The message, then every other distinct non-empty string leaf, without filtered ones."""
    strings = F.transform(F.filter(attrs, lambda a: (a["value_type"] == "string") & (a["string_value"] != "") & (a["string_value"] != S.FILTERED)), lambda a: a["string_value"])
    return F.array_distinct(F.concat(F.array(message), F.filter(strings, lambda v: v != message)))


# --- records ---------------------------------------------------------------------------------------


#: What normalisation reads of an event payload: one parse per row.
PAYLOAD = (
    "type string, event_id string, timestamp string, level string, environment string, release string, message string, tags map<string,string>,"
    " contexts struct<service:struct<name:string>,trace:struct<trace_id:string,span_id:string>>, logentry struct<message:string,formatted:string>,"
    f" exception struct<values:{S.EXCEPTIONS}>"
)


def normalize_events(rows: DataFrame, default_service: str = "unknown", raw: str = "raw") -> DataFrame:
    """Record columns of event payloads, beside the columns of ``rows``. Events have a level and no severity number."""
    r, p = F.col(raw), F.col("__p")
    filled = lambda c: F.nullif(c, F.lit(""))
    # A message is text or an object; an exception is an object with values or a bare list.
    bare = F.when(p["exception"]["values"].isNull() & r.contains('"exception"'), S.exceptions(r))
    parsed = rows.withColumn("__p", F.from_json(r, PAYLOAD)).withColumn("__x", F.coalesce(p["exception"]["values"], bare))
    last = F.when(F.size("__x") > 0, F.element_at("__x", -1))
    has_object = p["message"].startswith("{")
    inner = lambda key: F.when(has_object, filled(F.get_json_object(p["message"], f"$.{key}")))
    text = F.when(~has_object, filled(p["message"]))
    message = F.coalesce(filled(p["logentry"]["formatted"]), text, inner("formatted"), filled(last["value"]), filled(last["type"]), filled(p["logentry"]["message"]), F.lit(""))
    # The template belongs to the place that the message is from.
    entry, formatted = filled(p["logentry"]["message"]), filled(p["logentry"]["formatted"])
    thrown = F.coalesce(filled(last["value"]), filled(last["type"]))
    template = F.when(formatted.isNotNull(), entry).when(text.isNotNull(), None).when(inner("formatted").isNotNull(), inner("message")).when(thrown.isNull(), entry)
    us, ns = S.parse_timestamp(filled(p["timestamp"]))
    lvl = S.level(p["level"], True)
    service = F.coalesce(p["tags"]["service.name"], p["contexts"]["service"]["name"], F.lit(default_service))
    kind = F.when(p["type"] == "transaction", "transaction").otherwise("error")
    trace = p["contexts"]["trace"]
    return parsed.select(
        *rows.columns, kind.alias("record_kind"), S.event_id(filled(p["event_id"])).alias("source_event_id"), us.alias("event_time_us"), ns.alias("event_time_ns_remainder"), S.timestamp_source(p["timestamp"]).alias("timestamp_source"),
        lvl.alias("level"), F.lit(None).cast("smallint").alias("severity_number"), message.alias("message"), template.alias("message_template"), service.alias("service"), filled(p["environment"]).alias("environment"), filled(p["release"]).alias("release"),
        S.trace_id(trace["trace_id"]).alias("trace_id"), S.span_id(trace["span_id"]).alias("span_id"), last["type"].alias("exception_type"), last["value"].alias("exception_value"), last["mechanism"]["handled"].alias("handled"),
    )


#: The fields and attributes of a log that have columns of their own.
LOG_FIELDS = ("body", "level", "severity_number", "trace_id", "span_id", "logger")
LOG_ATTRIBUTES = (
    "service.name", "logger.name", "server.address", "sentry.server.address", "server.name", "sentry.environment", "sentry.release", "sentry.sdk.name",
    "sentry.sdk.version", "sentry.severity_number", "sentry.severity_text", "sentry.message.template", "sentry.trace.parent_span_id",
)


def _entry(parsed: Column, path: str, key: str, wrapped: bool = False) -> Column:
    """The value of a parsed object's ``key`` as a variant, null if it is not there. It may be ``wrapped`` in {value}; an
    object without a value stays as it is, neither a text nor a number."""
    found = F.try_variant_get(parsed, f"{path}['{key}']", "variant")
    return F.coalesce(F.try_variant_get(parsed, f"{path}['{key}'].value", "variant"), found) if wrapped else found


def _first_text(*entries: tuple[Column, Column], fallback: Column | None = None) -> Column:
    """The text of the first entry (value, its type) that is there, null if that is no text; the fallback only where none is there."""
    out = F.lit(None).cast("string") if fallback is None else fallback
    for value, kind in reversed(entries):
        out = F.when(kind.isNull(), out).when(kind == "STRING", value.cast("string"))
    return out


def normalize_logs(rows: DataFrame, default_service: str | None = None, sdk: tuple[Column, Column] | None = None, raw: str = "raw") -> DataFrame:
    """Record columns of log items and their ``warnings``. Release, environment, service, logger, server and SDK come
    from attributes; service, logger and SDK have fall-backs (a default, the log's own field, the envelope's ``sdk`` name and version)."""
    r, names = F.col(raw), {k: f"__{i}" for i, k in enumerate(LOG_FIELDS + LOG_ATTRIBUTES)}
    entry = lambda key: (F.col(names[key]), F.col(f"{names[key]}_kind"))
    at = lambda key: F.coalesce(_first_text(entry(key)), F.lit(""))
    text = lambda *keys, fallback=None: _first_text(*map(entry, keys), fallback=fallback)
    integer = lambda key: F.when(entry(key)[1] == "BIGINT", entry(key)[0].cast("bigint"))
    field, beside = F.col("__field"), F.col("__beside")
    within = lambda e: F.when(e.between(1, 24), e.cast("smallint"))
    us, ns = S.parse_timestamp(F.nullif(F.get_json_object(r, "$.timestamp"), F.lit("")))
    name, version = sdk or (F.lit(None).cast("string"), F.lit(None).cast("string"))
    level = at("level")
    # Plain columns for each entry: those that nothing asks for are not looked up, and nothing is interpreted row by row.
    held = {names[k]: _entry(F.col("__v"), "$", k) for k in LOG_FIELDS} | {names[k]: _entry(F.col("__v"), "$.attributes", k, wrapped=True) for k in LOG_ATTRIBUTES}
    kinds = {f"{c}_kind": F.schema_of_variant(F.col(c)) for c in held}
    given = (entry("severity_number")[1].isNotNull() & ~F.is_variant_null(entry("severity_number")[0])) | entry("sentry.severity_number")[1].isNotNull()
    typed = rows.withColumn("__v", F.try_parse_json(r)).withColumns(held).withColumns(kinds).withColumns({"__field": integer("severity_number"), "__beside": integer("sentry.severity_number")})
    parsed = typed.withColumns({
        "__number": F.coalesce(within(field), within(beside)), "__given": given,
        "__own": S.level(level, False), "__said": F.when(level != "", level).otherwise(F.coalesce(text("sentry.severity_text"), F.lit(""))),
        "__trace": F.nullif(at("trace_id"), F.lit("")), "__span": F.coalesce(F.nullif(at("span_id"), F.lit("")), F.nullif(text("sentry.trace.parent_span_id"), F.lit(""))),
    })
    number, own, said, trace, span = (F.col(f"__{c}") for c in ("number", "own", "said", "trace", "span"))
    lvl = S.level(said, False)
    warned = F.array(
        F.when((S.severity_level(number) != own) & (own != "unknown"), "severity_level_conflict"), F.when(number.isNull() & F.col("__given"), "invalid_severity_number"),
        F.when(trace.isNotNull() & S.trace_id(trace).isNull(), "invalid_trace_id"), F.when(span.isNotNull() & S.span_id(span).isNull(), "invalid_span_id"),
    )
    return parsed.select(
        *rows.columns, F.lit("log").alias("record_kind"), us.alias("event_time_us"), ns.alias("event_time_ns_remainder"), said.alias("original_level"), lvl.alias("level"),
        F.coalesce(number, S.representative_severity(lvl)).alias("severity_number"), at("body").alias("message"), F.nullif(text("sentry.message.template"), F.lit("")).alias("message_template"),
        text("service.name", fallback=F.lit(default_service).cast("string")).alias("service"), text("logger.name", fallback=text("logger")).alias("logger"),
        text("server.address", "sentry.server.address", "server.name").alias("server_name"), text("sentry.environment").alias("environment"), text("sentry.release").alias("release"),
        text("sentry.sdk.name", fallback=name).alias("sdk_name"), text("sentry.sdk.version", fallback=version).alias("sdk_version"),
        S.trace_id(trace).alias("trace_id"), S.span_id(span).alias("span_id"), F.array_compact(warned).alias("warnings"),
    )


def event_warnings(raw: Column, envelope_event_id: Column) -> Column:
    """What normalisation of an event had to set aside. The envelope's id goes before the payload's."""
    filled = lambda c: F.nullif(c, F.lit(""))
    at = lambda path: filled(F.get_json_object(raw, path))
    own, outer = at("$.event_id"), filled(envelope_event_id)
    chosen = F.coalesce(outer, own)
    same = F.coalesce(S.event_id(own) == S.event_id(outer), own == outer)
    trace, span = at("$.contexts.trace.trace_id"), at("$.contexts.trace.span_id")
    return F.array_compact(
        F.array(
            F.when(~same, "event_id_conflict"), F.when(chosen.isNotNull() & S.event_id(chosen).isNull(), "invalid_event_id"),
            F.when(trace.isNotNull() & S.trace_id(trace).isNull(), "invalid_trace_id"), F.when(span.isNotNull() & S.span_id(span).isNull(), "invalid_span_id"),
        )
    )


def item_warnings(payload: Column, kind: Column) -> Column:
    """Warnings that every record of an item inherits: a log container that asks for inferred fields, and lone surrogates."""
    asked = lambda key: F.coalesce(F.get_json_object(payload, f"$.ingest_settings.{key}") != "never", F.lit(False))
    # Escaped backslashes and whole pairs out of the way, any escape of a surrogate left is a lone one.
    rest = F.regexp_replace(F.regexp_replace(payload, r"\\\\", " "), r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", " ")
    return F.array_compact(F.array(F.when((kind == "log") & (asked("infer_ip") | asked("infer_user_agent")), "inference_disabled"), F.when(rest.rlike(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"), "lone_surrogate_replaced")))
