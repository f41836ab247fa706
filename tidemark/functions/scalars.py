"""Scalar functions of the record pipeline, as column builders over built-in functions."""

from __future__ import annotations

import json
from collections.abc import Callable
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Level names, their numbers, and the words of secret keys.
LEVELS = ("trace", "debug", "info", "warning", "error", "fatal")
SECRET_WORDS = ("authorization", "cookie", "password", "passwd", "token", "secret", "api_key", "apikey")
FILTERED = "[Filtered]"


def level(raw: Column, for_event: bool) -> Column:
    """Lower-cased level; warn and critical have other names; empty is error for events and unknown for logs."""
    low = F.lower(raw)
    named = F.when(low == "warn", "warning").when(low == "critical", "fatal").when(low.isin(*LEVELS), low)
    return F.when(low.isNull() | (low == ""), "error" if for_event else "unknown").otherwise(F.coalesce(named, F.lit("unknown")))


def severity_number(raw: Column, fallback: Column | None = None) -> Column:
    """An integer of 1 to 24 from text, else the fallback's, else null."""

    def one(c: Column) -> Column:
        n = F.when(c.rlike("^[0-9]{1,2}$"), c.cast("int"))
        return F.when(n.between(1, 24), n)

    found = one(raw) if fallback is None else F.coalesce(one(raw), one(fallback))
    return found.cast("smallint")


def severity_level(number: Column) -> Column:
    """Bands of four numbers: trace, debug, info, warning, error, fatal."""
    return F.get(F.array(*map(F.lit, LEVELS)), F.floor((number - 1) / 4).cast("int"))


def representative_severity(name: Column) -> Column:
    out = F.lit(None).cast("smallint")
    for i, v in enumerate(LEVELS):
        out = F.when(name == v, F.lit(1 + 4 * i).cast("smallint")).otherwise(out)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; nested expressions would repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_timestamp(raw: Column) -> tuple[Column, Column]:
    """(microseconds, remaining nanoseconds) of RFC 3339 text or decimal epoch seconds; floors before the epoch; null if neither."""
    rfc = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
    moment = let(raw, lambda t: F.when(t.rlike(rfc), _rfc_moment(t)).when(t.rlike(_NUMBER), _decimal_moment(t)))
    return moment["us"], moment["ns"]


_NUMBER = r"\A(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]{1,4}))?\z"


def _rfc_moment(text: Column) -> Column:
    whole = F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.upper(text), r"\.[0-9]+", ""), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]+)", 1), 9, "0")

    def split(w: Column) -> Column:
        return F.struct((w["us"] + F.substring(w["f"], 1, 6).cast("bigint")).alias("us"), F.when(w["us"].isNotNull(), F.substring(w["f"], 7, 3).cast("smallint")).alias("ns"))

    return let(F.struct(whole.alias("us"), fraction.alias("f")), split)


def _decimal_moment(text: Column) -> Column:
    """The digits before the point, shifted by the exponent and nine places, are the nanoseconds; what is cut off a negative
    number makes it one less. Anything outside 64 bits of microseconds is null."""
    thousand = F.lit(1000).cast("decimal(4,0)")
    part = lambda i: F.regexp_extract(text, _NUMBER, i)

    def shift(p: Column) -> Column:
        point = F.length(p["whole"]) + F.coalesce(F.nullif(p["exponent"], F.lit("")).cast("int"), F.lit(0)) + 9
        return let(F.struct(p["minus"].alias("minus"), F.concat(p["whole"], p["fraction"]).alias("digits"), point.alias("point")), cut)

    def cut(p: Column) -> Column:
        digits, point, most = p["digits"], p["point"], F.length(p["digits"]) + 60
        size = F.when(point > 0, F.substring(F.rpad(digits, F.least(point, most), "0"), F.lit(1), point)).otherwise("0")
        rest = F.when(point > 0, F.substring(digits, point + 1, F.length(digits))).otherwise(digits)
        return let(F.struct(p["minus"].alias("minus"), F.regexp_replace(size, r"\A0+(?=[0-9])", "").alias("size"), rest.rlike("[1-9]").alias("more"), (point <= most).alias("near")), nanos)

    def nanos(p: Column) -> Column:
        size = F.when((F.length(p["size"]) <= 28) & (p["near"] | (p["size"] == "0")), p["size"]).try_cast("decimal(28,0)")
        below = -size - F.when(p["more"], 1).otherwise(0).cast("decimal(1,0)")
        return let(F.when(p["minus"], below).otherwise(size).cast("decimal(29,0)"), split)

    def split(n: Column) -> Column:
        rest = F.pmod(n, thousand)
        us = ((n - rest) / thousand).try_cast("bigint")
        return F.struct(us.alias("us"), F.when(us.isNotNull(), rest.cast("smallint")).alias("ns"))

    return let(F.struct((part(1) == "-").alias("minus"), part(2).alias("whole"), part(3).alias("fraction"), part(4).alias("exponent")), shift)


def timestamp_source(raw: Column) -> Column:
    return F.when(raw.isNull() | (raw == ""), "arrival").otherwise("sdk")


def event_day(time_us: Column) -> Column:
    return F.to_date(F.timestamp_micros(time_us))


def event_id(raw: Column) -> Column:
    """32 hex digits without dashes, lower-cased, not all zero; else null."""
    return _hex(F.lower(F.regexp_replace(raw, "-", "")), 32)


def trace_id(raw: Column) -> Column:
    return _hex(F.lower(raw), 32)


def span_id(raw: Column) -> Column:
    return _hex(F.lower(raw), 16)


def _hex(text: Column, width: int) -> Column:
    return F.when(text.rlike(rf"\A[0-9a-f]{{{width}}}\z") & ~text.rlike(r"\A0+\z"), text)


def record_id(domain: str, *parts: Column) -> Column:
    """sha256 of the domain tag and the parts, each behind its length in 8 bytes."""
    sized = []
    for p in (F.lit(domain), *parts):
        raw = F.encode(p, "UTF-8")
        sized += [F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw]
    return F.sha2(F.concat(*sized), 256)


def lane(uuid: Column, lanes: int = 16) -> Column:
    """First byte of the hash of a UUID's bytes, modulo the number of lanes."""
    digest = F.sha2(F.unhex(F.regexp_replace(uuid, "-", "")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), F.lit(lanes))


def transition_id(issue_id: Column, revision: Column) -> Column:
    """A UUID-shaped id from the hash of issue and revision, version and variant bits set."""
    h = F.sha2(F.concat_ws(":", issue_id, revision.cast("string")), 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_valid(path: Column) -> Column:
    """An RFC 6901 path: opens with /, every ~ is followed by 0 or 1, at most 1,024 bytes."""
    return F.coalesce(path.rlike(r"^/([^~]|~[01])*$") & (F.octet_length(path) <= 1024), F.lit(False))


def truncate_runes(text: Column, most: int = 512) -> Column:
    return F.substring(text, 1, most)


def unsupported_type(kind: Column) -> Column:
    """Types over 128 bytes keep a prefix of at most 100 bytes, whole characters only, and a short hash."""
    head = F.coalesce(*(F.try_validate_utf8(F.substring(F.encode(kind, "UTF-8"), 1, n).cast("string")) for n in (100, 99, 98, 97)))
    return F.when(F.octet_length(kind) > 128, F.concat(head, F.lit("#"), F.substring(F.sha2(kind, 256), 1, 16))).otherwise(kind)


def scrub_url(url: Column) -> Column:
    """Every query value filtered: keys decoded, sorted by their bytes and encoded again; the fragment stays.

    Empty pairs go, and so do pairs with a semicolon or a broken escape, as their keys cannot be told; an empty key
    stays. A URL whose pairs all go loses its question mark. ``normalize.scrub_url_text`` is the same rule for payloads.
    """
    rest = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)(#.*)$", 1)
    told = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    keys = F.array_sort(F.array_compact(F.transform(told, lambda p: F.when(~p.rlike("%(?![0-9A-Fa-f]{2})"), F.try_url_decode(F.regexp_extract(p, r"^([^=]*)", 1))))))
    encoded = lambda k: F.replace(F.replace(F.url_encode(k), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    filtered = F.array_join(F.transform(keys, lambda k: F.concat(encoded(k), F.lit("=%5BFiltered%5D"))), "&")
    return F.when(query == "", url).otherwise(F.concat(rest, F.when(filtered == "", "").otherwise(F.concat(F.lit("?"), filtered)), fragment))


def sensitive_key(key: Column) -> Column:
    """The key is a secret word, or ends with one behind a dot or underscore."""
    return F.lower(F.trim(key)).rlike(f"(^|[._])({'|'.join(SECRET_WORDS)})$")


def width_bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above x."""
    return F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + (x >= b).cast("int"))


def row_bytes(strings: list[Column], attrs: Column | None = None, lists: list[Column] | None = None) -> Column:
    """Estimated bytes of a wide row: strings, 256 and its strings per attribute, 32 per list item."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    total = sum((size(c) for c in strings), F.lit(0).cast("bigint"))
    if attrs is not None:
        total = total + F.coalesce(F.aggregate(attrs, F.lit(0).cast("bigint"), lambda n, a: n + 256 + size(a["path"]) + size(a["string_value"]) + size(a["json_value"])), F.lit(0).cast("bigint"))
    for c in lists or []:
        total = total + F.coalesce(F.size(c), F.lit(0)) * 32
    return total


EXCEPTIONS = "array<struct<type:string,value:string,mechanism:struct<handled:boolean>,stacktrace:struct<frames:array<struct<module:string,function:string,filename:string,in_app:boolean>>>>>"


def mentions(raw: Column, key: str) -> Column:
    """False only where no key of the JSON text can be ``key``, some letters: they stand in the text, unless as escapes."""
    return F.contains(raw, F.lit(key)) | F.contains(raw, F.lit("\\u"))


def exceptions(raw: Column) -> Column:
    """The exception chain, from an object with values or a bare list."""
    at = lambda path: F.from_json(F.get_json_object(raw, path), EXCEPTIONS)
    return F.when(mentions(raw, "exception"), F.coalesce(at("$.exception.values"), at("$.exception")))


def last_exception(raw: Column) -> Column:
    """struct<type, value, mechanism, ...> of the last exception, null without one."""
    return let(exceptions(raw), lambda chain: F.when(F.size(chain) > 0, F.element_at(chain, -1)))


def event_message(raw: Column) -> tuple[Column, Column]:
    """(message, template) of ``event_told``."""
    told = event_told(raw)
    return told["message"], told["template"]


def event_told(raw: Column) -> Column:
    """struct<message, template>: formatted log entry, message text, formatted message, last exception, log entry template.
    Only the log entry and the message object have a template, and only for their own text. No path is looked up twice,
    and none that the text does not mention."""
    at = lambda path: F.get_json_object(raw, path)
    filled = lambda c: F.nullif(c, F.lit(""))

    def within(p: Column) -> Column:
        # Only an object has a text of its own within.
        deeper = p["said"].startswith("{") | (p["said"] == "")
        inner = {n: F.when(deeper, at(f"$.message.{path}")).alias(n) for n, path in (("inner", "formatted"), ("inner_entry", "message"))}
        return let(F.struct(*(p[n].alias(n) for n in ("said", "formatted", "entry")), *inner.values()), choose)

    def choose(p: Column) -> Column:
        text = F.when(p["said"].startswith("{"), F.lit(None).cast("string")).otherwise(filled(p["said"]))
        return let(F.struct(*(filled(p[n]).alias(n) for n in ("formatted", "entry", "inner", "inner_entry")), text.alias("text")), tell)

    def tell(p: Column) -> Column:
        own = F.coalesce(p["formatted"], p["text"], p["inner"])
        thrown = F.when(own.isNull(), let(last_exception(raw), lambda last: F.coalesce(filled(last["value"]), filled(last["type"]))))

        def both(thrown: Column) -> Column:
            template = F.when(p["formatted"].isNotNull(), p["entry"]).when(p["text"].isNotNull(), None).when(p["inner"].isNotNull(), p["inner_entry"]).when(thrown.isNull(), p["entry"])
            return F.struct(F.coalesce(own, thrown, p["entry"], F.lit("")).alias("message"), template.alias("template"))

        return let(thrown, both)

    entry = {n: F.when(mentions(raw, "logentry"), at(f"$.logentry.{path}")).alias(n) for n, path in (("formatted", "formatted"), ("entry", "message"))}
    return let(F.struct(F.when(mentions(raw, "message"), at("$.message")).alias("said"), *entry.values()), within)


class _Number(str):
    """A number as it is spelled."""


def _written(v) -> str:
    if isinstance(v, _Number):
        return v
    if isinstance(v, str):
        return encode_basestring(v)
    if isinstance(v, dict):
        return "{" + ",".join([f"{encode_basestring(k)}:{_written(v[k])}" for k in sorted(v)]) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_written, v)) + "]"
    return json.dumps(v)


#: Made once: a decoder of its own for each text would cost more than most texts.
_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number)


def _canonical(text: str | None, without: str | None = None) -> str | None:
    """Keys sorted, no spaces, numbers spelled as they stand; of an object, the key ``without`` goes."""
    if text is None:
        return None
    try:
        if text.startswith("\ufeff"):
            return None
        value = _DECODER.decode(text)
        return _written({k: v for k, v in value.items() if k != without} if isinstance(value, dict) else value)
    except (ValueError, OverflowError):
        return None


def json_canonical(raw: Column, without: str | None = None) -> Column:
    """Canonical JSON text for hashes; null where the text is no JSON. Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _canonical(t, without), na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(raw)


def in_ranges(position: Column, ranges: Column) -> Column:
    """Whether a position lies in one of the [first, last] ranges."""
    return F.coalesce(F.exists(ranges, lambda r: (F.get(r, F.lit(0)) <= position) & (position <= F.get(r, F.lit(1)))), F.lit(False))


def dotted_key(raw: Column, key: str) -> Column:
    """The value of a top-level key taken literally, dots included."""
    return F.get_json_object(raw, f"$['{key}']")
