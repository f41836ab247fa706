"""Table functions for SQL: the items of an envelope and the attributes of a payload, by ``lateral``.

``register(spark)`` names them ``envelope_items``, ``event_attributes`` and
``log_attributes``; rows travel pickled in batches, as Arrow would make a table of each input row's few. A null or broken input gives no
attributes, and an envelope one row that says what is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.operators.normalize import event_attributes, log_attributes, parse_envelope

ITEM = "ordinal int, header string, type string, payload string, problem string"
ATTRIBUTES = "namespace string, path string, value_type string, string_value string, integer_value decimal(38,0), double_value double, boolean_value boolean, json_value string, unit string"
_ORDER = tuple(f.split()[0] for f in ATTRIBUTES.split(", "))


class EnvelopeItems:
    """One row per item of a binary envelope."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for ordinal, header, kind, payload, problem in parse_envelope(bytes(data or b"")):
            yield ordinal, header, kind, payload.decode("utf-8", "replace"), problem


def _rows(found: list[dict]) -> Iterator[tuple]:
    for a in found:
        whole = a["integer_value"]
        yield tuple(Decimal(whole) if k == "integer_value" and whole is not None else a[k] for k in _ORDER)


class EventAttributes:
    """One row per leaf of an event's tags, extra, contexts, user, request and sdk."""

    def eval(self, raw: str) -> Iterator[tuple]:
        yield from _rows(event_attributes(raw))


class LogAttributes:
    """One row per attribute of a log."""

    def eval(self, raw: str) -> Iterator[tuple]:
        yield from _rows(log_attributes(raw))


def register(spark: SparkSession) -> SparkSession:
    """The session, with the table functions in its catalog."""
    for name, kind, schema in (("envelope_items", EnvelopeItems, ITEM), ("event_attributes", EventAttributes, ATTRIBUTES), ("log_attributes", LogAttributes, ATTRIBUTES)):
        spark.udtf.register(name, udtf(kind, returnType=schema, useArrow=False))
    return spark
