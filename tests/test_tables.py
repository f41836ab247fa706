"""Table functions in SQL: nulls, broken inputs, and the same rows as the operators give."""

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.functions import tables
from tidemark.operators import normalize as N

RAW = [None, "", "no json", "[]", '{"tags":{}}', '{"tags":{"a/b":1,"c~":[true,null,{}]},"extra":{"n":123456789012345678901234567890,"f":1.5e0},"user":{"id":"u"}}', '{"tags":{"big":' + "9" * 40 + "}}"]


def test_attributes(spark):
    df = spark.createDataFrame(list(enumerate(RAW)), "id int, raw string")
    got = tables.register(spark).sql("select d.id, a.* from {d} d, lateral event_attributes(d.raw) a", d=df)
    known = N.with_attributes(df, "event").select("id", F.explode("attrs").alias("a")).select("id", "a.*")
    rows = sorted(map(str, known.collect()))
    assert len(rows) == 8 and sorted(map(str, got.collect())) == rows
    assert got.schema["integer_value"].dataType.simpleString() == "decimal(38,0)"


def test_logs(spark):
    raw = ['{"attributes":{"a":{"type":"integer","value":"x"},"b":{"type":"double","value":3},"c":"t"}}', None, '{"attributes":7}']
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = tables.register(spark).sql("select d.id, a.path, a.value_type, a.double_value from {d} d, lateral log_attributes(d.raw) a", d=df)
    assert sorted(map(tuple, got.collect())) == [(0, "/a", "invalid", None), (0, "/b", "double", 3.0), (0, "/c", "string", None)]


def test_envelopes(spark):
    whole = b'{}\n{"type":"event","length":2}\n{}\n{"type":"x"}\nabc\n'
    data = [bytearray(whole), bytearray(b"broken"), None, bytearray(b'{}\n{"type":"event","length":9}\n{}')]
    df = spark.createDataFrame(list(enumerate(data)), "id long, data binary")
    got = tables.register(spark).sql("select d.id, i.ordinal, i.type, i.payload, i.problem from {d} d, lateral envelope_items(d.data) i", d=df)
    known = N.read_envelopes(df, "id", "data").select("id", "ordinal", "type", "payload", "problem")
    rows = sorted(map(tuple, known.collect()))
    assert sorted(map(tuple, got.collect())) == rows
    assert [(r[0], r[4]) for r in rows] == [(0, None), (0, None), (1, "envelope_header"), (2, "envelope_header"), (3, "item_length")]


def test_functions_make_no_arrow_table_per_row(spark, monkeypatch):
    """With Arrow each input row's output is a table of its own, which costs far more than its few rows."""
    made = []
    monkeypatch.setattr(tables, "udtf", lambda kind, **how: made.append(how) or udtf(kind, **how))
    tables.register(spark)
    assert len(made) == 3 and not any(how["useArrow"] for how in made)
