"""The registered digest queries: against SQL, whole tables, and the pipeline against its stages' brute force."""

import sys

import pytest

from tidemark.llm.queries import ORACLES, QUERIES

sys.path.insert(0, "tests")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_digest_matches_sql(spark, name):
    from oracle import assert_same

    assert_same(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_row(spark, name):
    out = QUERIES[name](spark, SF)
    table = {"op9": "pages"}.get(name.split("_")[0], "documents")
    n = out.count()
    assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if name.split("_")[0] not in ("op6", "op7", "op11") else n > 0


def test_pipeline(spark):
    import corpus_pipeline
    from tidemark.llm.decontaminate import find_copies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    lines = corpus_pipeline.drop_lines(spark, clean, SF).cache()
    single = corpus_pipeline.one_of_each_group(spark, lines, SF).cache()
    from test_operators import brute_groups, brute_lines

    expected = {d: t for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in clean.collect()])}
    assert {r.doc_id: r.text for r in lines.collect()} == expected
    groups = brute_groups(list(expected.items()))
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    left = corpus_pipeline.drop_leaks(spark, single, SF)
    leaks = {r.doc_id for r in find_copies(single, bench).collect()}
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in single.collect()} - leaks
    assert left.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in left.collect()}


def test_pipeline_keeps_columns_whose_names_clash(spark):
    import corpus_pipeline

    line = "A line that is long enough to count"
    rows = [(i, f"{line}\nown {i}", 100 + i, "x", 7) for i in range(4)] + [(9, None, 5, "y", 8), (None, line, 6, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped string, n_chars long")
    out = corpus_pipeline.drop_lines(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.n_lines, r.n_dropped) for r in out.collect()) == sorted((r[2], r[3]) for r in rows)
    assert {r.doc_id: r.text for r in out.collect()} == {0: "own 0", 1: "own 1", 2: "own 2", 3: f"{line}\nown 3", 9: "", None: line}


def test_pii_counts_each_kind(spark, tmp_path):
    """Counts by kind, whatever the order of the kinds in a text, and the hash of the spans."""
    from hashlib import sha256

    from test_operators import brute_pii

    card, ip = "4111 1111 1111 1111", "10.0.0.1"
    texts = {1: f"{ip} {ip} {ip}", 2: f"{card} a@b.example {ip}", 3: f"+49 30 1234-5678, {card}, a@b.example, {ip}, c@d.example", 4: "none", 5: None, 6: f"{card} {card}"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = ("email", "ip", "card", "phone")
    for r in QUERIES["op4_pii"](spark, str(tmp_path)).collect():
        spans = [(s, k, e) for s, k, e, *_ in brute_pii(texts[r.doc_id] or "")]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in spans) for i in range(4)], texts[r.doc_id]
        assert r.base_sha256 == sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
