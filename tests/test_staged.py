"""Staged files over many splits: a fault anywhere is found, at the edge of a split, too."""

import json
import random

import pytest

from tidemark.sources.io import read_staged

SCHEMA = "ordinal bigint, note string"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_swapped_lines_are_found_wherever_they_stand(small_splits, tmp_path):
    rng, expected = random.Random(3), {}
    for f in range(30):
        lines = [json.dumps({"ordinal": 3 * i, "note": "n" * rng.randint(0, 40)}) for i in range(300)]
        at = rng.choice([None, rng.randrange(299)])
        if f:  # every place once in a while, the edges of splits among them
            at = f * 10 - 1
        if at is not None and f % 5:
            lines[at], lines[at + 1] = lines[at + 1], lines[at]
        expected[f"f{f}.json"] = "ordinal_order" if at is not None and f % 5 else None
        (tmp_path / f"f{f}.json").write_text("\n".join(lines) + "\n\n")
    rows, files = read_staged(small_splits, SCHEMA, str(tmp_path))
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 40
    found = files.collect()
    assert {r.file_path.rsplit("/", 1)[1]: r.reason for r in found} == expected and {r.lines for r in found} == {300}
    assert rows.columns == ["ordinal", "note", "file_path"] and rows.count() == 300 * sum(v is None for v in expected.values())


def test_a_swap_at_the_very_edge_of_a_split(small_splits, tmp_path):
    lines = [json.dumps({"ordinal": i, "note": "x" * 70}) for i in range(100, 400)]
    size, found = len(lines[0]) + 1, 0
    for at in range(0, 299):
        if (at + 1) * size // 2000 != at * size // 2000 and found < 3:  # the lines on both sides of an edge
            found += 1
            swapped = lines[:]
            swapped[at : at + 2] = swapped[at + 1], swapped[at]
            (tmp_path / f"edge{at}.json").write_text("\n".join(swapped))
    (tmp_path / "fine.json").write_text("\n".join(lines))
    _, files = read_staged(small_splits, SCHEMA, str(tmp_path))
    got = {r.file_path.rsplit("/", 1)[1]: r.reason for r in files.collect()}
    assert len(got) == 4 and got.pop("fine.json") is None and set(got.values()) == {"ordinal_order"}


def test_other_faults(spark, tmp_path):
    for name, text in {"a": '{"ordinal":1}\n{"ordinal":1}', "b": '{"ordinal":1}\n{"note":"x"}', "c": '{"ordinal":1}\n{"ordinal":', "d": '{"ordinal":"x"}', "e": '{"ordinal":2,"note":"y"}', "g": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, files = read_staged(spark, SCHEMA, str(tmp_path))
    assert {r.file_path[-6]: r.reason for r in files.collect()} == {"a": "ordinal_order", "b": "no_ordinal", "c": "no_json", "d": "no_json", "e": None, "g": "no_json"}
    assert [(r.ordinal, r.note) for r in rows.collect()] == [(2, "y")]
