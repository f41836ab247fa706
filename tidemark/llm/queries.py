"""The registered digest queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chunk_bpe, oracles, pii, quality, toxicity
from tidemark.llm.ann import search
from tidemark.llm.decontaminate import find_copies
from tidemark.llm.html_text import extract_text
from tidemark.llm.jaccard_join import jaccard_groups
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.line_dedup import drop_shared_lines
from tidemark.llm.negatives import mine
from tidemark.llm.periodic import find_runs

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"]))))
    cover = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    at = F.transform("places", lambda p: p["at"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), cover.cast("double").alias("score"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, field)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _of_kind(k: int) -> Callable[[Column], Column]:
    # A second parameter would be taken for the item's index.
    return lambda b: b["kind"] == k


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "disclosed"))
    return found.select("doc_id", *count, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(every).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = quality.fit(docs, _table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, trees)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    # Components beyond 2**31 are left null, as their vectors are too long to score in 64 bits.
    whole = lambda x: F.when(F.abs(x) < 2.0**31, F.floor(F.lit(256.0) * x))
    rows = _table(spark, sf_dir, "embeddings").where(F.forall("embedding", finite))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: whole(x.cast("double"))).alias("v")))


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32(doc_id) repeats from word a on with period p; the others' texts stay."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    due = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long"))
    a, n = F.col("g") % F.greatest(F.col("n"), F.lit(1)), F.col("n")
    at = due.withColumn("a", F.when(n > 0, a)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return at.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Ratios compare by cross products; the first run of equal ones has the smallest start, then period.
    best = F.aggregate(F.slice("runs", 2, 2_000_000_000), F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    digest = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""))
    return digest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_license_scan, op3_toxicity, op4_pii, op5_quality, op6_decontaminate, op7_nearest, op8_bpe, op9_html_text, op10_jaccard_join,
        op11_hard_negatives, op12_chunk_bpe, op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = oracles.SQL
