"""Line dedup: lines that several documents share stay only in the largest document that holds them.

Native: DataFrame functions only. Each document's normalised lines are
exploded to 128-bit hashes with their positions; documents are counted per
hash through partial aggregates dealt by (hash, document), so a line that a
third of all documents share is counted by many tasks. The shared lines are a
written table, so that the join of all lines with it has plain shuffles on both
sides, which adaptive execution splits where a line is hot. The positions to
drop go back to their documents, whose text is put together again by position
in one walk along its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, keep_table

#: ASCII white space [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text in ``text_col`` and the added columns n_lines and n_dropped.

    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines except in the largest id that holds them.
    A null or empty text is one empty line; a null text becomes an empty one.
    Rows with a null id keep all lines and count for none. Rows that repeat an
    id count as one document and each lose their own lines; equal rows lose the
    same lines. No tie is possible, as an id either is the largest or is not. An
    empty table gives no rows. Time is linear in a text's lines, whatever their
    number. Other columns pass through, whatever their names; input columns
    named n_lines or n_dropped give way to the added ones.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).cast("long").alias("__id"), text.alias("__text"))
    # Rows that repeat an id are told apart by a hash of their texts; equal texts lose equal positions.
    src = src.withColumn("__twin", F.xxhash64("__text"))

    keys = src.where("__id is not null").select("__id", "__twin", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    keys = keys.select("__id", "__twin", "__pos", line_key(F.col("__line")).alias("__key")).where(F.length("__key") >= min_chars)
    lines = keys.select("__id", "__twin", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit("line"), "__key").alias("__h2"))

    per_doc = lines.select("__h1", "__h2", "__id").distinct()
    shared = per_doc.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__docs"), F.max("__id").alias("__last")).where(F.col("__docs") >= min_docs)
    shared = keep_table(shared.select("__h1", "__h2", "__last"))
    drops = lines.join(shared, ["__h1", "__h2"]).where("__id < __last")
    drops = drops.groupBy(F.col("__id").alias("__did"), F.col("__twin").alias("__dtwin")).agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))

    joined = src.join(drops, F.col("__id").eqNullSafe(F.col("__did")) & (F.col("__twin") == F.col("__dtwin")), "left")
    n = F.expr("length(__text) - length(replace(__text, '\\n', '')) + 1").cast("long")
    # One flag a line up to the last dropped one, from the gaps between the dropped positions; array_join passes over nulls.
    before = F.concat(F.array(F.lit(-1)), "__drop")
    flags = F.flatten(F.zip_with(before, "__drop", lambda a, b: F.when(b.isNotNull(), F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))).otherwise(F.array(F.lit(False)))))
    kept = F.array_join(F.zip_with(F.split("__text", "\n", -1), flags, lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line)), "\n")
    out = joined.select("__row", "__text", n.alias("__n"), "__drop")
    out = out.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(kept))
    dropped = F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    plain = [F.col("__kept").alias(text_col) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*plain, F.col("__n").alias("n_lines"), F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(dropped).cast("long").alias("n_dropped"))
