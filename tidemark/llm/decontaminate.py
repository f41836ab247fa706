"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A bitmap of fixed size tells which word n-grams of the corpus may be seeds of
test items; around those, regions of words are kept. The seeds of the regions
join the items' n-grams in Spark; a region and an item become a candidate when
two seeds agree on a diagonal or one seed is rare, that is, seldom hit alone.
Candidates are aligned locally, so copies with edits are scored as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, find_words, gram_hashes, keep, row_bounds, text_slices

#: Words in a seed.
N = 3
#: Bits of the seed filter; its size does not depend on the benchmark.
FILTER_BITS = 24
#: Diagonals of one item this far apart agree.
GAP = 6
#: A seed hit alone in at most this share of the documents (plus a few) is rare.
RARE_SHARE, RARE_LEAST = 1e-4, 3
#: Alignment scores.
MATCH, MISMATCH, SPACE = 2, -1, -1
#: Share of the best possible score from which a passage counts as a copy.
COPY = 0.5
#: Items up to this many n-grams are sent to all tasks; more are joined by a shuffle.
SMALL_GRAMS = 200_000


def _items(batches):
    for batch in batches:
        for lo, hi, buf, offs in text_slices(batch.column(1)):
            _, _, row, h = find_words(buf, offs, ALNUM)
            at = row_bounds(row, hi - lo)
            words = [h[a:b].view(np.int64) for a, b in zip(at, at[1:])]
            grams = gram_hashes(h, N)
            own = [grams[a : max(a, b - N + 1)].view(np.int64) for a, b in zip(at, at[1:])]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], ["item_id", "words", "grams"])


def _regions(filter_shared, margin: int):
    """Per document: runs of words around possible seeds, with the seeds' places in the document."""
    fields = ["doc_id", "twin", "base", "words", "grams", "places"]

    def run(batches):
        bits = np.unpackbits(np.frombuffer(filter_shared.value, np.uint8)).astype(bool)
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                _, _, row, h = find_words(buf, offs, ALNUM)
                grams = gram_hashes(h, N)
                hit = np.flatnonzero(bits[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                hit = hit[row[hit] == row[hit + N - 1]]
                if not len(hit):
                    continue
                at = row_bounds(row, hi - lo)
                cut = np.flatnonzero((np.diff(hit) > 2 * margin) | (np.diff(row[hit]) != 0)) + 1
                out = [[], [], [], [], [], []]
                ids, twins = batch.column(0), batch.column(2)
                for part in np.split(hit, cut):
                    r = int(row[part[0]])
                    a, b = max(at[r], part[0] - margin), min(at[r + 1], part[-1] + N + margin)
                    for column, value in zip(out, (ids[lo + r].as_py(), twins[lo + r].as_py(), int(a - at[r]), h[a:b].view(np.int64), grams[part].view(np.int64), (part - a).astype(np.int32))):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], fields)

    return run


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of an item in a passage: share of the best possible score, first word and end (exclusive)."""
    best, end = _best(passage, item)
    if best <= 0:
        return 0.0, 0, 0
    _, back = _best(passage[:end][::-1], item[::-1])
    return best / (MATCH * len(item)), end - back, end


def _best(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Highest cell of the Smith-Waterman table and its column's end, one array operation per item word."""
    step = np.arange(len(passage) + 1) * -SPACE
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        here = np.maximum(above + SPACE, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + np.where(passage == w, MATCH, MISMATCH))
        # A run of spaces along the row: the running maximum of what stands left, less its distance.
        here = np.maximum(np.maximum.accumulate(here + step) - step, 0)
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def _score(batches):
    for batch in batches:
        passages, items = batch.column("words"), batch.column("item_words")
        rows = [align(np.asarray(p.values), np.asarray(i.values)) for p, i in zip(passages, items)]
        base = np.asarray(batch.column("base"))
        first = base + np.array([r[1] for r in rows], np.int64)
        end = base + np.array([r[2] for r in rows], np.int64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("twin"), batch.column("item_id"), pa.array([r[0] for r in rows], pa.float64()), pa.array(first), pa.array(end)], ["doc_id", "twin", "item_id", "score", "first_word", "end_word"])


def find_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = COPY) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): the best copy of each item in each document, scores from ``least`` up.

    Words are runs of a-z, 0-9 and non-ASCII after lower-casing A-Z, counted
    from 0. Null ids take no part; null and empty texts and items of fewer
    than three words match nothing. Rows that repeat an id are looked at one
    by one and give one row for the id and item; a repeated item id stands for
    all its texts. Of equally good copies the one that starts first is given,
    then the shortest. Long texts are searched whole, in regions around their
    seeds. With either table empty there are no rows; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    items = keep(benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_items, "item_id long, words array<long>, grams array<long>"))
    grams = items.select("item_id", F.posexplode("grams").alias("at", "gram"))
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for (b,) in grams.select(F.shiftrightunsigned("gram", 64 - FILTER_BITS).alias("b")).distinct().toLocalIterator():
        bitmap[b >> 3] |= 128 >> (b & 7)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    longest, n_grams = items.agg(F.coalesce(F.max(F.size("words")), F.lit(1)), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()

    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("twin"))
    regions = keep(src.mapInArrow(_regions(shared, int(longest)), "doc_id long, twin long, base long, words array<long>, grams array<long>, places array<int>"))
    hits = regions.select("doc_id", "twin", "base", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("doc_id", "twin", "base", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    hits = hits.join(F.broadcast(grams) if n_grams <= SMALL_GRAMS else grams, "gram")
    key = ["doc_id", "twin", "base", "item_id"]
    # Diagonals go to two overlapping grids of buckets, so near ones meet in one of them.
    diagonal = F.col("place") - F.col("at")
    votes = hits.select(*key, "gram", F.explode(F.array(F.floor(diagonal / GAP) * 2, F.floor((diagonal + GAP / 2) / GAP) * 2 + 1)).alias("band"))
    bands = keep(votes.groupBy(*key, "band").agg(F.size(F.collect_set("gram")).alias("seeds"), F.min("gram").alias("gram")))
    total = docs.count()
    alone = bands.where("seeds = 1 and band % 2 = 0").groupBy("gram").agg(F.count(F.lit(1)).alias("alone"))
    single = bands.where("seeds = 1").join(alone, "gram", "left").where(F.coalesce("alone", F.lit(0)) <= RARE_LEAST + RARE_SHARE * total)
    candidates = bands.where("seeds >= 2").select(*key).union(single.select(*key)).distinct()
    pairs = candidates.join(regions.select("doc_id", "twin", "base", "words"), ["doc_id", "twin", "base"]).join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
    scored = pairs.select("doc_id", "twin", "item_id", "base", "words", "item_words").mapInArrow(_score, "doc_id long, twin long, item_id long, score double, first_word long, end_word long")
    top = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("top")
    return scored.where(F.col("score") >= least).groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.score", "top.first_word", "top.end_word")
