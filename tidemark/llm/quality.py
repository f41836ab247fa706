"""Quality by histogram gradient-boosted trees over document statistics.

The statistics come from byte histograms and word hashes of Arrow batches;
the trees are grown over binned values of a bounded labelled sample and
flattened into arrays, so that a batch walks all trees by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NON_SPACE, find_words, row_bounds, text_slices

#: Labelled rows that the trees learn from at most: the bound of the fit.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SHRINK = 80, 4, 48, 0.12, 2.0


def _byte_classes() -> np.ndarray:
    b = np.arange(256)
    within = lambda chars: np.isin(b, list(chars))
    letters = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 0xC0)
    return np.stack(
        [
            letters, (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), within(b" \t\n\x0b\x0c\r"), b == 10, within(b".?!"), within(b",;:"),
            within(b"#$%&*@^~+=<>\\/"), b == ord("|"), within(b"!"), within(b"()[]{}"), within(b"\"'"), (b >= 0x80) & (b < 0xC0), b < 32, within(b"_-"),
        ],
        axis=1,
    ).astype(float)


CLASSES = _byte_classes()
NAMES = (
    *(f"share_{n}" for n in ("letters", "upper", "digits", "space", "newline", "stops", "commas", "symbols", "bars", "bangs", "brackets", "quotes", "continued", "control", "dashes")),
    "log_chars", "log_words", "word_chars", "longest_word", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "top_line", "byte_entropy", "short_words", "long_words", "words_a_line", "symbol_ended",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; zeros for null and empty ones."""
    out = []
    for lo, hi, buf, offs in text_slices(texts):
        n = hi - lo
        size = np.maximum(np.diff(offs), 1).astype(float)
        hist = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offs)) + buf, minlength=n * 256).reshape(n, 256).astype(float)
        share = hist @ CLASSES / size[:, None]
        q = hist / size[:, None]
        entropy = -(q * np.log2(np.where(q > 0, q, 1))).sum(axis=1)
        s, e, row, h = find_words(buf, offs, NON_SPACE)
        at = row_bounds(row, n)
        lens = (e - s).astype(float)
        words = np.maximum(np.diff(at), 1).astype(float)
        total = lambda x: np.bincount(row, weights=x, minlength=n)  # noqa: E731,B023
        longest = np.zeros(n)
        np.maximum.at(longest, row, lens)
        ends_odd = CLASSES[buf[e - 1], 7] + CLASSES[buf[e - 1], 8] + CLASSES[buf[e - 1], 9] if len(e) else np.zeros(0)
        # Lines: words between newlines, hashed by the sum of their words' hashes and numbers.
        line = np.cumsum(buf == 10)[s] if len(s) else np.zeros(0, np.int64)
        more = np.zeros((n, 5))
        for i in range(n):
            a, b = at[i], at[i + 1]
            if b <= a:
                continue
            _, c = np.unique(h[a:b], return_counts=True)
            pairs = h[a : b - 1] * np.uint64(3) + h[a + 1 : b]
            new = np.flatnonzero(np.diff(line[a:b], prepend=line[a] - 1))
            lines, lc = np.unique(np.add.reduceat(h[a:b], new), return_counts=True)
            more[i] = len(c) / (b - a), len(np.unique(pairs)) / max(1, b - a - 1), len(lines) / len(new), c.max() / (b - a), lc.max() / len(new)
        lines = hist[:, 10] + 1
        block = np.column_stack([
            share, np.log1p(np.diff(offs)), np.log1p(np.diff(at)), total(lens) / words, longest, more, entropy,
            total((lens <= 2) * 1.0) / words, total((lens >= 15) * 1.0) / words, np.diff(at) / lines, total(ends_odd) / words,
        ])
        block[np.diff(offs) == 0] = 0
        out.append(block)
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


@dataclass
class Trees:
    """Complete binary trees side by side: feature and threshold of inner node i (children 2i+1, 2i+2), values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row."""
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log-loss; without rows of both labels, the base rate only."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(rate / (1 - rate)))
    inner = 2**DEPTH - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    d = x.shape[1]
    raw = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, m = 2**depth - 1, 2**depth
            key = ((node - first)[:, None] * d + np.arange(d)) * BINS + binned
            sums = [np.bincount(key.ravel(), weights=np.repeat(v, d), minlength=m * d * BINS).reshape(m, d, BINS) for v in (g, w)]
            left_g, left_w = (np.cumsum(v, axis=2) for v in sums)
            all_g, all_w = left_g[:, :, -1:], left_w[:, :, -1:]
            gain = left_g**2 / (left_w + SHRINK) + (all_g - left_g) ** 2 / (all_w - left_w + SHRINK) - all_g**2 / (all_w + SHRINK)
            gain[(left_w < 1) | (all_w - left_w < 1)] = 0
            best = gain.reshape(m, -1).argmax(axis=1)
            for i, at in enumerate(best):
                j, cut = divmod(int(at), BINS)
                if gain[i, j, cut] > 1e-6 and cut < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=w, minlength=inner + 1) + SHRINK)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Learns from at most ``FIT_ROWS`` labelled rows (docs: doc_id, text; labels: doc_id, quality), drawn by a hash of the id.

    Of labels that contradict each other 1 counts; labels that are null or neither 0 nor 1, or whose
    document is missing, teach nothing, and documents that share an id each teach their id's label.
    Without labels of both kinds every text gets the same kind of score. Extra columns are ignored.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("long").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(FIT_ROWS)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(run, "x array<double>, y long").toArrow()
    x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, len(NAMES)) if len(rows) else np.zeros((0, len(NAMES)))
    return grow(x, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, statistics array<double>) per row of ``docs``.

    Null texts count as empty; null ids stay; rows that repeat an id each have
    their own row, equal texts equal scores, and texts of any length are read
    whole. An empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(x)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "score", "statistics"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, statistics array<double>")
