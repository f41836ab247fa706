"""Periodic runs of words: stretches that repeat with a period three times or more.

A word of a run occurs in it at least three times, so a word that occurs less
often within a segment of a text is in no run and splits the segment; what is
left splits again by its own counts, until every word of a segment occurs often
enough. Segments that survive are scanned by lag. A run of period q holds two
anchors, multiples of q, a lag apart, with q equal words behind them: lags of 8
and more compare fingerprints of as many words as the power of two below the
lag has, for all anchors at once, and only where they agree are the words
themselves compared; shorter lags are compared word by word. A segment of n
words costs about n log n.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix

#: Words of the shortest run.
LEAST_WORDS = 24
#: Periods that a run holds at least.
LEAST_PERIODS = 3
#: Lags up to here are compared word by word.
SHORT_LAGS = 8
#: Anchors compared at once.
ANCHORS = 1 << 20


def split_by_frequency(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """(start, end) of the segments whose words all occur in them ``least_periods`` times, in order.

    No run crosses a word that it leaves out. Long segments of many words take
    part whole in each round, so a text takes as many rounds as its segments nest.
    """
    out, todo = [], [(0, len(words))]
    while todo:
        a, b = todo.pop()
        if b - a < least_words:
            continue
        part = words[a:b]
        _, at, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[at] < least_periods)
        if not len(rare):
            out.append((a, b))
            continue
        bounds = np.concatenate([[-1], rare, [b - a]])
        for k in np.flatnonzero(np.diff(bounds) > least_words):
            todo.append((a + int(bounds[k]) + 1, a + int(bounds[k + 1])))
    return sorted(out)


def _reach(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words equal those a lag on: (first, one past the last), compared in growing pieces."""
    last, step, end = len(words) - lag, 64, at
    while end < last:
        n = min(step, last - end)
        differ = np.flatnonzero(words[end : end + n] != words[end + lag : end + lag + n])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + n, 2 * step
    step, start = 64, at
    while start > 0:
        n = min(step, start)
        differ = np.flatnonzero(words[start - n : start] != words[start - n + lag : start + lag])
        if len(differ):
            start = start - n + int(differ[-1]) + 1
            break
        start, step = start - n, 2 * step
    return start, end


def scan_lags(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs of these words, lag by lag."""
    n = len(words)
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()

    def add(start: int, end: int, lag: int) -> None:
        length = end - start + lag
        # The same stretch with a shorter period was found before this lag.
        if length >= max(least_words, least_periods * lag) and (start, length) not in seen:
            seen.add((start, length))
            runs.append((start, length, lag))

    most = n // least_periods
    for lag in range(1, min(SHORT_LAGS, most + 1)):
        same = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= max(least_words - lag, (least_periods - 1) * lag)].tolist():
            add(start, end, lag)
    # Fingerprints of 1, 2, 4, ... words; those of `size` words serve the lags from size to 2 * size - 1.
    prints, size = mix(words.astype(np.uint64) + np.uint64(1)), 1
    while size < SHORT_LAGS:
        prints, size = mix(prints[:-size] * np.uint64(0x9E3779B97F4A7C15) + prints[size:]), 2 * size
        if not len(prints):
            return runs
    while size <= most:
        lags = np.arange(size, min(2 * size, most + 1))
        # Anchors k * lag of each lag whose fingerprint, and that a lag on, lie within the segment.
        counts = (n - size - lags) // lags + 1
        held = np.concatenate([[0], np.cumsum(counts)])
        i = 0
        while i < len(lags):
            j = max(i + 1, int(np.searchsorted(held, held[i] + ANCHORS, "right")) - 1)
            each = np.repeat(lags[i:j], counts[i:j])
            at = (np.arange(held[j] - held[i]) - np.repeat(held[i:j] - held[i], counts[i:j])) * each
            alike = prints[at] == prints[at + each]
            each, at = each[alike], at[alike]
            # Where a known run covers a lag from the anchor on and its period divides the lag, the stretch repeats that shorter period.
            for start, length, period in runs:
                if length >= 2 * size and len(at):
                    keep = ~((each % period == 0) & (at >= start) & (at + each <= start + length) & (each > period))
                    each, at = each[keep], at[keep]
            past: dict[int, int] = {}
            for lag, anchor in zip(each.tolist(), at.tolist()):
                if anchor >= past.get(lag, 0):
                    start, end = _reach(words, anchor, lag)
                    past[lag] = end
                    add(start, end, lag)
            i = j
        prints, size = mix(prints[:-size] * np.uint64(0x9E3779B97F4A7C15) + prints[size:]), 2 * size
        if not len(prints):
            break
    return runs


def runs_of(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs, by start, then period."""
    if len(words) < least_words:
        return []
    counts = Counter(words)
    # Most texts end here: no stretch between two rare words is long enough.
    often, stretch = [c >= least_periods for c in map(counts.__getitem__, words)], 0
    for o in often:
        stretch = stretch + 1 if o else 0
        if stretch >= least_words:
            break
    else:
        return []
    names = {w: i for i, w in enumerate(counts)}
    numbers = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    found = [(a + s, n, q) for a, b in split_by_frequency(numbers, least_words, least_periods) for s, n, q in scan_lags(numbers[a:b], least_words, least_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: a run keeps its first period, unless another run drops it."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): all periodic runs of each row's whole text.

    Words are what lies between ASCII white space, numbered from 0; runs are
    maximal, have their smallest period, at least ``least_words`` words and
    ``least_periods`` periods, and come by start, then period. ``collapsed`` is the
    text with one period of each run: a word goes if a run holds it past its first
    period; words are joined by one space. Null and empty texts have no words, no
    runs and an empty ``collapsed``. Rows that repeat an id, and rows with a null
    id, stay rows of their own. Columns besides the two named are not read,
    whatever their names. An empty table gives an empty one. A text is one row and
    so one task's work, which grows as n log n with its words.
    """
    if least_periods < 3:
        raise ValueError("the lag scan finds runs of three periods and more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            n, found, left = [], [], []
            for v in b.column(1).cast(pa.binary()):
                words = (v.as_py() or b"").split()
                runs = runs_of(words, least_words, least_periods)
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                left.append(b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()] if runs else words))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string(), safe=False)], ["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
