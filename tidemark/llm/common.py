"""Shared pieces: checkpoints in the shared folder, word hashing over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.io import checkpoint_folder, shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: smaller there than ``keep`` for many rows."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, other letters untouched; ASCII rows take the fast built-in."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


# --- numpy word hashing -------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+ : everything that is no ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: a-z, digits and non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _power_table(base: int, n: int, name: str) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        step = np.full(max(n, _CHUNK), base, np.uint64)
        step[0] = 1
        held = np.cumprod(step)
        if n <= _CHUNK:
            _powers[name] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_slices(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about ``most_bytes``; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def find_words(buf: np.ndarray, offs: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Starts, ends (bytes), row numbers and 64-bit hashes of the words of A-Z-lower-cased rows.

    Hashes are polynomials over the bytes modulo 2**64, mixed; equal words hash
    equal. For each length in ``prefixes`` an array follows with the hashes of
    the words' first bytes, 0 where a word is not longer than that.
    """
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none, *(np.zeros(0, np.uint64) for _ in (0, *prefixes))
    low = LOWER_BYTES[buf]
    m = word[low]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    row_start = offs[:-1][offs[:-1] < offs[1:]]
    first[row_start] = m[row_start]
    row_end = offs[1:][offs[:-1] < offs[1:]] - 1
    last[row_end] = m[row_end]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.empty(len(s), np.uint64)
    heads = [np.zeros(len(s), np.uint64) for _ in prefixes]
    k = 0
    while k < len(s):
        k2 = max(k + 1, int(np.searchsorted(e, s[k] + _CHUNK, "right")))
        a, b = s[k], e[k2 - 1]
        c = np.zeros(b - a + 1, np.uint64)
        np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * _power_table(_R, b - a, "up"), out=c[1:])
        at, down = s[k:k2] - a, _power_table(_RINV, b - a, "down")[s[k:k2] - a]
        h[k:k2] = (c[e[k:k2] - a] - c[at]) * down
        for head, m in zip(heads, prefixes):
            longer = np.flatnonzero(e[k:k2] - s[k:k2] > m)
            head[k + longer] = mix((c[at[longer] + m] - c[at[longer]]) * down[longer] + np.uint64(m))
        k = k2
    row = np.searchsorted(offs, s, "right") - 1
    return s, e, row, mix(h), *heads


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (also those across rows; the caller masks them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (k * 0x632BE59BD9B4E019) & _MASK, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        out = out ^ (out >> np.uint64(31))
    return mix(out)


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """For each of ``n_rows`` rows, the index of its first word; ends with the number of words."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes ``find_words`` gives these words."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offs[1:])
    return find_words(np.frombuffer(b" ".join([*raw, b""]), np.uint8), offs, NON_SPACE)[3] if raw else np.zeros(0, np.uint64)
