"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes of a text decides where it is cut, so
documents that share a passage share its chunks wherever the passage stands.
Documents are dealt by the least of their chunk hashes: copies and near copies
meet in a task, side by side, and each chunk is encoded there once. A group of
copies larger than a partition is split, and its chunks are then encoded once
in each part.

Chunks are cut anywhere, also inside words, so their IDs are wrong around a
join. A join is repaired by encoding the text around it with the library: the
two last words of the chunk before and the two first of the chunk after. The
repair holds when its IDs open with those that the chunk before has for its
last word but one, and end with those that the chunk after has for its second
word. Chunks with too few words for that are put together first. Where a repair
does not agree, the library encodes the whole text.

A new chunk is encoded word by word (ASCII white space never lies inside a
token, nor in what Unicode normalisation puts together), and only words not
seen before go to the library, whose pattern matching is what costs most.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, text_slices

#: Bytes of the rolling window, and bytes of a chunk on average (a power of two).
WINDOW, MEAN = 16, 1024
#: Words, and chunks (and joins), in a generation of the caches of a Python worker; two generations are held.
WORDS, CHUNKS = 300_000, 10_000
#: Longer chunks are encoded without being held.
LONGEST_CACHED = 8192
#: Bytes of texts that are encoded together.
SLICE = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_R_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_codecs: dict[str, "ChunkCodec"] = {}
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size, up, back = max(n + 1, 1 << 21), _R, _R_BACK
        tables = []
        for base in (up, back):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def cut_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte bounds of all chunks of these rows, hash of each chunk), in order; a row without bytes has none.

    A cut stands after each window of ``WINDOW`` bytes within a row whose hash has
    its low bits clear, moved on to the next first byte of a character.
    """
    n = len(buf)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    up, back = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    if n > WINDOW:
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * back[: n - WINDOW + 1]
        at = np.flatnonzero((mix(rolled) & np.uint64(MEAN - 1)) == 0) + WINDOW
        starts = offs[np.searchsorted(offs, at, "left") - 1]  # of the row that holds the byte before the cut
        at = at[at - starts >= WINDOW]
        for _ in range(3):  # a character has at most three bytes besides its first
            inside = at < n
            at = at + (inside & ((buf[np.minimum(at, n - 1)] & 0xC0) == 0x80))
    else:
        at = np.zeros(0, np.int64)
    bounds = np.unique(np.concatenate([at, offs]))
    return bounds, mix((sums[bounds[1:]] - sums[bounds[:-1]]) * back[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _with_key(batches):
    """Adds the least chunk hash of each text; empty texts have 0."""
    for b in batches:
        keys = np.zeros(b.num_rows, np.uint64)
        for lo, hi, buf, offs in text_slices(b.column(1)):
            bounds, hashes = cut_points(buf, offs)
            if len(hashes):
                full = np.flatnonzero(offs[:-1] < offs[1:])
                keys[lo + full] = np.minimum.reduceat(hashes, np.searchsorted(bounds, offs[:-1][full]))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(keys.view(np.int64))], ["doc_id", "text", "near"])


@dataclass(slots=True)
class Piece:
    """IDs (bytes of little-endian unsigned 32-bit integers) and, where there are four words at least, what a repair needs.

    ``head``: (bytes up to the end of the second word, where the second word's IDs
    start and end); ``tail``: (bytes from the last word but one on, where that word's
    IDs start and end).
    """

    ids: bytes
    head: tuple[bytes, int, int] | None = None
    tail: tuple[bytes, int, int] | None = None


class Held(dict):
    """A cache of two generations: the older goes when the newer is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys) -> list:
        """The keys held in neither generation; those of the older move to the newer."""
        out = []
        for k in keys:
            if k not in self:
                if k in self.older:
                    self[k] = self.older[k]
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class ChunkCodec:
    """Encodes and decodes by a tokenizer file whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.words, self.chunks, self.joins = Held(WORDS), Held(CHUNKS), Held(CHUNKS)
        self.encoded = self.disagreed = 0

    def _by_library(self, parts: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), 4000):
            texts = [p.decode("utf-8", "replace") for p in parts[i : i + 4000]]
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """As ``_by_library``, for words without white space: a few are encoded as one text and told apart by their places."""
        out: list[bytes] = []
        groups = [[w.decode("utf-8", "replace") for w in words[i : i + 32]] for i in range(0, len(words), 32)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = accumulate((len(w) + 1 for w in group[:-1]), initial=0)
            cuts = [e.char_to_token(at) for at in starts]
            if None in cuts:
                out += self._by_library([w.encode() for w in group])
                continue
            raw = array("I", e.ids).tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
        return out

    def _pieces(self, chunks) -> dict[bytes, Piece]:
        """Each different chunk's piece, from the cache or encoded now: word by word, each new word by the library."""
        wanted = set(chunks)
        new = self.chunks.missing(wanted)
        split = [c.split() for c in new]
        words = self.words.missing(set(chain.from_iterable(split)))
        self.words.update(zip(words, self._words(words)))
        self.encoded += len(new)
        ids = self.words.__getitem__
        for c, w in zip(new, split):
            parts = list(map(ids, w))
            piece = Piece(b"".join(parts))
            if len(w) > 3:
                # Where words stand: each is found behind the one before it, or before the one behind it.
                second = c.index(w[1], c.index(w[0]) + len(w[0]))
                last = c.rindex(w[-1])
                before = c.rindex(w[-2], 0, last)
                n, a, d = len(piece.ids), len(parts[0]), len(parts[-1])
                piece.head = c[: second + len(w[1])], a, a + len(parts[1])
                piece.tail = c[before:], n - d - len(parts[-2]), n - d
            self.chunks[c] = piece
        out = {c: self.chunks[c] for c in wanted}
        for c in new:
            if len(c) > LONGEST_CACHED:
                del self.chunks[c]
        self.chunks.turn()
        self.words.turn()
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The IDs of each text, as bytes of little-endian unsigned 32-bit integers; null texts have none."""
        out: list[bytes] = []
        for _, _, buf, offs in text_slices(texts, SLICE):
            out += self._encode(*self._chunked(buf, offs))
        return out

    @staticmethod
    def _chunked(buf: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], list[list[bytes]]]:
        """Each row's text, and its chunks."""
        bounds, _ = cut_points(buf, offs)
        first, raw, at, rows = np.searchsorted(bounds, offs).tolist(), buf.tobytes(), bounds.tolist(), offs.tolist()
        return [raw[a:b] for a, b in zip(rows, rows[1:])], [[raw[at[j] : at[j + 1]] for j in range(a, b)] for a, b in zip(first, first[1:])]

    def _encode(self, texts: list[bytes], rows: list[list[bytes]]) -> list[bytes]:
        held = self._pieces(chain.from_iterable(rows))
        for i, row in enumerate(rows):
            if len(row) > 1 and any(held[c].head is None for c in row):
                rows[i] = self._stand(row, held)
        held.update(self._pieces({c for row in rows for c in row if c not in held}))
        joins = [[held[a].tail[0] + held[b].head[0] for a, b in zip(row, row[1:])] for row in rows]
        new = self.joins.missing(set(chain.from_iterable(joins)))
        self.joins.update(zip(new, self._by_library(new)))
        out = [self._assemble(text, [held[c] for c in row], [self.joins[j] for j in js]) for text, row, js in zip(texts, rows, joins)]
        self.joins.turn()
        return out

    @staticmethod
    def _stand(row: list[bytes], held: dict[bytes, Piece]) -> list[bytes]:
        """Chunks of fewer than four words become one with the next that has them; the last ones, with the one before."""
        out, run = [], []
        for c in row:
            run.append(c)
            if held[c].head is not None:
                out.append(b"".join(run))
                run = []
        if run:
            out[-1:] = [b"".join([*out[-1:], *run])]
        return out

    def _assemble(self, text: bytes, pieces: list[Piece], joins: list[bytes]) -> bytes:
        out, start = [], 0
        for p, q, fix in zip(pieces, pieces[1:], joins):
            (_, a, b), (_, c, d) = p.tail, q.head
            if len(fix) < b - a + d - c or not (fix.startswith(p.ids[a:b]) and fix.endswith(q.ids[c:d])):
                self.disagreed += 1
                return self._by_library([text])[0]
            out += [p.ids[start:a], fix]
            start = d
        return b"".join([*out, *(p.ids[start:] for p in pieces[-1:])])

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens with spaces between them."""
        return " ".join(map(self.names.__getitem__, ids))


def codec(path: str) -> ChunkCodec:
    """The worker's codec for this tokenizer file, built once."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def _near(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, near): documents with the same least chunk hash side by side; large groups are split."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = src.mapInArrow(_with_key, "doc_id long, text string, near long")
    return keyed.hint("rebalance", "near").sortWithinPartitions("near")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text, by the tokenizer file at ``path``, without special tokens added.

    Null and empty texts have no IDs, and so do texts of white space. Rows that
    repeat an id, and rows with a null id, stay rows of their own. Columns besides
    the two named are not read, whatever their names. An empty table gives an
    empty one. Special tokens that stand in a text are encoded as such.
    """

    def run(batches):
        own = codec(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _near(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): tokens with spaces between them, special ones included; null IDs give an empty text.

    An id that the vocabulary lacks is an error. Rows stay rows, whatever their id.
    """

    def run(batches):
        own = codec(path)
        for batch in batches:
            out = [own.decode(v.as_py() or []) for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the IDs, and digests both in one pass.

    Rows are as in ``encode``; a text without IDs has the digests of no bytes.
    """

    def run(batches):
        own = codec(path)
        for batch in batches:
            n, one, two = [], [], []
            for raw in own.encode(batch.column(1)):
                n.append(len(raw) // 4)
                one.append(hashlib.sha256(raw).hexdigest())
                two.append(hashlib.sha256(own.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _near(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
