"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut at single spaces between characters that are no white space:
a match of the pattern never crosses such a place, so the chunks are encoded
on their own and a chunk seen before comes from a bounded cache. Each ID stands
for bytes; the byte-to-character mapping of byte-level vocabularies is undone
by a table, and offsets of IDs that hold only part of a character cover that
whole character.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks in a generation of the cache of a Python worker; two generations are held.
CACHED = 350_000
#: Longer chunks are encoded without being held.
LONGEST_CACHED = 64
_CUT = re.compile(r"(?<=\S) (?=\S)")
_codecs: dict[str, "ByteLevelCodec"] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteLevelCodec:
    """Encodes and decodes by a rank file (base64 token, rank): ranks are IDs, and merge order."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        chars = byte_characters()
        as_chars = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [pair for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (pair := self._parts(t, ranks))]
        vocab = {as_chars[t]: r for t, r in ranks.items()}
        self.tokenizer = Tokenizer(BPE(vocab, [(as_chars[a], as_chars[b]) for a, b in merges], ignore_merges=True))
        self.tokenizer.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for t, r in ranks.items():
            self.bytes[r] = t
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.ints = list(range(size))  # one object per ID, shared by all cached chunks
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one: merge its bytes by all lower ranks."""
        own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= own:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """The text, cut before each single space between characters that are no white space."""
        if not text:
            return []
        words = text.split()
        # With all white space in runs of one, every space is such a place.
        parts = text.split(" ") if len(text) == sum(map(len, words)) + len(words) - 1 else _CUT.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """IDs of each text, without special tokens."""
        chunked = [self._chunks(t) for t in texts]
        recent, older = self.recent, self.older
        wanted = set(chain.from_iterable(chunked))
        missing = [c for c in wanted if c not in recent]
        brief: list[str] = []
        new = []
        for c in missing:
            if c in older:
                recent[c] = older[c]
            else:
                new.append(c)
        for chunk, ids in self._encode_new(new):
            recent[chunk] = ids
            if len(chunk) > LONGEST_CACHED:
                brief.append(chunk)
        out = [list(chain.from_iterable(map(recent.__getitem__, chunks))) for chunks in chunked]
        for c in brief:
            del recent[c]
        if len(recent) > CACHED:
            self.recent, self.older = {}, recent
        return out

    def _encode_new(self, chunks: list[str]):
        """(chunk, IDs). Chunks that open with the space of a cut and end in no white space are encoded side by side."""
        beside, alone, ints = [], [], self.ints
        for c in chunks:
            (beside if c[0] == " " and not c[-1].isspace() else alone).append(c)
        for c, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            yield c, tuple(ints[i] for i in e.ids)
        for i in range(0, len(beside), 2000):
            part = beside[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode("".join(part), add_special_tokens=False).ids, np.int64)
            ends = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part]), "left") + 1
            flat, a = [ints[i] for i in ids.tolist()], 0
            for c, b in zip(part, cuts.tolist()):
                yield c, tuple(flat[a:b])
                a = b

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that the IDs stand for; characters split over IDs come together again."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """(start, end) in characters of each ID; one that holds part of a character covers all of it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        first = (raw & 0xC0) != 0x80
        char = np.cumsum(first) - 1
        ends = np.cumsum(self.lengths[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        starts = ends - (self.lengths[np.asarray(ids, np.int64)] if ids else 0)
        return [(int(char[s]), int(char[e - 1]) + 1) for s, e in zip(starts, ends)]


def codec(ranks_path: str, pattern: str) -> ByteLevelCodec:
    """The worker's codec for these ranks, built once."""
    key = json.dumps([ranks_path, pattern])
    if key not in _codecs:
        _codecs[key] = ByteLevelCodec(ranks_path, pattern)
    return _codecs[key]


def _rows(column: pa.Array, most: int = 1 << 21):
    """Runs of rows whose texts hold about ``most`` characters; null texts are empty."""
    part, held = [], 0
    for v in column:
        t = v.as_py() or ""
        part.append(t)
        held += len(t)
        if held > most:
            yield part
            part, held = [], 0
    yield part


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, offsets array<struct<start, end>> or null), one row per row of ``docs``.

    A null or empty text has no IDs. Null ids and repeated rows are kept, each with its own result; long texts are
    encoded whole; an empty table gives no rows; other columns are ignored, whatever their names. There are no ties.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            at = 0
            for texts in _rows(batch.column(1)):
                ids = own.encode(texts)
                offs = [[{"start": s, "end": e} for s, e in own.offsets(t, i)] for t, i in zip(texts, ids)] if with_offsets else [None] * len(ids)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(offs, kind)], ["doc_id", "ids", "offsets"])
                at += len(texts)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, offsets array<struct<start:int,end:int>>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), row by row; null IDs give an empty text, broken characters U+FFFD.

    Null and repeated ids are kept, an empty table gives no rows, and other columns (a ``text`` among them) are ignored.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            out = [own.decode_bytes(v.as_py() or []).decode("utf-8", "replace") for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the IDs, and digests both in one pass.

    Odd rows are treated as ``encode`` does; a text without IDs has the digests of an empty text.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        names = [str(i) for i in range(len(own.bytes))]
        for batch in batches:
            n, one, two = [], [], []
            for texts in _rows(batch.column(1)):
                for ids in own.encode(texts):
                    n.append(len(ids))
                    one.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    two.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
