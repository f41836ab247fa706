"""Toxicity by a linear-chain conditional random field over words.

Documents carry the labels, so tokens are labelled by distant supervision:
words and word beginnings that stand in toxic training documents far more
often than in clean ones mark the toxic tokens of toxic documents; all tokens
of clean documents are clean. The field learns a weight per word and word
beginning and a coupling of neighbouring tags. Forward-backward marginals tag
spans; a logistic curve over their sums gives the document's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, find_words, row_bounds, text_slices

#: Labelled rows that the field learns from at most: the bound of the fit.
FIT_ROWS = 20_000
#: Of these, the rows whose token sequences train the weights.
CHAIN_ROWS = 5_000
#: Features held at most, and the least number of documents of one.
FEATURES, LEAST_DOCS = 50_000, 4
#: Bytes of word beginnings that are features beside whole words.
HEADS = (4, 5, 6, 7, 8)
#: Words without features between two features that end a chain, and context kept around one.
CHAIN_GAP, CONTEXT = 12, 4
_BITS = 20


@dataclass
class Field:
    """Sorted feature hashes, their weights (and one 0 for none), the bias and the coupling; the curve of the score."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    coupling: float
    curve: tuple[float, float, float]

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.features >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the features; their number where it is none."""
        out = np.full(len(h), len(self.features), np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if len(maybe) and len(self.features):
            at = np.minimum(np.searchsorted(self.features, h[maybe]), len(self.features) - 1)
            out[maybe] = np.where(self.features[at] == h[maybe], at, len(self.features))
        return out


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _feature_columns(buf: np.ndarray, offs: np.ndarray):
    s, e, row, h, *heads = find_words(buf, offs, ALNUM, HEADS)
    return s, e, row, [h, *heads]


def _chains(known: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges (first, end) around known tokens, never across rows."""
    at = np.flatnonzero(known)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) > CHAIN_GAP) | (np.diff(row[at]) != 0)) + 1
    first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    n = int(row.max()) + 1
    bounds = row_bounds(row, n)
    return np.maximum(first - CONTEXT, bounds[row[first]]), np.minimum(last + CONTEXT + 1, bounds[row[last] + 1])


def marginals(emission: np.ndarray, first: np.ndarray, end: np.ndarray, coupling: float) -> tuple[np.ndarray, float]:
    """P(tag = 1) of the tokens of all chains in turn, and the expected number of neighbouring pairs of ones.

    Chains run side by side, the longest first, so that a step of the
    recursion is one array operation over the chains still running.
    """
    lens = end - first
    order = np.argsort(-lens, kind="stable")
    lens, first = lens[order], first[order]
    if not len(lens):
        return np.zeros(0), 0.0
    steps = int(lens[0])
    running = np.searchsorted(-lens, -np.arange(steps), "left")
    on, pair = np.exp(np.clip(emission, -30, 30)), np.exp(coupling)
    a0, a1 = [np.ones(running[0])], [on[first]]
    total = a0[0] + a1[0]
    a0[0], a1[0] = a0[0] / total, a1[0] / total
    for t in range(1, steps):
        m = running[t]
        p0, p1 = a0[t - 1][:m], a1[t - 1][:m]
        one = (p0 + p1 * pair) * on[first[:m] + t]
        total = (zero := p0 + p1) + one
        a0.append(zero / total)
        a1.append(one / total)
    p = np.empty(int(lens.sum()))
    place = np.cumsum(np.r_[0, lens[np.argsort(order)]])[:-1][order]  # where each chain's tokens go
    b0, b1 = np.ones(len(lens)), np.ones(len(lens))
    pairs = 0.0
    for t in range(steps - 1, -1, -1):
        m = running[t]
        g0, g1 = a0[t][:m] * b0[:m], a1[t][:m] * b1[:m]
        p[place[:m] + t] = g1 / (g0 + g1)
        if t:
            w = on[first[:m] + t] * b1[:m]
            p0, p1 = a0[t - 1][:m], a1[t - 1][:m]
            z = p0 * (b0[:m] + w) + p1 * (b0[:m] + pair * w)
            pairs += float((p1 * pair * w / z).sum())
            n0, n1 = b0[:m] + w, b0[:m] + pair * w
            norm = n0 + n1
            b0[:m], b1[:m] = n0 / norm, n1 / norm
    return p, pairs


def _counts(batches):
    """Per batch: (feature, toxic documents, clean documents)."""
    for batch in batches:
        label = np.asarray(batch.column(1).cast(pa.int64()))
        for lo, hi, buf, offs in text_slices(batch.column(0)):
            _, _, row, columns = _feature_columns(buf, offs)
            feature = np.concatenate(columns)
            rows = np.tile(row, len(columns))[feature != 0]
            feature = feature[feature != 0]
            order = np.lexsort((rows, feature))
            feature, rows = feature[order], rows[order]
            new = np.ones(len(feature), bool)
            new[1:] = (feature[1:] != feature[:-1]) | (rows[1:] != rows[:-1])
            f, y = feature[new], label[lo:hi][rows[new]]
            u, at = np.unique(f, return_inverse=True)
            toxic = np.bincount(at, weights=y, minlength=len(u)).astype(np.int64)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(u)).astype(np.int64) - toxic)], ["f", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Learns from at most ``FIT_ROWS`` labelled rows (docs: doc_id, text; labels: doc_id, toxic), drawn by a hash of the id.

    Of labels that contradict each other 1 counts; labels that are null or neither 0 nor 1, or whose
    document is missing, teach nothing, and documents that share an id each teach their id's label.
    Without labels of both kinds every text gets the same kind of score. Extra columns are ignored.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y"))
    chosen = chosen.withColumn("r", F.xxhash64(F.lit("toxic"), "doc_id")).orderBy("r", "doc_id").limit(FIT_ROWS)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "y")
    sums = rows.mapInArrow(_counts, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
    size = chosen.groupBy("y").count().toArrow().to_pydict()
    n = dict(zip(size["y"], size["count"]))
    n1, n0 = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    top = sums.withColumn("odds", odds).where(F.abs("odds") >= 1).orderBy(F.desc(F.abs(F.col("odds")) * F.sqrt(F.col("toxic") + F.col("clean"))), "f").limit(FEATURES).toArrow()
    f = top["f"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(f)
    odds_of = np.append(top["odds"].to_numpy()[order], 0.0)
    toxic_of = np.append(top["toxic"].to_numpy()[order], 0)
    field = Field(f[order], np.append(np.clip(odds_of[:-1], -2, 4) / 2, 0.0), -3.0, 0.0, (0.0, 0.0, -2.0))
    if not n1 or not n0:
        field.curve = (0.0, 0.0, 30.0 if n1 else -30.0)
        return field
    shared = spark.sparkContext.broadcast(field)

    def encoded(batches):
        own = shared.value
        for batch in batches:
            y = batch.column(1)
            for lo, hi, buf, offs in text_slices(batch.column(0)):
                _, _, row, columns = _feature_columns(buf, offs)
                ids = np.stack([own.lookup(c) for c in columns], axis=1).astype(np.int32)
                first, end = _chains((ids < len(own.features)).any(axis=1), row)
                at = np.searchsorted(row[first], np.arange(hi - lo + 1)) if len(first) else np.zeros(hi - lo + 1, np.int64)
                packed = [pa.scalar([ids[a:b].tobytes() for a, b in zip(first[at[i] : at[i + 1]], end[at[i] : at[i + 1]])], pa.list_(pa.binary())) for i in range(hi - lo)]
                yield pa.record_batch([pa.array([p.as_py() for p in packed], pa.list_(pa.binary())), y.slice(lo, hi - lo)], ["chains", "y"])

    few = chosen.orderBy("r", "doc_id").limit(CHAIN_ROWS)
    small = docs.join(F.broadcast(few), "doc_id").select("text", "y").mapInArrow(encoded, "chains array<binary>, y long").toArrow().to_pydict()
    chains, owner = [], []
    for d, doc in enumerate(small["chains"]):
        for c in doc:
            chains.append(np.frombuffer(c, np.int32).reshape(-1, 1 + len(HEADS)))
            owner.append(d)
    y = np.array(small["y"], float)
    if not chains:
        field.curve = (0.0, 0.0, float(np.log(n1 / n0)))
        return field
    ids = np.concatenate(chains).astype(np.int64)
    end = np.cumsum([len(c) for c in chains])
    first = np.r_[0, end[:-1]]
    doc = np.repeat(np.array(owner), [len(c) for c in chains])
    # Token labels: in toxic documents, tokens with a feature that is frequent there and rare elsewhere.
    strong = (odds_of >= 3) & (toxic_of >= LEAST_DOCS)
    tag = (strong[ids].any(axis=1) & (y[doc] == 1)).astype(float)
    _train(field, ids, first, end, tag)
    p, _ = marginals(_emission(field, ids), first, end, field.coupling)
    x = _summaries(p, doc, len(y))
    field.curve = _logistic(x, y)
    return field


def _emission(field: Field, ids: np.ndarray) -> np.ndarray:
    return field.weights[ids].sum(axis=1) + field.bias


def _train(field: Field, ids: np.ndarray, first: np.ndarray, end: np.ndarray, tag: np.ndarray, rounds: int = 60, rate: float = 0.1, shrink: float = 1e-3) -> None:
    """Gradient ascent (Adam) on the chains' conditional log-likelihood."""
    inside = np.ones(len(tag), bool)
    inside[first] = False
    pairs = float((tag[1:] * tag[:-1] * inside[1:]).sum())
    theta = np.r_[field.weights[:-1], field.bias, field.coupling]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(field.features)
    for step in range(1, rounds + 1):
        field.weights, field.bias, field.coupling = np.r_[theta[:k], 0.0], theta[k], theta[k + 1]
        p, expected = marginals(_emission(field, ids), first, end, field.coupling)
        miss = tag - p
        grad = np.r_[np.bincount(ids.ravel(), weights=np.repeat(miss, ids.shape[1]), minlength=k + 1)[:k], miss.sum(), pairs - expected] / max(tag.sum(), 1.0)
        grad -= shrink * np.r_[theta[:k], 0.0, theta[k + 1]]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights, field.bias, field.coupling = np.r_[theta[:k], 0.0], float(theta[k]), float(theta[k + 1])


def _summaries(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: log of the sum of clear marginals, and the largest one."""
    clear = np.where(p >= 0.1, p, 0.0)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.log1p(np.bincount(doc, weights=clear, minlength=n)), most, np.ones(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - q) - 0.1 * w
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hess, g)
    return tuple(float(v) for v in w)


def _scored(own: Field, texts: pa.Array):
    """(scores, spans) of runs of rows of a batch."""
    w = np.array(own.curve)
    for lo, hi, buf, offs in text_slices(texts):
        s, e, row, columns = _feature_columns(buf, offs)
        ids = np.stack([own.lookup(c) for c in columns], axis=1) if len(row) else np.zeros((0, 1), np.int64)
        first, end = _chains((ids < len(own.features)).any(axis=1), row)
        # Only the tokens of chains go on, in turn.
        lens = end - first
        at = np.r_[0, np.cumsum(lens)].astype(np.int64)
        tok = np.arange(at[-1]) + np.repeat(first - at[:-1], lens)
        p, _ = marginals(_emission(own, ids[tok]), at[:-1], at[1:], own.coupling)
        x = _summaries(p, row[tok], hi - lo)
        spans: list[list[dict]] = [[] for _ in range(hi - lo)]
        last = -2
        for i in np.flatnonzero(p >= 0.5).tolist():
            t = int(tok[i])
            r = int(row[t])
            first_byte = buf[offs[r] : offs[r + 1]] & 0xC0 != 0x80
            stop = int(np.count_nonzero(first_byte[: e[t] - offs[r]]))
            if spans[r] and t == last + 1:
                spans[r][-1]["end"], spans[r][-1]["p"] = stop, max(spans[r][-1]["p"], float(p[i]))
            else:
                spans[r].append({"start": int(np.count_nonzero(first_byte[: s[t] - offs[r]])), "end": stop, "p": float(p[i])})
            last = t
        yield 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), spans


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans array<struct<start, end, p>>) per row of ``docs``.

    Spans join neighbouring tokens of marginals of at least 0.5, in code
    points, end exclusive; p is the largest. Null and empty texts have no
    spans and the score of a text without any known feature. Null ids stay;
    rows that repeat an id each have their own row, equal texts equal scores,
    and texts of any length are read whole. An empty table gives no rows. Extra
    columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            at = 0
            for scores, spans in _scored(shared.value, batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(scores)), pa.array(scores), pa.array(spans, kind)], ["doc_id", "score", "spans"])
                at += len(scores)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, spans array<struct<start:bigint,end:bigint,p:double>>")


def keep_clean(docs: DataFrame, field: Field, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score less than ``below``.

    Each row is judged by its own text, null as an empty one; a score of just
    ``below`` goes. Repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    column = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = [s for part, _ in _scored(shared.value, batch.column(column).cast(pa.large_string())) for s in part]
            yield batch.filter(pa.array(np.array(scores) < below))

    return docs.mapInArrow(run, docs.schema)
