"""Hard negatives by bounds along spanning trees of anchors.

Anchors are dealt into blocks, and so are all rows; each pair of blocks is one
task's group. Within a group the anchors of the block form a minimum spanning
tree of Euclidean distances. The root is scored with every row; a score at a
parent, plus or minus the edge's length times the row's norm, bounds the score
at the child, and only rows whose bounds overlap what the child still looks for
are scored exactly. A row that was not scored hands its bounds on, widened by
the next edge.

Two passes: the first finds each anchor's positives, where a row is scored if
its upper bound reaches the k-th largest lower bound; the second its negatives,
where bounds must overlap the window of some positive. Each group keeps the best
rows of its block only, and the best of all blocks are chosen afterwards, so a
result is exact whatever the blocks are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import keep_table

#: Rows and anchors of a block on average.
ROWS, ANCHORS = 1024, 512
#: Beyond this norm a product may leave 64 bits.
MOST_NORM = 2.0**31
_EXACT = 2.0**53


def usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, v array<long>): distinct rows with an id, a label, and a non-empty vector of integers without nulls.

    Vectors whose norm is 2**31 or more take no part: their scores can leave 64 bits.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()) & (norm2 < MOST_NORM**2)
    return v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("v", F.col("v").cast("array<long>"))


def spanning_tree(v: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, length of the edge) from the root on, parents first: a minimum spanning tree by Prim's algorithm; the root's parent is -1."""
    n = len(v)
    sq = np.einsum("ij,ij->i", v, v)
    best, parent, out = np.full(n, np.inf), np.full(n, -1), []
    inside, at = np.zeros(n, bool), 0
    for _ in range(n):
        inside[at] = True
        d = np.sqrt(np.maximum(sq + sq[at] - 2 * (v @ v[at]), 0))
        nearer = (d < best) & ~inside
        best[nearer], parent[nearer] = d[nearer], at
        out.append((at, int(parent[at]), 0.0))
        best[at] = np.inf
        if len(out) < n:
            at = int(np.argmin(np.where(inside, np.inf, best)))
    # Lengths anew, by difference: the expanded form above loses digits.
    return [(a, p, float(np.sqrt(((v[a] - v[p]) ** 2).sum())) if p >= 0 else 0.0) for a, p, _ in out]


class Block:
    """Rows of one block, their norms, and how many scores were worked out."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.wide = v.astype(np.float64)
        self.norm = np.sqrt((self.wide**2).sum(axis=1))
        self.scored = 0

    def exact(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products as integers: by doubles where no sum can pass 2**53, else by 64-bit integers."""
        far = float(np.sqrt((anchor.astype(np.float64) ** 2).sum())) * float(self.norm.max(initial=0.0))
        return (self.wide[rows] @ anchor.astype(np.float64)).astype(np.int64) if far < _EXACT else self.v[rows] @ anchor

    def walk(self, anchors: np.ndarray, wanted):
        """For each anchor, tree order: (anchor's index, rows scored, their exact scores).

        ``wanted(i, low, high)`` names the rows whose bounds overlap what anchor
        ``i`` looks for; ``low`` and ``high`` hold every row's bounds.
        """
        tree = spanning_tree(anchors.astype(np.float64))
        children = np.bincount([p for _, p, _ in tree if p >= 0], minlength=len(anchors))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, parent, length in tree:
            if parent < 0:
                rows = np.arange(len(self.ids))
                low = high = np.zeros(len(rows))
            else:
                # A little wider than the edge, for what doubles lose.
                low, high = held[parent]
                reach = length * self.norm * (1 + 1e-9) + 1e-9 * (np.abs(low) + np.abs(high)) + 1
                low, high = low - reach, high + reach
                rows = wanted(i, low, high)
            scores = self.exact(rows, anchors[i])
            self.scored += len(rows)
            if parent >= 0:
                children[parent] -= 1
                if not children[parent]:
                    del held[parent]
            if children[i]:
                low, high = low.copy(), high.copy()
                low[rows] = high[rows] = scores.astype(np.float64)
                held[i] = low, high
            yield i, rows, scores


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the first ``k`` are, by score from the highest, then by id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _block(table: pa.Table, dim: int) -> Block:
    v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
    return Block(np.asarray(table.column("vec_id")), np.asarray(table.column("label")), v)


def mine(
    vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "v",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    ``vectors`` holds vectors of integers; a score is the inner product with the
    anchor, higher ones first, ties by smaller id. Anchors are the rows for which
    ``is_anchor`` holds (SQL over vec_id). Positives are an anchor's first other
    rows of its label; negatives of a positive are the first rows of other labels
    with ``least * positive_score <= 100 * negative_score <= most * positive_score``.
    Where there are fewer, all are given; an anchor without positives, and a
    positive without negatives, give no row. A negative or zero positive score has
    the window that the formula says, which for negative ones is empty.

    Rows with a null id, label, vector or component take no part, nor do empty
    vectors or those of norm 2**31 and more. Vectors of different lengths have no
    score. Equal rows count once; different rows that share an id are candidates
    each, but none of an anchor of that id. Columns besides the three named are
    not read, whatever their names. An empty table gives an empty result.
    """
    rows = keep_table(usable(vectors, id_col, label_col, vec_col).distinct())
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.expr(is_anchor)).alias("a")).collect()
    parts = [_mine(rows.where(F.size("v") == r["d"]), r["d"], r["n"], r["a"], is_anchor, positives, negatives, least, most) for r in sorted(sizes) if r["a"]]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _mine(rows: DataFrame, dim: int, n: int, n_anchors: int, is_anchor: str, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    row_blocks, anchor_blocks = max(1, -(-n // ROWS)), max(1, -(-n_anchors // ANCHORS))
    deal = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "label", "v"), F.lit(k)).cast("int")
    by_row = rows.select("vec_id", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ab"), deal(1, row_blocks).alias("rb"))
    own = (F.col(c).alias(c) for c in ("vec_id", "label", "v"))  # columns of their own, so that the two sides can meet
    anchors = rows.where(is_anchor).select(*own, deal(2, anchor_blocks).alias("ab"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def positives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            block, a, keys = _block(left, dim), _block(right, dim), np.asarray(right.column("key"))
            others = lambda i, at: (block.labels[at] == a.labels[i]) & (block.ids[at] != a.ids[i])

            def wanted(i, low, high):
                own = np.flatnonzero(others(i, slice(None)))
                if len(own) > positives:
                    own = own[high[own] >= np.partition(low[own], len(own) - positives)[len(own) - positives]]
                return own

            for i, scored, scores in block.walk(a.v, wanted):
                at = others(i, scored)
                ids, scores = block.ids[scored[at]], scores[at]
                best = first(ids, scores, positives)
                out[0] += [int(a.ids[i])] * len(best)
                out[1] += [int(keys[i])] * len(best)
                out[2] += ids[best].tolist()
                out[3] += scores[best].tolist()
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("anchor_id", "key", "positive_id", "positive_score"), out)})

    def negatives_of(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if left.num_rows and right.num_rows:
            block, a, keys = _block(left, dim), _block(right, dim), np.asarray(right.column("key"))
            others = lambda i, at: (block.labels[at] != a.labels[i]) & (block.ids[at] != a.ids[i])
            # Windows of scores, in integers: ceil(least * p / 100) to floor(most * p / 100).
            windows = [[(p["positive_id"], s := p["positive_score"], -(-least * s // 100), most * s // 100) for p in f] for f in right.column("found").to_pylist()]

            def wanted(i, low, high):
                other = np.flatnonzero(others(i, slice(None)))
                need, lo, hi = np.zeros(len(other), bool), low[other], high[other]
                for _, _, w0, w1 in windows[i]:
                    over = (hi >= w0) & (lo <= w1)
                    sure = lo[(lo >= w0) & (hi <= w1)]
                    if len(sure) >= negatives:
                        over &= hi >= np.partition(sure, len(sure) - negatives)[len(sure) - negatives]
                    need |= over
                return other[need]

            for i, scored, scores in block.walk(a.v, wanted):
                at = others(i, scored)
                ids, scores = block.ids[scored[at]], scores[at]
                for positive, score, w0, w1 in windows[i]:
                    inside = np.flatnonzero((scores >= w0) & (scores <= w1))
                    best = inside[first(ids[inside], scores[inside], negatives)]
                    for held, x in zip(out, (int(a.ids[i]), int(keys[i]), positive, score)):
                        held += [x] * len(best)
                    out[4] += ids[best].tolist()
                    out[5] += scores[best].tolist()
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("anchor_id", "key", "positive_id", "positive_score", "negative_id", "negative_score"), out)})

    # Where ids repeat, an anchor is told apart by its whole row.
    anchors = anchors.withColumn("key", F.xxhash64("vec_id", "label", "v"))
    pairs = by_row.groupBy("ab", "rb").cogroup(anchors.groupBy("ab", "rb"))
    near = pairs.applyInArrow(positives_of, "anchor_id long, key long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    found = keep_table(chosen.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("found")))
    pairs = by_row.groupBy("ab", "rb").cogroup(anchors.join(found, ["vec_id", "key"]).groupBy("ab", "rb"))
    far = pairs.applyInArrow(negatives_of, "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    best = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
