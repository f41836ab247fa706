"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits a bounded sample along a random direction between two of its
points, drawn towards two means, at the median. A query walks all trees through one shared priority queue,
always taking the branch whose splits it violates least, until the leaves it
reached promise enough candidates. Equal vectors are one candidate that
carries its smallest ids, so a vector that a third of all rows share is stored
and compared once. Leaf candidates meet their queries in Spark, by (tree,
leaf, block), and are reranked by exact distances there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import keep

#: Rows that the trees are fitted to at most; every row is indexed.
FIT_ROWS = 20_000
TREES = 8
#: Sample rows in a leaf at most.
LEAF = 64
#: Share of the sample that the leaves of a query hold, and the least number of its rows.
SEARCH_SHARE, SEARCH_LEAST = 0.65, 2500
#: Vectors of a leaf that one task group holds.
BLOCK = 4000


@dataclass
class Tree:
    """Inner nodes: normal, offset and two children; a child below 0 is leaf -1 - child. ``sizes``: sample rows of the leaves."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    sizes: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        if not len(self.normal):
            return node
        live = np.arange(len(x))
        while len(live):
            n = node[live]
            side = (np.einsum("ij,ij->i", x[live], self.normal[n]) > self.offset[n]).astype(np.int64)
            node[live] = self.child[n, side]
            live = live[node[live] >= 0]
        return -1 - node


def grow_tree(x: np.ndarray, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    normal, offset, child, sizes = [], [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > LEAF:
            near = x[rng.choice(rows, min(len(rows), 256), replace=False)]
            a, b = near[0], near[1]
            for _ in range(6):
                side = ((near - a) ** 2).sum(axis=1) < ((near - b) ** 2).sum(axis=1)
                if side.all() or not side.any():
                    break
                a, b = near[side].mean(axis=0), near[~side].mean(axis=0)
            w = a - b
            p = x[rows] @ w
            cut = float(np.median(p))
            right = p > cut
            if right.any() and not right.all():
                i = len(normal)
                normal.append(w / max(float(np.linalg.norm(w)), 1e-30))
                offset.append(cut / max(float(np.linalg.norm(w)), 1e-30))
                child.append([0, 0])
                child[i][0] = split(rows[~right])
                child[i][1] = split(rows[right])
                return i
        sizes.append(len(rows))
        return -len(sizes)

    split(np.arange(len(x)))
    d = x.shape[1]
    return Tree(np.array(normal).reshape(-1, d), np.array(offset), np.array(child, np.int64).reshape(-1, 2), np.array(sizes))


def probe(trees: list[Tree], q: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of a priority queue shared by all trees, until their sample rows reach ``wanted``."""
    out, held = [], 0
    margins = [t.normal @ q - t.offset if len(t.normal) else np.zeros(0) for t in trees]
    queue = [(0.0, i, 0) for i, t in enumerate(trees) if len(t.normal)]
    for i, t in enumerate(trees):
        if not len(t.normal):
            out.append((i, 0))
            held += int(t.sizes[0])
    while queue and held < wanted:
        far, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, -1 - node))
            held += int(trees[i].sizes[-1 - node])
            continue
        m = float(margins[i][node])
        near = int(m > 0)
        heapq.heappush(queue, (far, i, int(trees[i].child[node, near])))
        heapq.heappush(queue, (max(far, abs(m)), i, int(trees[i].child[node, 1 - near])))
    return out


def _held_as(vectors: DataFrame, vec_col: str) -> str:
    """Floats stay floats in shuffles; everything else is held as doubles."""
    return "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a non-empty, finite, non-zero vector without nulls."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(_held_as(vectors, vec_col)).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest other rows found, by Euclidean distance.

    Queries are the rows for which ``is_query`` holds (SQL over vec_id);
    candidates are all rows but the query's own id. Ties go to the smaller id.
    Rows whose vectors are null, zero, or hold null or non-finite components
    take no part; vectors of different lengths are never near each other. A
    repeated id is one candidate per distinct vector. An empty table, or one
    without usable rows, gives no rows; other columns are ignored, whatever
    their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    dims = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    found = [_search(rows.where(F.size("v") == d), d, is_query, k) for d in sorted(dims)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _search(rows: DataFrame, dim: int, is_query: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    # Equal vectors: one candidate with its k + 1 smallest ids (one may be the query's own).
    by_id = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    distinct = keep(firsts.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("rep")))
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64(F.lit("forest"), "rep"), "rep").limit(FIT_ROWS).select("v").toArrow()["v"].combine_chunks()
    x = np.asarray(sample.flatten()).astype(np.float64).reshape(-1, dim)
    held = np.float32 if rows.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    trees = [grow_tree(x, seed) for seed in range(TREES)]
    forest = spark.sparkContext.broadcast(trees)
    blocks = max(1, -(-total * LEAF // (max(len(x), 1) * BLOCK)))
    wanted = max(SEARCH_LEAST, int(SEARCH_SHARE * len(x)))

    def index(batches):
        for b in batches:
            v = np.asarray(b.column(0).flatten()).reshape(-1, dim)
            wide = v.astype(np.float64)
            ids = np.asarray(b.column(2))
            for i, t in enumerate(forest.value):
                n = len(ids)
                yield pa.record_batch([pa.array(np.full(n, i, np.int32)), pa.array(t.leaves(wide).astype(np.int32)), pa.array((ids % blocks).astype(np.int32)), pa.array([x.tobytes() for x in v], pa.binary()), b.column(1), pa.nulls(n, pa.int64())], ["tree", "leaf", "block", "v", "ids", "query_id"])

    def ask(batches):
        for b in batches:
            v = np.asarray(b.column(1).flatten()).reshape(-1, dim)
            tree, leaf, block, raw, query = [], [], [], [], []
            for q, one in zip(b.column(0).to_pylist(), v):
                for i, at in probe(forest.value, one.astype(np.float64), wanted):
                    for c in range(blocks):
                        tree.append(i)
                        leaf.append(at)
                        block.append(c)
                        raw.append(one.tobytes())
                        query.append(q)
            n = len(query)
            yield pa.record_batch([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), pa.array(raw, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.array(query, pa.int64())], ["tree", "leaf", "block", "v", "ids", "query_id"])

    def rerank(table: pa.Table) -> pa.Table:
        """Exact distances between a leaf's vectors and its queries; each query's k nearest rows of the leaf."""
        is_query = np.asarray(table.column("query_id").is_valid())
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), held).astype(np.float64).reshape(-1, dim)
        member, query = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        ids = table.column("ids").to_pylist()
        names = table.column("query_id").to_pylist()
        q_out, v_out, s_out = [], [], []
        if len(member):
            for q in query:
                dist = np.sqrt(((v[member] - v[q]) ** 2).sum(axis=1))
                # A member gives one row at least, its own query's excepted: the k + 1 nearest members and all that tie are enough.
                if len(dist) > k + 1:
                    near = np.flatnonzero(dist <= np.partition(dist, k)[k])
                else:
                    near = np.arange(len(dist))
                best = sorted((dist[j], i) for j in near for i in ids[member[j]] if i != names[q])[:k]
                q_out += [names[q]] * len(best)
                v_out += [i for _, i in best]
                s_out += [float(s) for s, _ in best]
        return pa.table({"query_id": pa.array(q_out, pa.int64()), "vec_id": pa.array(v_out, pa.int64()), "score": pa.array(s_out, pa.float64())})

    schema = "tree int, leaf int, block int, v binary, ids array<long>, query_id long"
    members = distinct.select("v", "ids", "rep").mapInArrow(index, schema)
    queries = rows.where(is_query).distinct().select("vec_id", "v").mapInArrow(ask, schema)
    pairs = members.unionByName(queries).groupBy("tree", "leaf", "block").applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    nearest = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return nearest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
