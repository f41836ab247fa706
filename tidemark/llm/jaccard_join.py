"""N-gram Jaccard join by T-occurrence search, exact, with connected groups.

1. All shingles are ordered from rare to common. Tasks send sorted, packed runs
   of (shingle, set) to ranges of the hash space, where each shingle's sets are
   counted; a shingle of one set says nothing and ends there. Shingles that are
   frequent in any large run of documents are found first, count as the most
   common ones, and are not gathered.
2. A set's prefix is its rarest shingles, so many that two sets near enough
   share one there. A set whose prefix holds only shingles of its own links with
   nothing. The others' prefixes go to inverted lists.
3. Short lists give their pairs; a pair goes on where the prefixes share as many
   as the overlap still needs. Long lists give a chain through their sets by
   size, which holds together whatever can link in them. Both together make
   candidate clusters, each in one task, or in blocks where it is large.
4. Each cluster is searched by DivideSkip: a set's short inverted lists are merged by
   counting, its long ones are probed by binary search for the sets still able
   to reach the overlap. Sets already in one component are not compared again.

No texts, pairs of copies or lists come to the driver; a shingle's or group's
rows are never gathered in one task beyond a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NON_SPACE, find_words, gram_hashes, keep, keep_table, mix, row_bounds, text_slices
from tidemark.llm.components import components

#: Sets, and members of sets, in a block of a large cluster; sets of the cluster that all its blocks share.
BLOCK, BLOCK_MEMBERS, PIVOTS = 1024, 4_000_000, 256
#: Inverted lists of shingles of up to this many sets are short.
SHORT = 16
#: Shingles that a task packs together, and that are counted together, on average.
CHUNK, PART = 3_000_000, 3_000_000
#: Share of the documents of a chunk that makes a shingle frequent, and how many such shingles are sent to
#: all tasks. Any order of shingles gives the same links; more of them only save work.
HOT_SHARE, HOT_LISTED = 1 / 500, 200_000
#: Bits of a shingle's hash in its rank; the bits above say how common it is.
RANK_BITS = 48


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): k-word shingles, or the whole sequence of fewer words, or nothing."""
    for lo, hi, buf, offs in text_slices(texts):
        _, _, row, h = find_words(buf, offs, NON_SPACE)
        at = row_bounds(row, hi - lo)
        grams = gram_hashes(h, k)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield lo + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield lo + i, gram_hashes(h[a:b], int(b - a))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def set_hash(shingles: np.ndarray) -> int:
    """An order-free 64-bit hash of a set, as a signed integer."""
    total = int(np.sum(mix(shingles ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)) + len(shingles) * 0x2545F4914F6CDD1D
    return int(np.array(total & ((1 << 64) - 1), np.uint64).view(np.int64))


def commonness(sets: np.ndarray) -> np.ndarray:
    """The class of a shingle that so many sets hold: 8 at two sets, and 8 more at each doubling; 255 is left for the frequent ones."""
    return np.minimum(254, 8 * np.log2(sets)).astype(np.uint64)


def squeeze(a: np.ndarray) -> bytes:
    """Integers packed byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unsqueeze(packed: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def unsqueeze_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(packed, np.uint64), dtype=np.uint64)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All indices of the runs that begin at ``starts``."""
    return np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(starts, lens)


def needed(percent: int, a, b):
    """The overlap that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


# --- 1: the order of shingles -------------------------------------------------------------------


def _profile(k: int, chunk: int):
    """Each document's set size and hash; shingles frequent within a chunk with their counts."""
    fields = ["doc_id", "node", "n", "g", "cnt"]

    def common(seen: list[np.ndarray]) -> pa.RecordBatch:
        g, c = np.unique(np.concatenate(seen), return_counts=True)
        often = c >= max(3, HOT_SHARE * len(seen))
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.record_batch([none, none, none, pa.array(g[often].view(np.int64)), pa.array(c[often].astype(np.int64))], fields)

    def run(batches):
        seen, held = [], 0
        for batch in batches:
            nodes, sizes = [], []
            for _, s in shingle_sets(batch.column(1), k):
                nodes.append(set_hash(s) if len(s) else None)
                sizes.append(len(s))
                seen.append(s)
                held += len(s)
                if held > chunk:
                    yield common(seen)
                    seen, held = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none, none], fields)
        if seen:
            yield common(seen)

    return run


def _packed(k: int, parts: int, chunk: int, hot_shared):
    """Packed runs of (shingle, set): each chunk's, by range of the shingle; those of frequent shingles by set."""
    fields = ["part", "frequent", "nodes", "sizes", "grams", "owners"]

    def packed(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        hot = hot_shared.value
        node, size = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.uint32)
        gram, own = np.concatenate(list(sets.values())), np.repeat(np.arange(len(node), dtype=np.uint32), size)
        often = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram if len(hot) else np.zeros(len(gram), bool)
        rows: list[tuple] = []
        for frequent in (False, True):
            g, o = gram[often == frequent], own[often == frequent]
            by = mix(node.view(np.uint64))[o] if frequent else g
            part = ((by >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.lexsort((g, part)) if frequent else np.argsort(g)
            g, o, part = g[order] >> np.uint64(64 - RANK_BITS), o[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                if a < b:
                    here, at = np.unique(o[a:b], return_inverse=True)
                    rows.append((int(part[a]), frequent, node[here].tobytes(), squeeze(size[here]), squeeze_sorted(g[a:b]), squeeze(at.astype(np.uint32))))
        columns = list(zip(*rows))
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in columns[2:])], fields)

    def run(batches):
        sets, held = {}, 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(1), k):
                if len(s) and (node := set_hash(s)) not in sets:
                    sets[node] = s
                    held += len(s)
                    if held > chunk:
                        yield packed(sets)
                        sets, held = {}, 0
        if sets:
            yield packed(sets)

    return run


def _tally(table: pa.Table) -> pa.Table:
    """One range of shingles: (node, n, rank) of those that several sets hold, and of the frequent ones."""
    nodes, sizes, grams, passed = [], [], [], []
    for frequent, node, size, gram, own in zip(*(table.column(c).to_pylist() for c in ("frequent", "nodes", "sizes", "grams", "owners"))):
        at, ranks = unsqueeze(own, np.uint32), unsqueeze_sorted(gram)
        entries = np.frombuffer(node, np.int64)[at], unsqueeze(size, np.uint32)[at], ranks
        if frequent:
            passed.append((entries[0], entries[1], ranks | np.uint64(255 << RANK_BITS)))
        else:
            for x, y in zip((nodes, sizes, grams), entries):
                x.append(y)
    if grams:
        node, size, gram = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(grams)
        order = np.argsort(gram)
        same = np.diff(gram[order]) == 0
        several = order[np.append(same, False) | np.append(False, same)]
        several = several[np.lexsort((node[several], gram[several]))]
        node, size, gram = node[several], size[several], gram[several]
        new = np.append(True, (np.diff(gram) != 0) | (np.diff(node) != 0))[: len(gram)]  # tasks that met copies of one set
        node, size, gram = node[new], size[new], gram[new]
        first = np.flatnonzero(np.append(True, np.diff(gram) != 0)[: len(gram)])
        held = np.diff(np.append(first, len(gram)))
        held = np.repeat(held, held)
        passed.append((node[held > 1], size[held > 1], gram[held > 1] | commonness(held[held > 1]) << np.uint64(RANK_BITS)))
    node, size, rank = (np.concatenate(x) for x in zip(*passed)) if passed else (np.zeros(0, np.int64),) * 3
    return pa.table({"node": node, "n": size.astype(np.int64), "rank": rank.view(np.int64)})


# --- 2: prefixes --------------------------------------------------------------------------------


def _whole_groups(batches, key: int):
    """Columns of sorted batches, cut where column ``key`` changes."""
    held = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        cut = int(np.searchsorted(cols[key], cols[key][-1]))
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None:
        yield held


def _surviving(percent: int):
    """Rows sorted by (node, rank): the sets that may link, with their shared shingles, and how many of these their prefixes hold."""

    def run(batches):
        for node, n, rank in _whole_groups(batches, 0):
            new = np.append(True, (np.diff(node) != 0) | (np.diff(rank) != 0))
            node, n, rank = node[new], n[new], rank[new]
            first = np.flatnonzero(np.append(True, np.diff(node) != 0))
            shared = np.diff(np.append(first, len(node)))
            size = n[first]
            # The prefix begins with the shingles that no other set holds.
            m = shared + 1 - -(-percent * size // 100)
            some = np.flatnonzero(m > 0)
            packed = [squeeze_sorted(rank[first[i] : first[i] + shared[i]].view(np.uint64)) for i in some]
            yield pa.record_batch([pa.array(node[first[some]]), pa.array(size[some]), pa.array(m[some]), pa.array(packed, pa.binary())], ["node", "n", "m", "ranks"])

    return run


def _postings(batches):
    """The inverted lists' rows: each rank of a set's prefix, with the set's size and the last rank of its prefix."""
    for batch in batches:
        if batch.num_rows:
            node, n, m = (np.asarray(batch.column(c)) for c in range(3))
            heads = [unsqueeze_sorted(r.as_py())[:k].view(np.int64) for r, k in zip(batch.column(3), m)]
            yield pa.record_batch([np.concatenate(heads), np.repeat(node, m), np.repeat(n, m), np.repeat([h[-1] for h in heads], m)], ["rank", "node", "n", "last"])


# --- 3: candidate clusters ----------------------------------------------------------------------


def _short_pairs(percent: int):
    """Lists sorted by (rank, n, node): pairs near enough in size, how often they met here, and how often they must meet in prefixes."""

    def run(batches):
        for rank, node, n, last in _whole_groups(batches, 0):
            found = []
            i, d = np.arange(len(rank)), 1
            while len(i):
                i = i[i + d < len(rank)]
                i = i[rank[i] == rank[i + d]]
                x = i[n[i] * 100 >= percent * n[i + d]]
                y = x + d
                # Whatever they share beyond a prefix lies beyond the one that ends first.
                rest = np.where(last[x] < last[y], n[x], n[y])
                rest = np.where(last[x] == last[y], np.minimum(n[x], n[y]), rest)
                must = needed(percent, n[x], n[y]) - (-(-percent * rest // 100) - 1)
                found.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), must]))
                d += 1
            pairs, met = np.unique(np.concatenate([*found, np.zeros((3, 0), np.int64)], axis=1), axis=1, return_counts=True)
            yield pa.record_batch([*pairs, met.astype(np.int64)], ["a", "b", "must", "met"])

    return run


def _chains(percent: int):
    """Lists sorted by (rank, n, node): neighbours near enough in size; a partition's first and last row, where lists may go on."""
    fields = ["a", "b", "rank", "node", "n"]

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, node, n = (np.asarray(batch.column(c)) for c in range(3))
            if last is None:
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, rank[:1], node[:1], n[:1]], fields)
            else:
                rank, node, n = (np.append(x, y) for x, y in zip(last, (rank, node, n)))
            near = (rank[1:] == rank[:-1]) & (n[:-1] * 100 >= percent * n[1:]) & (node[1:] != node[:-1])
            a, b = node[:-1][near], node[1:][near]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.record_batch([*pairs, none, none, none], fields)
            last = rank[-1:], node[-1:], n[-1:]
        if last is not None:
            none = pa.nulls(1, pa.int64())
            yield pa.record_batch([none, none, *last], fields)

    return run


def _candidates(postings: DataFrame, percent: int, short: int) -> DataFrame:
    """(a, b): whatever two sets may link, a path of these joins them."""
    limit = F.lit(int(commonness(np.array([short]))[0]) + 1 << RANK_BITS)
    lists = postings.where(F.col("rank") < limit).repartition("rank").sortWithinPartitions("rank", "n", "node")
    met = lists.mapInArrow(_short_pairs(percent), "a long, b long, must long, met long")
    pairs = met.groupBy("a", "b").agg(F.min("must").alias("must"), F.sum("met").alias("met")).where("met >= must")
    order = ["rank", "n", "node"]
    chained = postings.where(F.col("rank") >= limit).select("rank", "node", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    chains = keep_table(chained.mapInArrow(_chains(percent), "a long, b long, rank long, node long, n long"))
    # Two rows of each partition.
    ends = chains.where("rank is not null").select("rank", "n", "node").distinct()
    before = {c: F.lag(c).over(Window.orderBy(*order)).alias(f"{c}_before") for c in order}
    over = ends.select(*order, *before.values()).where(f"rank = rank_before and n_before * 100 >= {percent} * n").select(F.least("node", "node_before").alias("a"), F.greatest("node", "node_before").alias("b"))
    return pairs.select("a", "b").union(chains.where("a is not null").select("a", "b")).union(over).distinct()


# --- 4: search ----------------------------------------------------------------------------------


def long_lists(lens: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The lists that are probed: the longest ones, up to half the least overlap asked for."""
    longs = np.argsort(-lens, kind="stable")[: int(need.min()) // 2 if len(need) else 0]
    return longs[lens[longs] > max(4, len(need) // 2)]


def divide_skip(lists: list[np.ndarray] | tuple[np.ndarray, np.ndarray, np.ndarray], alive: np.ndarray, need: np.ndarray, n_sets: int) -> np.ndarray:
    """Which of the sets ``alive`` (ascending) stand in ``need`` or more of the lists.

    ``lists``: members of all lists one after another, and where these lists
    begin and how long they are. The short lists are merged by counting; the
    long ones are probed for the sets that could still reach their need.
    """
    member, starts, lens = lists
    longs = long_lists(lens, need)
    short = np.ones(len(lens), bool)
    short[longs] = False
    count = np.bincount(member[spread(starts[short], lens[short])], minlength=n_sets)[alive]
    left = np.flatnonzero(count >= need - len(longs))
    for done, j in enumerate(longs):
        own = member[starts[j] : starts[j] + lens[j]]
        count[left] += own[np.minimum(np.searchsorted(own, alive[left]), len(own) - 1)] == alive[left]
        left = left[count[left] >= need[left] - (len(longs) - done - 1)]
        if not len(left):
            break
    return alive[left]


def search_block(sets: list[np.ndarray], sizes: np.ndarray, comp: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components ``comp`` of these sets, as many as join them; with ``side``, only of sets of different sides.

    ``sets``: the shingles that matter, sorted; ``sizes``: of the whole sets.
    """
    order = np.argsort(sizes, kind="stable")
    sets, sizes, (_, label) = [sets[i] for i in order], sizes[order], np.unique(comp[order], return_inverse=True)
    side = None if side is None else side[order]
    held = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    listed = np.argsort(at, kind="stable")
    member = np.repeat(np.arange(len(sets)), held)[listed]
    ends = np.searchsorted(at[listed], np.arange(at.max() + 2))
    begin = np.cumsum(held) - held
    out = []
    for q in range(len(sets)):
        # Sets by size: the others this one may link with are those after it, up to a size.
        until = int(np.searchsorted(sizes, sizes[q] * 100 // percent, "right"))
        alive = q + 1 + np.flatnonzero(label[q + 1 : until] != label[q])
        if side is not None:
            alive = alive[side[alive] != side[q]]
        if not len(alive):
            continue
        own = at[begin[q] : begin[q] + held[q]]
        for j in divide_skip((member, ends[own], ends[own + 1] - ends[own]), alive, needed(percent, sizes[q], sizes[alive]), len(sets)):
            if label[j] != label[q]:
                out.append((int(order[q]), int(order[j])))
                label[label == label[j]] = label[q]
    return out


def _search(percent: int):
    """Rows sorted by key: links of each key's sets that join different components; sides, if not null, are searched against each other."""

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        node, comp, side, n, ranks = zip(*rows)
        sides = None if side[0] is None else np.array(side)
        found = search_block([unsqueeze_sorted(r) for r in ranks], np.array(n), np.array(comp), percent, sides)
        return pa.record_batch([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], ["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != key:
                    yield linked(rows)
                    rows = []
                key = row[0]
                rows.append(row[1:])
        if rows:
            yield linked(rows)

    return run


def _links(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links within each key of ``named`` (key, node, comp, side)."""
    rows = named.join(sets.select("node", "n", "ranks"), "node").select("key", "node", "comp", "side", "n", "ranks")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_search(percent), "a long, b long")


def _dealt(clusters: DataFrame, sets: DataFrame, block: int, pivots: int) -> DataFrame:
    """(key, node, comp, side, cluster, blocks): each cluster's sets by block; some sets of a large cluster stand in all its blocks."""
    sized = clusters.join(sets.select("node", "n"), "node")
    per = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_MEMBERS)).alias("blocks"))
    own = F.array(F.pmod(F.xxhash64("node"), "blocks"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.col("m")) < pivots)
    blk = F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own))
    return clusters.join(per, "cluster").select("node", "cluster", "blocks", blk.alias("blk")).select(F.xxhash64("cluster", "blk").alias("key"), "node", F.col("node").alias("comp"), F.lit(None).cast("int").alias("side"), "cluster", "blocks")


def _between(open_lists: DataFrame, block: int) -> DataFrame:
    """(key, node, comp, side): pairs of blocks of what meets in lists that still hold several components.

    Components that share lists, over any number of steps, form a cluster. Its
    sets are dealt into blocks, large components into blocks of their own, and
    every two blocks that do not belong to one component make a key.
    """
    lead = open_lists.groupBy("rank").agg(F.min("comp").alias("a"))
    clusters = components(open_lists.join(lead, "rank").select("a", F.col("comp").alias("b")).where("a != b").distinct())
    members = keep(open_lists.select("node", "comp").distinct().join(clusters.select(F.col("node").alias("comp"), F.col("comp").alias("cluster")), "comp"))
    size = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m")).withColumn("big", F.col("m") > block)
    pool = size.where("not big").groupBy("cluster").agg(F.sum("m").alias("pool"))
    dealt = members.join(size, ["cluster", "comp"]).join(pool, "cluster", "left")
    own = F.concat(F.lit("c"), F.col("comp"), F.lit(":"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / block)))
    shared = F.concat(F.lit("p"), F.pmod(F.xxhash64("comp"), F.ceil(F.col("pool") / block)))
    dealt = keep(dealt.select("node", "comp", "cluster", F.when(F.col("big"), own).otherwise(shared).alias("blk"), F.when(F.col("big"), F.col("comp")).alias("of")))
    blocks = dealt.select("cluster", "blk", "of").distinct()
    other = blocks.select("cluster", F.col("blk").alias("blk2"), F.col("of").alias("of2"))
    both = blocks.join(other, "cluster").where("blk <= blk2 and not coalesce(of = of2, false)").select("cluster", "blk", "blk2", F.xxhash64("cluster", "blk", "blk2").alias("key"))
    within = both.where("blk = blk2").select("cluster", "blk", "key", F.lit(None).cast("int").alias("side"))
    across = both.where("blk < blk2")
    sides = within.union(across.select("cluster", "blk", "key", F.lit(0))).union(across.select("cluster", "blk2", "key", F.lit(1)))
    return dealt.join(sides, ["cluster", "blk"]).select("key", "node", "comp", "side")


def _open_lists(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(rank, node, comp) of the lists that still hold several components."""
    labelled = postings.select("rank", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = labelled.groupBy("rank").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("rank")
    return labelled.join(several, "rank", "left_semi")


def _has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK, pivots: int = PIVOTS, short: int = SHORT, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of
    their sets of ``k``-word shingles; component_id is the smallest id that
    links reach, the row's own included. Null or empty texts have an empty set
    and link with nothing; rows with a null id keep a null component and link
    with nothing. Rows that repeat an id take part with each of their texts
    and share that id's component. Ties cannot arise; an empty table gives no
    rows; texts of any length take part whole; extra columns are ignored,
    whatever their names. The sizes of blocks, lists and chunks change the
    plan, never the result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = keep(base.mapInArrow(_profile(k, chunk), "doc_id long, node long, n long, g long, cnt long"))
    rows = profile.where("n is not null").select("doc_id", "node", "n")
    hot = profile.where("g is not null").groupBy("g").agg(F.sum("cnt").alias("c")).orderBy(F.desc("c"), "g").limit(HOT_LISTED).select("g").toArrow()
    shared = base.sparkSession.sparkContext.broadcast(np.sort(hot["g"].to_numpy().astype(np.int64).view(np.uint64)))
    members = rows.agg(F.sum("n")).first()[0] or 0

    packed = base.where("doc_id is not null").mapInArrow(_packed(k, max(1, members // part), chunk, shared), "part long, frequent boolean, nodes binary, sizes binary, grams binary, owners binary")
    ranked = packed.groupBy("part").applyInArrow(_tally, "node long, n long, rank long")
    sets = keep_table(ranked.repartition("node").sortWithinPartitions("node", "rank").mapInArrow(_surviving(percent), "node long, n long, m long, ranks binary"))
    postings = sets.mapInArrow(_postings, "rank long, node long, n long, last long")
    clusters = components(_candidates(postings, percent, short)).withColumnRenamed("comp", "cluster")
    dealt = keep(_dealt(clusters, sets, block, pivots))

    # An empty set is a set of its id's own, which ties may join to the id's other texts.
    rows = rows.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", F.xxhash64(F.lit("empty"), "doc_id"))))
    with_id = rows.where("node is not null")
    # An id with several texts ties their sets together.
    tied = with_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    ties = with_id.join(tied, "doc_id").select("a", F.col("node").alias("b")).where("a != b").distinct()
    labels = components(_links(dealt.drop("cluster", "blocks"), sets, percent).union(ties))
    wide = dealt.where("blocks > 1").select("node").distinct()
    if _has_rows(wide):
        open_lists = keep(_open_lists(postings.join(wide, "node", "left_semi"), labels))
        if _has_rows(open_lists):
            labels = _merged(labels, _links(_between(open_lists, block), sets, percent))

    # A component's name is the smallest id in it.
    reps = with_id.groupBy("node").agg(F.min("doc_id").alias("rep"))
    named = keep(labels.join(reps, "node"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("name"))
    # A written table: the last join then has plain shuffles on both sides, which adaptive execution splits where a set is hot.
    names = keep_table(reps.join(named.join(smallest, "comp").select("node", "name"), "node", "left").select("node", F.coalesce("name", "rep").alias("component_id")))
    return rows.join(names, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between nodes: the links join labels, and only those are worked on."""
    links = keep(links)
    known = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    tops = keep(links.join(known[0], "a", "left").join(known[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct())
    if not _has_rows(tops):
        return labels
    joined = components(tops)
    old = labels.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = joined.join(labels, "node", "left_anti").select("node", "comp")
    return keep(old.union(new))
