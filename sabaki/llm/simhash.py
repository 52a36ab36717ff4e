"""SimHash near-duplicates with BK-trees.

Fingerprints within ``radius`` bits of each other are linked.  The 64 bits are cut into blocks such
that two linked fingerprints agree on ``agree`` whole blocks at least (``radius + agree`` blocks;
pigeonhole), so it is enough to compare fingerprints that agree on some choice of blocks.  Every
choice and value of its blocks is a shard; a shard has a BK-tree whose children are keyed by integer
Hamming distance to the parent, and each fingerprint of the shard follows only the edges within the
radius.  More fingerprints mean more agreeing blocks, so shards keep their size as the input grows:
every setting finds the same links.

Equal fingerprints are one node.  A shard over ``shard_rows`` is cut into parts, and every pair of
parts has a tree of its own, so no task holds an unbounded shard.  A task returns a spanning forest of
the links it has found (a subtree that is already in the query's component is not entered), so dense
groups give as many links as members, not pairs.  Components are found by alternating star
contraction over tables in the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import materialise, table

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_ROWS = 4096
#: Fingerprints of a shard that one more agreeing block is chosen for.
FULL_SHARD = 256
#: (query, node) pairs that one step of the search holds.
FRONTIER = 1 << 19


def simhash(text: bytes | None) -> bytes:
    """64-bit SimHash, high bit first, of the words of ``text`` in shingles of four."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8)
    digest, seed = xxhash.xxh64_digest, SEED
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(words, words[1:], words[2:], words[3:], strict=False))
    h = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [simhash(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        fp = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "th"])


def blocks_for(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks as (shift, width), and the choices of blocks, for ``n`` distinct fingerprints."""
    for agree in range(1, 5):
        k = radius + agree
        if agree == 4 or n <= FULL_SHARD << (64 * agree // k):
            break
    edges = [64 * i // k for i in range(k + 1)]
    return [(lo, hi - lo) for lo, hi in itertools.pairwise(edges)], list(itertools.combinations(range(k), agree))


def _keys(fp: Column, radius: int, n: int) -> Column:
    """Array of (choice, value) keys as longs: the choice in the 8 high bits, the bits of its blocks mixed below."""
    blocks, choices = blocks_for(n, radius)
    out = []
    for i, choice in enumerate(choices):
        mask = 0
        for b in choice:
            shift, width = blocks[b]
            mask |= ((1 << width) - 1) << shift
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*out)


class BKForest:
    """BK-trees of many groups at once.  ``fp`` holds distinct fingerprints within a group; ``group`` is sorted."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        n = len(fp)
        self.fp = fp
        first = np.r_[True, group[1:] != group[:-1]]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        at, todo = self.root.copy(), np.flatnonzero(~first)
        self.depth = np.zeros(n, np.int64)
        while len(todo):
            d = distance(fp[todo], fp[at[todo]])
            slot = at[todo] * 65 + d
            _, lead, back = np.unique(slot, return_index=True, return_inverse=True)
            child = todo[lead]
            self.parent[child], self.edge[child] = at[child], d[lead]
            self.depth[child] = self.depth[at[child]] + 1
            at[todo] = child[back]
            todo = np.delete(todo, lead)
        order = np.lexsort((self.edge, self.parent))
        order = order[self.parent[order] >= 0]
        self.child, self.slot = order, self.parent[order] * 65 + self.edge[order]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """Of each node: the label of its whole subtree, or -1 if there are several."""
        out = label.copy()
        for d in range(int(self.depth.max(initial=0)), 0, -1):
            at = np.flatnonzero(self.depth == d)
            odd = out[at] != label[self.parent[at]]
            out[self.parent[at[odd]]] = -1
        return out

    def links(self, radius: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of all pairs of a group within ``radius`` bits, as positions.

        ``direct``: pairs that are themselves within the radius and connect as much, not each position with the first it reaches.
        """
        n = len(self.fp)
        near = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        a, b = [near], [self.parent[near]]
        label = merge(np.arange(n), near, self.parent[near])
        step = max(1, FRONTIER // 64)
        for lo in range(0, n, step):
            whole = self.uniform(label)
            q = np.arange(lo, min(n, lo + step))
            todo = [(q, self.root[q])]
            while todo:
                q, node = todo.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                    continue
                keep = whole[node] != label[q]
                q, node = q[keep], node[keep]
                if not len(q):
                    continue
                d = distance(self.fp[q], self.fp[node])
                hit = (d <= radius) & (label[q] != label[node])
                if hit.any():
                    a.append(q[hit])
                    b.append(node[hit])
                    label = merge(label, q[hit], node[hit])
                    whole = self.uniform(label)
                lo_, hi_ = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0)), np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), "right")
                count = hi_ - lo_
                if total := int(count.sum()):
                    to = np.repeat(lo_ - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
                    todo.append((np.repeat(q, count), self.child[to]))
        if direct:
            return np.concatenate(a), np.concatenate(b)
        _, first = np.unique(label, return_index=True)
        root = first[np.searchsorted(label[first], label)]
        linked = np.flatnonzero(root != np.arange(n))
        return linked, root[linked]


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64)).astype(np.int64)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of each a and b; a label is the least position of its set."""
    label = label.copy()
    x, y = label[a], label[b]
    while len(x):
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        to = np.arange(len(label))
        np.minimum.at(to, hi, lo)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
        x, y = to[x], to[y]
        odd = x != y
        x, y = x[odd], y[odd]
    return label


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links (a, b) between fingerprints that connect as much as all: the closest ones, fewer than there are fingerprints."""
    order = np.argsort(distance(a, b), kind="stable")
    ids, at = np.unique(np.r_[a[order], b[order]], return_inverse=True)
    up, kept = list(range(len(ids))), []
    for i, (x, y) in enumerate(at.reshape(2, -1).T.tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            kept.append(i)
    return order[kept]


def _search(radius: int, lean: bool = False):
    """Rows come sorted by shard; whole shards are searched together. ``lean``: a shard may hold a fingerprint twice, and links are direct, those of all shards searched together a forest."""

    def found(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        if lean:
            order = np.lexsort((fp, group))
            fp, group = fp[order], group[order]
            new = np.r_[True, (fp[1:] != fp[:-1]) | (group[1:] != group[:-1])]
            fp, group = fp[new], group[new]
        a, b = BKForest(fp, group).links(radius, lean)
        if lean:
            first = forest(fp[a], fp[b])
            a, b = a[first], b[first]
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            fp, shard = cols[-1], cols[:-1]
            new = np.r_[last is None or any(c[0] != x for c, x in zip(shard, last, strict=True)), np.any([c[1:] != c[:-1] for c in shard], axis=0)]
            group = number + np.cumsum(new)
            number, last = int(group[-1]), [c[-1] for c in shard]
            held.append((fp, group))
            if sum(len(x) for x, _ in held) >= 20_000 and held[0][1][0] != number:
                fp, group = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(group, number))
                yield found(fp[:cut], group[:cut])
                held = [(fp[cut:], group[cut:])]
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, lean: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a spanning forest of each shard's links.

    ``lean`` is for many choices of blocks: one narrow shuffle, shards told to be full by a sample of their
    fingerprints, named by a hash (shards that share one are searched together, which loses no link). Its links
    are within the radius each, so that they can be confirmed by something else.
    """
    ship(prints.sparkSession)
    n = prints.count()
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), radius, n)).alias("k")).select("fp", "k.choice", "k.bits")
    share = 64 if lean else 1
    counted = keyed.filter(F.pmod(F.xxhash64("fp", F.lit("counted")), F.lit(share)) == 0) if lean else keyed
    full = counted.groupBy("choice", "bits").count().filter(F.col("count") * share > shard_rows // 2)
    full = full.select("choice", "bits", F.ceil(F.col("count") * (2 * share) / shard_rows).cast("int").alias("parts"))
    keyed = keyed.join(F.broadcast(full) if lean else full, ["choice", "bits"], "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")),
    )
    keyed = keyed.withColumn("part", part)
    keyed = keyed.select("choice", "bits", "fp", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).alias("p"))
    keyed = keyed.select("choice", "bits", "p.i", "p.j", "fp")
    if lean:
        shards = keyed.select(F.hash("choice", "bits", "i", "j").alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard")
        return shards.mapInArrow(_search(radius, lean=True), "a long, b long")
    shards = keyed.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j")
    return shards.mapInArrow(_search(radius), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node that can be reached.

    Alternates large-star and small-star steps until the links no longer change.  Every step
    aggregates before it joins, so a node with many links costs one row in each task.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = None
    for _ in range(rounds):
        edges = materialise(step(step(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _classes(docs: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """doc_id, th (hash of the text), fp, root and component_id of each row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("th"))
    prints = materialise(docs.mapInArrow(_fingerprints, "doc_id long, fp long, th long"), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    reached = components(near_links(nodes.select("fp"), radius, shard_rows))
    linked = nodes.join(reached, nodes["fp"] == reached["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked, "roots")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(linked.select("fp", "root").join(least, "root"), "fp")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    A null text counts as empty, and an empty one has the fingerprint zero, which is linked like any
    other.  component_id is the smallest doc_id that can be reached over links; null doc_ids are
    passed over (a component of such rows only has a null component_id).  Repeated rows are kept.
    """
    return _classes(docs, radius, shard_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of every component, all columns as they are.

    Of rows that tie on doc_id within a component one stays, and of a component without doc_ids too.
    """
    return keep_least(docs, _classes(docs, radius, shard_rows))


def keep_least(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The row of each component of ``classes`` (doc_id, th, root, component_id) with the smallest doc_id."""
    chosen = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("th").alias("th"), F.first("component_id").alias("id"))
    # Null-safe keys as plain columns: the join and the window then share one distribution of whole rows.
    key = lambda c: [F.col(c).isNull().alias("k_null"), F.coalesce(c, F.lit(0)).alias("k_id")]
    chosen = chosen.select(*key("id"), F.col("th").alias("k_th"))
    names = [f"in_{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("k_th"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    rows = rows.select(*key("own_id"), "k_th", *names)
    keys = ["k_null", "k_id", "k_th"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    return rows.join(chosen.distinct(), keys, "left_semi").withColumn("nth", nth).filter("nth = 1").select(*names).toDF(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
