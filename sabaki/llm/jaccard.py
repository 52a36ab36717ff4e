"""Near copies: SimHash of five-word shingles, links confirmed by a Jaccard similarity of 0.8 or more.

Fingerprints within 8 bits are found by the blocks and BK-trees of ``simhash``, without loss, and what they
link is confirmed on the texts.  Of the pairs with that similarity in a table of 0.5 GB the furthest is 19 of 64
bits apart, a radius at which no choice of blocks is selective; 8 bits reach 62 % of them, 4 bits 13 %.
The rest, pairs of texts that those links leave unconnected, come from prefixes, without loss.  With the
shingles of every text in one order, two texts that are near have a common one among the first fifth
(and one more) of each, and the lengths and places of the first they share allow the overlap.  Any order is
right; here the shingles that a bounded sample repeats come last, so prefixes are made of rare ones.

A group of texts with a prefix shingle in common gives all its pairs if it is small.  A large one, mostly
one cluster of near copies, first gives each member a few others, and after the links among those
are known the pairs that they leave unconnected.  A set's sketch is the parity of its shingles in 1024
bins, and for larger sets in twice as many bins at least as there are shingles: two sets differ in as many
shingles at least as their sketches in bits, so pairs whose sketches are too far apart go without their texts.
Every other pair is confirmed on the texts, unless those already confirmed connect it.

Texts are large and most have no part in this, so what is shuffled is texts of asked rows only: a bitmap of
hashed keys passes by the others where they are read, and a join then decides exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import discard, materialise, written
from .simhash import components, near_links, text_hash

WORDS = 5
SEED = 42
#: Bits that fingerprints may differ in, and fingerprints of a shard that is cut into parts.
RADIUS = 8
SHARD_ROWS = 8192
#: Rows, about, that tell which shingles are common, their least share, and the most such shingles.
SAMPLE_DOCS = 4000
SAMPLE_SHARE = 1 / 16
COMMON = 1 << 18
#: A group of more texts gives its pairs in two rounds.
GROUP = 16
#: 64-bit words of a sketch.
SKETCH = 16
#: Rows that are searched together at least, and pairs that one step holds.
HELD = 100_000
STEP = 1 << 18
#: Pairs for each this many nodes that are confirmed together.
ROUND = 16
#: Bits of a bitmap for each key, and in all.
KEY_BITS = 16
BITMAP = 1 << 28
#: Columns of a null-safe key of a row.
KEY = ["k_null", "k_id", "k_th"]


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the different shingles of five words, sorted; of fewer words, one of them all."""
    words = (text or b"").lower().split()
    if len(words) < WORDS:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), ">i8").astype(np.int64))


def near(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def fingerprint(own: np.ndarray) -> int:
    """SimHash: a bit is 1 if it is set in over half the shingles' hashes."""
    h = own.astype(">i8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def sketch(own: np.ndarray, bins: int = 64 * SKETCH) -> bytes:
    odd = np.bincount(own & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(own: np.ndarray) -> bytes | None:
    """With two bins a shingle at least; None if a sketch has them."""
    return sketch(own, 1 << (2 * len(own) - 1).bit_length()) if len(own) > 32 * SKETCH else None


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded to the other's bins."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _close(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be near: near ones differ in a ninth of n + m at most."""
    return 9 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n + m


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH)


def _node(own: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh64_digest(own.tobytes(), SEED), ">i8")[0])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
        cols = [pa.array(map(_node, own), pa.int64()), pa.array(map(fingerprint, own), pa.int64()), b.column(2), pa.array(map(len, own), pa.int64()), pa.array(map(sketch, own), pa.binary()), pa.array(map(wide_sketch, own), pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "node", "fp", "th", "n", "sketch", "wide"])


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))], ["s"])


def _prefixes(common: np.ndarray, count: np.ndarray):
    """Rows (shingle, node, place) of each set's prefix; place is size << 32 | position. Sets that a task repeats come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            parts = [np.zeros((3, 0), np.int64)]
            for t in b.column(0).cast(pa.binary()).to_pylist():
                own = shingles(t)
                n, node = len(own), _node(own)
                if not n or node in seen:
                    continue
                seen.add(node)
                rank = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, count[at], 0)
                first = own[np.lexsort((own, rank))][: n - (4 * n + 4) // 5 + 1]
                parts.append(np.stack([first, np.full(len(first), node), (n << 32) + np.arange(len(first))]))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(parts, axis=1))), ["s", "node", "place"])

    return run


def _may(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether two places leave room for the overlap, if the shingle is the first that both sets have."""
    n, m = p >> 32, q >> 32
    room = np.minimum(n - (p & 0xFFFFFFFF), m - (q & 0xFFFFFFFF))
    return (9 * room >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns (shingle first, node second) of whole groups, sorted, without repeated rows and groups of one."""
    held: list[list[np.ndarray]] = []

    def ready(cols: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])][: len(order)]
        cols = [c[new] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        many = np.r_[False, same] | np.r_[same, False] if len(cols[0]) else np.zeros(0, bool)
        return [c[many] for c in cols]

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        if b.num_columns > width:
            held[-1].append(_words(b.column(width)))
        size += b.num_rows
        if size >= HELD and held[0][0][0] != held[-1][0][-1]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1
            yield ready([c[:cut] for c in cols])
            held = [[c[cut:] for c in cols]]
            size = len(held[0][0])
    if held:
        yield ready([np.concatenate(c) for c in zip(*held, strict=True)])


def _batch(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, *more)], ["a", "b", "s", "place"][: 2 + len(more)])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of small groups, some of large ones, and the members of large groups (a, null, s, place)."""
    for s, node, place in _groups(batches, 3):
        if not len(s):
            continue
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[start, len(s)])
        large = np.repeat(size > GROUP, size)
        x, y = [], []
        for k in range(1, min(GROUP, int(size.max()))):
            i = np.flatnonzero(s[k:] == s[:-k])
            i = i[~large[i]] if k > 1 else i
            i = i[_may(place[i], place[i + k])]
            x.append(i)
            y.append(i + k)
        # Each shingle has another member of its group in the middle.
        middle = np.repeat(start + (s[start] & 0x7FFFFFFF) % size, size)
        i = np.flatnonzero(large & (middle != np.arange(len(s))))
        i = i[_may(place[i], place[middle[i]])]
        x, y = np.concatenate([*x, i]), np.concatenate([*y, middle[i]])
        pair = np.unique(np.stack([np.maximum(node[x], node[y]), np.minimum(node[x], node[y])]), axis=1)
        none = pa.nulls(pair.shape[1], pa.int64())
        yield _batch(pair[0], pair[1], none, none)
        i = np.flatnonzero(large)
        yield _batch(node[i], pa.nulls(len(i), pa.int64()), s[i], place[i])


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each group that have different roots."""
    for s, node, place, root, bits in _groups(batches, 4):
        edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(0, int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            order = lo + np.argsort(root[lo:hi], kind="stable")
            r, p, own, w = root[order], place[order], node[order], bits[order]
            ends = np.flatnonzero(np.r_[r[1:] != r[:-1], True]) + 1
            for begin, end in zip(np.r_[0, ends[:-2]], ends[:-1], strict=False):
                step = max(1, STEP // (len(r) - end))
                for at in range(begin, end, step):
                    i, j = np.nonzero(_may(p[at : min(end, at + step), None], p[None, end:]))
                    i, j = at + i, end + j
                    good = _close(w[i], p[i] >> 32, w[j], p[j] >> 32)
                    if good.any():
                        i, j = own[i[good]], own[j[good]]
                        yield _batch(np.maximum(i, j), np.minimum(i, j))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, m = (b.column(i).to_numpy() for i in (2, 3))
        good = pa.array(_close(_words(b.column(4)), n, _words(b.column(5)), m), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i).filter(good) for i in range(4)], ["a", "b", "na", "nb"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same by wide sketches, with the bits in which they differ."""
    for b in batches:
        far = np.array([apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
        good = pa.array(9 * far <= b.column(2).to_numpy() + b.column(3).to_numpy(), pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(good) for c in (b.column(0), b.column(1), pa.array(far))], ["a", "b", "far"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = functools.lru_cache(64)(shingles)
    for b in batches:
        x, y = (b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
        good = np.array([near(own(s), own(t)) for s, t in zip(x, y, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    reached = components(links).withColumnRenamed("node", "id")
    nodes = nodes.select("node", "least_id")
    return materialise(nodes.join(reached, nodes["node"] == reached["id"], "left").select("node", "least_id", F.coalesce("root", "node").alias("root")), "set-roots")


def _key(doc_id: str, th: str) -> list[Column]:
    """Plain columns for a null-safe join, and the long that bitmaps hold."""
    k = [F.col(doc_id).isNull(), F.coalesce(F.col(doc_id), F.lit(0).cast("long")), F.col(th)]
    return [c.alias(n) for c, n in zip([*k, F.xxhash64(*k)], [*KEY, "k_hash"], strict=True)]


def _among(keys: DataFrame):
    """A function that tells of a long column whether ``keys`` (k_hash) may hold it: yes for all that it holds, and for few others."""
    size = min(BITMAP, max(1 << 16, 1 << (KEY_BITS * keys.count()).bit_length()))
    at = F.col("k_hash").bitwiseAND(size - 1)
    rows = keys.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << 15) - 1)).alias("bits")).toArrow()
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for block, x in zip(rows["block"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        bits[block] = np.frombuffer(x, np.uint8)
    bits = bits.reshape(-1)

    def may(h: pa.Array) -> pa.Array:
        p = h.to_numpy(zero_copy_only=False) & (size - 1)
        return pa.array((bits[p >> 3] >> (p & 7)) & 1 == 1)

    return F.arrow_udf(may, "boolean")


def _unconnected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) whose nodes have different roots."""
    sides = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return functools.reduce(lambda df, side: df.join(side, side.columns[0]), sides, pairs).filter("ra <> rb").drop("ra", "rb")


def simhash_pairs(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that connect all whose fingerprints are within ``radius`` bits."""
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "set-prints")
    found = near_links(first.select("fp"), radius, shard_rows, lean=True).distinct()
    for c in "ab":
        found = found.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")), c)
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = found.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).unionByName(same)
    return materialise(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "set-simhash")


def near_classes(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, round_pairs: int | None = None) -> DataFrame:
    """doc_id, th (hash of the text), root and component_id of each row of ``docs``; rows linked by near texts have one root."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("th"))
    start = written()
    prints = materialise(docs.mapInArrow(_nodes, "doc_id long, node long, fp long, th long, n long, sketch binary, wide binary"), "sets")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(best).alias("best"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.max("sketch").alias("sketch"), F.max("wide").alias("wide"))
    nodes = materialise(nodes, "set-nodes")
    round_pairs = round_pairs or max(10_000, nodes.count() // ROUND)

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, far) of those (a, b) that the sketches allow."""
        first = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        wide = (nodes.select(F.col("node").alias(c), F.coalesce("wide", "sketch").alias(f"s{c}")) for c in "ab")
        add = lambda df, sides: functools.reduce(lambda df, side: df.join(side, side.columns[0]), sides, df)
        pairs = add(pairs.select("a", "b").distinct(), first).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible, "a long, b long, na long, nb long")
        pairs = add(materialise(pairs, "set-possible"), wide).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely, "a long, b long, far long")
        return materialise(pairs, "set-candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
        asked = materialise(asked.select(F.col("best.doc_id").alias("id"), F.col("best.th").alias("own"), "node").select(*_key("id", "own"), "node"), "set-asked")
        rows = docs.select(*_key("doc_id", "th"), "text").filter(_among(asked)("k_hash")).drop("k_hash")
        texts = rows.join(asked.drop("k_hash"), KEY).groupBy(*KEY, "node").agg(F.min("text").alias("text"))
        texts = materialise(texts.select("node", "text"), "set-texts")
        left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return materialise(rows.mapInArrow(_confirm, "a long, b long"), "set-links")

    def linked(pairs: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``links`` and roots with what ``pairs`` add. Many pairs go in rounds, at first the closest of each node; what those connect needs no texts."""
        slots = 1
        while True:
            pairs = materialise(_unconnected(pairs, roots), "set-open")
            if pairs.isEmpty():
                return links, roots
            last = pairs.count() <= round_pairs
            chosen = pairs
            if not last:
                closest = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(slots))).agg(F.min(F.struct("far", "b")).alias("c"))
                chosen = materialise(closest.select("a", F.col("c.b").alias("b")), "set-round")
            links = links.unionByName(confirmed(chosen))
            roots = _rooted(nodes, links)
            if last:
                return links, roots
            pairs = pairs.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
            slots *= 4

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    roots = nodes.select("node", "least_id", F.col("node").alias("root"))
    links, roots = linked(possible(simhash_pairs(nodes.filter("n > 0").select("node", "fp"))), links, roots)

    count = prints.count()
    share = max(SAMPLE_SHARE, sample_docs / max(1, count))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "th", F.lit("common")), F.lit(1 << 30)) < min(1.0, share) * (1 << 30)).select("text")
    repeated = drawn.mapInArrow(_all, "s long").groupBy("s").count().filter("count > 1").orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    common, often = (repeated[c].to_numpy().astype(np.int64) for c in ("s", "count"))
    order = np.argsort(common)
    places = docs.select("text").mapInArrow(_prefixes(common[order], often[order]), "s long, node long, place long")
    found = places.repartition("s").sortWithinPartitions("s").mapInArrow(_first_pairs, "a long, b long, s long, place long")
    found = materialise(found, "set-pairs")

    links, roots = linked(possible(found.filter("b IS NOT NULL")), links, roots)
    large = found.filter("b IS NULL").select("s", F.col("a").alias("node"), "place")
    if not large.isEmpty():
        met = materialise(large.join(roots.select("node", "root"), "node"), "set-large")
        mixed = met.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("s")
        met = met.join(mixed, "s", "left_semi").join(nodes.select("node", "sketch"), "node").select("s", "node", "place", "root", "sketch")
        others = met.repartition("s").sortWithinPartitions("s").mapInArrow(_other_pairs, "a long, b long")
        links, roots = linked(possible(others), links, roots)
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = prints.select("doc_id", "th", "node").join(roots.select("node", "root").join(least, "root"), "node").select("doc_id", "th", "root", "component_id")
    out = materialise(classes, "set-classes")
    discard(start, keep=1)
    return out


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of every component of near texts, all columns as they are.

    Texts without a word are equal.  Of rows that tie on doc_id within a component one stays, and of a
    component without doc_ids too.
    """
    classes = near_classes(docs)
    chosen = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("th").alias("th"), F.first("component_id").alias("id"))
    chosen = chosen.select(*_key("id", "th")).distinct()
    keys = classes.select(*_key("doc_id", "th")).groupBy(*KEY, "k_hash").count()
    keys = materialise(keys.join(chosen.drop("k_hash").withColumn("kept", F.lit(True)), KEY, "left"), "set-keys")
    # Rows that no other key's bit covers stay, rows that no kept key's bit covers go; the few between, and repeated rows, are joined.
    kept, other = _among(keys.filter("kept")), _among(keys.filter("kept IS NULL OR count > 1"))
    names = [f"in_{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_th"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    rows = rows.select(*_key("own_id", "own_th"), *names)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(1)))
    open_ = rows.filter(other("k_hash") & kept("k_hash")).join(keys.filter("kept").select(*KEY), KEY, "left_semi").withColumn("nth", nth).filter("nth = 1")
    return rows.filter(~other("k_hash")).select(*names).unionByName(open_.select(*names)).toDF(*docs.columns)
