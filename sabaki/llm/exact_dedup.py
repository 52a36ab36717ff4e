"""Exact deduplication by an extendible-hash index.

Two scans of the texts.  The first hashes every text (SHA-256 of the bytes after lower-casing A-Z)
and keeps a narrow table of documents.  From the distinct hashes the directory is built: a bucket
with more than ``bucket_rows`` keys is split by the next bit of the key, and the directory doubles
when the bucket was as deep as the directory.  Owners get runs of buckets, which are key ranges, of about
equal bytes.  The second scan sends one entry for each distinct text of a task, with its count and
largest doc_id, to the owner of its bucket.  The owner walks its keys in order, chains entries whose keys
collide, compares bytes within a chain, and writes its pages of the index to the shared folder, where the
directory is too.  Documents then look their bucket up in the directory and their class in its pages.

Depth and owners follow the input, without a bound.  A text held by a third of all rows reaches its owner
as one entry for each task, not as rows; the lookup joins narrow rows only, and AQE splits a skewed side of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import materialise, table

#: Bits of a key that a prefix can have, and those that it has at least.
PREFIX_BITS = 32
LEAST_BITS = 16
#: Bytes of distinct texts that an owner takes, about.
OWNER_BYTES = 128 << 20
#: A task keeps this many bytes of texts to collapse repeats before they are sent.
WINDOW_BYTES = 48 << 20
BATCH_BYTES = 4 << 20

_ENTRY = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("n", pa.int64()), ("max_id", pa.int64())])
_PAGE = "bucket int, key long, chain int, sha binary, length long, keep_id long, group_size long"


def _key(sha: bytes, key_bits: int) -> int:
    return int.from_bytes(sha[:8], "big") >> (64 - key_bits)


def build_directory(counts: dict[int, int], bits: int, bucket_rows: int) -> np.ndarray:
    """Bucket of each ``bits``-bit key prefix.

    ``counts`` holds the number of keys by prefix.  Starting from one bucket of depth 0, an
    overfull bucket is split by its next bit; the directory doubles when the bucket's depth equals
    its own.  A bucket of one prefix can't be split any more and overflows into its chain.
    """
    held = np.zeros(1 << bits, np.int64)
    held[np.fromiter(counts, np.int64, len(counts))] = list(counts.values())
    prefix_sums = np.r_[0, np.cumsum(held)]
    depth, directory, local = 0, np.zeros(1, np.int64), [0]
    todo, spans = [0], {0: (0, 1 << bits)}
    while todo:
        b = todo.pop()
        lo, hi = spans[b]
        if prefix_sums[hi] - prefix_sums[lo] <= bucket_rows or local[b] == bits:
            continue
        if local[b] == depth:
            depth += 1
            directory = np.repeat(directory, 2)
        new, mid = len(local), (lo + hi) // 2
        local[b] += 1
        local.append(local[b])
        spans[b], spans[new] = (lo, mid), (mid, hi)
        shift = bits - depth
        directory[mid >> shift : hi >> shift] = new
        todo += [b, new]
    return np.repeat(directory, 1 << (bits - depth))


def owners_of(sizes: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each bucket: runs of buckets in order, of about equal ``sizes`` together."""
    middle = np.cumsum(sizes, dtype=np.float64) - sizes / 2
    return np.minimum(middle * owners / max(1.0, float(sizes.sum())), owners - 1).astype(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        sha = [hashlib.sha256((t or b"").lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64())], ["doc_id", "sha", "size"])


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, sha, size and row (a number that no other row has) of each document, as a table of the shared folder."""
    hashed = docs.mapInArrow(_hashes, "doc_id long, sha binary, size long")
    return materialise(hashed.withColumn("row", F.monotonically_increasing_id()), "exact-hash")


def _prefix(sha: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.conv(F.substring(F.hex(sha), 1, PREFIX_BITS // 4), 16, 10).cast("long"), PREFIX_BITS - bits)


def _entries(directory: np.ndarray, owner: np.ndarray, bits: int, key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for item in seen.items():
                rows.append(item)
                size += len(item[1][0])
                if size > BATCH_BYTES or len(rows) == 4096:
                    yield packed(rows)
                    rows, size = [], 0
            yield packed(rows)

        def packed(rows: list) -> pa.RecordBatch:
            keys = [_key(s, key_bits) for s, _ in rows]
            buckets = [int(directory[k >> (key_bits - bits)]) for k in keys]
            cols = [
                [int(owner[b]) for b in buckets],
                buckets,
                [k - (1 << 64) if k >= 1 << 63 else k for k in keys],
                [s for s, _ in rows],
                *([x[i] for _, x in rows] for i in range(3)),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRY, strict=True)], schema=_ENTRY)

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = (raw or b"").lower()
                sha = hashlib.sha256(text).digest()
                x = seen.get(sha)
                if x is None:
                    seen[sha] = [text, 1, doc_id]
                    held += len(text) + 200
                else:
                    if x[0] != text:
                        raise ValueError("two texts share a SHA-256")
                    x[1] += 1
                    if doc_id is not None and (x[2] is None or doc_id > x[2]):
                        x[2] = doc_id
                if held > WINDOW_BYTES:
                    yield from flush()
                    seen, held = {}, 0
        yield from flush()

    return run


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come in order of bucket and key; the chain of one key is held at a time."""
    at: tuple[int, int] | None = None
    chain: list[list] = []
    out: list[tuple] = []

    def close() -> None:
        out.extend((at[0], at[1], i, sha, len(text), keep, n) for i, (text, sha, n, keep) in enumerate(chain))

    def page() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "key", "chain", "sha", "length", "keep_id", "group_size"])

    for b in batches:
        for bucket, key, sha, text, n, max_id in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (bucket, key) != at:
                if at is not None:
                    close()
                at, chain = (bucket, key), []
            for c in chain:
                if len(c[0]) == len(text) and c[0] == text:
                    c[2] += n
                    c[3] = max_id if c[3] is None else c[3] if max_id is None else max(c[3], max_id)
                    break
            else:
                if any(c[1] == sha for c in chain):
                    raise ValueError("two texts share a SHA-256")
                chain.append([text, sha, n, max_id])
        if len(out) >= 4096:
            yield page()
            out.clear()
    if at is not None:
        close()
    yield page()


def build_index(docs: DataFrame, bucket_rows: int = 8192, key_bits: int = 64, owner_bytes: int = OWNER_BYTES, hashed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The directory (prefix, bucket, bits) and the pages of the index: one row for each distinct text, as columns ``_PAGE`` says.

    ``docs`` has doc_id and text.  ``key_bits`` (64) may be lowered to force collisions in tests.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = _hashed(docs) if hashed is None else hashed
    distinct = materialise(hashed.groupBy("sha").agg(F.first("size").alias("size")), "exact-keys")
    n, whole = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // owner_bytes))
    # Sixteen prefixes for each full bucket and each owner, so that both can be cut evenly.
    wanted = 16 * max(owners, -(-n // bucket_rows))
    bits = min(max(LEAST_BITS, (wanted - 1).bit_length()), key_bits, PREFIX_BITS)
    counts = distinct.groupBy(_prefix(F.col("sha"), bits).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    directory = build_directory({r["p"]: r["n"] for r in counts}, bits, bucket_rows)
    # Buckets are numbered as they were split off; from here on in the order of their keys.
    directory = np.cumsum(np.r_[0, directory[1:] != directory[:-1]])
    at = np.array([r["p"] for r in counts], np.int64)
    sizes = np.bincount(directory[at], np.array([r["size"] + 64 * r["n"] for r in counts], float), directory[-1] + 1) if len(counts) else np.zeros(directory[-1] + 1)
    owner = owners_of(sizes, owners)
    first = np.flatnonzero(np.r_[True, directory[1:] != directory[:-1]])
    runs = [(int(lo), int(hi), int(directory[lo])) for lo, hi in zip(first, [*first[1:], len(directory)], strict=True)]
    listed = spark.createDataFrame(runs, "lo long, hi long, bucket int").select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("prefix"), "bucket", F.lit(bits).alias("bits"))
    listed = materialise(listed, "exact-directory")
    entries = docs.mapInArrow(_entries(directory, owner, bits, key_bits), "owner int, bucket int, key long, sha binary, text binary, n long, max_id long")
    owned = entries.repartitionById(owners, "owner").sortWithinPartitions("bucket", "key").drop("owner")
    return listed, materialise(owned.mapInArrow(_owner, _PAGE), "exact-index")


def exact_duplicates(docs: DataFrame, bucket_rows: int = 8192, key_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after A-Z are lower-cased; a null text counts as empty.
    The row with the largest doc_id of a group stays; a null doc_id is smaller than any other, and
    of rows that tie on doc_id one stays.  Very long texts are one entry each.  Other columns of ``docs``, whatever
    their names, are not used.  An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = _hashed(docs)
    directory, pages = build_index(docs, bucket_rows, key_bits, hashed=hashed)
    bits = directory.select("bits").first()["bits"]
    asked = hashed.withColumn("prefix", _prefix(F.col("sha"), bits)).join(directory.select("prefix", "bucket"), "prefix")
    found = asked.join(pages.select("bucket", "sha", "keep_id", "group_size"), ["bucket", "sha"])
    # Of rows that share a text and a doc_id the first stays; few do, so these are found by counting.
    tied = hashed.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1")
    tied = tied.select(F.col("sha").alias("own_sha"), F.col("doc_id").alias("own_id"), "first")
    found = found.join(tied, (F.col("sha") == F.col("own_sha")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("first") == F.col("row"), F.lit(True))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t, doc_id) AS rn, sha256(t) AS text_sha256
  FROM d
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND rn = 1) AS kept, text_sha256 FROM g
"""
