"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised where they are read; pieces carry their length, the number of their task
and their place among the pieces of equal length in it, and are written once.  Best-fit decreasing
needs lengths only, and there are at most ``capacity`` of them, so it runs on the driver over the
histogram of lengths: the longest first, each length goes to the tightest open bins that take it.
A segment tree over the remaining capacities 0..capacity finds these bins in logarithmic time.
Bins that hold the same are one group, and documents of equal length that fall into one group are
placed by one step, so the plan has the same few thousand steps for any number of documents
(a step at least halves what a group has left; groups are split or opened a few times a length).
Every piece then finds its step by its length and rank: ranks are prefix sums of counts by task.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import materialise, table

CAPACITY = 2048
#: Steps of a plan that is broadcast (48 bytes each); it takes a few thousand at the usual capacity.
BROADCAST_STEPS = 1 << 18
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Above this code point the two libraries' Unicode tables might differ.
PLAIN = re.compile("[ɐ-\U0010ffff]")
_ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(maxsize=4)
def encoder(path: str, special_ids: bool = False):
    """Function from a text to its ids.

    Special strings in a text are ordinary text, or, with ``special_ids``, get the id that the library
    gives them by itself.  Most texts go through ``tiktoken`` over the vocabulary of the same file, which gives the same
    ids several times as fast; texts with rarer characters, and with ``special_ids`` those that hold a special
    string, go through ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    @functools.cache
    def slow() -> Tokenizer:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not special_ids
        return t

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    chars = _byte_chars()
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join([PLAIN.pattern, *(map(re.escape, sorted(special)) if special_ids else ())]))
    return lambda text: slow().encode(text, add_special_tokens=False).ids if odd.search(text) else fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first takes what the full ones leave."""
    k = -(-n // capacity)
    first = n - capacity * (k - 1)
    return [(0, first), *((first + capacity * i, capacity) for i in range(k - 1))]


def _pieces(path: str, capacity: int, with_ids: bool, special_ids: bool):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, special_ids), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def packed(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        rows, size = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), task, seen[length], *([own.astype(np.int32)] * with_ids)))
                    seen[length] += 1
                    size += length if with_ids else 1
                if size > (1 << 20 if with_ids else 1 << 14):
                    yield packed(rows)
                    rows, size = [], 0
        yield packed(rows)

    return run


class CapacityTree:
    """Segment tree over remaining capacities: how many groups of open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of ``need`` or more that an open bin has."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.size
            at >>= 1
        return None


class Step(NamedTuple):
    """Pieces of ``length`` with ranks ``lo`` to ``hi`` (excluded) go to bins from ``first``, ``each`` to a bin, from ``offset``."""

    length: int
    lo: int
    hi: int
    first: int
    each: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """The steps that best-fit decreasing takes over ``histogram`` (pieces by length)."""
    tree, open_bins, steps, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def put(first: int, n: int, left: int) -> None:
        if n and left:
            if not open_bins[left]:
                tree.add(left, 1)
            open_bins[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        at, total = 0, histogram[length]
        while at < total:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-(total - at) // (capacity // length))
                bins += n
            else:
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    tree.add(left, -1)
            each = left // length
            take = min(total - at, n * each)
            steps.append(Step(length, at, at + take, first, each, capacity - left))
            full, rest = divmod(take, each)
            put(first, full, left - each * length)
            put(first + full, int(rest > 0), left - rest * length)
            put(first + full + (rest > 0), n - full - (rest > 0), left)
            at += take
    return steps


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, special_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    A document's ids end with id 0, so an empty or null text is one piece of one id.  Only longer
    documents are cut.  Gives a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``with_ids`` the ids.  ``special_ids`` is that of ``encoder``.  Rows with a null or repeated doc_id are
    packed like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(docs.mapInArrow(_pieces(path or tokenizer_path(), capacity, with_ids, special_ids), _ROWS + ", ids array<int>" * with_ids), "pieces")
    counts = pieces.groupBy("length", "task").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialise(counts.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(steps, "step_length long, lo long, hi long, first long, each long, at long")
    # The counts grow with the tasks, so they are never broadcast; a hot length is spread over the tasks.
    ranked = pieces.join(counts.select("length", "task", "before").hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan's size depends on the capacity alone; for a very large one it is joined by length.
    placed = ranked.join(F.broadcast(plan) if len(steps) <= BROADCAST_STEPS else plan.hint("merge"), (F.col("length") == F.col("step_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), special_ids=True)
