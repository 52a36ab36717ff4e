"""Encoding and decoding with SentencePiece models, words of equal length advancing together.

A text is normalised as the model says, spaces become U+2581, and it is cut where a piece can't
reach across.  The distinct words of a batch are encoded once, as numpy matrices of code points, one
for each word length; substring hashes (64-bit polynomial) probe the sorted hashes of the pieces.

``unigram`` models use Viterbi: at every end position the scores of all pieces that end there are
compared for all words together, and vectorised maxima store the backpointers.  In ``bpe`` models a
piece's score is the order of its merge, and the segmentation with the best sum is not the one that
the merges give, so Viterbi can't give right ids there: the same matrices instead take the best
adjacent pair of every word together, round by round.  A character that no piece holds becomes its
UTF-8 byte pieces, or the unknown id where the model has none.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Words that a worker remembers at a time.
CACHE_WORDS = 400_000
#: Documents whose new words are encoded together.
SLICE = 512
#: Words of more characters are merged one by one with a heap: a round over a matrix would cost their square.
LONG_WORD = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Codec:
    """Pieces, scores and settings of one model file, and its segmentation in numpy."""

    def __init__(self, raw: bytes):
        self.processor = spm.SentencePieceProcessor(model_proto=raw)
        self.kind, self.dummy_prefix, self.squeeze, self.plain = "unigram", True, True, True
        for number, value in _fields(raw):
            if number == 2:  # trainer_spec
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = {1: "unigram", 2: "bpe"}.get(v, str(v))
            elif number == 3:  # normalizer_spec
                for n, v in _fields(value):
                    if n == 2:
                        self.plain = not v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        if self.kind not in ("unigram", "bpe"):
            raise ValueError(f"no encoder for a {self.kind} model")
        sp = self.processor
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.known = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.across = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.known)
        self.longest = max(map(len, self.known), default=1)
        ids = np.array(list(self.known.values()), np.int64)
        hashes = np.array([self._hash_word(p) for p in self.known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces share a hash")
        self.scores = np.array([sp.get_score(i) for i in range(size)])
        # An unknown character costs more than the worst piece.
        self.unknown_score = float(min((self.scores[i] for i in self.known.values()), default=0.0)) - 10.0
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _hash_word(word: str) -> int:
        h = 0
        for c in word:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1) if len(self.hashes) else np.full(hashes.shape, -1)

    def prefix_hashes(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = chars.shape
        prefix, power = np.zeros((n, length + 1), np.uint64), np.ones(length + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(length, _BASE))
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * _BASE + chars[:, i].astype(np.uint64) + np.uint64(1)
        return prefix, power

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the best pieces of each word, and their ids; -1 is an unknown character, or nothing where two edges are equal."""
        n, length = chars.shape
        prefix, power = self.prefix_hashes(chars)
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1)
        for end in range(1, length + 1):
            width = min(self.longest, end)
            starts = np.arange(end - width, end)
            found = self.probe(prefix[:, end : end + 1] - prefix[:, starts] * power[end - starts])
            gain = np.where(found >= 0, self.scores[found], -np.inf)
            alone = found[:, -1] < 0
            gain[alone, -1] = self.unknown_score
            total = score[:, starts] + gain
            best = total.argmax(axis=1)
            rows = np.arange(n)
            score[:, end], back[:, end], piece[:, end] = total[rows, best], starts[best], found[rows, best]
        # Follow the backpointers of all words together; column t holds the t-th piece from the end.
        ends = [np.full(n, length)]
        while ends[-1].any():
            ends.append(np.where(ends[-1] > 0, back[np.arange(n), ends[-1]], 0))
        edges = np.stack(ends[::-1], axis=1)
        return edges, np.take_along_axis(piece, edges[:, 1:], axis=1)

    def merges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``viterbi``, after merging the best adjacent pair, leftmost of equals, of each word as long as there is one."""
        n, length = chars.shape
        prefix, power = self.prefix_hashes(chars)
        rows = np.arange(n)

        def span(lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
            return self.probe(prefix[own[:, None], hi] - prefix[own[:, None], lo] * power[hi - lo])

        edges = np.broadcast_to(np.arange(length + 1), (n, length + 1)).copy()  # symbol i of a word is edges[i]..edges[i+1]
        count = np.full(n, length)
        active = rows
        score = np.full((n, max(1, length - 1)), -np.inf)
        if length > 1:
            joined = span(edges[:, :-2], edges[:, 2:], rows)
            score = np.where(joined >= 0, self.scores[joined], -np.inf)
        while len(active):
            own = score[active]
            best = own.argmax(axis=1)
            good = own[np.arange(len(active)), best] > -np.inf
            active, best = active[good], best[good]
            if not len(active):
                break
            cols = np.arange(length + 1)
            take = np.minimum(cols[None, :] + (cols[None, :] > best[:, None]), length)  # drop edge best+1
            edges[active] = np.take_along_axis(edges[active], take, axis=1)
            count[active] -= 1
            pairs = np.arange(score.shape[1])
            kept = np.take_along_axis(score[active], np.minimum(pairs[None, :] + (pairs[None, :] > best[:, None]), score.shape[1] - 1), axis=1)
            kept[pairs[None, :] >= (count[active] - 1)[:, None]] = -np.inf
            for at in (best - 1, best):  # the pairs on both sides of the new symbol
                ok = (at >= 0) & (at < count[active] - 1)
                if ok.any():
                    a, r = at[ok], active[ok]
                    joined = span(edges[r, a][:, None], edges[r, a + 2][:, None], r)[:, 0]
                    kept[np.flatnonzero(ok), a] = np.where(joined >= 0, self.scores[joined], -np.inf)
            score[active] = kept
        edges = edges[:, : count.max(initial=0) + 1]
        return edges, span(edges[:, :-1], edges[:, 1:], rows)

    def merge_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``merges`` for one word, by a heap of adjacent pairs; old pairs are known by their ends."""
        n, known, scores, longest = len(word), self.known, self.scores, self.longest
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at i
        heap: list[tuple[float, int, int, int]] = []

        def push(at: int) -> None:
            mid = end[at]
            if mid < n and end[mid] - at <= longest and (i := known.get(word[at : end[mid]])) is not None:
                heapq.heappush(heap, (-scores[i], at, mid, end[mid]))

        for at in range(n):
            push(at)
        while heap:
            _, at, mid, stop = heapq.heappop(heap)
            if end[at] != mid or end[mid] != stop:
                continue
            end[at], end[mid] = stop, -1
            if stop < n:
                before[stop] = at
            push(at)
            if before[at] >= 0:
                push(before[at])
        edges = [0]
        while edges[-1] < n:
            edges.append(end[edges[-1]])
        ids = [known.get(word[a:b], -1) for a, b in itertools.pairwise(edges)]
        return np.array([edges]), np.array([ids]).reshape(1, -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit integers; words of equal length advance together."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        out: list = [b""] * len(words)
        segment = self.viterbi if self.kind == "unigram" else self.merges
        for length, at in by_length.items():
            step = max(1, (1 << 18) // max(1, length * min(length, self.longest)))
            for lo in range(0, len(at), step):
                own = at[lo : lo + step]
                together = "".join([words[i] for i in own])
                chars = np.frombuffer(together.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), length)
                long = length > LONG_WORD and self.kind == "bpe"
                parts = [self.merge_long(words[i]) for i in own] if long else [segment(chars)]
                if len(parts) > 1:  # words of a length differ in their number of pieces
                    for i, (edges, ids) in zip(own, parts, strict=True):
                        out[i] = self._with_unknown(words[i], edges[0], ids[0])
                    continue
                edges, ids = parts[0]
                real = edges[:, 1:] > edges[:, :-1]
                odd = (real & (ids < 0)).any(axis=1)
                counts = real.sum(axis=1)
                flat = ids[real].astype("<i4")
                if not odd.any() and "".join(map(self.pieces.__getitem__, flat.tolist())) != together:
                    raise ValueError("a substring has the hash of another piece")
                raw, ends = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, a, b in zip(own, [0, *ends], ends, strict=False):
                    out[i] = raw[a:b]
                for k in np.flatnonzero(odd).tolist():
                    out[own[k]] = self._with_unknown(words[own[k]], edges[k][np.r_[True, real[k]]], ids[k][real[k]])
        return out

    def _with_unknown(self, word: str, edges: np.ndarray, ids: np.ndarray) -> bytes:
        out: list[int] = []
        for start, end, i in zip(edges[:-1].tolist(), edges[1:].tolist(), ids.tolist(), strict=True):
            if i >= 0:
                if self.pieces[i] != word[start:end]:
                    raise ValueError("a substring has the hash of another piece")
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in word[start:end].encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def normalised(self, text: str) -> str:
        if not self.plain:
            text = self.processor.normalize(text)
            return text
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (" " * self.dummy_prefix + text).replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        split = [[n] if self.across and n else cut.findall(n) for n in map(self.normalised, texts)]
        cache = self.words
        words = set(itertools.chain.from_iterable(split))
        new = list(words.difference(cache))
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(words)
        cache.update(zip(new, self.encode_words(new), strict=True))
        return [np.frombuffer(b"".join(map(cache.__getitem__, ws)), "<i4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``: bytes are joined to characters, U+2581 is a space, the dummy prefix goes."""
        parts, held = [], bytearray()
        byte_of = {i: b for b, i in self.bytes.items()}
        for i in ids.tolist():
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(self.pieces[i] if i != self.unknown else " ⁇ ")
        if held:
            parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids = c.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [np.array(x or (), np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text); a null text has no ids.

    Repeated rows are encoded one by one; very long texts and words whole, a word in the order of its length times the logarithm;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path or model_path()), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids give an empty text, repeated rows and empty tables as many rows."""
    ship(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path or model_path()), "doc_id long, text string")


def _digests(path: str):
    """Encode, decode what was encoded, and keep digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in _encode(path)(batches):
            values, offsets = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()
            ids = [values[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"],
            )

    return run


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_sha256 of each document."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(model_path()), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
