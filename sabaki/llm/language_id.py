"""Language identification with error-correcting output codes.

Every learned language has a codeword.  For each bit of the codewords a binary logistic classifier
over hashed byte n-grams predicts the bit; loss-weighted decoding sums the logistic loss of every
bit against each codeword, weighted by how well the bit's classifier does on that language, and the
codeword with the least loss wins.  Two codewords of nearly equal loss make the result ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (``sample_docs``), drawn evenly
over the languages by a hash of doc_id; their features are made on the executors and come to the driver
packed, by Arrow; there is one matrix of them there, of the buckets that the sample has.  Prediction reads
whole texts in one pass without a shuffle; the model (``buckets`` x bits floats) is in the closure.

A text far from every codeword is in none of the languages.  How far, a further quarter of the
sample tells, which isn't fitted on: ``limit`` is the greatest loss to the nearest codeword there, ``NEAR`` at
least.  A text in two languages is far as a whole, but its windows are near, one after the other.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from .common import renamed, table

UNKNOWN = "und"
BUCKETS = 1 << 13
#: Bound on the labelled rows that are fitted on, all languages together.
SAMPLE_DOCS = 2400
#: Most letters of a text in a learned language are letters that the sample has.
FOREIGN = 0.5
#: The two best scores of an ambiguous text differ by less.
AMBIGUOUS = 0.2
#: Least limit of the loss to the nearest codeword: bits that are right have a mean probability of two thirds.
NEAR = 0.4
#: Letters without which the loss tells nothing, and characters of a window of a text that is far as a whole.
FEW_LETTERS = 64
WINDOW = 200
_ASCII_LETTER = re.compile("[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]")
_MARKS = re.compile(r"[\x00-`{-\x7f]+")  # all of ASCII but a-z
#: Odd multipliers that hash n-grams of two and three bytes.
_MULTIPLIERS = {2: np.uint32(2654435761), 3: np.uint32(2246822519)}


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the decimal doc_id leaves 2 modulo 4 (never for a null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts of the whole lower-cased text."""
    raw = np.frombuffer((" " + _MARKS.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8)
    shift = np.uint32(32 - int(math.log2(buckets)))
    out = np.zeros(buckets, np.float32)
    for at in range(0, len(raw), 1 << 20):  # windows overlap by two bytes, so no n-gram is lost
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        pair = b[:-1] << np.uint32(8) | b[1:]
        more = len(raw) > at + (1 << 20)
        for n, code in ((2, pair[:-1] if more else pair), (3, pair[:-1] << np.uint32(8) | b[2:])):
            out += np.bincount(code * _MULTIPLIERS[n] >> shift, minlength=buckets)
    np.sqrt(out, out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def packed(x: np.ndarray) -> bytes:
    """The buckets of ``x`` that aren't zero, then their values in half precision."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float16).tobytes()


def _halves(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(x.as_buffer(), np.uint16)
    return raw[: len(raw) // 2], raw[len(raw) // 2 :].view(np.float16)


def unpacked(rows: pa.Array, buckets: np.ndarray) -> np.ndarray:
    """A row for each of ``rows`` (packed) and a column for each of ``buckets``; the values of other buckets are left out."""
    column = np.full(BUCKETS, -1)
    column[buckets] = np.arange(len(buckets))
    out = np.zeros((len(rows), len(buckets)), np.float32)
    for row, x in zip(out, rows, strict=True):
        at, value = _halves(x)
        to = column[at]
        row[to[to >= 0]] = value[to >= 0]
    return out


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 for each class: every split of up to seven classes, else spread random ones."""
    if classes < 2:
        return np.zeros((classes, 0), np.int8)
    if classes <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=classes) if s[0] == 1 and min(s) < 0]
        return np.array(splits, np.int8).T
    rng, best, gap = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, math.ceil(10 * math.log2(classes))))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(classes), 2))
        if apart > gap:
            best, gap = code, apart
    return best


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, _WORD.findall(text)))


def letters_of(text: str) -> list[str]:
    """The letters of ``text`` in order; numerals such as ½ and Ⅷ aren't letters."""
    return [c for c in _WORD.findall(text) if c.isalpha()]


@functools.lru_cache(maxsize=8)
def _other_letter(letters: str) -> re.Pattern:
    return re.compile(rf"[^\W\d_{letters}]")


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    scale: float
    letters: str = ""
    limit: float = NEAR

    def foreign(self, text: str) -> float:
        """Share of the letters of ``text`` that the training sample doesn't have."""
        low = text.lower()
        others = sum(map(str.isalpha, _other_letter(self.letters).findall(low)))
        return others / len(letters_of(low)) if others else 0.0

    def far(self, text: str, loss: float) -> bool:
        """Whether ``text``, of this loss to the nearest codeword, is in none of the languages.

        Texts of few letters never are.  One that is far as a whole is so unless most of its letters are in windows that
        are near.
        """
        if loss <= self.limit or len(letters_of(text)) < FEW_LETTERS:
            return False
        near = whole = 0
        for at in range(0, len(text), WINDOW):
            part = text[at : at + WINDOW]
            n = len(letters_of(part))
            whole += n
            near += n * bool(n and self.losses(features(part)[None]).min() <= self.limit)
        return 2 * near <= whole

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of every codeword (columns) for every row of features."""
        z = x @ self.weights + self.bias
        return np.logaddexp(0, -z) @ (self.trust * (self.code > 0)).T + np.logaddexp(0, z) @ (self.trust * (self.code < 0)).T

    def scores(self, losses: np.ndarray) -> np.ndarray:
        """Of codewords with these losses, from 0 to 1; those of a row sum to 1."""
        e = -self.scale * losses
        e = np.exp(e - e.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: list[str], steps: int = 300) -> Model:
    """Logistic classifiers by accelerated gradient descent, every class with the same total weight."""
    languages = sorted(set(y))
    own = np.array([languages.index(v) for v in y], int)
    code = codewords(len(languages))
    target = code[own].astype(np.float32)
    share = (1 / np.bincount(own, minlength=len(languages)))[own] / max(1, len(languages)) if len(own) else np.zeros(0)
    share = share.astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate, decay = np.zeros_like(w), np.zeros_like(b), np.float32(30), np.float32(1e-5)
    for _ in range(steps if len(own) and code.shape[1] else 0):
        z = x @ w + b
        g = -share * target / (1 + np.exp(np.clip(target * z, -30, 30)))
        vw = np.float32(0.9) * vw - rate * (x.T @ g + decay * w)
        vb = np.float32(0.9) * vb - np.float32(1) * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * target > 0).astype(float) if len(own) else np.zeros((0, code.shape[1]))
    trust = np.array([right[own == k].mean(axis=0) if code.shape[1] else [] for k in range(len(languages))]).reshape(code.shape)
    trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
    return Model(languages, code, w, b, trust, 4.0)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about ``sample_docs`` rows that have a language and aren't held out, and set the limit by a quarter as many others.

    Every language gives an equal share, or all it has; which rows, a hash of doc_id and text says. Repeated
    rows count once.
    """
    ship(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = 1.25 * sample_docs / max(1, len(counts))
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in counts.items()), F.lit(0.0))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit("limit")), F.lit(5)) == 0).alias("limits"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            x = [packed(features(t)) for t in texts]
            letters = ["".join(sorted(set(letters_of(t.lower())))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(letters, pa.string()), b.column(2)], ["lang", "x", "letters", "limits"])

    got = drawn.mapInArrow(made, "lang string, x binary, letters string, limits boolean").distinct().toArrow()
    got = got.sort_by([(c, "ascending") for c in ("lang", "limits", "x", "letters")])
    lang, limits = got["lang"].to_pylist(), np.array(got["limits"].to_pylist(), bool)
    learned = {k for k, limit in zip(lang, limits, strict=True) if not limit}
    other = limits & np.array([k in learned for k in lang], bool)
    fitted = got["x"].filter(pa.array(~other))
    has = np.zeros(BUCKETS, bool)
    for x in fitted:
        has[_halves(x)[0]] = True
    # The weights of other buckets are zero, so neither the fit nor the limit needs their columns.
    buckets = np.flatnonzero(has)
    model = fit(unpacked(fitted, buckets), [k for k, o in zip(lang, other, strict=True) if not o])
    if other.any() and len(model.languages) > 1:
        model.limit = max(NEAR, float(model.losses(unpacked(got["x"].filter(pa.array(other)), buckets)).min(axis=1).max()))
    weights = np.zeros((BUCKETS, model.weights.shape[1]), np.float32)
    weights[buckets] = model.weights
    model.weights = weights
    model.letters = "".join(sorted(set().union(*got["letters"].to_pylist())))
    return model


_PREDICTED = "lang_pred string, score double, ambiguous boolean, foreign double, loss double, far boolean"


def _predict(model: Model, text_at: int, emit: list[int]):
    """Columns ``emit`` of each batch, then those of ``_PREDICTED`` for column ``text_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            known = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
            lang, score, gap, loss, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for at in range(0, len(known), 256):
                rows = known[at : at + 256]
                losses = model.losses(np.stack([features(texts[i]) for i in rows]))
                s = model.scores(losses)
                best = s.argmax(axis=1)
                ranked = np.sort(s, axis=1)
                score[rows], loss[rows] = ranked[:, -1], losses.min(axis=1)
                gap[rows] = ranked[:, -1] - (ranked[:, -2] if s.shape[1] > 1 else 0)
                far[rows] = [model.far(texts[i], loss[i]) for i in rows]
                for i, k in zip(rows, best, strict=True):
                    lang[i] = model.languages[k]
            foreign = [model.foreign(t) if t else 0.0 for t in texts]
            added = [pa.array(lang, pa.string()), pa.array(score), pa.array(gap < AMBIGUOUS), pa.array(foreign, pa.float64()), pa.array(loss), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in emit), *added], [*(b.schema.names[i] for i in emit), "lang_pred", "score", "ambiguous", "foreign", "loss", "far"])

    return run


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous, foreign (share of unknown letters), loss (to the nearest codeword) and far (from all) for every row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0, as is every text where nothing was
    learned.  A null doc_id is never held out.  Rows, repeated or not, are treated one by one; very long texts are read
    whole, in steps; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model, 2, [0, 1]), f"doc_id long, held_out boolean, {_PREDICTED}")


def keep_known_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` in a learned language, all columns as they are.

    Rejected are ``und``, texts far from every codeword (another language, or none), and texts most of whose
    letters the training sample doesn't have (another script).  Texts in two of the languages stay, as do
    texts of few letters in a known script.
    """
    ship(docs.sparkSession)
    plain, by = renamed(docs)
    names = plain.columns
    text_at = names.index(by["text"])
    schema = T.StructType([*plain.schema.fields, *T._parse_datatype_string(_PREDICTED).fields])
    found = plain.mapInArrow(_predict(model, text_at, list(range(len(names)))), schema)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("foreign") <= FOREIGN) & ~F.col("far"))
    return kept.select(*names).toDF(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, train(docs))
