"""Secret scanning: patterns, and a battery of randomness tests over long tokens.

Everything is a DataFrame expression over one row, so there is no shuffle.  Beside the base patterns
the battery judges every token of 20 or more characters of an encoding alphabet.  The encoding is
inferred from the characters (upper-case hex, base32 of either case, base64 and its URL form, base36 of
lower case, in which - and _ separate); tokens of letters alone fit none.  Three tests give p-values
of a token of random bytes: chi-squared uniformity over the encoding's alphabet, whose values follow the
letters' frequency in words, so that words fill few bins; runs of characters of one class (Wald and
Wolfowitz for several classes), of which words have few; and lag-1 serial correlation of the values.
Fisher's method combines them to the token's score, uniform for random bytes and near 0 for words.

A report is a discovery, and its null hypothesis a natural token.  Scores of names put together by rule
from words, numbers and separators, ``NATURAL`` for each encoding and class of length, are the
null distribution: a token's p-value is the share of them that look as random as it does.
Benjamini-Hochberg control, with weights by length (longer tokens can be told better), over a document's
tokens bounds the share of natural tokens among the reports by ``fdr``, as far as the document's names
are like the made ones.  Those discovered are reported as kind ``random``.  A lone random token among
more than ``fdr`` times ``NATURAL`` natural ones of its document can't be told from their extremes and isn't reported.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed, table, text_or_empty
from .spans import SPANS, apart_from, let, listed, redacted, tagged, with_spans

#: Fixed patterns of the base kinds.  "Either case" is ASCII only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
#: Letters by their frequency in English words; values of an alphabet follow it, digits come last.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
_DIGITS = "0123456789"
#: Encoding, pattern of the whole token, alphabet in order of value.
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]{20,}$", "EADCFB" + _DIGITS),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", COMMON.upper() + "234567"),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", COMMON + COMMON.upper() + "+/" + _DIGITS),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", COMMON + COMMON.upper() + "-_" + _DIGITS),
    ("base32 lower", "^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+$", COMMON + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9_-]+$", COMMON + _DIGITS),
)
#: Bins of the chi-squared test: common letters, rare ones, the rest.  More bins tell words no better (measured with up to 16).
BINS = 3
#: Classes of length begin here; made names for each of them and each encoding; p-values told apart.
LENGTHS = (20, 24, 32, 48)
NATURAL = 1000
LEVELS = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)
#: Parts of made names.
WORDS = (
    "the and for with from into over under after before when then this that all any one two first last next new old big small "
    "get set put add make take find load save read write send open close start stop run test check build parse split join merge sort count print show "
    "user name file path page line word text list map key value item order price date time year month day week hour number index table column row "
    "data base model view form field type class object method function module package library service server client request response error message "
    "event handler listener manager factory config option default version release update build report result status state context session token cache "
    "image color width height left right top bottom red green blue black white house water light street market school paper music story world people"
).split()
SHORT = "id db io os ip tz js py cfg ctx tmp src dst len max min num ptr str int utf xml html json http sql api url asn rfc iso cpu dtype args init xfrm".split()
HEX_WORDS = "ADD BAD BED BEEF CAFE DAD DEAD DEED FACE FADE FEED FACADE DECADE ABCDEF".split()
FDR = 0.05


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable (Abramowitz and Stegun 26.2.17, error below 1e-7)."""

    def tail(a: Column, t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) * 0.3989422804014327 * poly

    return let(z, lambda x: let(let(F.abs(x), lambda a: let(1 / (1 + 0.2316419 * a), lambda t: tail(a, t))), lambda p: F.when(x >= 0, p).otherwise(1 - p)))


def _battery(span: Column) -> Column:
    """The span with its encoding's number and alphabet size, the values of its characters, their classes, and its cell of the null distribution."""
    token = span["match"]
    encoding = F.coalesce(*(F.when(token.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)))
    alphabet = F.coalesce(*(F.when(token.rlike(p), F.lit(letters)) for _, p, letters in ENCODINGS))
    values = let(alphabet, lambda a: F.filter(F.transform(F.split(token, ""), lambda c: F.instr(a, c) - 1), lambda v: v >= 0))  # separators have none
    classes = F.translate(token, COMMON + COMMON.upper() + _DIGITS + "+/_-", "l" * 26 + "u" * 26 + "d" * 10 + "s" * 4)
    length = sum((F.when(F.length(token) >= n, 1).otherwise(0) for n in LENGTHS[1:]), F.lit(0))
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), encoding.alias("encoding"), F.length(alphabet).alias("size"), values.alias("v"), classes.alias("c"),
        (encoding * len(LENGTHS) + length).alias("cell"),
    )


def _chi_squared(t: Column) -> Column:
    """p-value of uniformity over BINS equal bins of the alphabet (Wilson and Hilferty's approximation)."""
    placed = F.transform(t["v"], lambda v: F.floor(v * BINS / t["size"]).cast("int"))
    square = let(placed, lambda p: sum((F.pow(F.size(F.filter(p, lambda x: x == F.lit(b))).cast("double"), F.lit(2.0)) for b in range(BINS)), F.lit(0.0)))
    x = F.greatest(square * BINS / F.size(t["v"]) - F.size(t["v"]), F.lit(0.0))
    spread = 2 / (9 * (BINS - 1))
    return upper_tail((F.cbrt(x / (BINS - 1)) - (1 - spread)) / spread**0.5)


def _runs(t: Column) -> Column:
    """p-value of the number of runs of characters of one class; 0 if all are of one class."""
    n = F.length(t["c"]).cast("double")
    counts = F.array(*((F.length(t["c"]) - F.length(F.replace(t["c"], F.lit(k)))).cast("double") for k in "luds"))
    power = lambda c, k: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.pow(x, F.lit(k)))
    runs = F.length(F.regexp_replace(t["c"], r"(.)\1*+", "x"))

    def p_value(d: Column) -> Column:
        n, squares, cubes = d["n"], d["squares"], d["cubes"]
        variance = (squares * (squares + n * (n + 1)) - 2 * n * cubes - n * n * n) / (n * n * (n - 1))
        z = let(variance, lambda v: F.when(v > 1e-9, F.abs(d["runs"] - (n + 1 - squares / n)) / F.sqrt(v)))
        return F.least(F.lit(1.0), F.coalesce(2 * upper_tail(z), F.lit(0.0)))

    sums = let(counts, lambda c: F.struct(n.alias("n"), runs.alias("runs"), power(c, 2.0).alias("squares"), power(c, 3.0).alias("cubes")))
    return let(sums, p_value)


def _serial(t: Column) -> Column:
    """p-value of the lag-1 correlation of the values; 0 if they are all equal."""
    n = F.size(t["v"])
    mean = F.aggregate(t["v"], F.lit(0).cast("long"), lambda acc, v: acc + v) / n
    centred = let(mean, lambda m: F.transform(t["v"], lambda v: v - m))

    def p_value(c: Column) -> Column:
        spread = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
        lagged = F.aggregate(F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        z = (lagged / F.nullif(spread, F.lit(0.0)) + 1 / n) * F.sqrt(n.cast("double"))
        return F.least(F.lit(1.0), F.coalesce(2 * upper_tail(F.abs(z)), F.lit(0.0)))

    return let(centred, p_value)


def _combined(*p: Column) -> Column:
    """p-value of three p-values: the upper tail of chi-squared with six degrees of freedom at -2 times the sum of their logs."""
    logs = -sum((F.log(F.greatest(x, F.lit(1e-300))) for x in p), F.lit(0.0))
    return let(logs, lambda x: F.least(F.lit(1.0), F.exp(-x) * (1 + x + x * x / 2)))


def _score(t: Column) -> Column:
    return _combined(_chi_squared(t), _runs(t), _serial(t))


def natural_tokens(each: int = NATURAL, seed: int = 17) -> list[str]:
    """``each`` names for every encoding and class of length, put together from parts; the same ones every time."""
    draw = random.Random(seed)

    def number(digits: str) -> str:
        if draw.random() < 0.3 and digits == _DIGITS:
            return f"{draw.randrange(1990, 2030)}" + draw.choice(["", "01", "0115", "1231"])
        return "".join(draw.choice(digits) for _ in range(draw.choice([1, 1, 1, 2, 2, 3, 4])))

    def part(digits: str) -> str:
        return number(digits) if draw.random() < 0.2 else draw.choice(WORDS if draw.random() < 0.85 else SHORT)

    def hexadecimal() -> str:
        return draw.choice([draw.choice(HEX_WORDS), number(_DIGITS), "0" * draw.randrange(2, 9)])

    def camel() -> str:
        return draw.choice([str.capitalize, str.capitalize, str.capitalize, str.lower, str.upper])(part(_DIGITS))

    makers = {
        "hex": (hexadecimal, [""]),
        "base32": (lambda: part("234567").upper(), [""]),
        "base64": (camel, ["", "", "/"]),
        "base64url": (camel, ["_", "-"]),
        "base32 lower": (lambda: part("234567"), [""]),
        "base36": (lambda: part(_DIGITS), ["_", "_", "-", "-", ""]),
    }
    ends, patterns, out = [*LENGTHS[1:], 2 * LENGTHS[-1]], [re.compile(p) for _, p, _ in ENCODINGS], []
    for i, (encoding, _, _) in enumerate(ENCODINGS):
        make, marks = makers[encoding]
        for least, end in zip(LENGTHS, ends, strict=True):
            wanted = each
            while wanted:
                mark, target = draw.choice(marks), draw.randrange(least, end)
                name = make()
                while len(name) < target:
                    name += mark + make()
                if len(name) < end and next((k for k, p in enumerate(patterns) if p.match(name)), None) == i:
                    wanted -= 1
                    out.append(name)
    return out


_cuts: dict[int, list[list[float]]] = {}


def natural_cuts(spark: SparkSession) -> list[list[float]]:
    """For each cell the scores beyond which the share of natural tokens is LEVELS[1:]; found once in this process."""
    if 0 not in _cuts:
        rows = spark.createDataFrame([(t,) for t in natural_tokens()], "match string").repartition(16)
        spans = rows.select(F.transform(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("match"))), _battery).alias("tried"))
        scores = spans.select(F.transform("tried", lambda t: F.struct(t["cell"].alias("cell"), _score(t).alias("score"))).alias("t"))
        cells: list[list[float]] = [[] for _ in range(len(ENCODINGS) * len(LENGTHS))]
        for cell, score in scores.select(F.inline("t")).collect():
            cells[cell].append(score)
        ranked = [sorted(c, reverse=True) for c in cells]
        _cuts[0] = [[c[int(level * (len(c) + 1) + 1e-9) - 1] for level in LEVELS[1:]] for c in ranked]
    return _cuts[0]


def random_tokens(tokens: Column, cuts: list[list[float]], fdr: float = FDR) -> list[tuple[str, Column]]:
    """Steps (name, column) that lead from token spans to ``random_s``, the discoveries; ``cuts`` are those of ``natural_cuts``."""
    scored = F.transform(
        F.col("tried"),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.size(t["v"]).alias("n"), t["cell"].alias("cell"), _score(t).alias("score")),
    )
    table_, levels = F.array(*(F.array(*map(F.lit, c)) for c in cuts)), F.array(*map(F.lit, LEVELS))
    p_value = lambda t: F.get(levels, F.size(F.filter(F.get(table_, t["cell"]), lambda c: c < t["score"])))
    judged = F.transform(F.col("scored"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["n"].alias("n"), p_value(t).alias("p")))
    total = F.aggregate(F.col("judged"), F.lit(0).cast("long"), lambda acc, t: acc + t["n"])
    # The weight of a token is its length over the mean length.
    weighted = let(
        F.struct(F.col("judged").alias("tokens"), (total / F.greatest(F.size("judged"), F.lit(1))).alias("mean")),
        lambda d: F.transform(d["tokens"], lambda t: F.struct((t["p"] * d["mean"] / t["n"]).alias("w"), t["start"].alias("start"), t["end"].alias("end"))),
    )
    discovered = let(
        F.struct(F.col("weighted").alias("tokens"), F.size("weighted").alias("m")),
        lambda d: F.aggregate(F.transform(d["tokens"], lambda t, i: F.when(t["w"] <= (i + 1) * fdr / d["m"] + 1e-12, i + 1).otherwise(0)), F.lit(0), lambda acc, k: F.greatest(acc, k)),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    kept = F.transform(F.slice(F.col("weighted"), 1, F.col("discovered")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    some = F.size(tokens) > 0
    return [
        ("tried", F.filter(F.transform(tokens, _battery), lambda t: t["encoding"].isNotNull())),
        ("scored", scored),
        ("judged", judged),
        ("weighted", F.array_sort(weighted)),
        ("discovered", discovered),
        ("random_s", F.when(some & (F.size("weighted") > 0), kept).otherwise(none)),
    ]


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with ``assign``, ``access``, ``hex`` and ``random``: arrays of spans in the text.

    A null text has none.  Matches of ``assign`` whose value is shorter than six characters are
    dropped.  A ``random`` span lies in no base span.  Repeated rows are scanned one by one, very long texts whole, with
    work in proportion to the text and its matches; an empty table gives none.  Other columns pass through, whatever their names
    (those that clash with the added ones in lower case are replaced).
    """
    source = [c for c in docs.columns if c.lower() not in KINDS]
    df = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(source)), text_or_empty(f"`{text}`").alias("scanned"))
    df = with_spans(df, "scanned", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}, {"access": F.contains("scanned", F.lit("AKIA"))})
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6))
    base = F.concat("assign", "access", "hex")
    df = df.withColumn("base_s", F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    df = df.withColumn("token", F.when(F.size("token") > 0, apart_from(F.col("token"), F.col("base_s"))).otherwise(F.array().cast(SPANS)))
    for name, column in random_tokens(F.col("token"), natural_cuts(docs.sparkSession), fdr):
        df = df.withColumn(name, column)
    return df.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(source)), "assign", "access", "hex", F.col("random_s").alias("random"))


def all_spans(base_only: bool = False) -> Column:
    """The spans of ``find_secrets`` with their kinds."""
    return F.concat(*(tagged(F.col(k), i, k) for i, k in enumerate(KINDS) if not (base_only and k == "random")))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind in brackets; columns and rows stay.

    A null text stays null.  Repeated rows, very long texts and empty tables are as in ``find_secrets``.
    """
    rows, names = renamed(docs)
    own = names[text.lower()]
    found = find_secrets(rows, own).withColumn("spans", all_spans())
    clean = F.when(F.col(own).isNotNull(), redacted(F.col(own), F.col("spans")))
    return found.withColumn(own, clean).select(*rows.columns).toDF(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(all_spans(True)), 256).alias("base_sha256"),
        listed(all_spans()).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
