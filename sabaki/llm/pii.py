"""Personal data: fixed patterns, and candidates that boosted trees judge.

High-recall generators propose spans that may overlap each other and the base spans: anything like
a number of 7 to 19 digits with separators, mail addresses with spelt-out signs, and account numbers
that begin with a country.  Features tell the format (digits, groups, separators, Luhn, length) and
the words around it.  Gradient-boosted trees, fitted here to sentences made from templates, score
every candidate; of overlapping ones above the calibrated threshold the best is taken, and none that
overlaps a base span.  Base spans always stay.

All work on documents is DataFrame expressions over one row, the trees included (as CASE
expressions), so nothing is shuffled.  The features of the training sentences are made by the very
same expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import renamed, table, text_or_empty
from .spans import apart_from, clusters, cut, listed, overlap, pieces, redacted, tagged, with_spans

#: Fixed patterns.  They match what the plain forms match: a possessive run can't be shortened to a
#: match anyway, and a local part begins where its run does, or where the last match has ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of candidates.
NUMBER = r"(?<![0-9])[0-9(](?:[\x20().\x2f-]{0,2}[0-9]){6,18}+(?![0-9])"
SPELT = r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++)++"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "spelt", "account")
CONTEXT = 32
#: Words before a candidate that speak for and against it.
PERSONAL = "(?i)(phone|tel|call|mobile|fax|contact|whatsapp|card|visa|credit|account|ssn|social|passport|iban|mail|reach|patient|licen[cs]e)"
OTHER = "(?i)(order|invoice|version|isbn|sku|item|page|total|price|part|lot|build|commit|figure|table|model|serial|revision|section)"
FEATURES = ("digits", "groups", "marks", "luhn", "parens", "longest", "letters", "personal", "other", "glued", "spelt", "account", "distinct")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit at its end."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.instr(F.lit("0123456789"), c) - 1)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def _good_ip(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _good_card(match: Column) -> Column:
    n = F.length(digits_of(match))
    return F.when(n.between(12, 19), luhn(digits_of(match))).otherwise(F.lit(False))


def _good_phone(match: Column) -> Column:
    return F.length(digits_of(match)).between(9, 15)


def _checked(kind: str, good: Callable[[Column], Column]) -> Column:
    return F.filter(kind, lambda s: good(s["match"]))


def _features(span: Column, kind: str) -> Column:
    """The span with its features; ``parts`` are the pieces of the text."""
    m, digits = span["match"], digits_of(span["match"])
    before = cut(F.col("parts"), F.greatest(span["start"] - CONTEXT, F.lit(0)), F.least(span["start"], F.lit(CONTEXT)))
    around = F.concat(cut(F.col("parts"), F.greatest(span["start"] - 1, F.lit(0)), F.when(span["start"] > 0, 1).otherwise(0)), F.lit(" "), cut(F.col("parts"), span["end"], F.lit(1)))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    number = lambda c: c.cast("double")
    columns = {
        "digits": F.length(digits),
        "groups": F.size(groups),
        "marks": F.size(F.array_distinct(F.split(F.regexp_replace(m, "[A-Za-z0-9]", ""), ""))),
        "luhn": F.when(F.length(digits) > 0, luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "parens": m.contains("(").cast("int"),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "personal": F.regexp_count(before, F.lit(PERSONAL)),
        "other": F.regexp_count(before, F.lit(OTHER)),
        "glued": around.rlike("[A-Za-z0-9_#$%&=/.-]").cast("int"),
        "spelt": F.lit(int(kind == "spelt")),
        "account": F.lit(int(kind == "account")),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
    }
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).alias("kind"), *(number(columns[f]).alias(f) for f in FEATURES))


def _with_features(kind: str) -> Column:
    return F.transform(kind, lambda s: _features(s, kind))


def _candidates(df: DataFrame) -> DataFrame:
    """Add ``candidates`` with features to rows with ``scanned``."""
    df = with_spans(
        df,
        "scanned",
        {"number": NUMBER, "spelt": SPELT, "account": ACCOUNT},
        {"number": F.col("scanned").rlike("[0-9]"), "spelt": F.col("scanned").rlike(r"(?i)[\[(]\x20?at\x20?[\])]"), "account": F.col("scanned").rlike("[A-Z]{2}[0-9]{2}")},
    )
    some = F.size("number") + F.size("spelt") + F.size("account") > 0
    df = df.withColumn("parts", F.when(some, pieces(F.col("scanned"))).otherwise(F.array().cast("array<string>")))
    return df.withColumn("candidates", F.concat(*(_with_features(k) for k in ("number", "spelt", "account")))).drop("number", "spelt", "account", "parts")


def training_sentences() -> list[tuple[str, int]]:
    """Sentences with one candidate, and whether it is personal; the same ones every time."""
    rng = np.random.default_rng(11)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card(n: int) -> str:
        body = d(n - 1)
        total = sum((2 * v - 9 if 2 * v > 9 else 2 * v) if i % 2 == 0 else v for i, v in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def quads(s: str) -> str:
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    yes = [
        lambda: f"please call me at ({d(3)}) {d(3)}-{d(4)} today",
        lambda: f"phone: {d(3)}-{d(3)}-{d(4)}",
        lambda: f"my mobile is {d(3)} {d(3)} {d(4)} thanks",
        lambda: f"tel. 0{d(2)}/{d(7)}",
        lambda: f"the ssn on file is {d(3)}-{d(2)}-{d(4)}",
        lambda: f"paid with credit card {quads(card(16))} yesterday",
        lambda: f"visa {card(16)}",
        lambda: f"the passport number is {d(9)}",
        lambda: f"write to ann{d(2)} [at] example [dot] org please",
        lambda: f"mail bob.{d(2)}(at)mail.example.com",
        lambda: f"iban DE{d(2)} {quads(d(16))} {d(2)}",
        lambda: f"account GB{d(2)}ABCD{d(14)}",
        lambda: f"and her patient record {d(3)}-{d(2)}-{d(4)} was",
    ]
    no = [
        lambda: f"order no. {d(10)} was shipped",
        lambda: f"invoice {d(12)}",
        lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"in {1900 + int(d(2))}-{d(2)}-{d(2)} they said",
        lambda: f"version {d(2)}.{d(2)}.{d(4)} is out",
        lambda: f"the sum of {d(7)} and more",
        lambda: f"item sku={d(9)} is sold out",
        lambda: f"it counted {d(16)} grains",
        lambda: f"pages {d(3)}-{d(3)} {d(2)} of the table",
        lambda: f"with rhe {d(16)} thon the",
        lambda: f"model {d(4)}-{d(4)} of the part",
        lambda: f"values {d(3)} {d(3)} {d(3)} in figure",
        lambda: f"serial AB{d(2)}{d(4)}WXYZ{d(4)}",
    ]
    # Every third sentence calibrates; the makers are taken in turn so that both parts have all of them.
    return [(make(), label) for _ in range(20) for make, label in [*((m, 1) for m in yes), *((m, 0) for m in no)]]


_models: dict[int, boosting.Boosted] = {}


def model(spark: SparkSession) -> boosting.Boosted:
    """The trees, fitted once in this process."""
    if 0 not in _models:
        rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(training_sentences())], "i int, scanned string, y int").coalesce(1)
        got = _candidates(rows).select("i", "y", F.explode("candidates").alias("c")).select("i", "y", "c.*").collect()
        got = sorted(got, key=lambda r: (r["i"], r["start"]))
        x = np.array([[r[f] for f in FEATURES] for r in got])
        order = np.random.default_rng(3).permutation(len(got))
        _models[0] = boosting.fit(x[order], np.array([r["y"] for r in got])[order])
    return _models[0]


def find_personal_data(docs: DataFrame, text: str = "text", trees: boosting.Boosted | None = None) -> DataFrame:
    """``docs`` with arrays of spans (start, end, match) ``email``, ``ip``, ``card``, ``phone``, and ``judged`` (start, end, kind, score).

    A null text has none.  Base matches that fail their check are dropped and what they cover is not
    tried again.  Repeated rows are scanned one by one, very long texts whole; an empty table gives none.  Work follows
    the text and its matches, but for candidates of several generators that overlap in one chain.  Other columns pass
    through (those that clash with the added ones are replaced).
    """
    trees = trees or model(docs.sparkSession)
    added = {*BASE, "judged"}
    source = [c for c in docs.columns if c.lower() not in added]
    df = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(source)), text_or_empty(f"`{text}`").alias("scanned"))
    df = with_spans(df, "scanned", {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}, {"email": F.contains("scanned", F.lit("@")), "phone": F.contains("scanned", F.lit("+"))})
    for kind, good in (("ip", _good_ip), ("card", _good_card), ("phone", _good_phone)):
        df = df.withColumn(kind, _checked(kind, good))
    df = _candidates(df)
    df = df.withColumn("base_s", F.transform(F.concat(*BASE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    # Those of one generator don't overlap one another, as a sweep needs.
    own = lambda kind: F.filter("candidates", lambda c: c["kind"] == kind)
    free = F.concat(*(apart_from(own(k), F.col("base_s")) for k in KINDS[len(BASE) :]))
    df = df.withColumn("candidates", F.when((F.size("candidates") > 0) & (F.size("base_s") > 0), free).otherwise(F.col("candidates")))
    score = F.expr(f"transform(candidates, x -> named_struct('neg', -({trees.sql(list(FEATURES), 'x')}), 'start', x.start, 'end', x.end, 'kind', x.kind))")
    df = df.withColumn("scored", F.when(F.size("candidates") > 0, score).otherwise(F.array().cast("array<struct<neg:double,start:int,end:int,kind:string>>")))
    df = df.withColumn("scored", F.filter("scored", lambda c: -c["neg"] >= F.lit(float(trees.threshold))))
    # A candidate is taken if none before it, in order of score, overlaps it; only those of a cluster can.
    spans = F.transform("scored", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["neg"].alias("neg"), c["kind"].alias("kind")))
    rank = lambda c: F.struct(c["neg"], c["start"], c["end"], c["kind"])
    best = lambda group: F.filter(group, lambda c: F.forall(group, lambda s: ~overlap(s, c) | (rank(s) >= rank(c))))
    taken = F.flatten(F.transform(clusters(spans), best))
    ordered = F.array_sort(F.transform(taken, lambda c: F.struct(c["neg"].alias("neg"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    judged = F.transform(ordered, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), (-c["neg"]).alias("score")))
    judged = F.when(F.size("scored") > 0, judged).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>"))
    df = df.withColumn("judged", judged)
    return df.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(source)), *BASE, "judged")


def _judged(order: int, kind: str) -> Column:
    return tagged(F.filter("judged", lambda s: s["kind"] == kind), order, kind)


def all_spans(base_only: bool = False) -> Column:
    """The spans of ``find_personal_data`` with their kinds."""
    base = [tagged(F.col(k), i, k) for i, k in enumerate(BASE)]
    more = [_judged(i, k) for i, k in itertools.islice(enumerate(KINDS), len(BASE), None)]
    return F.concat(*base, *([] if base_only else more))


def redact_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind in brackets; a null text stays null, other cases are as in ``find_personal_data``."""
    rows, names = renamed(docs)
    own = names[text.lower()]
    found = find_personal_data(rows, own).withColumn("spans", all_spans())
    clean = F.when(F.col(own).isNotNull(), redacted(F.col(own), F.col("spans")))
    return found.withColumn(own, clean).select(*rows.columns).toDF(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(all_spans(True)), 256).alias("base_sha256"),
        listed(all_spans()).alias("spans"),
        F.size("judged").cast("long").alias("n_judged"),
    )
