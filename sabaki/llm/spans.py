"""Matches of a pattern as spans, by DataFrame functions alone.

Spark gives the matches of a pattern but not their places.  The parts between matches do: ``split``
and ``regexp_extract_all`` walk the text alike, so a match starts where the lengths of all parts and
matches before it end.  Places are code points, ends excluded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix sums go by blocks, so a text with many matches costs little more than their number.
BLOCK = 64
#: Parts of a text are cut from pieces of this many characters, not from its beginning.
PIECE = 256
#: Pairs of spans from which a sweep is faster than comparing them all.
MANY = 4096
SPANS = "array<struct<start:int,end:int,match:string>>"


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of ints; an empty array stays empty."""
    return running(values, lambda a, b: a + b)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of ``op`` (associative, 0 changes nothing) over an array of ints of 0 or more; an empty array stays empty."""

    def along(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
        local = F.zip_with(blocks, along(totals, F.lit(0)), lambda b, o: F.when(b.isNotNull(), F.slice(along(b, o), 2, BLOCK)).otherwise(F.array().cast("array<int>")))
        return F.flatten(local)

    return F.when(F.size(values) > 0, let(values, whole)).otherwise(F.array().cast("array<int>"))


def pieces(text: Column) -> Column:
    """``text`` in pieces of ``PIECE`` characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, at: Column, n: Column) -> Column:
    """``n`` characters from place ``at`` of the text whose ``pieces`` are ``parts``; its cost doesn't depend on ``at``."""
    first = F.floor(at / PIECE).cast("int")
    last = F.floor((at + F.greatest(n, F.lit(1)) - 1) / PIECE).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(n > 0, F.substring(near, at - first * PIECE + 1, n)).otherwise(F.lit(""))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart_from(spans: Column, others: Column, many: int = MANY) -> Column:
    """Those of ``spans``, which don't overlap one another and are in order, that overlap none of ``others`` (start, end).

    Few are compared directly.  Many are swept: up to the end of a span, no other one may reach beyond its start.
    """
    plain = F.filter(spans, lambda t: ~F.exists(others, lambda s: overlap(s, t)))

    def swept(d: Column) -> Column:
        ends = F.transform(d["others"], lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("k"), s["end"].alias("end"), F.lit(-1).alias("i"), F.lit(0).alias("start")))
        asks = F.transform(d["spans"], lambda t, i: F.struct(t["end"].alias("at"), F.lit(0).alias("k"), F.lit(0).alias("end"), i.alias("i"), t["start"].alias("start")))

        def kept(events: Column) -> Column:
            reach = running(F.transform(events, lambda e: e["end"]), lambda a, b: F.greatest(a, b))
            free = F.zip_with(events, reach, lambda e, r: F.when((e["k"] == 0) & (r <= e["start"]), e["i"]))
            return F.transform(F.filter(free, lambda i: i.isNotNull()), lambda i: F.get(d["spans"], i))

        return let(F.array_sort(F.concat(ends, asks)), kept)

    size = F.size(spans).cast("long") * F.size(others)
    return F.when(size <= many, plain).otherwise(let(F.struct(spans.alias("spans"), others.alias("others")), swept))


def clusters(spans: Column) -> Column:
    """``spans`` (start, end first), sorted, as an array of arrays: overlapping ones, also over others, are together."""

    def parted(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.greatest(F.size(reach) - 1, F.lit(0))))
        heads = F.filter(F.zip_with(F.transform(s, lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"))), before, lambda x, r: F.when((x["i"] == 0) | (x["start"] >= r), x["i"])), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda at, j: F.slice(s, at + 1, F.coalesce(F.get(h, j + 1), F.size(s)) - at)))

    return let(F.array_sort(spans), parted)


def _steps(matches: Column, parts: Column) -> Column:
    """From the start of each match back to that of the one before it."""
    before = F.concat(F.array(F.lit(0)), F.transform(matches, F.length))
    return F.slice(F.zip_with(parts, before, lambda p, m: p + m), F.lit(1), F.size(matches))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], only_if: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each name of ``patterns``, an array of spans of its leftmost non-overlapping matches.

    ``text`` must not be null.  ``only_if`` may name a cheap condition without which there is no match.
    """
    only_if = only_if or {}
    none = F.array().cast("array<string>")
    for name, pattern in patterns.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        df = df.withColumn(f"{name}_m", F.when(only_if[name], found).otherwise(none) if name in only_if else found)
    for name, pattern in patterns.items():
        parts = F.split(F.col(text), pattern, -1)
        df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_m") > 0, F.transform(parts, F.length)).otherwise(F.array().cast("array<int>")))
    for name in patterns:
        df = df.withColumn(f"{name}_p", _steps(F.col(f"{name}_m"), F.col(f"{name}_p")))
    for name in patterns:
        df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_m") > 0, prefix_sums(F.col(f"{name}_p"))).otherwise(F.array().cast("array<int>")))
    for name in patterns:
        spans = F.zip_with(f"{name}_p", f"{name}_m", lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
        df = df.withColumn(name, F.when(F.size(f"{name}_m") > 0, spans).otherwise(F.array().cast(SPANS)))
    return df.drop(*(f"{name}_{x}" for name in patterns for x in "mp"))


def tagged(spans: Column, order: int, kind: str) -> Column:
    """Spans as (start, order of the kind, end, kind), which sort as results list them."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of tagged spans by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span of ``spans`` (start, end, kind) replaced by its kind in brackets; overlapping ones become one, of the first kind.

    Spans that begin at one place are taken longest first.  The cost follows the text and the spans, not their product.
    """

    def built(d: Column) -> Column:
        reach = running(F.transform(d["spans"], lambda s: -s["neg"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.greatest(F.size(reach) - 1, F.lit(0))))
        parts = F.zip_with(d["spans"], before, lambda s, at: F.when(s["start"] >= at, F.concat(cut(d["parts"], at, s["start"] - at), F.lit("["), s["kind"], F.lit("]"))))
        end = F.element_at(reach, -1)
        return F.concat(F.array_join(parts, ""), cut(d["parts"], end, F.greatest(d["n"] - end, F.lit(0))))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(F.struct(ordered.alias("spans"), pieces(text).alias("parts"), F.length(text).alias("n")), built)).otherwise(text)
