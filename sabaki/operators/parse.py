"""Blocks to raw rows by template.

A template is an entry of ``TEMPLATES``: a function from the facts of a block (below) to its fields.
All templates are built into one expression, so documents of different templates need no branches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import digits, document_year, first_match, let, parse_number, template_of, whole_lines


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def facts(lines: Column, template: Column) -> Column:
    """What templates look at: chassis, date lines, packed, subtotal and lot lines, money candidates; each only where its template asks for it."""

    def money(xs: Column) -> Column:
        return F.transform(F.filter(F.transform(xs, digits), lambda d: F.length(d).between(5, 8)), lambda d: d.try_cast("bigint"))

    def of(joined: Column) -> Column:
        uss, generic = template == "USS", template == FALLBACK
        dated = F.filter(lines, lambda x: x.rlike(rules.DATE))
        return F.struct(
            first_match(joined, rules.CHASSIS).alias("chassis"),
            F.when(generic, F.get(dated, F.size(dated) - 1)).otherwise(first_match(joined, whole_lines(f"^.*{rules.DATE}.*$"))).alias("dated"),
            F.when(uss, first_match(joined, whole_lines(rules.PACKED))).alias("packed"),
            F.when(uss, first_match(joined, whole_lines(rules.SUBTOTAL))).alias("subtotal"),
            F.when(uss, first_match(joined, whole_lines(rules.LOT))).alias("lot"),
            F.when(template == "TAA", F.filter(money(lines), lambda v: v != 0)).alias("money"),
            F.when(generic, F.sort_array(money(F.filter(lines, lambda x: ~x.rlike(rules.DATE))), asc=False)).alias("undated_money"),
        )

    return let(F.array_join(lines, "\n"), of)


def _date(line: Column, year: Column) -> Column:
    found = F.regexp_substr(line, F.lit(rules.DATE))
    return F.concat(year.cast("string"), F.lit("-"), F.replace(found, F.lit("/"), F.lit("-")))


def _uss(f: Column, year: Column) -> dict[str, Column]:
    line, packed = f["dated"], f["packed"]
    rest = F.regexp_replace(line, f"^.*?{rules.DATE}", "")
    n = F.length(packed)
    total = F.substring(packed, F.lit(1), n - 8).try_cast("bigint")
    return {
        "date": _date(line, year),
        "bid": parse_number(rest),
        "total": F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(F.coalesce(f["subtotal"].try_cast("bigint"), total)),
        "recycle": F.substring(packed, n - 7, F.lit(4)).try_cast("bigint"),
        "jidosha": F.substring(packed, n - 3, F.lit(4)).try_cast("bigint"),
        "lot_number": f["lot"].try_cast("int"),
    }


def _taa(f: Column, year: Column) -> dict[str, Column]:
    a, b = F.get(f["money"], F.lit(0)), F.get(f["money"], F.lit(1))
    return {
        "date": _date(f["dated"], year),
        "bid": F.when(b.isNotNull(), F.least(a, b)).otherwise(a),
        "total": F.when(b.isNotNull(), F.greatest(a, b)),
        "recycle": _null("bigint"),
        "jidosha": _null("bigint"),
        "lot_number": _null("int"),
    }


def _generic(f: Column, year: Column) -> dict[str, Column]:
    return {
        "date": _date(f["dated"], year),
        "bid": F.get(f["undated_money"], F.lit(1)),
        "total": F.get(f["undated_money"], F.lit(0)),
        "recycle": _null("bigint"),
        "jidosha": _null("bigint"),
        "lot_number": _null("int"),
    }


#: Template to its fields; the last is the fallback.  The auction of a row is its template's name.
TEMPLATES: dict[str, Callable[[Column, Column], dict[str, Column]]] = {"USS": _uss, "TAA": _taa, "GENERIC": _generic}
FALLBACK = "GENERIC"


def math_mismatch(bid: Column, recycle: Column, jidosha: Column, fee: Column, total: Column) -> Column:
    """Whether the total differs from its parts by over 1000 and not by a tenth of the bid, give or take 1000.

    False where bid or total is null or 0.
    """
    zero = F.lit(0).cast("bigint")
    diff = F.abs(total - (bid + F.coalesce(recycle, zero) + F.coalesce(jidosha, zero) + F.coalesce(fee, zero)))
    tax = F.floor(bid / 10)
    return F.coalesce((bid != 0) & (total != 0) & (diff > 1000) & ~(F.abs(diff - tax) < 1000), F.lit(False))


def truthy(x: Column) -> Column:
    """Neither null nor zero nor empty."""
    return F.coalesce(x.cast("string"), F.lit("")).isin("", "0") == F.lit(False)


def parsed(f: Column, template: Column, year: Column) -> Column:
    """The raw row of the facts of a block, without its scores."""
    by = {name: build(f, year) for name, build in TEMPLATES.items()}

    def pick(field: str) -> Column:
        out = by[FALLBACK][field]
        for name in reversed([n for n in TEMPLATES if n != FALLBACK]):
            out = F.when(template == name, by[name][field]).otherwise(out)
        return out

    fields = [pick(k).alias(k) for k in ("date", "bid", "total", "lot_number", "recycle", "jidosha")]
    return F.struct(f["chassis"].alias("chassis"), *fields, template.alias("auction"), _null("string").alias("area"), _null("bigint").alias("auction_fee"))


def scored(p: Column) -> Column:
    """A raw row with its confidence and flags."""
    generic, lost = p["auction"] == FALLBACK, p["chassis"].isNull()
    mismatch = math_mismatch(p["bid"], p["recycle"], p["jidosha"], p["auction_fee"], p["total"])
    checked = truthy(p["bid"]) & truthy(p["total"])
    missing = sum(((~truthy(p[k])).cast("int") for k in ("chassis", "bid", "total")), F.lit(0))
    unnamed = lost & ~generic
    # In tenths, so that sums are exact.
    tenths = 10 - missing - 3 * (mismatch | ~checked).cast("int") - generic.cast("int") - unnamed.cast("int") - 2 * lost.cast("int")
    score = F.greatest(tenths, F.lit(0)) / 10
    some = lambda cond, flag: F.when(cond, F.array(F.lit(flag))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(
        F.array(F.concat(F.lit("TEMPLATE:"), p["auction"])),
        some(generic, "FALLBACK_USED"),
        some(unnamed, "CHASSIS_NOT_FOUND"),
        some(mismatch, "MATH_MISMATCH"),
    )
    names = ("chassis", "bid", "total", "date", "auction", "area", "lot_number", "recycle", "jidosha", "auction_fee")
    return F.struct(*(p[k].alias(k) for k in names), F.when(generic, score * 0.8).otherwise(score).alias("confidence"), flags.alias("flags"))


def passes_gate(row: Column) -> Column:
    """Rows go on only with a chassis, a bid and a total."""
    return truthy(row["chassis"]) & truthy(row["bid"]) & truthy(row["total"])


def parse(segmented: DataFrame, default_year: int) -> DataFrame:
    """Add ``year``, ``template`` and ``raw_rows`` (one for each valid block, in order)."""
    df = segmented.withColumn("year", document_year(F.col("text"), default_year)).withColumn("template", template_of(F.col("text")))
    df = df.withColumn("raw_rows", F.transform("valid_blocks", lambda b: facts(b, F.col("template"))))
    df = df.withColumn("raw_rows", F.transform("raw_rows", lambda f: parsed(f, F.col("template"), F.col("year"))))
    return df.withColumn("raw_rows", F.transform("raw_rows", scored))
