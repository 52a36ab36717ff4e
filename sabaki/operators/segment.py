"""Lines of a statement to blocks, one block a vehicle.

Every step is an array expression over one document, so nothing is shuffled.  Grouping depends on
how long the running block is, which no window can express; it is a fold over marks made beforehand
that keeps the starts of blocks only, and grows them a part of the lines at a time, since an array
grown at every line or block would cost the square of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean_lines, let, mentions

#: Lines of a part, within which an array of starts grows.
PART = 256


def is_noise(line: Column, own_names: tuple[str, ...] = ()) -> Column:
    """Whether a line is a header, a footer, transport, a summary or an address (``own_names``: of the tenant)."""
    noise = mentions(line, rules.FOOTER_MARKERS + rules.TRANSPORT_KEYWORDS + (rules.ADDRESSEE,))
    noise = noise | (line.rlike("^[0-9,]+$") & line.contains(",")) | line.rlike("^[0-9]+頁")
    noise = noise | line.rlike(rf"[0-9]{{4}}{rules.JS_SPACE}*年{rules.JS_SPACE}*[0-9]{{2}}{rules.JS_SPACE}*月")
    for name in own_names:
        noise = noise | line.contains(name)
    return noise


def data_lines(lines: Column, own_names: tuple[str, ...] = ()) -> Column:
    return F.filter(lines, lambda x: ~is_noise(x, own_names))


def _mark(line: Column) -> Column:
    prefix = line.rlike("^(" + rules.any_of(rules.BLOCK_PREFIXES) + ")")
    venue = line.rlike("^(" + rules.any_of(rules.VENUES) + ")( |$)")
    return F.struct((prefix | venue).alias("always"), line.rlike(rules.LOT).alias("lot"), line.rlike(rules.CHASSIS).alias("chassis"))


def block_starts(lines: Column) -> Column:
    """Zero-based positions at which blocks begin.

    Within a block, a new one begins at a prefix, at a venue that stands alone, at a lot number once
    the block has three lines, and at a chassis once it has one.
    """
    none = F.array().cast("array<int>")

    def step(acc: Column, m: Column) -> Column:
        new = (acc["n"] == 0) | m["always"] | (m["lot"] & (acc["n"] >= 3)) | (acc["has"] & m["chassis"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(new, m["chassis"]).otherwise(acc["has"] | m["chassis"]).alias("has"),
            F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    def along(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["i"].alias("i"), acc["n"].alias("n"), acc["has"].alias("has"), none.alias("starts"))
        return let(F.aggregate(part, begin, step), lambda r: F.struct(r["i"].alias("i"), r["n"].alias("n"), r["has"].alias("has"), F.concat(acc["parts"], F.array(r["starts"])).alias("parts")))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("has"), F.array().cast("array<array<int>>").alias("parts"))
    parts = let(F.transform(lines, _mark), lambda m: F.transform(F.sequence(F.lit(0), F.floor(F.size(m) / PART).cast("int")), lambda p: F.slice(m, p * PART + 1, F.lit(PART))))
    return F.aggregate(parts, zero, along, lambda acc: F.flatten(acc["parts"]))


def blocks_at(lines: Column, starts: Column) -> Column:
    """The lines of each block, in order."""
    return F.transform(starts, lambda s, i: F.slice(lines, s + 1, F.coalesce(F.get(starts, i + 1), F.size(lines)) - s))


def is_valid_block(lines: Column) -> Column:
    """Three lines or more, no transport word (none is left after ``data_lines``), and a chassis."""
    long_enough = F.size(lines) >= 3
    return long_enough & let(F.array_join(lines, "\n"), lambda j: j.rlike(rules.CHASSIS) & ~mentions(j, rules.TRANSPORT_KEYWORDS))


def segment(docs: DataFrame, own_names: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (with text) and ``lines`` (data lines), ``blocks`` (all) and ``valid_blocks``."""
    df = docs.withColumn("lines", data_lines(clean_lines(F.col("text")), own_names))
    df = df.withColumn("starts", block_starts(F.col("lines")))
    df = df.withColumn("blocks", blocks_at(F.col("lines"), F.col("starts"))).drop("starts")
    return df.withColumn("valid_blocks", F.filter("blocks", is_valid_block))
