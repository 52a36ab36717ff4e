"""Column functions over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def trim_js(text: Column) -> Column:
    """``text`` without white space of any script at its ends (Spark's trim takes ASCII spaces only)."""
    return F.regexp_replace(text, f"^{rules.JS_SPACE}+|{rules.JS_SPACE}+$", "")


def half_width(text: Column) -> Column:
    """Full-width digits and capitals as ASCII; other full-width characters stay."""
    return F.translate(text, rules.FULL_WIDTH, rules.HALF_WIDTH)


def clean_lines(text: Column) -> Column:
    """Trimmed, normalised, non-empty lines in order; null gives none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(F.transform(lines, lambda x: half_width(trim_js(x))), lambda x: F.length(x) > 0)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def parse_number(text: Column) -> Column:
    """The digits of ``text`` as a number; null without a digit or beyond a long."""
    return F.nullif(digits(text), F.lit("")).try_cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(joined: Column, pattern: str) -> Column:
    """What the first line that matches ``pattern`` matches; null if none does.

    ``joined`` holds lines between newlines, none of which ``pattern`` can match, so that one search
    does for all lines.
    """
    return F.regexp_substr(joined, F.lit(pattern))


def whole_lines(pattern: str) -> str:
    """``pattern``, which has anchors, for a search in joined lines; only a newline ends a line."""
    return f"(?md){pattern}"


def mentions(line: Column, words: tuple[str, ...]) -> Column:
    """Whether any of ``words`` occurs.  Most lines are ASCII, and most words aren't, so they are told apart first."""
    plain = [w for w in words if w.isascii()]
    other = tuple(w for w in words if not w.isascii())
    found = line.rlike(r"[^\x00-\x7f]") & line.rlike(rules.any_of(other)) if other else F.lit(False)
    for w in plain:
        found = found | line.contains(w)
    return found


def document_year(text: Column, default_year: int) -> Column:
    """The four digits before the first year sign of the raw text, else ``default_year``."""
    found = F.regexp_extract(text, rf"([0-9]{{4}}){rules.JS_SPACE}*年", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(default_year))


def template_of(text: Column) -> Column:
    """USS, TAA or GENERIC by substrings of the raw text."""
    return F.when(text.contains("USS"), "USS").when(text.contains("TAA"), "TAA").otherwise("GENERIC")


def language_of(text: Column) -> Column:
    """``ja`` if there is any Japanese or full-width character, else ``en``."""
    return F.when(F.coalesce(text, F.lit("")).rlike(rules.JAPANESE), "ja").otherwise("en")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of ``words`` occur in ``text``."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))
