"""Type, language and scan detection of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import hits, language_of


def auction_score(text: Column) -> Column:
    """Points for auction words, chassis numbers and dates packed with amounts."""
    chassis = F.regexp_count(text, F.lit(rules.STRICT_CHASSIS))
    packed = F.regexp_count(text, F.lit(rules.PACKED_DATE))
    points = hits(text, rules.AUCTION_PRIMARY) * 3 + hits(text, rules.AUCTION_SECONDARY)
    points = points + F.when(chassis >= 3, 4).when(chassis >= 1, 2).otherwise(0)
    return points + F.when(packed >= 3, 3).otherwise(0)


def is_purchase(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rules.STRICT_CHASSIS)).between(1, 2) & (hits(text, rules.PURCHASE_KEYWORDS) >= 1)


def document_type(text: Column, filename: Column) -> Column:
    """The first type that fits the text together with the file's name."""
    both = F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(filename, F.lit("")))
    out = F.when(auction_score(both) >= 5, "AUCTION_SHEET").when(is_purchase(both), "PURCHASE")
    for name, japanese, english in rules.TYPE_CASCADE:
        out = out.when(both.contains(japanese) | F.upper(both).contains(english), name)
    return out.otherwise("UNKNOWN")


def is_scanned(text: Column, pages: Column) -> Column:
    """Fewer than 50 characters a page; no pages count as one."""
    n = F.when(F.coalesce(pages, F.lit(0)) == 0, 1).otherwise(pages)
    return F.length(F.coalesce(text, F.lit(""))) / n < 50


def classify(docs: DataFrame, text: str = "text", filename: str = "filename", pages: str = "pages") -> DataFrame:
    """Add ``document_type``, ``language`` and ``is_scanned``.  A type never keeps a document from extraction."""
    return docs.withColumns(
        {
            "document_type": document_type(F.col(text), F.col(filename)),
            "language": language_of(F.col(text)),
            "is_scanned": is_scanned(F.col(text), F.col(pages)),
        }
    )
