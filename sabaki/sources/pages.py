"""Pages of recognised text to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_number(image: Column) -> Column:
    """The number at the end of an image's name (page-12.png), 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(image, r"-([0-9]+)\.png$", 1), F.lit("")).try_cast("int"), F.lit(0))


def assemble_pages(pages: DataFrame, key: str) -> DataFrame:
    """The text of each document of ``pages`` (key, image, text): pages by number, each under its heading.

    Names that aren't ``page-*.png`` are passed over.
    """
    images = pages.filter(F.col("image").startswith("page-") & F.col("image").endswith(".png"))
    ordered = images.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page_number(F.col("image")).alias("n"), F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    parts = F.transform("pages", lambda p, i: F.concat(F.lit("--- PAGE "), (i + 1).cast("string"), F.lit(" ---\n"), p["text"], F.lit("\n\n")))
    return ordered.select(key, F.array_join(parts, "").alias("text"))
