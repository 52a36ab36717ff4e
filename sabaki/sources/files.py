"""Files as tables: uploads, expected results, glossaries, and the seam for text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship
from ..functions.text import trim_js

UPLOAD_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("auction", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("lotNumber", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("chassis", T.StringType()),
        T.StructField("bid", T.LongType()),
        T.StructField("recycle", T.LongType()),
        T.StructField("jidosha", T.LongType()),
        T.StructField("auctionFee", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
    ]
)
#: Declared, as an empty list of records would be inferred as strings.
TRUTH_SCHEMA = T.StructType([T.StructField("records", T.ArrayType(RECORD_SCHEMA))])
GLOSSARY_SCHEMA = "category string, japanese string, english string, priority int, isLocked boolean"
#: Sizes and names that the conversion service takes.
CONVERT_MAX_BYTES = 50 * 1024 * 1024


def base_name(path: Column) -> Column:
    """The file's name without folders and without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _named(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    mime = F.when(F.lower(name).endswith(".pdf"), "application/pdf").otherwise("application/octet-stream")
    tenant = F.url_decode(F.nullif(F.regexp_extract("path", r"/tenant=([^/]+)/", 1), F.lit("")))
    return files.select("path", name.alias("name"), mime.alias("mime"), F.col("length").alias("size"), F.col("modificationTime").alias("arrival"), tenant.alias("tenant_id"), "content")


def read_uploads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, mime, size, arrival, tenant_id and content of every file of a landing folder.

    Files of a tenant lie under a folder ``tenant=<id>`` (encoded as in URLs); others have none.
    """
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def stream_uploads(spark: SparkSession, folder: str, max_files: int = 100, archive: str | None = None) -> DataFrame:
    """As ``read_uploads``, for files as they arrive, at most ``max_files`` in a batch (the queue's capacity).

    A file's own time says nothing about its arrival, so none is too old (Spark passes over files a week older than
    the newest unless told).  The stream remembers every file of the folder; where that is too many, files that are
    done move to ``archive``.
    """
    stream = spark.readStream.schema(UPLOAD_SCHEMA).format("binaryFile").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("maxFileAge", "36500d")
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _named(stream.load(folder))


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """base and records of each JSON file of expected results."""
    truth = spark.read.schema(TRUTH_SCHEMA).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return truth.select(base_name(F.col("_metadata.file_path")).alias("base"), "records")


def pair_with_truth(documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents (name) with the expected records of the same base name; ``has_truth`` is false without any."""
    return documents.withColumn("base", base_name(F.col("name"))).join(truth, "base", "left").withColumn("has_truth", F.col("records").isNotNull())


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary seed of a JSON array, as rows without a tenant, in the form that ``upsert_glossary`` takes."""
    rows = spark.read.schema(GLOSSARY_SCHEMA).option("multiLine", "true").json(path)
    return rows.select(F.lit(None).cast("bigint").alias("tenant_id"), "category", "japanese", "english", "priority", F.col("isLocked").alias("is_locked"), F.monotonically_increasing_id().alias("nth"))


def extract_text(files: DataFrame, reader: Callable[[bytes], str], key: str = "path", strict: bool = False, errors: bool = False) -> DataFrame:
    """``key`` and ``text`` of every file (content), by a reader for its format; this is where a PDF or OCR library is put.

    An error gives an empty text, or fails the job if ``strict``; with ``errors`` a column ``error`` tells
    what the reader raised.  A file is one call of ``reader``, and batches hold a few files, as contents
    may be large.
    """

    def read(content: bytes | None) -> tuple[str, str | None]:
        try:
            return reader(bytes(content or b"")) or "", None
        except Exception as e:
            if strict:
                raise
            return "", str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read(c) for c in b["content"]]
            more = {"error": pd.Series([e for _, e in got], dtype=object, index=b.index)} if errors else {}
            yield pd.DataFrame({key: b[key], "text": [t for t, _ in got], **more})

    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"`{key}` {kind}, text string" + ", error string" * errors)


def with_ocr_fallback(texts: DataFrame, recognised: DataFrame, key: str = "path") -> DataFrame:
    """Texts, with the recognised ones where fewer than ten characters were found."""
    short = F.length(trim_js(F.coalesce("text", F.lit("")))) < 10
    other = recognised.select(key, F.col("text").alias("recognised"))
    return texts.join(other, key, "left").select(key, F.when(short, F.coalesce("recognised", F.lit(""))).otherwise(F.col("text")).alias("text"))


def conversion_rejection(name: Column, content: Column, max_bytes: int | None = CONVERT_MAX_BYTES) -> Column:
    """Status with which a conversion is refused, or null: no PDF name 400, empty 400, too large 413 (no limit for tables)."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    out = F.when(~F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False)), 400).when(size == 0, 400)
    return out if max_bytes is None else out.when(size > max_bytes, 413)


def block_tree(converted: DataFrame, key: str, column: str = "json") -> DataFrame:
    """Rows of the blocks of a converted document (JSON text): its ``children``, or the whole where it has no such field; none of text that isn't JSON."""
    whole = F.try_parse_json(column)
    children = F.try_variant_get(whole, "$.children", "array<variant>")
    blocks = F.coalesce(children, F.when(whole.isNotNull(), F.array(whole)))
    rows = converted.select(key, F.posexplode_outer(blocks).alias("block_id", "block")).filter("block_id IS NOT NULL")
    return rows.select(key, "block_id", F.try_variant_get("block", "$.block_type", "string").alias("block_type"), F.to_json("block").alias("block"))
