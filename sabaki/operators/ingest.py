"""Checks, deduplication and bookkeeping of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash

MAX_BYTES = 20 * 1024 * 1024
QUEUE_CAPACITY = 100
URGENT_BYTES = 1024 * 1024
DEFAULT_TENANT = "default-tenant"


def is_pdf_name(mime: Column, name: Column) -> Column:
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def has_pdf_magic(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def validate_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``rejection``: the first check that a file (name, mime, content) fails, or null."""
    size = F.octet_length("content")
    reason = (
        F.when(~is_pdf_name(F.col("mime"), F.col("name")), "NOT_A_PDF")
        .when(size > max_bytes, "TOO_LARGE")
        .when(~has_pdf_magic(F.col("content")), "BAD_MAGIC")
    )
    return files.withColumn("rejection", reason)


def passes_scan(scanner_present: Column, file_present: Column, output: Column) -> Column:
    """Verdict of a malware scan: no scanner passes, a missing file fails, else the output must say OK."""
    return F.when(~scanner_present, True).when(~file_present, False).otherwise(F.coalesce(output.contains("OK"), F.lit(False)))


def file_priority(size: Column) -> Column:
    return F.when(size < URGENT_BYTES, 1).otherwise(2)


def tenant_of(tenant: Column) -> Column:
    return F.coalesce(tenant, F.lit(DEFAULT_TENANT))


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash", content_hash(F.col(content)))


def dedup_uploads(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """New uploads that need work, and responses for those that don't.

    ``uploads`` has upload_id, file_hash, tenant_id and arrival; ``existing`` has document_id,
    file_hash, tenant_id, status and created.  An upload whose hash and tenant a document that hasn't
    FAILED already has is answered with that document (the earliest, where the source leaves it
    open), as is a later upload of the batch with the first one.  Adds document_id, job_id, is_duplicate.
    """
    key = ["file_hash", "tenant_id"]
    live = existing.filter("status <> 'FAILED'").groupBy(*key).agg(F.min_by("document_id", F.struct("created", "document_id")).alias("live_id"))
    # Aggregates, not a window: a file that a third of all rows upload is a row a task, and the join's side can be split.
    first = uploads.groupBy(*key).agg(F.min_by("upload_id", F.struct("arrival", "upload_id")).alias("first_id"))
    first = first.join(live, key, "left").select(*(F.col(c).alias(f"own_{c}") for c in key), "first_id", "live_id")
    df = uploads.join(first, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in key])
    target = F.coalesce("live_id", "first_id")
    dup = F.col("live_id").isNotNull() | (F.col("first_id") != F.col("upload_id"))
    return df.select("upload_id", "file_hash", "tenant_id", target.alias("document_id"), F.when(dup, F.concat(F.lit("dup_"), target.cast("string"))).otherwise(F.col("upload_id").cast("string")).alias("job_id"), dup.alias("is_duplicate"))


def upload_rows(uploads: DataFrame) -> DataFrame:
    """The stored row of each new upload (document_id, tenant_id, file_hash, name, mime, size, arrival): queued, not yet processed."""
    return uploads.select(
        "document_id",
        tenant_of(F.col("tenant_id")).alias("tenant_id"),
        "file_hash",
        F.col("name").alias("original_name"),
        F.col("mime").alias("mime_type"),
        F.col("size").cast("long").alias("file_size"),
        F.lit("QUEUED").alias("status"),
        F.lit("INGESTED").alias("stage"),
        F.col("arrival").alias("created"),
    )


def upload_audit(uploads: DataFrame) -> DataFrame:
    """The audit row of each new upload: by its user, with size and name."""
    details = F.to_json(F.struct(F.col("size").cast("long").alias("size"), F.col("name").alias("originalName")))
    return uploads.select("document_id", F.lit("uploaded").alias("action"), F.lit("INGESTED").alias("stage"), F.lit("user").alias("actor"), details.alias("details"), F.col("arrival").alias("created_at"))


def backpressure(jobs: DataFrame, capacity: int = QUEUE_CAPACITY) -> DataFrame:
    """Counts by state of a queue's jobs (state) and whether a further one is rejected."""
    n = lambda s: F.count_if(F.col("state") == s)
    counts = jobs.agg(n("waiting").alias("waiting"), n("active").alias("active"), n("completed").alias("completed"), n("failed").alias("failed"))
    return counts.withColumn("rejects", F.col("waiting") + F.col("active") >= capacity)


def job_order(jobs: DataFrame) -> DataFrame:
    """Jobs (priority, arrival) with their place in the queue, by priority, then arrival, then id.

    Places come from counts by priority and hour, and by second within an hour, so ranking within a
    second is the most that a task does.  Jobs without a priority or an arrival come first.
    """
    bucketed = jobs.withColumn("bucket", F.date_trunc("second", "arrival"))
    hour = F.date_trunc("hour", "bucket")
    seconds = bucketed.groupBy("priority", "bucket").count()
    hours = seconds.groupBy("priority", hour.alias("hour")).agg(F.sum("count").alias("count"))
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(F.col("priority").alias("hour_priority"), "hour", before(Window.orderBy("priority", "hour")).alias("earlier"))
    seconds = seconds.select("priority", "bucket", before(Window.partitionBy("priority", hour).orderBy("bucket")).alias("within"))
    starts = seconds.join(hours, F.col("priority").eqNullSafe(F.col("hour_priority")) & hour.eqNullSafe(F.col("hour")))
    starts = starts.select(F.col("priority").alias("own_priority"), F.col("bucket").alias("own_bucket"), (F.col("earlier") + F.col("within")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("priority", "bucket").orderBy("arrival", "job_id"))
    ranked = bucketed.withColumn("nth", nth).join(starts, F.col("priority").eqNullSafe(F.col("own_priority")) & F.col("bucket").eqNullSafe(F.col("own_bucket")))
    return ranked.withColumn("place", F.col("before") + F.col("nth")).drop("bucket", "nth", "before", "own_priority", "own_bucket")


def audit_events(uploaded: DataFrame, processed: DataFrame, failed: DataFrame) -> DataFrame:
    """One audit log of three sources (document_id, at, details)."""
    stages = ((uploaded, "uploaded", "INGESTED"), (processed, "processed", "EXPOSED"), (failed, "failed", "FAILED"))
    rows = [df.select("document_id", F.lit(a).alias("action"), F.lit(s).alias("stage"), F.lit("system").alias("actor"), "details", F.col("at").alias("created_at")) for df, a, s in stages]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def is_audited_request(method: Column, url: Column) -> Column:
    """Requests that the audit log takes: changes, and reads of raw files or of the log, of one document."""
    return ((method != "GET") | url.contains("/raw") | url.contains("/audit")) & url.rlike("documents/[a-f0-9-]+")


def latest_stage(events: DataFrame, keys: list[str], at: list[str], stage: str) -> DataFrame:
    """The last stage of every key."""
    return events.groupBy(*keys).agg(F.max_by(stage, F.struct(*at)).alias("stage"), F.count(F.lit(1)).alias("n_events"))


def upsert_glossary(current: DataFrame, seed: DataFrame) -> DataFrame:
    """Glossary rows (tenant_id, category, japanese, english, priority, is_locked) after an upsert.

    Keys are null-safe, so an entry without a tenant replaces the one of before; of seed rows with the
    same key the last (``nth``) wins.  Missing priority and lock are 0 and false.
    """
    columns = ["tenant_id", "category", "japanese", "english", "priority", "is_locked"]
    last = seed.groupBy("tenant_id", "category", "japanese").agg(F.max_by(F.struct("english", "priority", "is_locked"), "nth").alias("v"))
    new = last.select("tenant_id", "category", "japanese", "v.english", F.coalesce("v.priority", F.lit(0)).alias("priority"), F.coalesce("v.is_locked", F.lit(False)).alias("is_locked"))
    same = [current[c].eqNullSafe(new[c]) for c in ("tenant_id", "category", "japanese")]
    return current.select(*columns).join(new, same, "left_anti").unionByName(new.select(*columns))


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    """Children whose document isn't among ``deleted``."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def lookup_by_key(asked: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``stored`` that ``asked`` names, and an error row for each key that isn't there."""
    keys = asked.select(key).distinct()
    missing = keys.join(stored.select(key), key, "left_anti")
    return stored.join(keys, key, "left_semi"), missing.select(key, F.concat(F.lit("Document "), F.col(key).cast("string"), F.lit(" not found")).alias("error"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, into: str = "children") -> DataFrame:
    """``parents`` with the array of their ``children`` (all columns but the key) by ``order``; empty without any."""
    own = F.struct(order, *(c for c in children.columns if c not in (key, order)))
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias(into))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(into, F.coalesce(into, F.array().cast(lists.schema[into].dataType)))
