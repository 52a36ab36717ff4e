"""The registered queries: each applies one operator to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import exploded
from ..functions.text import clean_lines, content_hash, document_year, language_of, template_of
from ..operators import api, classify, evaluate, ingest, metrics, resilience, ui
from ..operators.parse import math_mismatch, parse
from ..operators.segment import segment
from ..operators.summarise import erp_rows, line_items
from ..operators.validate import area_of, is_hard_reject, validate, validate_records
from ..sources.pages import assemble_pages
from .extraction import DEFAULT_YEAR, extract
from .synth import statements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(column: str | Column, by: str = "|") -> Column:
    return F.array_join(column, by)


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(statements(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(statements(spark, sf_dir))


def _validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate(parse(_segmented(spark, sf_dir), DEFAULT_YEAR))
    return exploded(df, ["doc_id"], "validated").select("doc_id", "pos", "r.*")


@query
def text_normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", clean_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), _joined("lines", "\n").alias("normalized"))


@query
def line_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("doc_id", F.size("lines").alias("n_lines"), _joined("lines", "\n").alias("kept"))


def _blocks(df: DataFrame, column: str) -> DataFrame:
    return exploded(df, ["doc_id"], column, "block_id", "b").select("doc_id", "block_id", _joined("b").alias("lines"))


@query
def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(_segmented(spark, sf_dir), "blocks")


@query
def valid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(_segmented(spark, sf_dir), "valid_blocks")


@query
def template_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("doc_id", template_of(F.col("text")).alias("template"))


@query
def document_year_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("doc_id", document_year(F.col("text"), DEFAULT_YEAR).alias("year"))


QUERIES["document_year"] = QUERIES.pop("document_year_of")


def _raw(spark: SparkSession, sf_dir: str, template: str | None = None) -> DataFrame:
    df = parse(_segmented(spark, sf_dir), DEFAULT_YEAR)
    df = df.filter(F.col("template") == template) if template else df
    return exploded(df, ["doc_id"], "raw_rows").select("doc_id", "pos", "r.*")


def _raw_view(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "pos", "chassis", "date", "bid", "total", "lot_number", "recycle", "jidosha", "confidence", _joined("flags").alias("flags"))


@query
def parse_uss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(_raw(spark, sf_dir, "USS"))


@query
def parse_taa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(_raw(spark, sf_dir, "TAA"))


@query
def parse_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_view(_raw(spark, sf_dir, "GENERIC"))


@query
def math_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, none = F.col("l_extendedprice"), F.lit(None).cast("bigint")
    total = F.floor(price * (1 + F.col("l_tax"))) * 10 + F.col("l_suppkey") % 1500
    mismatch = math_mismatch(F.floor(price) * 10, F.col("l_partkey") % 500, none, none, total)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", mismatch.alias("mismatch"))


@query
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("doc_id", "pos", "confidence")


_RECORD = ("doc_id", "pos", "date", "auction", "area", "lot_number", "year", "chassis", "bid", "recycle", "jidosha", "auction_fee", "total", "confidence")


@query
def map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate(parse(_segmented(spark, sf_dir), DEFAULT_YEAR))
    df = exploded(df, ["doc_id"], "mapped").select("doc_id", "pos", "r.*")
    return df.select(*_RECORD, _joined("flags").alias("flags"))


@query
def area_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    area = F.when(k == 0, "東京").when(k == 1, "神戸").when(k == 2, "熊本")
    return _table(spark, sf_dir, "customer").select("c_custkey", area_of(area).alias("area"))


@query
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated_rows(spark, sf_dir).select(*_RECORD, _joined("flags").alias("flags"), "valid")


@query
def hard_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection can't occur after the row gate, so rows go to the validator directly."""
    key, none = F.col("p_partkey"), F.lit(None)
    row = F.struct(
        F.lit("").alias("date"),
        F.lit("TAA").alias("auction"),
        F.lit("").alias("area"),
        none.cast("int").alias("lot_number"),
        F.lit(DEFAULT_YEAR).alias("year"),
        F.when(key % 5 == 0, none).when(key % 5 == 1, "bad chassis").otherwise(F.concat(F.lit("KSP-"), key.cast("string"))).alias("chassis"),
        F.lit(0).cast("bigint").alias("bid"),
        *(none.cast("bigint").alias(c) for c in ("recycle", "jidosha", "auction_fee")),
        F.when(key % 7 == 0, F.lit(0).cast("bigint")).when(key % 7 == 1, none).otherwise(F.floor("p_retailprice")).alias("total"),
        F.lit(0.0).alias("confidence"),
        F.array(F.lit("TEMPLATE:TAA")).alias("flags"),
    )
    df = validate_records(_table(spark, sf_dir, "part").select("p_partkey", F.array(row).alias("rows")), "rows")
    df = exploded(df, ["p_partkey"], "validated")
    return df.select("p_partkey", "r.confidence", _joined("r.flags").alias("flags"), "r.valid", is_hard_reject(F.col("r")).alias("rejected"))


@query
def document_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("doc_id", F.size("records").cast("long").alias("n_records"), "status", "confidence", _joined("errors").alias("errors"), _joined("flags").alias("flags"), "document_status")


@query
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).groupBy("document_status", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def line_items_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(_results(spark, sf_dir))


@query
def erp_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erp_rows(_results(spark, sf_dir))


@query
def classify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", language_of(F.col("text")).alias("language"))


@query
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.coalesce("source", F.lit("")), F.lit(".pdf"))
    both = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), name)
    return _table(spark, sf_dir, "documents").select("doc_id", classify.auction_score(both).alias("score"), classify.document_type(F.col("text"), name).alias("document_type"))


@query
def classify_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = statements(spark, sf_dir).withColumns({"filename": F.lit("statement.pdf"), "pages": F.lit(1)})
    return classify.classify(df).select("doc_id", "document_type", "language")


@query
def is_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", classify.is_scanned(F.col("text"), F.col("doc_id") % 40).alias("is_scanned"))


@query
def upload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html").alias("mime"),
        F.col("url").alias("name"),
        F.when(F.col("page_id") % 2 == 0, F.overlay("html", F.lit("%PDF"), F.lit(1), F.lit(4))).otherwise(F.col("html")).cast("binary").alias("content"),
    )
    return ingest.validate_uploads(pages, max_bytes=4000).select("page_id", "rejection")


@query
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("file_hash"))


QUERIES["content_hash"] = QUERIES.pop("content_hashes")


@query
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ingest.with_hash(_table(spark, sf_dir, "documents"), "text")
    uploads = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("upload_id"), "file_hash", F.col("source").alias("tenant_id"), F.col("doc_id").alias("arrival"))
    existing = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("document_id"), "file_hash", F.col("source").alias("tenant_id"), F.when(F.col("doc_id") % 5 == 0, "FAILED").otherwise("NEEDS_REVIEW").alias("status"), F.col("doc_id").alias("created"))
    return ingest.dedup_uploads(uploads, existing)


@query
def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))) * 100
    return _table(spark, sf_dir, "documents").select("doc_id", ingest.file_priority(size).alias("priority"))


@query
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", 1).otherwise(2).alias("priority"), F.col("ts").alias("arrival"))
    return ingest.job_order(jobs).select("job_id", "priority", "place")


@query
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "click", "waiting").when(t == "view", "active").when(t == "error", "failed").otherwise("completed")
    return ingest.backpressure(_table(spark, sf_dir, "events").select(state.alias("state")))


@query
def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_type", F.col("props").alias("details"), F.col("ts").alias("at"))
    return ingest.audit_events(*(events.filter(F.col("event_type") == t) for t in ("signup", "purchase", "error")))


@query
def audit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter("user_id = 7").select("event_id", "event_type", "ts")


@query
def audited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, k = F.col("page_id"), F.col("page_id") % 5
    url = F.when(k == 0, F.concat(F.lit("/api/documents/a1-"), page.cast("string"), F.lit("/raw"))).when(k == 1, F.concat(F.lit("/api/documents/"), page.cast("string"), F.lit("/audit"))).when(k == 2, "/api/documents").otherwise(F.col("url"))
    method = F.when(page % 2 == 0, "POST").otherwise("GET")
    return _table(spark, sf_dir, "pages").select("page_id", ingest.is_audited_request(method, url).alias("audited"))


@query
def malware_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    said = F.when(page % 5 == 0, "f: OK").when(page % 5 == 1, "f: Eicar FOUND")
    return _table(spark, sf_dir, "pages").select("page_id", ingest.passes_scan(page % 4 != 0, page % 3 != 0, said).alias("passes"))


@query
def latest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_stage(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query
def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    names = [F.col("p_brand").alias("category"), F.col("p_type").alias("japanese")]
    seed = part.filter("p_partkey % 2 = 0").select(F.lit(None).cast("bigint").alias("tenant_id"), *names, F.col("p_name").alias("english"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_size END").alias("priority"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN true END").alias("is_locked"), F.col("p_partkey").alias("nth"))
    tenant = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 1L END")
    current = part.filter("p_partkey % 2 = 1").select(tenant.alias("tenant_id"), *names).distinct()
    current = current.withColumns({"english": F.lit("old"), "priority": F.lit(1), "is_locked": F.lit(False)})
    return ingest.upsert_glossary(current, seed)


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ingest.cascade_delete(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), deleted, "l_orderkey")


@query
def parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    df = _table(spark, sf_dir, "orders").join(children, "o_orderkey", "left")
    return df.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected records that are the validated ones but for planned differences, compared; and the documents."""
    rows = _validated_rows(spark, sf_dir)
    doc, pos = F.col("doc_id"), F.col("pos")
    truth = rows.filter(doc % 7 != 0).select(
        "doc_id",
        "pos",
        "chassis",
        F.when(pos % 4 == 3, F.col("bid") + 1).otherwise(F.col("bid")).alias("bid"),
        F.when(doc % 11 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("total"),
        "date",
        "auction",
        F.when(doc % 13 != 0, F.col("lot_number")).alias("lot_number"),
    )
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    lost = orders.filter((doc % 7 != 0) & (doc % 17 == 0)).select("doc_id", F.lit(1000).alias("pos"), F.lit("NONE-1").alias("chassis"), F.lit(1).cast("bigint").alias("bid"), F.lit(1).cast("bigint").alias("total"), F.lit("").alias("date"), F.lit("USS").alias("auction"), F.lit(None).cast("int").alias("lot_number"))
    documents = orders.select("doc_id", (doc % 7 != 0).alias("has_truth"), (doc % 19 != 0).alias("has_records"))
    return evaluate.compare_records(truth.unionByName(lost), rows), documents


@query
def evaluate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[0]


@query
def evaluate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared, documents = _evaluated(spark, sf_dir)
    return evaluate.accuracy(evaluate.document_scores(compared), documents)


@query
def evaluate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluation_summary(evaluate_documents(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "ts", "event_id", "value")


@query
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(_samples(spark, sf_dir).withColumn("by", F.lit(1)))


@query
def metrics_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gauges(_samples(spark, sf_dir), ["ts", "event_id"])


@query
def metrics_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(metrics.last_samples(_samples(spark, sf_dir), ["ts", "event_id"]))


@query
def latency_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_samples(_samples(spark, sf_dir), ["ts", "event_id"], keep=500).select("metric", "event_id", "value")


@query
def timed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _samples(spark, sf_dir).withColumn("failed", F.col("value") > 50)
    return df.groupBy(metrics.timed_metric("metric", "failed").alias("metric")).agg(F.count(F.lit(1)).alias("n"))


@query
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, version = content_hash(F.col("text")), F.lit("2")
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        resilience.cache_key("extraction", "app", version, digest).alias("extraction_key"),
        resilience.cache_key("translation", "app", version, F.lit("m1"), digest).alias("translation_key"),
        resilience.cache_key("segmentation", "app", version, digest).alias("segmentation_key"),
    )


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("purchase", "signup"), "set").otherwise("get")
    ops = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("op_id"), op.alias("op"))
    return resilience.cache_lookups(ops, resilience.TTL_SECONDS["extraction"])


@query
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("key", "op_id", "written_at", "hit")


@query
def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_ratio(_lookups(spark, sf_dir))


@query
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user are failures; two open the circuit, for ten hours."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', CAST(ts AS TIMESTAMP_NTZ)) div 1000")
    calls = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at_ms"), F.col("event_id").alias("call_id"), (F.col("event_type") != "error").alias("ok"))
    return resilience.circuit_breaker(calls, threshold=2, recovery_ms=36_000_000).select("key", "call_id", "met", "allowed", "state", "failures")


@query
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("job_id"))
    return resilience.retry_schedule(jobs)


@query
def ocr_page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("page-"), F.col("turn").cast("string"), F.lit(".png")).alias("image"), "text")
    return assemble_pages(pages, "conv_id")


@query
def ui_confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return _validated_rows(spark, sf_dir).select("doc_id", "pos", ui.confidence_band(c).alias("band"), ui.shown_percent(c).alias("shown_percent"))


def _page_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads of two tenants and none."""
    tenant = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("t"), (F.col("page_id") % 3).cast("string")))
    pages = _table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("document_id"), tenant.alias("tenant_id"), content_hash(F.col("html")).alias("file_hash"), F.col("url").alias("name"), F.lit("application/pdf").alias("mime"), F.octet_length("html").alias("size"), F.col("page_id").alias("arrival"))


@query
def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upload_rows(_page_uploads(spark, sf_dir))


@query
def upload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upload_audit(_page_uploads(spark, sf_dir))


@query
def breaker_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call takes its event's value; those over 60 are too slow, whether or not they gave an error."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', CAST(ts AS TIMESTAMP_NTZ)) div 1000")
    calls = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at_ms"), F.col("event_id").alias("call_id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("took_ms"))
    return resilience.circuit_breaker(calls, threshold=2, recovery_ms=36_000_000, timeout_ms=60).select("key", "call_id", "met", "allowed", "state", "failures")


@query
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("cache_key"), F.col("event_id").alias("written_at"), F.lit(86_400).alias("ttl_s"), F.col("event_type").alias("payload"))
    cache = events.filter("payload = 'signup'").groupBy("cache_key").agg(F.max_by(F.struct(*events.columns), "written_at").alias("v")).select("v.*")
    return resilience.cache_writes(cache, events.filter("payload = 'purchase'"))


@query
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 1000).alias("o_orderkey"))
    return ingest.lookup_by_key(asked, _table(spark, sf_dir, "orders"), "o_orderkey")[1]


@query
def found_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 1000).alias("o_orderkey"))
    return ingest.lookup_by_key(asked, _table(spark, sf_dir, "orders"), "o_orderkey")[0].select("o_orderkey", "o_orderstatus")


@query
def children_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("part"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    listed = F.transform("children", lambda c: F.concat_ws(":", c["n"].cast("string"), c["part"].cast("string")))
    return ingest.with_children(orders, items, "o_orderkey", "n").select("o_orderkey", _joined(F.array_sort(listed), ",").alias("children"))


@query
def ui_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("QUEUED", "PROCESSING", "CLASSIFIED", "EXTRACTED", "STORED", "COMPLETED", "NEEDS_REVIEW", "FAILED", "")
    k = F.col("o_orderkey") % 10
    status = F.element_at(F.array(*map(F.lit, names)), F.when(k < 9, k + 1).cast("int"))
    price = F.when(k != 5, F.floor("o_totalprice"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", ui.badge(status).alias("badge"), ui.progress_percent(status).alias("progress"), ui.money(price).alias("money"))


@query
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    key = F.when(k == 0, "right").when(k == 1, "wrong").when(k == 2, "")
    status = F.when(F.col("page_id") % 3 == 0, 404).when(F.col("page_id") % 3 == 1, 400)
    message = F.when(F.col("page_id") % 5 == 0, "gone")
    body = api.error_envelope(status, message, F.col("url"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return _table(spark, sf_dir, "pages").select("page_id", api.key_rejection(key, F.lit("right")).alias("rejection"), F.get_json_object(body, "$.statusCode").alias("status"), F.get_json_object(body, "$.message").alias("message"), F.get_json_object(body, "$.path").alias("path"))


@query
def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that are kept by default."""
    return metrics.last_samples(_samples(spark, sf_dir), ["ts", "event_id"]).select("metric", "event_id", "value")
