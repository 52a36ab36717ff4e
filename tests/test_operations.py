"""Ingestion, evaluation, metrics, resilience, sources and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sabaki.operators import api, evaluate, ingest, metrics, resilience, ui
from sabaki.operators.resilience import Breaker
from sabaki.plans.extraction import extract
from sabaki.sources import files, sinks
from sabaki.sources.pages import assemble_pages
from sabaki.streaming import uploads
from sabaki.streaming.breaker import stream_circuit_breaker

from .test_extraction import V3, V5


def test_upload_checks(spark):
    rows = [("application/pdf", "a", b"%PDF-1"), ("x", "A.PDF", b"%PDF"), ("x", "a.txt", b"%PDF"), (None, "b.pdf", b"PK"), (None, None, None), ("x", "c.pdf", b"%PDF" + b"0" * 30)]
    got = ingest.validate_uploads(spark.createDataFrame(rows, "mime string, name string, content binary"), max_bytes=20)
    assert [r.rejection for r in got.collect()] == [None, None, "NOT_A_PDF", "BAD_MAGIC", "NOT_A_PDF", "TOO_LARGE"]


def test_priority_and_tenant(spark):
    got = spark.createDataFrame([(1048575, None), (1048576, "t")], "n long, t string").select(ingest.file_priority(F.col("n")), ingest.tenant_of(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1, "default-tenant"), (2, "t")]


def test_backpressure_boundary(spark):
    jobs = lambda n: spark.range(n).select(F.when(F.col("id") % 2 == 0, "waiting").otherwise("active").alias("state"))
    assert [ingest.backpressure(jobs(n)).first().rejects for n in (0, 99, 100)] == [False, False, True]


def record(doc, pos, chassis, bid=1, total=2, lot=None):
    return (doc, pos, chassis, bid, total, "d", "USS", lot)


SCHEMA = "doc_id int, pos int, chassis string, bid long, total long, date string, auction string, lot_number int"


def test_evaluation(spark):
    expected = spark.createDataFrame([record(1, 0, "A-1"), record(1, 1, "A-1"), record(2, 0, "B-1"), record(3, 0, "C-1")], SCHEMA)
    actual = spark.createDataFrame([record(1, 0, "A-1"), record(1, 1, "A-1", bid=9), record(2, 0, "B-1", total=3)], SCHEMA)
    compared = evaluate.compare_records(expected, actual)
    scores = {r.doc_id: r.score for r in evaluate.document_scores(compared).collect()}
    assert scores == {1: 2.0, 2: 0.8, 3: 0.0}
    documents = spark.createDataFrame([(1, True, True), (2, True, True), (3, True, False), (4, False, True), (5, True, True)], "doc_id int, has_truth boolean, has_records boolean")
    per = {r.doc_id: r.accuracy for r in evaluate.accuracy(evaluate.document_scores(compared), documents).collect()}
    assert per == {1: 1.0, 2: 0.8, 3: 0.0, 4: 1.0, 5: 1.0}
    summary = evaluate.evaluation_summary(evaluate.accuracy(evaluate.document_scores(compared), documents)).first()
    assert (summary.documents, summary.failed, summary.passed) == (5, 2, False)
    none = evaluate.evaluation_summary(evaluate.accuracy(evaluate.document_scores(compared), documents.filter("false"))).first()
    assert (none.final_accuracy, none.chassis_accuracy, none.passed) == (1.0, 1.0, False)


def test_histogram(spark):
    rows = spark.createDataFrame([("m", float(v)) for v in (3, 1, 2, 4)], "metric string, value double")
    got = metrics.histogram(rows).first()
    assert tuple(got) == ("m", 4, 1.0, 4.0, 2.5, 3.0, 4.0, 4.0)


def test_last_samples_of_one_metric(spark):
    rows = spark.range(5000).select(F.lit("m").alias("metric"), F.col("id").alias("ts"), F.col("id").cast("double").alias("value"))
    got = metrics.last_samples(rows, ["ts"], keep=100)
    assert got.agg(F.min("ts"), F.count("*")).first() == (4900, 100)


def test_hit_ratio(spark):
    rows = spark.createDataFrame([(True,), (False,), (False,)], "hit boolean")
    assert tuple(metrics.hit_ratio(rows).first()) == (1, 2, 0.333)
    assert tuple(metrics.hit_ratio(rows.filter("false")).first()) == (0, 0, 0.0)


def test_breaker_states():
    b = Breaker(threshold=3, recovery_ms=200)
    assert [b.observe(t, False) for t in (0, 1, 2)] == [("CLOSED", True)] * 3
    assert b.state == "OPEN" and b.observe(50, True) == ("OPEN", False) and b.failures == 3
    assert b.observe(202, True) == ("HALF_OPEN", True) and (b.state, b.failures) == ("CLOSED", 0)
    for t in (300, 301, 302):
        b.observe(t, False)
    assert b.observe(501, True) == ("OPEN", False)
    assert b.observe(502, False) == ("HALF_OPEN", True) and b.state == "OPEN"
    assert b.observe(702, True, took_ms=30_001) == ("HALF_OPEN", True) and b.state == "OPEN"


def test_cache_ttl_boundary(spark):
    ops = spark.sql("SELECT 'k' AS key, TIMESTAMP '2024-01-01 00:00:00' AS at, 0 AS op_id, 'set' AS op UNION ALL SELECT 'k', TIMESTAMP '2024-01-01 00:00:09', 1, 'get' UNION ALL SELECT 'k', TIMESTAMP '2024-01-01 00:00:10', 2, 'get' UNION ALL SELECT 'z', TIMESTAMP '2024-01-01 00:00:01', 3, 'get'")
    assert {r.op_id: r.hit for r in resilience.cache_lookups(ops, 10).collect()} == {1: True, 2: False, 3: False}


def test_retry_schedule(spark):
    got = resilience.retry_schedule(spark.createDataFrame([(1,)], "job_id int")).collect()
    assert [(r.attempt, r.delay_s) for r in got] == [(2, 5), (3, 10)]


def test_glossary_upsert_is_null_safe(spark):
    schema = "tenant_id long, category string, japanese string, english string, priority int, is_locked boolean"
    current = spark.createDataFrame([(None, "unit", "個", "old", 1, False), (7, "unit", "個", "own", 1, True)], schema)
    seed = spark.createDataFrame([(None, "unit", "個", "a", None, None, 1), (None, "unit", "個", "pcs", 10, True, 2)], schema + ", nth int")
    got = sorted((tuple(r) for r in ingest.upsert_glossary(current, seed).collect()), key=str)
    assert got == sorted([(7, "unit", "個", "own", 1, True), (None, "unit", "個", "pcs", 10, True)], key=str)


def test_pages_by_number(spark):
    rows = spark.createDataFrame([(1, "page-10.png", "b"), (1, "page-9.png", "a"), (1, "cover.png", "x"), (1, "page-11.png", None)], "d int, image string, text string")
    assert assemble_pages(rows, "d").first().text == "--- PAGE 1 ---\na\n\n--- PAGE 2 ---\nb\n\n--- PAGE 3 ---\n\n\n"


def test_truth_pairs(spark, tmp_path):
    (tmp_path / "doc 1.json").write_text('{"records": []}')
    (tmp_path / "doc2.json").write_text('{"records": [{"chassis": "A-1", "total": 5}]}')
    truth = files.read_ground_truth(spark, str(tmp_path))
    docs = spark.createDataFrame([("doc2.pdf",), ("other.pdf",)], "name string")
    assert {r.name: r.has_truth for r in files.pair_with_truth(docs, truth).collect()} == {"doc2.pdf": True, "other.pdf": False}


def test_glossary_scan(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"category": "unit", "japanese": "個", "english": "pcs", "priority": 10, "isLocked": True}, {"category": "unit", "japanese": "箱", "english": "box"}]))
    got = files.read_glossary(spark, str(tmp_path / "g.json")).orderBy("english").collect()
    assert [(r.english, r.priority, r.is_locked) for r in got] == [("box", None, None), ("pcs", 10, True)]


def test_text_seam_and_conversion(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError
        return content.decode()

    rows = spark.createDataFrame([("a.pdf", b"text of a"), ("b.pdf", b"bad"), ("c.txt", b"x"), ("d.pdf", b"")], "path string, content binary")
    assert [r.text for r in files.extract_text(rows, reader).orderBy("path").collect()] == ["text of a", "", "x", ""]
    with pytest.raises(Exception):
        files.extract_text(rows, reader, strict=True).collect()
    got = rows.select(files.conversion_rejection(F.col("path"), F.col("content"), 5)).collect()
    assert [r[0] for r in got] == [413, None, 400, 400]
    short = files.with_ocr_fallback(spark.createDataFrame([("a", "x"), ("b", "long enough text")], "path string, text string"), spark.createDataFrame([("a", "seen"), ("b", "no")], "path string, text string"))
    assert {r.path: r.text for r in short.collect()} == {"a": "seen", "b": "long enough text"}


def test_block_tree(spark):
    rows = spark.createDataFrame([(1, '{"children":[{"block_type":"Page"},{"block_type":"Table"}]}'), (2, '{"block_type":"Document"}'), (3, "nonsense"), (4, '{"children":[]}')], "d int, json string")
    got = files.block_tree(rows, "d").orderBy("d", "block_id").collect()
    assert [(r.d, r.block_id, r.block_type) for r in got] == [(1, 0, "Page"), (1, 1, "Table"), (2, 0, "Document")]


def test_sinks(spark, tmp_path):
    current = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    changes = spark.createDataFrame([(None, "c", 1), (None, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in sinks.replace_by_key(current, changes, ["k"], ["n"]).collect()} == {(1, "a"), (None, "d"), (3, "e")}
    snapshot = sinks.metrics_snapshot(spark.createDataFrame([("a", 1)], "metric string, total long"), spark.createDataFrame([("g", 2.0)], "metric string, value double"), metrics.histogram(spark.createDataFrame([("l", 1.0)], "metric string, value double")))
    body = json.loads(snapshot.first().body)
    assert body["counters"] == {"a": 1} and body["latencies"]["l"]["p99"] == 1.0
    assert json.loads(sinks.health(spark).first().body) == {"status": "ok"}


def test_ui(spark):
    row = spark.createDataFrame([(0.0, "QUEUED", 1234567), (0.89, None, None)], "c double, s string, m long")
    got = row.select(ui.confidence_band(F.col("c")), ui.shown_percent(F.col("c")), ui.progress_percent(F.col("s")), ui.badge(F.col("s")), ui.money(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("low", 95, 20, "Queued", "1,234,567"), ("medium", 89, 0, "Unknown", "-")]


def test_upload_stream_equals_batch(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    for name, text in (("a.pdf", V3), ("copy.pdf", V3), ("b.pdf", V5)):
        (landing / name).write_bytes(b"%PDF" + text.encode())
    (landing / "c.txt").write_bytes(b"%PDF")
    (landing / "d.pdf").write_bytes(b"no")
    reader = lambda content: content[4:].decode()
    uploads.start(spark, str(landing), str(out), str(tmp_path / "cp"), reader, once=True).awaitTermination()
    got = spark.read.parquet(str(out / "documents"))
    assert sorted(r.status for r in got.collect()) == ["NEEDS_REVIEW", "NEEDS_REVIEW"]
    assert spark.read.parquet(str(out / "line_items")).count() == 2
    (landing / "e.pdf").write_bytes(b"%PDF" + V3.encode())
    uploads.start(spark, str(landing), str(out), str(tmp_path / "cp"), reader, once=True).awaitTermination()
    assert spark.read.parquet(str(out / "documents")).count() == 2


def test_breaker_stream_equals_batch(spark, tmp_path):
    calls = [("a" if i % 3 else "b", i * 10, i, i % 4 == 0) for i in range(60)]
    schema = "key string, at_ms long, call_id long, ok boolean"
    for part in (calls[:25], calls[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream_circuit_breaker(stream, 2, 50).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    batch = resilience.circuit_breaker(spark.createDataFrame(calls, schema), 2, 50)
    columns = ["key", "call_id", "met", "allowed", "state", "failures"]
    assert sorted(map(tuple, spark.table("breaker").select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_api(spark):
    rows = spark.createDataFrame([(None, 404, "gone"), ("x", None, None), ("k", 400, None)], "key string, status int, message string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    got = rows.select(api.key_rejection(F.col("key"), F.lit("k")), api.error_envelope(F.col("status"), F.col("message"), F.lit("/p"), at)).collect()
    assert [r[0] for r in got] == ["API key is missing", "Invalid API key", None]
    assert [(e["statusCode"], e["message"]) for e in map(json.loads, (r[1] for r in got))] == [(404, "gone"), (500, "Internal server error"), (400, "Error occurred")]
    assert json.loads(got[0][1])["timestamp"] == "2024-01-02T03:04:05.000Z"


def test_live_cache_entries(spark):
    cache = spark.sql("SELECT 'k' AS cache_key, 'old' AS payload, TIMESTAMP '2024-01-01 00:00:00' AS written_at, 60 AS ttl_s UNION ALL SELECT 'k', 'new', TIMESTAMP '2024-01-01 00:00:30', 60 UNION ALL SELECT 'z', 'gone', TIMESTAMP '2024-01-01 00:00:00', 10")
    got = resilience.live_entries(cache, F.lit("2024-01-01 00:00:40").cast("timestamp")).collect()
    assert [(r.cache_key, r.payload) for r in got] == [("k", "new")]


def test_write_results(spark, tmp_path):
    results = extract(spark.createDataFrame([(1, V3), (2, "")], "doc_id int, text string"))
    for _ in range(2):
        sinks.write_results(results, str(tmp_path), F.lit(0))
    rows = spark.read.parquet(str(tmp_path / "documents"))
    assert sorted((r.doc_id, r.status) for r in rows.collect()) == [(1, "NEEDS_REVIEW"), (1, "NEEDS_REVIEW"), (2, "FAILED"), (2, "FAILED")]
    payload = json.loads(rows.filter("doc_id = 1").first().canonical_json)
    assert payload["status"] == "SUCCESS" and payload["records"][0]["chassis"] == "KSP210-0116561"
    assert spark.read.parquet(str(tmp_path / "audit")).filter("document_id = 1").first().details == '{"rowCount":1,"confidence":0.9}'


def test_duplicate_uploads(spark):
    uploads_ = spark.createDataFrame([(10, "h", "t", 1), (11, "h", "t", 2), (12, "h", "u", 1), (13, "x", "t", 1)], "upload_id int, file_hash string, tenant_id string, arrival int")
    existing = spark.createDataFrame([(1, "x", "t", "FAILED", 1), (3, "x", "t", "COMPLETED", 3), (2, "x", "t", "NEEDS_REVIEW", 2)], "document_id int, file_hash string, tenant_id string, status string, created int")
    got = {r.upload_id: (r.document_id, r.job_id, r.is_duplicate) for r in ingest.dedup_uploads(uploads_, existing).collect()}
    assert got == {10: (10, "10", False), 11: (10, "dup_10", True), 12: (12, "12", False), 13: (2, "dup_2", True)}
