"""Uploads that come late, from several tenants, or again after a failure; lookups, caches and slow calls."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sabaki.operators import ingest, resilience
from sabaki.sources import files
from sabaki.streaming import uploads
from sabaki.streaming.breaker import stream_circuit_breaker

from .test_extraction import V3, V5


def put(folder, name, text, days_ago=0):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"%PDF" + text.encode())
    at = 1_700_000_000 - days_ago * 86_400
    os.utime(folder / name, (at, at))


def drain(spark, tmp_path, reader):
    uploads.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), reader, once=True).awaitTermination()
    return lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()


def test_late_uploads_tenants_and_failures(spark, tmp_path):
    landing = tmp_path / "in"
    read = lambda content: content[4:].decode()

    def failing(content):
        raise ValueError("no text layer")

    put(landing, "a.pdf", V3)
    drain(spark, tmp_path, read)
    put(landing, "old.pdf", V5, days_ago=30)
    got = drain(spark, tmp_path, read)
    assert len(got("documents")) == 2  # a file with an old time isn't lost
    put(landing / "tenant=north%20yard", "a.pdf", V3)
    put(landing, "again.pdf", V3)
    got = drain(spark, tmp_path, read)
    rows = got("documents")
    assert sorted(r.tenant_id for r in rows) == ["default-tenant", "default-tenant", "north yard"]
    assert len({r.document_id for r in rows}) == 3 and len({r.file_hash for r in rows}) == 2
    dup = [r for r in got("responses") if r.is_duplicate]
    first = next(r for r in rows if r.original_name == "a.pdf" and r.tenant_id == "default-tenant")
    assert [(r.document_id, r.job_id) for r in dup] == [(first.document_id, "dup_" + first.document_id)]

    put(landing, "c.pdf", V3 + "\nmore")
    got = drain(spark, tmp_path, failing)
    bad = next(r for r in got("documents") if r.original_name == "c.pdf")
    assert (bad.status, bad.stage) == ("FAILED", "ERROR")
    put(landing, "c2.pdf", V3 + "\nmore")
    got = drain(spark, tmp_path, read)
    again = next(r for r in got("documents") if r.original_name == "c2.pdf")
    assert again.status == "NEEDS_REVIEW" and again.file_hash == bad.file_hash and again.document_id != bad.document_id
    audit = [(r.document_id, r.action) for r in got("audit")]
    assert sorted(a for _, a in audit) == ["failed"] + ["processed"] * 4 + ["uploaded"] * 5
    assert (bad.document_id, "failed") in audit and (again.document_id, "processed") in audit
    said = next(r for r in got("audit") if r.action == "failed")
    assert json.loads(said.details) == {"error": "no text layer"}


def test_two_equal_uploads_of_a_batch(spark, tmp_path):
    put(tmp_path / "in", "b.pdf", V3, days_ago=1)
    put(tmp_path / "in", "a.pdf", V3)
    got = drain(spark, tmp_path, lambda content: content[4:].decode())
    assert [r.original_name for r in got("documents")] == ["b.pdf"]
    assert sorted(r.is_duplicate for r in got("responses")) == [False, True]
    assert [(r.priority, r.place) for r in got("jobs")] == [(1, 1)]


def test_tenant_of_a_path(spark, tmp_path):
    put(tmp_path / "tenant=x", "a.pdf", "1")
    put(tmp_path, "b.pdf", "2")
    assert sorted((r.name, r.tenant_id) for r in files.read_uploads(spark, str(tmp_path)).collect()) == [("a.pdf", "x"), ("b.pdf", None)]


def test_hot_duplicate_and_null_keys(spark):
    rows = spark.range(3000).select(F.col("id").alias("upload_id"), F.lit("h").alias("file_hash"), F.when(F.col("id") % 2 == 0, "t").alias("tenant_id"), (-F.col("id")).alias("arrival"))
    existing = spark.createDataFrame([], "document_id long, file_hash string, tenant_id string, status string, created long")
    got = ingest.dedup_uploads(rows, existing)
    assert got.count() == 3000
    assert sorted(r.upload_id for r in got.filter("NOT is_duplicate").collect()) == [2998, 2999]


def test_upload_rows(spark):
    df = spark.createDataFrame([("d", None, "h", "n.pdf", "application/pdf", 7, 1)], "document_id string, tenant_id string, file_hash string, name string, mime string, size int, arrival int")
    assert tuple(ingest.upload_rows(df).first()) == ("d", "default-tenant", "h", "n.pdf", "application/pdf", 7, "QUEUED", "INGESTED", 1)
    assert json.loads(ingest.upload_audit(df).first().details) == {"size": 7, "originalName": "n.pdf"}


def test_slow_calls_fail(spark, tmp_path):
    calls = [("a", i * 10, i, True, 5.0 if i % 3 else 500.0) for i in range(12)] + [("b", 0, 99, True, None), ("b", 1, 100, None, 1.0)]
    schema = "key string, at_ms long, call_id long, ok boolean, took_ms double"
    batch = resilience.circuit_breaker(spark.createDataFrame(calls, schema), 1, 25, timeout_ms=100)
    want, circuits = {}, {}
    for key, at, call, ok, took in calls:
        circuit = circuits.setdefault(key, resilience.Breaker(1, 25, 100))
        want[call] = (*circuit.observe(at, bool(ok), took), circuit.state, circuit.failures)
    columns = ["met", "allowed", "state", "failures"]
    assert {r.call_id: tuple(r[c] for c in columns) for r in batch.collect()} == want
    assert {s for s, *_ in want.values()} == {"CLOSED", "OPEN", "HALF_OPEN"}
    spark.createDataFrame(calls, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    stream_circuit_breaker(stream, 1, 25, 100).writeStream.format("memory").queryName("slow").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert {r.call_id: tuple(r[c] for c in columns) for r in spark.table("slow").collect()} == want


def test_cache_over_hours(spark):
    ops = [("k", h * 3600 + m, 100 * h + m, "set" if (h, m) in ((0, 5), (2, 1)) else "get") for h in range(4) for m in (0, 1, 2, 5)] + [(None, 0, 1, "set"), (None, 9, 2, "get")]
    df = spark.createDataFrame(ops, "key string, s long, op_id long, op string").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.key, r.op_id): r.hit for r in resilience.cache_lookups(df, 3600).collect()}
    want = {}
    for k, s, i, op in ops:
        if op == "get":
            sets = [t for kk, t, j, o in ops if kk == k and o == "set" and (t, j) < (s, i)]
            want[k, i] = bool(sets) and s - max(sets) < 3600
    assert got == want


def test_cache_writes(spark):
    schema = "cache_key string, written_at int, ttl_s int, payload string"
    cache = spark.createDataFrame([("a", 1, 9, "old"), ("b", 1, 9, "stays")], schema)
    writes = spark.createDataFrame([("a", 3, 9, "new"), ("a", 2, 9, "mid"), ("c", 1, 9, "first")], schema)
    assert sorted((r.cache_key, r.payload) for r in resilience.cache_writes(cache, writes).collect()) == [("a", "new"), ("b", "stays"), ("c", "first")]


def test_lookup_and_children(spark):
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    found, missing = ingest.lookup_by_key(spark.createDataFrame([(1,), (1,), (9,)], "k int"), stored, "k")
    assert [tuple(r) for r in found.collect()] == [(1, "x")]
    assert [tuple(r) for r in missing.collect()] == [(9, "Document 9 not found")]
    items = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, w string")
    got = {r.k: [tuple(c) for c in r.children] for r in ingest.with_children(stored, items, "k", "n").collect()}
    assert got == {1: [(1, "a"), (2, "b")], 2: []}


def test_job_order_within_hours_and_without_arrival(spark):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = [(i, i % 3 or None, None if i % 10 == 0 else at(i * 7 % 50 * 100 + i % 4 / 4)) for i in range(200)]
    got = {r.job_id: r.place for r in ingest.job_order(spark.createDataFrame(rows, "job_id int, priority int, arrival timestamp")).collect()}
    want = sorted(rows, key=lambda r: (r[1] or 0, r[2] or datetime.min, r[0]))
    assert got == {r[0]: n + 1 for n, r in enumerate(want)}
