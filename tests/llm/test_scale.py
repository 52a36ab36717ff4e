"""Plans and work that follow the input: long texts, hot rows, blocks of queries."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sabaki.llm import common, exact_dedup, language_id, line_dedup, pii, secrets, sentencepiece_codec, simhash, spans, topk

from . import brute
from .test_pipeline import redacted


def as_rows(found):
    return [tuple(x) for x in found]


def test_sweeps_equal_comparing_all(spark):
    draw = random.Random(8)

    def disjoint(n, gap):
        out, at = [], 0
        for _ in range(n):
            a = at + draw.randrange(gap)
            at = a + draw.randrange(1, 9)
            out.append((a, at))
        return out

    rows = [(i, disjoint(n, 6), [(a, a + draw.randrange(1, 30)) for a in (draw.randrange(900) for _ in range(m))]) for i, (n, m) in enumerate([(0, 0), (0, 3), (3, 0), (1, 1), (40, 30), (200, 90), (90, 4)])]
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    got = df.select("a", "b", spans.apart_from(F.col("a"), F.col("b"), 0).alias("swept"), spans.apart_from(F.col("a"), F.col("b"), 1 << 30).alias("plain"), spans.clusters(F.col("b")).alias("clusters"))
    for r in got.collect():
        want = [s for s in as_rows(r.a) if not any(s[0] < e and b < s[1] for b, e in as_rows(r.b))]
        assert as_rows(r.swept) == as_rows(r.plain) == want
        groups = [as_rows(g) for g in r.clusters] if r.b else []
        assert sorted(sum(groups, [])) == sorted(as_rows(r.b))
        reach = 0
        for g in groups:
            assert g[0][0] >= reach
            for a, b in g:
                assert a < reach or (a, b) == g[0]
                reach = max(reach, b)


def test_cuts_and_redaction_of_long_texts(spark):
    draw = random.Random(9)
    text = "".join(draw.choice("ab é漢\U0001f600\n") for _ in range(3000))
    marks = [(a, k, a + draw.randrange(1, 60), "xyz"[k]) for a in sorted(draw.randrange(2900) for _ in range(200)) for k in (draw.randrange(3),)]
    df = spark.createDataFrame([(text, [(a, e, k) for a, _, e, k in marks])], "t string, s array<struct<start:int,end:int,kind:string>>")
    assert df.select(spans.redacted(F.col("t"), F.col("s"))).first()[0] == redacted(text, marks)
    places = [(a, n) for a in (0, 1, 255, 256, 257, 511, 2999) for n in (0, 1, 5, 256, 600)]
    got = spark.createDataFrame([(text, a, n) for a, n in places], "t string, a int, n int").select("a", "n", spans.cut(spans.pieces(F.col("t")), F.col("a"), F.col("n")).alias("c"))
    assert all(r.c == text[r.a : r.a + r.n] for r in got.collect())


def test_dense_text_equals_plain_version(spark):
    secret = " ".join(f"token=abcdef{i:05d} x9A8b7C6d5E4f3G2h1J0k{i:05d}zz" for i in range(300))
    found = secrets.find_secrets(spark.createDataFrame([(1, secret)], "doc_id long, text string")).first()
    assert [(s.start, 0, s.end, "assign") for s in found.assign] + [(s.start, 2, s.end, "hex") for s in found.hex] == brute.secrets(secret)
    mail = " ".join(f"mail a{i}@b.cc or call (212) 555-{i:04d} or b{i} [at] x [dot] org" for i in range(150))
    r = pii.find_personal_data(spark.createDataFrame([(1, mail)], "doc_id long, text string")).first()
    assert len(r.email) == 150 and {mail[s.start : s.end] for s in r.email} == {f"a{i}@b.cc" for i in range(150)}
    own = sorted((s.start, s.end) for s in r.judged)
    assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
    assert not any(s.start < e.end and e.start < s.end for s in r.judged for e in r.email)


def test_spelt_address_of_any_length_is_one_span(spark):
    text = "write to " + "a" * 90 + " [at] " + "b" * 80 + " [dot] " + ".".join(["c"] * 12) + " now"
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in r.judged if s.kind == "spelt"] in ([], [(9, len(text) - 4)])


def seconds(run, df):
    df = df.cache()
    df.count()
    best = 1e9
    for _ in range(2):
        began = time.perf_counter()
        run(df).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    df.unpersist()
    return best


@pytest.mark.parametrize("name", ["lines", "redact"])
def test_twice_the_text_is_about_twice_the_time(spark, name):
    make, run = {
        "lines": (lambda n: "\n".join(f"line {i % (n // 3)} of a text" for i in range(n * 60)), lambda df: line_dedup.dedup_lines(df)),
        "redact": (lambda n: " ".join(f"mail a{i}@b.cc and b{i} [at] x [dot] org" for i in range(n)), pii.redact_personal_data),
    }[name]
    took = [seconds(run, spark.createDataFrame([(1, make(n))], "doc_id long, text string")) for n in (100, 4000, 8000)]
    assert took[2] - took[0] <= 3 * (took[1] - took[0]) + 2


def test_long_words_are_the_librarys(documents):
    codec = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    draw = random.Random(4)
    words = ["".join(draw.choice(a) for _ in range(n)) for n in (257, 300, 300, 4000) for a in ("ab", "etaoinshrdlu", "aé漢\U0001f600z")] + ["a" * 5000, "the" * 2000]
    assert [x.tolist() for x in codec.encode(words)] == codec.processor.encode(words)


def test_owners_get_equal_key_ranges():
    rng = np.random.default_rng(3)
    sizes = rng.integers(50, 150, 4000).astype(float)
    owner = exact_dedup.owners_of(sizes, 37)
    assert (np.diff(owner) >= 0).all() and set(owner) == set(range(37))
    load = np.bincount(owner, sizes)
    assert load.max() <= 1.2 * load.mean()


def test_directory_grows_with_the_texts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    directory, pages = exact_dedup.build_index(docs, bucket_rows=1)
    assert directory.select("bits").distinct().count() == 1 and directory.first().bits == 16
    assert directory.count() == 1 << 16 and pages.count() == 3000
    assert pages.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4  # keys that share sixteen bits are a chain
    assert pages.join(directory.select("bucket").distinct(), "bucket", "left_anti").count() == 0


def test_repeated_rows_of_one_text(spark):
    docs = spark.createDataFrame([(7, "A"), (7, "a"), (7, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r.text_sha256[:4], str(r.doc_id), r.kept) for r in got) == sorted((r.text_sha256[:4], str(r.doc_id), r.kept) for r in got)
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, False, True]
    assert [r.kept for r in got if r.doc_id == 3] == [False] and sorted(r.kept for r in got if r.doc_id is None) == [False, True]


def test_shuffled_vectors_do_not_follow_the_blocks(spark, monkeypatch):
    written = []
    plain = topk.materialise

    def count(df, tag):
        out = plain(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(topk, "materialise", count)
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(600, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    narrow = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=30, block_rows=2).collect()))
    assert wide == narrow and len(wide) == 60
    assert [n for tag, n in written if tag in ("vectors", "shards")] == [600] * 4
    assert sum(n for tag, n in written if tag == "found") == 60


def test_ragged_vectors(spark):
    rows = [(i, [float(i % 7)] * (i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=2).collect())
    want = []
    for q in range(0, 400, 50):
        best = sorted((-(q % 7) * (i % 7) * 65536 * (q % 40), i) for i in range(400) if i != q and i % 40 == q % 40)[:2]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want


def test_shared_folder_has_to_be_named_on_a_cluster(spark):
    class Unset:
        sc = getCheckpointDir = lambda self: self
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://a:7077"
        _jsc = Unset()

    class Conf:
        @staticmethod
        def get(_, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_keeper_of_near_copies_is_whole(spark, odd):
    kept = simhash.keep_one_of_each(odd.unionByName(odd))
    assert kept.columns == odd.columns and kept.count() == kept.dropDuplicates(["doc_id", "text"]).count()


def test_training_holds_less_than_its_sample_at_full_width(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~language_id.held_out(F.col("doc_id"))).count()
    tracemalloc.start()
    model = language_id.train(docs)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows >= 500 and model.weights.shape[0] == language_id.BUCKETS
    assert peak < rows * language_id.BUCKETS * 4


def test_packed_features_are_those_of_the_text(documents):
    texts = ["", "a", "Ünï 漢字 \U0001f600", *(r.text for r in documents.select("text").limit(20).collect())]
    x = np.stack([language_id.features(t) for t in texts]).astype(np.float16)
    rows = pa.chunked_array([[language_id.packed(r) for r in x[:7]], [language_id.packed(r) for r in x[7:]]])
    assert (language_id.unpacked(rows, np.arange(language_id.BUCKETS)) == x).all()
    some = np.array([5, 17, 4000, language_id.BUCKETS - 1])
    assert (language_id.unpacked(rows, some) == x[:, some]).all()
