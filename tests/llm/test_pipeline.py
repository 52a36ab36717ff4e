"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from sabaki.llm import packing, secrets

from . import brute
from .conftest import ODD


def redacted(text, spans):
    out, at = "", 0
    for start, neg, kind in sorted((a, -b, k) for a, _, b, k in spans):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, -neg)
    return out + text[at:]


def run_stages(spark, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_stages(spark, sf_dir, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    docs, known, lines, unique, clean, packed = run_stages(spark, documents, sf_dir)
    for df in (known, lines, unique, clean):
        assert df.columns == documents.columns
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    assert texts(known) == {d: t for d, t in texts(docs).items() if re.search(r"[^\W\d_]", t)}

    want = brute.dedup_lines(list(texts(known).items()))
    assert texts(lines) == {d: t for d, (t, _, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    prints = {d: brute.fingerprint(t) for d, t in texts(lines).items()}
    root = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert texts(unique) == {d: t for d, t in texts(lines).items() if root[d] == d}

    random = {r.doc_id: [(s.start, 3, s.end, "random") for s in r.random] for r in secrets.find_secrets(unique).collect()}
    assert texts(clean) == {d: redacted(t, brute.secrets(t) + random[d]) for d, t in texts(unique).items()}
    assert not any(brute.secrets(t) for t in texts(clean).values())

    encode = packing.encoder(packing.tokenizer_path())
    lengths = {}
    for d, t in texts(clean).items():
        n = len(encode(t)) + 1
        lengths[d] = [(n - 1) % 2048 + 1] + [2048] * ((n - 1) // 2048)
    rows = packed.collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).append(r.length)
    assert got == lengths
    assert len({r.sequence_id for r in rows}) == brute.best_fit_decreasing([n for x in lengths.values() for n in x], 2048)


def shingle_sets(rows):
    words = {d: (t or "").lower().split() for d, t in rows}
    return {d: frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in words.items()}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_have_similar_shingles(spark, documents):
    """Also in groups that are over the bound for all pairs."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(5000)}"
    rows = [(r.doc_id, r.text.lower()) for r in documents.filter("text is not null").select("doc_id", "text").collect() if r.text.isascii()]
    for k in range(3):
        base = [word() for _ in range(120)]
        for i in range(60):
            own = list(base)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(120)] = word()
            rows.append((10_000 + 100 * k + i, " ".join(own)))
    root = brute.components(shingle_sets(rows), alike)
    kept = sorted(d for d in root if root[d] == d)
    assert len(rows) - len(kept) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, None)
    assert sorted(r.doc_id for r in got.collect()) == kept


def test_run_equals_stages(spark, sf_dir, documents):
    packed = run_stages(spark, documents, sf_dir)[-1]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(packed)


def test_odd_rows(spark, sf_dir, odd, documents):
    both = odd.unionByName(documents.filter("doc_id > 20"), allowMissingColumns=True)
    stages = run_stages(spark, both, sf_dir)
    assert all(df.columns == both.columns for df in stages[:-1])
    ids = [r.doc_id for r in stages[3].collect()]
    assert ids.count(None) == 1 and ids.count(4) == 1
    assert not {d for d, t in ODD if not t} - {None} & set(ids)


def test_no_rows(spark, sf_dir, documents):
    assert run_stages(spark, documents.filter("false"), sf_dir)[-1].count() == 0
