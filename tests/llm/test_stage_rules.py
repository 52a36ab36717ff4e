"""Every stage of the pipeline, near copies by the rule for stages: five-word shingles, Jaccard 0.8 or more."""

from __future__ import annotations

import re

from sabaki.llm import packing, secrets

from . import brute
from .test_contracts import library
from .test_pipeline import alike, redacted, run_stages, shingle_sets


def test_stages_by_their_rules(spark, sf_dir, documents):
    docs, known, lines, unique, clean, packed = run_stages(spark, documents, sf_dir)
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert texts(known) == {d: t for d, t in texts(docs).items() if re.search(r"[^\W\d_]", t)}
    have = texts(lines)
    assert have == {d: t for d, (t, _, _) in brute.dedup_lines(list(texts(known).items())).items()}
    root = brute.components(shingle_sets(have.items()), alike)
    assert texts(unique) == {d: t for d, t in have.items() if root[d] == d}
    random = {r.doc_id: [(s.start, 3, s.end, "random") for s in r.random] for r in secrets.find_secrets(unique).collect()}
    assert texts(clean) == {d: redacted(t, brute.secrets(t) + random[d]) for d, t in texts(unique).items()}
    plain, got = library(packing.tokenizer_path()), {}
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).append(r.length)
    want = {d: len(plain(t)) + 1 for d, t in texts(clean).items()}
    assert got == {d: [(n - 1) % 2048 + 1] + [2048] * ((n - 1) // 2048) for d, n in want.items()}
