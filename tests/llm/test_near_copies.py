"""Work and disk of the pipeline's near-copy stage."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from sabaki.llm import jaccard, simhash

from . import brute
from .test_pipeline import alike, shingle_sets


@pytest.fixture
def written(monkeypatch):
    """Rows of the stage's tables, by name."""
    rows, write = {}, jaccard.materialise

    def counted(df, tag):
        out = write(df, tag)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    return rows


def test_long_texts_with_common_passages_are_no_candidates(spark, written, monkeypatch):
    """A sketch of 1024 bits is full at a few thousand shingles; every two such texts used to be joined with their texts."""
    monkeypatch.setattr(jaccard, "COMMON", 0)
    draw = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(400))
    rows = [(d, f"{passage} " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(3000))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.simhash_near_dedup(spark, docs, None).count() == 40
    assert sum(written["set-pairs"]) > 0 and sum(written["set-candidates"]) == 0


def test_apart_is_a_bound():
    draw = random.Random(4)
    for n, m, both in ((10, 12, 9), (600, 500, 450), (5000, 4500, 4400), (3000, 3000, 0)):
        own = [draw.getrandbits(63) for _ in range(n + m - both)]
        x, y = (jaccard.np.array(s, jaccard.np.int64) for s in (own[:n], own[n - both :]))
        a, b = (jaccard.wide_sketch(s) or jaccard.sketch(s) for s in (x, y))
        assert jaccard.apart(a, b) == jaccard.apart(b, a) <= n + m - 2 * both
    assert 9 * jaccard.apart(a, b) > n + m


def test_rounds_find_the_same(spark):
    """Clusters whose pairs go in several rounds, the closest of each node first."""
    draw = random.Random(6)
    rows = []
    for k in range(2):
        base = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for i in range(30):
            own = list(base)
            for _ in range(draw.randrange(5)):
                own[draw.randrange(120)] = f"x{draw.randrange(5000)}"
            rows.append((100 * k + i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_classes(docs, round_pairs=3).collect()}
    assert got == brute.components(shingle_sets(rows), alike)


def test_rows_of_one_key(spark):
    """Copies of a row, null doc_ids and texts: one row of a component stays, with the columns as they are."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (1, text, "a"), (2, f"{text} more", "b"), (3, "other", "c"), (3, "other", "c"), (None, "alone here", "d"), (None, "alone here", "d"), (4, None, "e"), (5, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k_id string")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[7]], key=str)


def texts_with_changes(draw, clusters=6, members=4):
    rows = []
    for k in range(clusters):
        base = [f"w{draw.randrange(5000)}" for _ in range(300)]
        for i in range(members):
            own = list(base)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(300)] = f"x{draw.randrange(5000)}"
            rows.append((10 * k + i, " ".join(own)))
    return rows


def prints_of(rows):
    own = {d: jaccard.shingles(t.encode()) for d, t in rows}
    return {d: (jaccard._node(s), jaccard.fingerprint(s)) for d, s in own.items()}


@pytest.mark.parametrize("shard_rows", [8192, 4])
def test_simhash_pairs_connect_all_within_the_radius(spark, shard_rows):
    prints = prints_of(texts_with_changes(random.Random(8)))
    nodes = dict(prints.values())
    near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= jaccard.RADIUS
    df = spark.createDataFrame(list(nodes.items()), "node long, fp long")
    pairs = [(r.a, r.b) for r in jaccard.simhash_pairs(df, shard_rows=shard_rows).collect()]
    assert pairs and all(near(nodes[a], nodes[b]) for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    assert brute.components(dict(zip(nodes, nodes, strict=True)), lambda a, b: frozenset((a, b)) in linked) == brute.components(nodes, near)


def test_simhash_finds_near_copies_by_itself(spark, monkeypatch):
    """Without prefixes: near copies within the radius are still one component."""
    monkeypatch.setattr(jaccard, "_prefixes", lambda *_: lambda batches: iter(()))
    rows = texts_with_changes(random.Random(9))
    prints, sets = prints_of(rows), shingle_sets(rows)
    near = lambda a, b: alike(sets[a], sets[b]) and ((prints[a][1] ^ prints[b][1]) & (1 << 64) - 1).bit_count() <= jaccard.RADIUS
    root = brute.components({d: d for d in sets}, near)
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d in root if root[d] == d)
    assert len(set(root.values())) < len(rows) / 2


def test_fingerprint_is_the_majority():
    draw = random.Random(10)
    for n in (1, 2, 5, 5000):
        own = [draw.getrandbits(64) - (1 << 63) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        assert jaccard.fingerprint(jaccard.np.array(own, jaccard.np.int64)) & (1 << 64) - 1 == want


def test_direct_links_of_a_dense_group_are_a_forest(spark):
    draw = np.random.default_rng(4)
    center = int(draw.integers(1 << 62))
    group = {center} | {center ^ 1 << i ^ 1 << j for i, j in draw.integers(0, 62, (600, 2)).tolist() if i != j}
    prints = sorted(group | {int(x) for x in draw.integers(1 << 62, size=300)})
    df = spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3)
    found = [(r.a, r.b) for r in simhash.near_links(df, 8, lean=True).collect()]
    assert all(a != b and (a ^ b).bit_count() <= 8 for a, b in found)
    root = brute.components({x: x for x in prints}, lambda a, b: (a ^ b).bit_count() <= 8)
    at = {x: i for i, x in enumerate(prints)}
    label = simhash.merge(np.arange(len(prints)), np.array([at[a] for a, _ in found]), np.array([at[b] for _, b in found]))
    assert [prints[i] for i in label] == [root[x] for x in prints]
    assert len(found) <= int(spark.conf.get("spark.sql.shuffle.partitions")) * (len(group) - 1)
