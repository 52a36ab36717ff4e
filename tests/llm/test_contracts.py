"""Contracts where a plain call of a library, or of Python, says what is right."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sabaki.llm import language_id, packing

SPECIAL = "<|endoftext|>"


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_the_plain_calls(spark, odd, documents):
    plain = library(packing.tokenizer_path())
    more = spark.createDataFrame([(20, f"a {SPECIAL} b"), (21, SPECIAL * 3), (22, "x" * 9000 + SPECIAL + "é½"), (23, None)], "doc_id long, text string")
    for df in (documents.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        want = {}
        for r in df.collect():
            ids = [*plain(r.text or ""), 0]
            first = (len(ids) - 1) % 2048 + 1
            for piece, a in enumerate([0, *range(first, len(ids), 2048)]):
                own = ids[a : first if a == 0 else a + 2048]
                want.setdefault((r.doc_id, piece), []).append(zlib.crc32(np.array(own, "<u4").tobytes()))
        got = {}
        for r in packing.pack_documents(df, special_ids=True).collect():
            got.setdefault((r.doc_id, r.piece), []).append(r.ids_crc32)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text(st.characters(max_codepoint=0x2AF), max_size=30), st.sampled_from([SPECIAL, "<|endof", "text|>", " ", "\n\n", "don't", "\u00a0"])), max_size=8))
def test_both_encoders_on_any_text(parts):
    path = packing.tokenizer_path()
    text = "".join(parts)
    assert list(packing.encoder(path, True)(text)) == library(path)(text)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language_id.train(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet"))


def test_numerals_are_no_letters(spark, model):
    texts = ["² ½ Ⅷ ①", "٣٤ 12", "_ - _", "ª", "ß", "Ⅷa", "日", "\u0301", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred == "und" for r in language_id.identify_languages(df, model).collect()}
    assert got == {i: not any(map(str.isalpha, t)) for i, t in enumerate(texts)}


def decode(model, text):
    """Language and loss by plain loops over n-grams, bits and codewords."""
    raw = (" " + re.sub(r"[\x00-`{-\x7f]+", " ", text.lower()) + " ").encode("utf-8", "replace")
    counts = np.zeros(language_id.BUCKETS)
    shift = 32 - (language_id.BUCKETS.bit_length() - 1)
    for n, times in ((2, 2654435761), (3, 2246822519)):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "big")
            counts[(code * times & 0xFFFFFFFF) >> shift] += 1
    x = np.sqrt(counts)
    x /= np.linalg.norm(x)
    losses = []
    for k in range(len(model.languages)):
        loss = 0.0
        for bit in range(model.code.shape[1]):
            z = float(x @ model.weights[:, bit]) + float(model.bias[bit])
            loss += model.trust[k, bit] * np.log1p(np.exp(-z * model.code[k, bit]))
        losses.append(loss)
    return model.languages[int(np.argmin(losses))], min(losses)


def test_predictions_equal_plain_decoding(documents, model):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").limit(40).collect()}
    got = {r.doc_id: r for r in language_id.identify_languages(documents, model).collect()}
    for d, t in texts.items():
        lang, loss = decode(model, t)
        assert got[d].lang_pred == lang and abs(got[d].loss - loss) < 1e-3


ITALIAN = "La repubblica riconosce e garantisce i diritti inviolabili dell'uomo e richiede l'adempimento dei doveri di solidarietà. "
FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. "


def test_unlearned_languages_go_and_mixtures_stay(spark, documents, model):
    by = {}
    for r in documents.filter("length(text) > 1500").collect():
        by.setdefault(r.lang, []).append(r.text[:1500])
    away = [ITALIAN * 20, FINNISH * 20, "zzzz qqqq xxxx kkkk wwww " * 20]
    langs = sorted(by)
    mixed = [by[a][0] + " " + by[b][0] for a in langs for b in langs if a < b]
    clean = [t for k in langs for t in by[k][:5]]
    rows = list(enumerate([*away, *mixed, *clean]))
    kept = language_id.keep_known_languages(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert len(mixed) >= 3
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(away), len(rows)))
