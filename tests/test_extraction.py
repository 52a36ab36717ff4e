"""Hand-traced vectors and boundaries of the extraction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sabaki.functions.text import half_width, parse_number, trim_js
from sabaki.operators.classify import classify
from sabaki.operators.parse import math_mismatch
from sabaki.operators.segment import segment
from sabaki.operators.summarise import line_items
from sabaki.operators.validate import validate_records
from sabaki.plans.extraction import extract

V3 = "2026 年 04 月 04 日\nUSS東京\n1234\nプリウス\n04/041692000\n170445094503000\nKSP210-0116561"
V4 = V3.replace("04/041692000", "04/041000000").replace("170445094503000", "110000000000000")
V5 = V4.replace("110000000000000", "125000000000000")
V6 = V3.replace("04/041692000", "04/4500000")
V7 = "TAA\n04/04\nGB3-1234567\n1200000\n1300000"


def result(spark, text, **kwargs):
    return extract(spark.createDataFrame([(1, text)], "doc_id int, text string"), **kwargs).first()


def test_uss(spark):
    r = result(spark, V3)
    (row,) = r.records
    assert (row.date, row.lot_number, row.bid, row.total, row.recycle, row.jidosha) == ("2026-04-04", 1234, 1692000, 1704450, 9450, 3000)
    assert (row.flags, row.confidence) == (["TEMPLATE:USS", "AMBIGUOUS_SOURCE"], 0.9)
    assert (r.status, r.flags, r.document_status) == ("SUCCESS", ["1_REVIEW_ROWS"], "NEEDS_REVIEW")


def test_tax_difference_is_no_mismatch(spark):
    (row,) = result(spark, V4).records
    assert (row.total, row.recycle, row.jidosha, row.confidence) == (1100000, 0, 0, 0.9)


def test_mismatch(spark):
    r = result(spark, V5)
    assert r.records[0].flags == ["TEMPLATE:USS", "MATH_MISMATCH", "MATH_MISMATCH", "AMBIGUOUS_SOURCE", "NEEDS_REVIEW"]
    assert (r.records[0].confidence, r.status, r.errors, r.flags, r.document_status) == (0.6, "FAILED", ["1 rows failed validation"], ["1_INVALID_ROWS"], "NEEDS_REVIEW")


def test_greedy_date_leaves_no_bid(spark):
    r = result(spark, V6)
    assert (r.status, r.errors, r.flags) == ("FAILED", ["No extraction results produced", "INVALID_ROW_SKIPPED"], ["ALL_ROWS_REJECTED"])


def test_taa_chassis_digits_count_as_money(spark):
    (row,) = result(spark, V7).records
    assert (row.bid, row.total, row.confidence) == (1200000, 31234567, 0.5)
    assert row.flags == ["TEMPLATE:TAA", "MATH_MISMATCH", "MATH_MISMATCH", "MISSING_OPTIONAL_FIELDS", "AMBIGUOUS_SOURCE", "NEEDS_REVIEW"]


def test_long_packed_line(spark):
    (row,) = extract(spark.createDataFrame([(1, V3.replace("170445094503000", "15500094501849000"))], "doc_id int, text string")).first().raw_rows
    assert (row.total, row.recycle, row.jidosha) == (155000945, 184, 9000)


@pytest.mark.parametrize("text, flag", [(None, "NO_TEXT_CONTENT"), ("", "NO_TEXT_CONTENT"), ("　 x 　", "NO_TEXT_CONTENT"), ("nothing of interest here", "NO_BLOCKS_FOUND")])
def test_early_exits(spark, text, flag):
    r = result(spark, text)
    assert (r.flags, r.status, r.document_status, r.errors) == ([flag], "FAILED", "FAILED", ["No extraction results produced"])


def test_lot_line_splits_after_three_lines(spark):
    text = "1550\n15500094501849000\n184900\nKSP210-0116561\n6兵庫\n1550\n1550009450500000\n50000\nNKE165-7242861\n7兵庫"
    (row,) = segment(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert row.valid_blocks == [["1550", "15500094501849000", "184900", "KSP210-0116561", "6兵庫"], ["1550", "1550009450500000", "50000", "NKE165-7242861", "7兵庫"]]


def test_own_names_are_noise(spark):
    df = spark.createDataFrame([(1, "ACME TRADING\nplain")], "doc_id int, text string")
    assert segment(df, own_names=("ACME",)).first().lines == ["plain"]


@pytest.mark.parametrize("total, expected", [(1001000, False), (1001001, True), (1099001, False), (1100999, False), (1099000, True), (1101000, True)])
def test_math_boundaries(spark, total, expected):
    n = F.lit(None).cast("bigint")
    assert spark.range(1).select(math_mismatch(F.lit(1000000).cast("bigint"), n, n, n, F.lit(total).cast("bigint"))).first()[0] is expected


def test_empty_row_is_rejected(spark):
    df = spark.sql("""SELECT array(named_struct('date', '', 'auction', '', 'area', '', 'lot_number', CAST(NULL AS INT), 'year', 2026, 'chassis', '', 'bid', 0L,
        'recycle', CAST(NULL AS BIGINT), 'jidosha', CAST(NULL AS BIGINT), 'auction_fee', CAST(NULL AS BIGINT), 'total', 0L, 'confidence', 0D, 'flags', CAST(array() AS ARRAY<STRING>))) AS rows""")
    (row,) = validate_records(df, "rows").first().validated
    assert row.flags == ["INVALID_CHASSIS", "MISSING_TOTAL", "MISSING_OPTIONAL_FIELDS", "AMBIGUOUS_SOURCE", "HARD_REJECT_NO_CHASSIS", "HARD_REJECT_NO_PRICE", "NEEDS_REVIEW"]
    assert (row.confidence, row.valid) == (0.0, False)


def test_text_functions(spark):
    row = spark.createDataFrame([("　  x　y ﻿", "ＡＢ１２－３４５６", "¥1,2３4円", "9" * 30)], "a string, b string, c string, d string")
    got = row.select(trim_js(F.col("a")), half_width(F.col("b")), parse_number(F.col("c")), parse_number(F.col("d"))).first()
    assert tuple(got) == ("x　y", "AB12－3456", 124, None)


def test_classification(spark):
    rows = [("TRANSPORT AB-1234 CD-1234 EF-1234", "x.pdf", 1), ("invoice", "x.pdf", 0), ("車両 AB-1234", "x", 1), ("", "receipt.pdf", 1), (None, None, None), ("注文書", "", 1)]
    got = classify(spark.createDataFrame(rows, "text string, filename string, pages int")).collect()
    assert [r.document_type for r in got] == ["AUCTION_SHEET", "BILLING", "PURCHASE", "RECEIPT", "UNKNOWN", "PURCHASE_ORDER"]
    assert [r.language for r in got] == ["en", "en", "ja", "en", "en", "ja"]


def test_line_items(spark):
    items = line_items(extract(spark.createDataFrame([(1, V3), (2, V6)], "doc_id int, text string"))).collect()
    assert [(i.doc_id, i.line_number, i.description, i.unit_price, i.subtotal) for i in items] == [(1, 1, "KSP210-0116561", 1692000.0, 1704450.0)]


def test_blocks_of_many_lines(spark):
    """Blocks go on over the parts of lines that the fold goes by, and cost no square of them."""
    for n in (0, 85, 86, 20_000):
        block = ["1234", "プリウス", "KSP210-0116561"]
        text = "\n".join(block * n)
        r = segment(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
        assert [list(b) for b in r.blocks] == [block] * n
