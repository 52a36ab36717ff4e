"""Statements made from orders and their lines, for tables that hold no auction sheets.

The lines are told in SQL that Spark and DuckDB read alike.  Their kinds vary with the keys: tax-only
differences, mismatches, missing packed lines and dates, short blocks, footers, full-width digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row a line: doc_id, its order (a, b, c, s) and the line; ``{orders}`` and ``{lineitem}`` are the tables.
LINES_SQL = """
SELECT doc_id, a, b, c, s, line FROM (
  WITH x AS (
    SELECT l_orderkey AS doc_id, l_linenumber AS a, l_partkey AS b, l_suppkey AS c,
           CAST(l_orderkey % 3 AS INT) AS t, CAST((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 11 AS INT) AS v,
           CAST(floor(l_extendedprice) AS BIGINT) * 10 AS bid, 1000 + l_partkey % 9000 AS recycle, 1000 + l_suppkey % 9000 AS jidosha,
           concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) AS md
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
  ), y AS (
    SELECT *, bid + recycle + jidosha + CASE v WHEN 4 THEN 12345 WHEN 5 THEN CAST(floor(bid / 10) AS BIGINT) ELSE 0 END AS total FROM x
  )
  SELECT doc_id, a, b, c, 0 AS s, CASE WHEN t = 0 AND v = 9 THEN 'TC-web名古屋' WHEN t = 0 THEN 'USS東京' WHEN t = 1 THEN '横浜' ELSE 'ANS 関東' END AS line FROM y
  UNION ALL SELECT doc_id, a, b, c, 1 AS s, CASE WHEN v = 6 THEN translate(CAST(100 + b % 900 AS STRING), '0123456789', '０１２３４５６７８９') ELSE concat('  ', CAST(100 + b % 900 AS STRING), ' ') END AS line FROM y WHERE v <> 3
  UNION ALL SELECT doc_id, a, b, c, 2 AS s, CASE WHEN v = 6 THEN '　プリウス　' WHEN v = 8 THEN 'ｶﾛｰﾗ 1500' ELSE 'プリウス' END AS line FROM y WHERE v <> 3
  UNION ALL SELECT doc_id, a, b, c, 3 AS s, CASE WHEN t = 0 THEN concat(md, CAST(bid AS STRING)) ELSE md END AS line FROM y WHERE v <> 3 AND v <> 2
  UNION ALL SELECT doc_id, a, b, c, 4 AS s, CAST(bid AS STRING) AS line FROM y WHERE t <> 0 AND v <> 3
  UNION ALL SELECT doc_id, a, b, c, 5 AS s, CASE WHEN t = 0 THEN concat(CAST(total AS STRING), CAST(recycle AS STRING), CAST(jidosha AS STRING)) ELSE CAST(total AS STRING) END AS line FROM y WHERE v <> 3 AND v <> 1
  UNION ALL SELECT doc_id, a, b, c, 6 AS s, concat('KSP', CAST(c AS STRING), '-', lpad(CAST(b AS STRING), CASE WHEN t = 0 THEN 7 ELSE 9 END, '0')) AS line FROM y WHERE v <> 10
  UNION ALL SELECT doc_id, a, b, c, 7 AS s, CASE v WHEN 7 THEN '合計 12345' WHEN 8 THEN '38,766,920' ELSE '12頁/' END AS line FROM y WHERE v IN (0, 7, 8)
  UNION ALL SELECT doc_id, a, b, c, 8 AS s, '' AS line FROM y WHERE v = 5
  UNION ALL SELECT o_orderkey AS doc_id, 0 AS a, 0 AS b, 0 AS c, 0 AS s, concat(CAST(year(o_orderdate) AS STRING), ' 年 ', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), ' 月') AS line FROM {orders} WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey AS doc_id, 0 AS a, 0 AS b, 0 AS c, 1 AS s, CASE o_orderkey % 3 WHEN 0 THEN '開催日 USS会場' WHEN 1 THEN '開催日 TAA会場' ELSE '開催日 会場' END AS line FROM {orders}
  UNION ALL SELECT o_orderkey AS doc_id, 99 AS a, 0 AS b, 0 AS c, 0 AS s, '落札料 合計 御請求' AS line FROM {orders} WHERE o_orderkey % 2 = 0
) z
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of one statement for each order."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = spark.sql(LINES_SQL, orders=read("orders"), lineitem=read("lineitem"))
    ordered = F.array_sort(F.collect_list(F.struct("a", "b", "c", "s", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
