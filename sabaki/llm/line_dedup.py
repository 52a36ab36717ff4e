"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of two lines decides, from content alone, after which lines a chunk
ends, so lines put before a passage don't shift the chunks inside it.  Chunks of two or more lines
that occur more than once in the whole corpus are removed but for one occurrence: in the document
with the smallest doc_id, the first.

Two scans with DataFrame functions only.  The first groups chunks by their bytes (the comparison:
grouping keys are equal only if all bytes are), which partial aggregation collapses in every task, so
a passage that a third of all documents share costs a row a task.  The second sends narrow rows, one
for each occurrence of a repeated chunk, to the list of its document, and joins the lists to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: A chunk ends after a line with probability 1/DIVISOR, by the lines' content.
DIVISOR = 3
MULTIPLIER = 31
MIN_LINES = 2
_LAST = (1 << 63) - 1


def with_chunks(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: the chunks (body, lines) of the text; joined by newlines the bodies are the text.

    Each step is a column of its own and lambdas refer to their arguments alone, so nothing is
    computed once a line that can be computed once a text.
    """
    lines, hashes, marked = f"{into}_l", f"{into}_h", f"{into}_m"
    df = df.withColumn(lines, F.split(text, "\n", -1))
    df = df.withColumn(hashes, F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")))
    # For each line the hashes of the one before it and of the one before that.
    n, zero = F.size(hashes), F.lit(0).cast("long")
    before = F.concat(F.array(zero), F.slice(hashes, 1, n - 1))
    further = F.concat(F.array(zero, zero), F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))))
    rolled = F.zip_with(before, further, lambda b, a: (F.coalesce(a, zero) * MULTIPLIER + b) % DIVISOR == 0)
    # Every line gets a mark in front, so a newline and "b" is where chunks part: lines hold no newline.
    df = df.withColumn(marked, F.zip_with(lines, rolled, lambda x, cut: F.concat(F.when(cut, "b").otherwise("c"), x)))
    bodies = F.split(F.expr(f"substring(array_join({marked}, '\n'), 2)"), "\nb", -1)

    def chunk(b: Column) -> Column:
        body = F.replace(b, F.lit("\nc"), F.lit("\n"))
        return F.struct(body.alias("body"), (F.length(b) - F.length(body) + 1).alias("lines"))

    return df.withColumn(into, F.transform(bodies, chunk)).drop(lines, hashes, marked)


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of ``text``, and ``n_chunks`` and ``n_removed`` if ``counts``.

    ``docs`` has doc_id and text; other columns pass through (those that have the names of the counts are
    replaced by them).  A null text stays null (no chunks); a text of one line stays; where all chunks go
    the text is empty and the row stays.  A very long text costs in proportion to its lines (its chunks' hashes are
    sorted); an empty table gives no rows.  A null doc_id comes after all others.  Rows of equal doc_id are
    one document: those that share the smallest doc_id of a chunk all keep its first occurrence.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_chunks", "n_removed") or not counts]
    others = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c.lower() != "text"), F.lit(0).alias("none"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")), 256)
    rows = docs.select(key.alias("k"), order.alias("ord"), F.col("text").alias("t"), others.alias("others"))
    cut = with_chunks(rows.select("k", "ord", "t").filter(F.contains("t", F.lit("\n"))), "t", "c")
    bodies = cut.select("ord", F.inline_outer("c")).filter(F.col("lines") >= MIN_LINES)
    repeated = bodies.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("owner")).filter("n > 1")
    repeated = materialise(repeated.select(F.sha2("body", 256).alias("sha"), "owner"), "repeated-chunks")

    own = cut.withColumn("c", F.transform("c", lambda c: F.when(c["lines"] >= MIN_LINES, F.sha2(c["body"], 256))))
    # Sorted by hash and place, the first of a document's equal chunks follows another hash.
    own = own.withColumn("c", F.array_sort(F.filter(F.transform("c", lambda s, i: F.struct(s.alias("sha"), i.alias("i"))), lambda x: x["sha"].isNotNull())))
    own = own.withColumn("before", F.concat(F.array(F.lit("")), F.transform(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda x: x["sha"])))
    own = own.withColumn("c", F.zip_with(F.col("c"), F.slice("before", F.lit(1), F.size("c")), lambda x, b: F.struct(x["sha"].alias("sha"), x["i"].alias("i"), (x["sha"] != b).alias("first"))))
    found = own.select("k", "ord", F.inline_outer("c")).filter(F.col("sha").isNotNull()).join(repeated, "sha")
    lists = found.filter(~(F.col("first") & (F.col("ord") == F.col("owner")))).groupBy("k").agg(F.collect_set("i").alias("gone"))

    joined = with_chunks(rows.join(lists, "k", "left"), "t", "c")
    # The set difference is by hashing, so a text of many chunks costs no more than their number.
    stay = F.array_except(F.sequence(F.lit(0), F.size("c") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("c"), i)["body"]), "\n")
    text = F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("t"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    out = [text.alias(c) if c.lower() == "text" else F.col(f"others.c{i}").alias(c) for i, c in enumerate(names)]
    return joined.select(*out, *([size("c").alias("n_chunks"), size("gone").alias("n_removed")] if counts else []))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS h FROM l
), r AS (
  SELECT *, coalesce(lag(h) OVER w, 0) * 31 + h AS rolled FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), b AS (
  SELECT *, coalesce(sum((rolled % 3 = 0)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r
), c AS (
  SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines FROM b GROUP BY ALL
), f AS (
  SELECT *, lines >= 2 AND row_number() OVER (PARTITION BY body, lines >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM c
), k AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS text,
         count(*)::INTEGER AS n_chunks, count(*) FILTER (gone)::INTEGER AS n_removed
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, k.text, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN k USING (doc_id)
"""
