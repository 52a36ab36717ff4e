"""DuckDB SQL for the registered queries.

``CHAIN`` tells the whole path from orders to results as common table expressions; a query selects
from one of them, and DuckDB leaves out what it doesn't need.
"""

from __future__ import annotations

from ..functions import rules
from .extraction import DEFAULT_YEAR
from .synth import LINES_SQL

_SPACE = rules.JS_SPACE
_FOOTER, _TRANSPORT = rules.any_of(rules.FOOTER_MARKERS), rules.any_of(rules.TRANSPORT_KEYWORDS)


def clean_cte(source: str) -> str:
    """l0 (split lines) and l1 (clean lines) of ``source`` (doc_id, text)."""
    return f"""
l0 AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {source}
), l1 AS (
  SELECT doc_id, i, line FROM (
    SELECT doc_id, i, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{rules.FULL_WIDTH}', '{rules.HALF_WIDTH}') AS line FROM l0
  ) WHERE length(line) > 0
)"""


def _first(lines: str, pattern: str) -> str:
    return f"list_filter({lines}, lambda x: regexp_matches(x, '{pattern}'))[1]"


def _money(lines: str) -> str:
    return f"list_transform(list_filter(list_transform({lines}, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 5 AND 8), lambda d: d::BIGINT)"


_MISMATCH = "coalesce(bid <> 0 AND total <> 0 AND abs(total - (bid + coalesce(recycle, 0) + coalesce(jidosha, 0) + coalesce(auction_fee, 0))) > 1000 AND NOT abs(abs(total - (bid + coalesce(recycle, 0) + coalesce(jidosha, 0) + coalesce(auction_fee, 0))) - floor(bid / 10)) < 1000, false)"

CHAIN = f"""
WITH RECURSIVE synth_lines AS ({LINES_SQL.format(orders="orders", lineitem="lineitem")}),
synth AS MATERIALIZED (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY a, b, c, s, line) AS text FROM synth_lines GROUP BY doc_id
), meta AS (
  SELECT doc_id, text, CASE WHEN contains(text, 'USS') THEN 'USS' WHEN contains(text, 'TAA') THEN 'TAA' ELSE 'GENERIC' END AS template,
         coalesce(nullif(regexp_extract(text, '([0-9]{{4}}){_SPACE}*年', 1), '')::INTEGER, {DEFAULT_YEAR}) AS year
  FROM synth
), {clean_cte("synth")},
l2 AS (
  SELECT doc_id, i, line FROM l1
  WHERE NOT regexp_matches(line, '{_FOOTER}') AND NOT regexp_matches(line, '{_TRANSPORT}')
    AND NOT (regexp_matches(line, '^[0-9,]+$') AND contains(line, ',')) AND NOT regexp_matches(line, '^[0-9]+頁')
    AND NOT regexp_matches(line, '[0-9]{{4}}{_SPACE}*年{_SPACE}*[0-9]{{2}}{_SPACE}*月') AND NOT contains(line, '{rules.ADDRESSEE}')
), m AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, line,
         regexp_matches(line, '^({rules.any_of(rules.BLOCK_PREFIXES)})') OR regexp_matches(line, '^({rules.any_of(rules.VENUES)})( |$)') AS always,
         regexp_matches(line, '{rules.LOT}') AS lot, regexp_matches(line, '{rules.CHASSIS}') AS chassis
  FROM l2
), g AS (
  SELECT doc_id, n, 0 AS block, 1 AS len, chassis AS has FROM m WHERE n = 0
  UNION ALL
  SELECT doc_id, n, block + new::INTEGER, CASE WHEN new THEN 1 ELSE len + 1 END, CASE WHEN new THEN chassis ELSE has OR chassis END
  FROM (SELECT m.doc_id, m.n, g.block, g.len, g.has, m.chassis, m.always OR (m.lot AND g.len >= 3) OR (g.has AND m.chassis) AS new
        FROM g JOIN m ON m.doc_id = g.doc_id AND m.n = g.n + 1)
), blocks AS MATERIALIZED (
  SELECT doc_id, block AS block_id, list(line ORDER BY n) AS lines FROM g JOIN m USING (doc_id, n) GROUP BY doc_id, block
), valid AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) - 1 AS pos, lines FROM blocks
  WHERE len(lines) >= 3 AND len(list_filter(lines, lambda x: regexp_matches(x, '{rules.CHASSIS}'))) > 0
    AND len(list_filter(lines, lambda x: regexp_matches(x, '{_TRANSPORT}'))) = 0
), facts AS (
  SELECT doc_id, pos, template, year,
         list_filter(list_transform(lines, lambda x: regexp_extract(x, '{rules.CHASSIS}')), lambda x: x <> '')[1] AS chassis,
         list_filter(lines, lambda x: regexp_matches(x, '{rules.DATE}')) AS dated,
         {_first("lines", rules.PACKED)} AS packed, {_first("lines", rules.SUBTOTAL)} AS subtotal, {_first("lines", rules.LOT)} AS lot,
         list_filter({_money("lines")}, lambda v: v <> 0) AS money,
         list_reverse_sort({_money(f"list_filter(lines, lambda x: NOT regexp_matches(x, '{rules.DATE}'))")}) AS undated
  FROM valid JOIN meta USING (doc_id)
), fields AS (
  SELECT doc_id, pos, year, template AS auction, chassis,
         year || '-' || replace(regexp_extract(CASE template WHEN 'GENERIC' THEN dated[-1] ELSE dated[1] END, '{rules.DATE}'), '/', '-') AS date,
         CASE template WHEN 'USS' THEN TRY_CAST(nullif(regexp_replace(regexp_replace(dated[1], '^.*?{rules.DATE}', ''), '[^0-9]', '', 'g'), '') AS BIGINT)
                       WHEN 'TAA' THEN CASE WHEN money[2] IS NOT NULL THEN least(money[1], money[2]) ELSE money[1] END
                       ELSE undated[2] END AS bid,
         CASE template WHEN 'USS' THEN CASE WHEN coalesce(TRY_CAST(substr(packed, 1, length(packed) - 8) AS BIGINT), 0) <> 0 THEN TRY_CAST(substr(packed, 1, length(packed) - 8) AS BIGINT)
                                            ELSE coalesce(subtotal::BIGINT, TRY_CAST(substr(packed, 1, length(packed) - 8) AS BIGINT)) END
                       WHEN 'TAA' THEN CASE WHEN money[2] IS NOT NULL THEN greatest(money[1], money[2]) END
                       ELSE undated[1] END AS total,
         CASE WHEN template = 'USS' THEN lot::INTEGER END AS lot_number,
         CASE WHEN template = 'USS' THEN substr(packed, length(packed) - 7, 4)::BIGINT END AS recycle,
         CASE WHEN template = 'USS' THEN substr(packed, length(packed) - 3, 4)::BIGINT END AS jidosha,
         NULL::BIGINT AS auction_fee
  FROM facts
), checked AS (
  SELECT *, {_MISMATCH} AS mismatch, coalesce(bid, 0) <> 0 AND coalesce(total, 0) <> 0 AS both_there FROM fields
), parsed AS (
  SELECT *,
         greatest(10 - (chassis IS NULL)::INTEGER - (coalesce(bid, 0) = 0)::INTEGER - (coalesce(total, 0) = 0)::INTEGER - 3 * (mismatch OR NOT both_there)::INTEGER
                  - (auction = 'GENERIC')::INTEGER - (chassis IS NULL AND auction <> 'GENERIC')::INTEGER - 2 * (chassis IS NULL)::INTEGER, 0) / 10
         * CASE WHEN auction = 'GENERIC' THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS confidence,
         list_concat(['TEMPLATE:' || auction], CASE WHEN auction = 'GENERIC' THEN ['FALLBACK_USED'] ELSE [] END,
                     CASE WHEN chassis IS NULL AND auction <> 'GENERIC' THEN ['CHASSIS_NOT_FOUND'] ELSE [] END, CASE WHEN mismatch THEN ['MATH_MISMATCH'] ELSE [] END) AS flags
  FROM checked
), mapped AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, coalesce(date, '') AS date, auction, '' AS area, lot_number, year, chassis, bid, recycle, jidosha, auction_fee, total, confidence, flags, mismatch
  FROM parsed WHERE chassis IS NOT NULL AND both_there
), judged AS (
  SELECT * REPLACE (
           list_concat(flags, CASE WHEN mismatch THEN ['MATH_MISMATCH'] ELSE [] END, CASE WHEN lot_number IS NULL OR date = '' THEN ['MISSING_OPTIONAL_FIELDS'] ELSE [] END, ['AMBIGUOUS_SOURCE'],
                       CASE WHEN mismatch THEN ['NEEDS_REVIEW'] ELSE [] END) AS flags,
           (10 - 2 * (auction = 'GENERIC')::INTEGER - 3 * mismatch::INTEGER - (lot_number IS NULL OR date = '')::INTEGER - 1) / 10 AS confidence)
  FROM mapped
), validated AS (
  SELECT * REPLACE (CASE WHEN confidence < 0.5 AND NOT mismatch THEN list_concat(flags, ['NEEDS_REVIEW']) ELSE flags END AS flags), confidence >= 0.5 AND NOT mismatch AS valid FROM judged
), per_doc AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (valid) AS n_review, list_reduce(list(confidence ORDER BY pos), lambda a, b: a + b) AS total_confidence
  FROM validated GROUP BY doc_id
), counted AS (
  SELECT meta.doc_id, text, coalesce(v.n_blocks, 0) AS n_blocks, coalesce(n, 0) AS n, coalesce(n_invalid, 0) AS n_invalid, coalesce(n_review, 0) AS n_review, total_confidence
  FROM meta LEFT JOIN (SELECT doc_id, count(*) AS n_blocks FROM valid GROUP BY doc_id) v USING (doc_id) LEFT JOIN per_doc USING (doc_id)
), results AS (
  SELECT doc_id, n AS n_records,
         CASE WHEN n = 0 THEN 'FAILED' WHEN n_invalid = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
         CASE WHEN n = 0 THEN 0 ELSE round(total_confidence / n, 3) END AS confidence,
         array_to_string(list_concat(CASE WHEN n = 0 THEN ['No extraction results produced'] ELSE [] END, list_transform(range(n_blocks - n), lambda x: 'INVALID_ROW_SKIPPED'),
                           CASE WHEN n_invalid > 0 THEN [n_invalid || ' rows failed validation'] ELSE [] END), '|') AS errors,
         CASE WHEN length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) < 10 THEN 'NO_TEXT_CONTENT' WHEN n_blocks = 0 THEN 'NO_BLOCKS_FOUND' WHEN n = 0 THEN 'ALL_ROWS_REJECTED'
              ELSE array_to_string(list_concat(CASE WHEN n_invalid > 0 THEN [n_invalid || '_INVALID_ROWS'] ELSE [] END, CASE WHEN n_review > 0 THEN [n_review || '_REVIEW_ROWS'] ELSE [] END,
                                               CASE WHEN n_blocks > n THEN ['HAS_SKIPPED_ROWS'] ELSE [] END), '|') END AS flags,
         CASE WHEN n = 0 THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS document_status
  FROM counted
)
"""

_RAW = "doc_id, pos, chassis, date, bid, total, lot_number, recycle, jidosha, confidence, array_to_string(flags, '|') AS flags"
_RECORD = "doc_id, pos, date, auction, area, lot_number, year, chassis, bid, recycle, jidosha, auction_fee, total, confidence, array_to_string(flags, '|') AS flags"


def _hits(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INTEGER" for w in words) + ")"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_TYPE = " ".join(f"WHEN contains(t, '{ja}') OR contains(upper(t), '{en}') THEN '{name}'" for name, ja, en in rules.TYPE_CASCADE)
_AREAS = ", ".join(f"('{k}', '{v}')" for k, v in rules.AREAS.items())

#: The records that are expected of the statements, changed here and there; one in seven documents has no truth.
_EXPECTED = """
, truth AS (
  SELECT doc_id, pos, chassis, CASE WHEN pos % 4 = 3 THEN bid + 1 ELSE bid END AS bid, CASE WHEN doc_id % 11 = 0 THEN total + 1 ELSE total END AS total, date, auction,
         CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lot_number END AS lot_number
  FROM validated WHERE doc_id % 7 <> 0
  UNION ALL
  SELECT doc_id, 1000, 'NONE-1', 1, 1, '', 'USS', NULL FROM meta WHERE doc_id % 7 <> 0 AND doc_id % 17 = 0
), actual AS (
  SELECT doc_id, chassis, bid, total, date, auction, lot_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chassis ORDER BY pos) AS rn FROM validated) WHERE rn = 1
), compared AS (
  SELECT t.doc_id, t.pos, a.doc_id IS NOT NULL AS found, a.doc_id IS NOT NULL AS ok_chassis,
         a.doc_id IS NOT NULL AND a.bid IS NOT DISTINCT FROM t.bid AS ok_bid, a.doc_id IS NOT NULL AND a.total IS NOT DISTINCT FROM t.total AS ok_total,
         a.doc_id IS NOT NULL AND a.date IS NOT DISTINCT FROM t.date AS ok_date, a.doc_id IS NOT NULL AND a.auction IS NOT DISTINCT FROM t.auction AS ok_auction,
         a.doc_id IS NOT NULL AND a.lot_number IS NOT DISTINCT FROM t.lot_number AS ok_lot_number
  FROM truth t LEFT JOIN actual a ON a.doc_id = t.doc_id AND a.chassis = t.chassis
), scores AS (
  SELECT doc_id, (sum(ok_chassis::INTEGER * 0.30 + ok_bid::INTEGER * 0.20 + ok_total::INTEGER * 0.20 + ok_date::INTEGER * 0.10 + ok_auction::INTEGER * 0.10 + ok_lot_number::INTEGER * 0.10))::DOUBLE AS score,
         count(*)::DOUBLE AS max_score, count(*) FILTER (ok_chassis) AS chassis_correct, count(*) AS chassis_total, count(*) FILTER (ok_total) AS total_correct, count(*) AS total_total
  FROM compared GROUP BY doc_id
), per_document AS (
  SELECT doc_id, doc_id % 7 <> 0 AS has_truth, CASE WHEN nr THEN 0 ELSE coalesce(score, 0) END AS score, CASE WHEN nr THEN 1 ELSE coalesce(max_score, 0) END AS max_score,
         CASE WHEN nr THEN 0 ELSE coalesce(chassis_correct, 0) END AS chassis_correct, CASE WHEN nr THEN 1 ELSE coalesce(chassis_total, 0) END AS chassis_total,
         CASE WHEN nr THEN 0 ELSE coalesce(total_correct, 0) END AS total_correct, CASE WHEN nr THEN 1 ELSE coalesce(total_total, 0) END AS total_total
  FROM (SELECT r.doc_id, r.doc_id % 19 = 0 AS nr FROM results r) LEFT JOIN scores USING (doc_id)
), accuracy AS (
  SELECT *, coalesce(score / nullif(max_score, 0), 1.0)::DOUBLE AS accuracy FROM per_document
)
"""

_SAMPLES = "SELECT event_type AS metric, ts, event_id, value FROM events"
_CACHE = """
WITH ops AS (
  SELECT user_id AS key, ts AS done, event_id AS op_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'set' ELSE 'get' END AS op FROM events
), seen AS (
  SELECT *, max(CASE WHEN op = 'set' THEN done END) OVER (PARTITION BY key ORDER BY done, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written_at FROM ops
), looked AS (
  SELECT key, op_id, written_at, coalesce(done - written_at < INTERVAL 86400 SECOND, false) AS hit FROM seen WHERE op = 'get'
)
"""

ORACLE_SQL: dict[str, str] = {
    "text_normalize_lines": f"WITH {clean_cte('documents')} SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(normalized, '') AS normalized FROM documents d LEFT JOIN (SELECT doc_id, count(*)::INTEGER AS n_lines, string_agg(line, chr(10) ORDER BY i) AS normalized FROM l1 GROUP BY doc_id) USING (doc_id)",
    "line_noise_filter": CHAIN + "SELECT meta.doc_id, coalesce(n, 0) AS n_lines, coalesce(kept, '') AS kept FROM meta LEFT JOIN (SELECT doc_id, count(*)::INTEGER AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM l2 GROUP BY doc_id) USING (doc_id)",
    "segment_blocks": CHAIN + "SELECT doc_id, block_id::INTEGER AS block_id, array_to_string(lines, '|') AS lines FROM blocks",
    "valid_blocks": CHAIN + "SELECT doc_id, pos::INTEGER AS block_id, array_to_string(lines, '|') AS lines FROM valid",
    "template_select": CHAIN + "SELECT doc_id, template FROM meta",
    "document_year": CHAIN + "SELECT doc_id, year FROM meta",
    "parse_uss": CHAIN + f"SELECT {_RAW} FROM parsed WHERE auction = 'USS'",
    "parse_taa": CHAIN + f"SELECT {_RAW} FROM parsed WHERE auction = 'TAA'",
    "parse_generic": CHAIN + f"SELECT {_RAW} FROM parsed WHERE auction = 'GENERIC'",
    "math_check": f"SELECT l_orderkey, l_linenumber, l_partkey, {_MISMATCH} AS mismatch FROM (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice)::BIGINT * 10 AS bid, l_partkey % 500 AS recycle, NULL::BIGINT AS jidosha, NULL::BIGINT AS auction_fee, floor(l_extendedprice * (1 + l_tax))::BIGINT * 10 + l_suppkey % 1500 AS total FROM lineitem)",
    "confidence_score": CHAIN + "SELECT doc_id, pos, confidence FROM parsed",
    "map_records": CHAIN + f"SELECT {_RECORD} FROM mapped",
    "area_lookup": f"WITH a AS (SELECT * FROM (VALUES {_AREAS}) t(area, name)), s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '東京' WHEN 1 THEN '神戸' WHEN 2 THEN '熊本' END AS area FROM customer) SELECT c_custkey, coalesce(a.name, s.area, '') AS area FROM s LEFT JOIN a USING (area)",
    "validate_rows": CHAIN + f"SELECT {_RECORD}, valid FROM validated",
    "hard_rejects": """
WITH r AS (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad chassis' ELSE 'KSP-' || p_partkey END AS chassis, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE floor(p_retailprice)::BIGINT END AS total
  FROM part
), c AS (SELECT *, coalesce(regexp_matches(chassis, '^[A-Z0-9]+-[0-9]+$'), false) AS gc, coalesce(total > 0, false) AS gp FROM r)
SELECT p_partkey, greatest(10 - 5 * (NOT gc)::INTEGER - 5 * (NOT gp)::INTEGER - 2, 0) / 10 AS confidence,
       array_to_string(list_concat(['TEMPLATE:TAA'], CASE WHEN NOT gc THEN ['INVALID_CHASSIS'] ELSE [] END, CASE WHEN NOT gp THEN ['MISSING_TOTAL'] ELSE [] END, ['MISSING_OPTIONAL_FIELDS', 'AMBIGUOUS_SOURCE'],
         CASE WHEN NOT gc THEN ['HARD_REJECT_NO_CHASSIS'] ELSE [] END, CASE WHEN NOT gp THEN ['HARD_REJECT_NO_PRICE'] ELSE [] END, CASE WHEN NOT (gc AND gp) THEN ['NEEDS_REVIEW'] ELSE [] END), '|') AS flags,
       gc AND gp AS valid, NOT (gc AND gp) AS rejected
FROM c""",
    "document_result": CHAIN + "SELECT * FROM results",
    "document_status": CHAIN + "SELECT document_status, status, count(*) AS n FROM results GROUP BY ALL",
    "line_items_fanout": CHAIN + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS line_number, chassis AS description, 1.0::DOUBLE AS quantity, bid::DOUBLE AS unit_price, total::DOUBLE AS subtotal, confidence, 'deterministic_parser' AS extraction_method FROM validated",
    "erp_projection": CHAIN + "SELECT doc_id, date AS purchase_date, chassis AS chassis_number, bid AS bid_price, floor(bid / 10)::BIGINT AS consumption_tax, total AS total_price, NOT list_contains(flags, 'MATH_MISMATCH') AS is_math_valid FROM validated",
    "classify_language": f"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '{rules.JAPANESE}') THEN 'ja' ELSE 'en' END AS language FROM documents",
    "classify_type": f"""
WITH c AS (SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') || '.pdf' AS t FROM documents),
n AS (SELECT *, {_count("t", rules.STRICT_CHASSIS)} AS chassis, {_count("t", rules.PACKED_DATE)} AS packed FROM c),
s AS (SELECT *, 3 * {_hits("t", rules.AUCTION_PRIMARY)} + {_hits("t", rules.AUCTION_SECONDARY)} + CASE WHEN chassis >= 3 THEN 4 WHEN chassis >= 1 THEN 2 ELSE 0 END + CASE WHEN packed >= 3 THEN 3 ELSE 0 END AS score FROM n)
SELECT doc_id, score, CASE WHEN score >= 5 THEN 'AUCTION_SHEET' WHEN chassis BETWEEN 1 AND 2 AND {_hits("t", rules.PURCHASE_KEYWORDS)} >= 1 THEN 'PURCHASE' {_TYPE} ELSE 'UNKNOWN' END AS document_type FROM s""",
    "classify_statements": CHAIN
    + f""", c AS (SELECT doc_id, text || ' statement.pdf' AS t FROM synth), n AS (SELECT *, {_count("t", rules.STRICT_CHASSIS)} AS chassis, {_count("t", rules.PACKED_DATE)} AS packed FROM c),
s AS (SELECT *, 3 * {_hits("t", rules.AUCTION_PRIMARY)} + {_hits("t", rules.AUCTION_SECONDARY)} + CASE WHEN chassis >= 3 THEN 4 WHEN chassis >= 1 THEN 2 ELSE 0 END + CASE WHEN packed >= 3 THEN 3 ELSE 0 END AS score FROM n)
SELECT doc_id, CASE WHEN score >= 5 THEN 'AUCTION_SHEET' WHEN chassis BETWEEN 1 AND 2 AND {_hits("t", rules.PURCHASE_KEYWORDS)} >= 1 THEN 'PURCHASE' {_TYPE} ELSE 'UNKNOWN' END AS document_type, 'ja' AS language FROM s""",
    "is_scanned": "SELECT doc_id, length(coalesce(text, '')) / (CASE WHEN doc_id % 40 = 0 THEN 1 ELSE doc_id % 40 END) < 50 AS is_scanned FROM documents",
    "upload_validate": "SELECT page_id, CASE WHEN NOT (page_id % 3 = 0 OR ends_with(lower(url), '.pdf')) THEN 'NOT_A_PDF' WHEN strlen(html) > 4000 THEN 'TOO_LARGE' WHEN page_id % 2 = 1 THEN 'BAD_MAGIC' END AS rejection FROM pages",
    "dedup_hash": """
WITH u AS (SELECT doc_id AS upload_id, sha256(text) AS file_hash, source AS tenant_id, doc_id AS arrival FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT doc_id AS document_id, sha256(text) AS file_hash, source AS tenant_id, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS status, doc_id AS created FROM documents WHERE doc_id % 2 = 1),
l AS (SELECT file_hash, tenant_id, arg_min(document_id, created) AS live_id FROM e WHERE status <> 'FAILED' GROUP BY ALL),
f AS (SELECT *, first_value(upload_id) OVER (PARTITION BY file_hash, tenant_id ORDER BY arrival) AS first_id FROM u)
SELECT upload_id, f.file_hash, tenant_id, coalesce(live_id, first_id) AS document_id,
       CASE WHEN live_id IS NOT NULL OR first_id <> upload_id THEN 'dup_' || coalesce(live_id, first_id) ELSE upload_id::VARCHAR END AS job_id, live_id IS NOT NULL OR first_id <> upload_id AS is_duplicate
FROM f LEFT JOIN l USING (file_hash, tenant_id)""",
    "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "queue_priority": "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) * 100 < 1048576 THEN 1 ELSE 2 END AS priority FROM documents",
    "job_order": "SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS priority, row_number() OVER (ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 2 END, ts, event_id) AS place FROM events",
    "backpressure": "SELECT count(*) FILTER (s = 'waiting') AS waiting, count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IN ('waiting', 'active')) >= 100 AS rejects FROM (SELECT CASE event_type WHEN 'click' THEN 'waiting' WHEN 'view' THEN 'active' WHEN 'error' THEN 'failed' ELSE 'completed' END AS s FROM events)",
    "audit_union": "SELECT user_id AS document_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'purchase' THEN 'processed' ELSE 'failed' END AS action, CASE event_type WHEN 'signup' THEN 'INGESTED' WHEN 'purchase' THEN 'EXPOSED' ELSE 'FAILED' END AS stage, 'system' AS actor, props AS details, ts AS created_at FROM events WHERE event_type IN ('signup', 'purchase', 'error')",
    "audit_lookup": "SELECT event_id, event_type, ts FROM events WHERE user_id = 7",
    "audited_requests": "SELECT page_id, (page_id % 2 = 0 OR contains(u, '/raw') OR contains(u, '/audit')) AND regexp_matches(u, 'documents/[a-f0-9-]+') AS audited FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/api/documents/a1-' || page_id || '/raw' WHEN 1 THEN '/api/documents/' || page_id || '/audit' WHEN 2 THEN '/api/documents' ELSE url END AS u FROM pages)",
    "malware_verdict": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN true WHEN page_id % 3 = 0 THEN false ELSE coalesce(contains(CASE page_id % 5 WHEN 0 THEN 'f: OK' WHEN 1 THEN 'f: Eicar FOUND' END, 'OK'), false) END AS passes FROM pages",
    "latest_stage": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS n_events FROM events GROUP BY user_id",
    "glossary_upsert": """
WITH seed AS (SELECT NULL::BIGINT AS tenant_id, p_brand AS category, p_type AS japanese, p_name AS english, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS priority, CASE WHEN p_partkey % 4 = 0 THEN true END AS is_locked, p_partkey AS nth FROM part WHERE p_partkey % 2 = 0),
cur AS (SELECT tenant_id, category, japanese, english, priority, is_locked FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 1::BIGINT END AS tenant_id, p_brand AS category, p_type AS japanese, 'old' AS english, 1 AS priority, false AS is_locked, row_number() OVER (PARTITION BY p_partkey % 3 = 0, p_brand, p_type ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 2 = 1) WHERE rn = 1),
new AS (SELECT tenant_id, category, japanese, english, coalesce(priority, 0) AS priority, coalesce(is_locked, false) AS is_locked FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, category, japanese ORDER BY nth DESC) AS rn FROM seed) WHERE rn = 1)
SELECT * FROM new UNION ALL SELECT * FROM cur c WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.tenant_id IS NOT DISTINCT FROM c.tenant_id AND n.category = c.category AND n.japanese = c.japanese)""",
    "cascade_delete": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "parent_children": "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_children, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "evaluate_records": CHAIN + _EXPECTED + "SELECT doc_id, pos, found, ok_chassis, ok_bid, ok_total, ok_date, ok_auction, ok_lot_number FROM compared",
    "evaluate_documents": CHAIN + _EXPECTED + "SELECT * FROM accuracy",
    "evaluate_summary": CHAIN
    + _EXPECTED
    + """, sums AS (
  SELECT count(*) AS documents, count(*) FILTER (has_truth AND accuracy < 0.99) AS failed, sum(score::DECIMAL(38,2)) FILTER (has_truth) AS score, sum(max_score::DECIMAL(38,2)) FILTER (has_truth) AS max_score,
         sum(chassis_correct) FILTER (has_truth) AS cc, sum(chassis_total) FILTER (has_truth) AS ct, sum(total_correct) FILTER (has_truth) AS tc, sum(total_total) FILTER (has_truth) AS tt FROM accuracy
), ratios AS (SELECT documents, failed, score::DOUBLE / max_score::DOUBLE AS final_accuracy, cc::DOUBLE / ct::DOUBLE AS chassis_accuracy, tc::DOUBLE / tt::DOUBLE AS total_accuracy FROM sums)
SELECT *, final_accuracy >= 0.99 AND chassis_accuracy >= 1.0 AND total_accuracy >= 0.99 AND failed = 0 AND documents > 0 AS passed FROM ratios""",
    "metrics_counters": "SELECT event_type AS metric, count(*) AS total FROM events GROUP BY event_type",
    "metrics_gauges": "SELECT event_type AS metric, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type",
    "metrics_histogram": f"""
WITH s AS ({_SAMPLES}), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn FROM s) WHERE rn <= 10000),
h AS (SELECT metric, count(value) AS n, avg(value) AS mean, list_sort(list(value)) AS v FROM k GROUP BY metric)
SELECT metric, n, v[1] AS min, v[-1] AS max, round(mean, 2) AS mean, v[floor(n * 0.5::DOUBLE)::INTEGER + 1] AS p50, v[floor(n * 0.95::DOUBLE)::INTEGER + 1] AS p95, v[floor(n * 0.99::DOUBLE)::INTEGER + 1] AS p99 FROM h""",
    "latency_window": f"WITH s AS ({_SAMPLES}) SELECT metric, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn FROM s) WHERE rn <= 500",
    "timed_metrics": "SELECT metric, count(*) AS n FROM (SELECT CASE WHEN value > 50 THEN event_type || '.error' ELSE event_type END AS metric FROM events) GROUP BY metric",
    "cache_keys": "SELECT doc_id, 'app:extraction:v2:' || sha256(text) AS extraction_key, 'app:translation:v2:m1:' || sha256(text) AS translation_key, 'app:segmentation:v2:' || sha256(text) AS segmentation_key FROM documents",
    "cache_lookup": _CACHE + "SELECT key, op_id, written_at, hit FROM looked",
    "cache_hit_ratio": _CACHE + "SELECT hits, misses, round(coalesce(hits / nullif(hits + misses, 0), 0), 3) AS hit_ratio FROM (SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM looked)",
    "circuit_breaker": """
WITH RECURSIVE c AS (
  SELECT user_id AS key, epoch_ms(ts) AS at_ms, event_id AS call_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events
), w AS (
  SELECT key, 0::BIGINT AS n, NULL::BIGINT AS call_id, 'CLOSED' AS met, true AS allowed, 'CLOSED' AS state, 0 AS failures, 0::BIGINT AS failed_at FROM (SELECT DISTINCT key FROM c)
  UNION ALL
  SELECT key, n, call_id, met, met <> 'OPEN',
         CASE WHEN met = 'OPEN' THEN 'OPEN' WHEN ok THEN 'CLOSED' WHEN met = 'HALF_OPEN' OR failures + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END,
         CASE WHEN met = 'OPEN' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN met = 'OPEN' OR ok THEN failed_at ELSE at_ms END
  FROM (SELECT c.key, c.n, c.call_id, c.ok, c.at_ms, w.failures, w.failed_at, CASE WHEN w.state = 'OPEN' AND c.at_ms - w.failed_at >= 36000000 THEN 'HALF_OPEN' ELSE w.state END AS met
        FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1)
)
SELECT key, call_id, met, allowed, state, failures FROM w WHERE n > 0""",
    "retry_schedule": "SELECT event_id AS job_id, k AS attempt, (5 * 2 ** (k - 2))::BIGINT AS delay_s FROM events CROSS JOIN (VALUES (2), (3)) t(k) WHERE event_type = 'error'",
    "ocr_page_assembly": "SELECT conv_id, string_agg('--- PAGE ' || rn || ' ---' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY rn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id",
    "ui_confidence_band": CHAIN + "SELECT doc_id, pos, CASE WHEN confidence < 0.7 THEN 'low' WHEN confidence < 0.9 THEN 'medium' ELSE 'high' END AS band, CASE WHEN confidence = 0 THEN 95 ELSE round(confidence * 100)::INTEGER END AS shown_percent FROM validated",
    "upload_rows": "SELECT page_id AS document_id, CASE page_id % 3 WHEN 0 THEN 'default-tenant' WHEN 1 THEN 't1' ELSE 't2' END AS tenant_id, sha256(html) AS file_hash, url AS original_name, 'application/pdf' AS mime_type, strlen(html)::BIGINT AS file_size, 'QUEUED' AS status, 'INGESTED' AS stage, page_id AS created FROM pages",
    "upload_audit": "SELECT page_id AS document_id, 'uploaded' AS action, 'INGESTED' AS stage, 'user' AS actor, '{\"size\":' || strlen(html) || ',\"originalName\":\"' || url || '\"}' AS details, page_id AS created_at FROM pages",
    "breaker_timeouts": """
WITH RECURSIVE c AS (
  SELECT user_id AS key, epoch_ms(ts) AS at_ms, event_id AS call_id, event_type <> 'error' AND coalesce(value <= 60, true) AS good, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events
), w AS (
  SELECT key, 0::BIGINT AS n, NULL::BIGINT AS call_id, 'CLOSED' AS met, true AS allowed, 'CLOSED' AS state, 0 AS failures, 0::BIGINT AS failed_at FROM (SELECT DISTINCT key FROM c)
  UNION ALL
  SELECT key, n, call_id, met, met <> 'OPEN',
         CASE WHEN met = 'OPEN' THEN 'OPEN' WHEN good THEN 'CLOSED' WHEN met = 'HALF_OPEN' OR failures + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END,
         CASE WHEN met = 'OPEN' THEN failures WHEN good THEN 0 ELSE failures + 1 END, CASE WHEN met = 'OPEN' OR good THEN failed_at ELSE at_ms END
  FROM (SELECT c.key, c.n, c.call_id, c.good, c.at_ms, w.failures, w.failed_at, CASE WHEN w.state = 'OPEN' AND c.at_ms - w.failed_at >= 36000000 THEN 'HALF_OPEN' ELSE w.state END AS met
        FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1)
)
SELECT key, call_id, met, allowed, state, failures FROM w WHERE n > 0""",
    "cache_writes": "SELECT user_id AS cache_key, event_id AS written_at, 86400 AS ttl_s, event_type AS payload FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('signup', 'purchase')) WHERE rn = 1",
    "missing_documents": "SELECT DISTINCT l_orderkey + l_linenumber * 1000 AS o_orderkey, 'Document ' || (l_orderkey + l_linenumber * 1000) || ' not found' AS error FROM lineitem WHERE l_orderkey + l_linenumber * 1000 NOT IN (SELECT o_orderkey FROM orders)",
    "found_documents": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey + l_linenumber * 1000 FROM lineitem)",
    "children_lists": "SELECT o_orderkey, coalesce(children, '') AS children FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, array_to_string(list_sort(list(l_linenumber || ':' || l_partkey)), ',') AS children FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)",
    "ui_status": """
WITH s AS (SELECT o_orderkey, ['QUEUED', 'PROCESSING', 'CLASSIFIED', 'EXTRACTED', 'STORED', 'COMPLETED', 'NEEDS_REVIEW', 'FAILED', ''][CASE WHEN o_orderkey % 10 < 9 THEN o_orderkey % 10 + 1 END] AS st, CASE WHEN o_orderkey % 10 <> 5 THEN floor(o_totalprice)::BIGINT END AS m FROM orders)
SELECT o_orderkey, CASE WHEN st = 'QUEUED' THEN 'Queued' WHEN st IN ('COMPLETED', 'STORED', 'NEEDS_REVIEW') THEN 'Complete' ELSE coalesce(nullif(st, ''), 'Unknown') END AS badge,
       CASE st WHEN 'QUEUED' THEN 20 WHEN 'CLASSIFIED' THEN 50 WHEN 'EXTRACTED' THEN 75 WHEN 'PROCESSING' THEN 40 WHEN 'COMPLETED' THEN 100 WHEN 'STORED' THEN 100 WHEN 'NEEDS_REVIEW' THEN 100 ELSE 0 END AS progress,
       coalesce(format('{:,}', m), '-') AS money FROM s""",
    "request_errors": """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Invalid API key' ELSE 'API key is missing' END AS rejection,
       CASE page_id % 3 WHEN 0 THEN '404' WHEN 1 THEN '400' ELSE '500' END AS status,
       CASE WHEN page_id % 5 = 0 THEN 'gone' WHEN page_id % 3 = 2 THEN 'Internal server error' ELSE 'Error occurred' END AS message, url AS path FROM pages""",
    "latency_samples": f"WITH s AS ({_SAMPLES}) SELECT metric, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS rn FROM s) WHERE rn <= 10000",
}
