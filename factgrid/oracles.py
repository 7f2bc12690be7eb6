"""The registered queries in DuckDB's SQL, written from the semantics and not from the DataFrames."""

from __future__ import annotations

from factgrid.functions.text import BINARY_SUFFIXES, BLANK_TOKENS, BLOCKED_DOMAINS, EXTRACTION_BLANK_TOKENS, TRUSTED_DOMAINS
from factgrid.operators.audit import SINGLE_REASON, UNGROUNDED_REASON, UNQUOTED_REASON


def _list(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def _has(column: str, tokens=BLANK_TOKENS) -> str:
    return f"({column} IS NOT NULL AND lower(trim({column}, ' ' || chr(9) || chr(10) || chr(13))) NOT IN {_list(tokens)})"


def _domain(url: str) -> str:
    return f"replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


def _norm(value: str) -> str:
    return rf"trim(regexp_replace(lower({value}), '[^\p{{L}}\p{{N}}\s]', '', 'g'))"


def _any(items, test: str) -> str:
    return "(" + " OR ".join(test.replace("{x}", "'" + x + "'") for x in items) + ")"


CTE = {
    "cells": """
np AS (SELECT count(*) AS n FROM pages),
rec AS (
  SELECT p.p_brand AS run_id, p.p_partkey AS ent_ord, p.p_name, p.p_type, p.p_size, p.p_retailprice, g.url AS source_url,
         CASE p.p_partkey % 3 WHEN 0 THEN p.p_name WHEN 1 THEN upper(p.p_name) ELSE replace(p.p_name, ' ', '-') END
         || CASE p.p_partkey % 5 WHEN 2 THEN ' co' WHEN 3 THEN ' co hub' WHEN 4 THEN ' corporation' ELSE '' END AS name
  FROM part p CROSS JOIN np JOIN pages g ON g.page_id = p.p_partkey % np.n),
long AS (
  SELECT run_id, ent_ord, name, source_url, 'type' AS field, CASE WHEN ent_ord % 7 = 0 THEN 'N/A' ELSE p_type END AS value FROM rec
  UNION ALL SELECT run_id, ent_ord, name, source_url, 'size', CASE WHEN ent_ord % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END FROM rec
  UNION ALL SELECT run_id, ent_ord, name, source_url, 'price', CASE WHEN ent_ord % 11 <> 0 THEN 'unknown' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END FROM rec
  UNION ALL SELECT run_id, ent_ord, name, source_url, 'color', substr(p_name, 1, instr(p_name, ' ') - 1) FROM rec),
cells AS (
  SELECT run_id, ent_ord, name, field, value, source_url,
         CASE WHEN value IS NULL THEN '' ELSE CASE ent_ord % 4 WHEN 0 THEN concat('listed as ', value, ' today') WHEN 1 THEN 'see details' WHEN 2 THEN '' ELSE upper(value) END END AS snippet
  FROM long),
entities AS (SELECT DISTINCT run_id, ent_ord, name FROM cells)""",
    "plan": """
plan AS (SELECT r.run_id, f.ord, f.field FROM (SELECT DISTINCT p_brand AS run_id FROM part) r
         CROSS JOIN (SELECT 0 AS ord, 'type' AS field UNION ALL SELECT 1, 'size' UNION ALL SELECT 2, 'price' UNION ALL SELECT 3, 'color') f)""",
    "results": """
results AS (
  SELECT concat('src', CAST(page_id % 20 AS VARCHAR)) AS run_id, q.query_ord, page_id AS rank, CASE WHEN page_id % 41 = 0 THEN '' ELSE url END AS url,
         substr(url, 1, 30) AS title, concat('snippet for ', url) AS snippet
  FROM pages JOIN (SELECT 0 AS query_ord, 1 AS every UNION ALL SELECT 1, 3 UNION ALL SELECT 2, 5) q ON page_id % q.every = 0)""",
    "raw_pages": """
raw_pages AS (
  SELECT page_id, url, CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status,
         CASE WHEN page_id % 10 = 5 THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS content_type, (page_id * 37) % 7000 AS elapsed_ms, html,
         concat('search snippet number ', CAST(page_id AS VARCHAR), ' for the page hosted at ', url) AS snippet
  FROM pages),
ladder AS (SELECT *, CASE WHEN status <> 200 THEN concat('HTTP ', status) WHEN NOT contains(content_type, 'text/html') THEN 'not HTML' END AS error FROM raw_pages)""",
    "odd_urls": """
odd AS (
  SELECT page_id,
         CASE page_id % 9 WHEN 0 THEN 'https://www.linkedin.com/in/' WHEN 1 THEN 'https://netflix.com/' WHEN 2 THEN 'http://m.facebook.com:8080/' WHEN 3 THEN 'https://example.gov/' ELSE 'https://news.example.org/' END
         || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf?x=1' WHEN 2 THEN '.zip' ELSE '.html' END AS url
  FROM pages)""",
    "sections": """
sections AS (
  SELECT source AS run_id, doc_id AS page_ord, concat('https://', source, '.example.com/', CAST(doc_id AS VARCHAR)) AS url, CAST(i - 1 AS BIGINT) AS sec_ord, parts[i] AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))""",
    "events": """
source_events AS (
  SELECT CAST(user_id % 20 AS BIGINT) AS run_id, event_id, concat('https://s', CAST(user_id AS VARCHAR), '.example.com/', CAST(event_id AS VARCHAR)) AS url, ts AS fetch_ts,
         CAST(floor(value * 100) AS BIGINT) AS elapsed_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS settle_status
  FROM events),
run_events AS (
  SELECT run_id, event_id AS seq, CASE WHEN event_id % 997 = 5 THEN 'error' WHEN event_id % 5 = 0 THEN 'status' ELSE 'source' END AS event,
         concat('{"url": "', url, '", "ms": ', elapsed_ms, '}') AS data
  FROM source_events),
frames AS (SELECT *, concat('event: ', event, chr(10), 'data: ', data, chr(10), chr(10)) AS frame FROM run_events)""",
    "replies": """
r0 AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Not stated' ELSE p_type END AS v, p_partkey % 8 AS kind, p_partkey % 16 = 7 AS failed FROM part),
replies AS (SELECT p_brand AS run_id, p_partkey AS batch, p_name, p_size, v, kind, failed, kind = 4 OR failed AS lost, kind NOT IN (3, 4) AND NOT failed AS has_one FROM r0)""",
    "scores": """
scored AS (
  SELECT s.*, CAST((contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT + (contains(lower(text), 'tion'))::INT + (contains(lower(text), 'of'))::INT
         + (contains(lower(text), 'que'))::INT + (contains(lower(text), 'der'))::INT + (contains(lower(text), 'les'))::INT AS BIGINT) AS score
  FROM sections s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, page_ord ORDER BY score DESC, sec_ord) AS slot, max(score) OVER (PARTITION BY run_id, page_ord) AS top FROM scored),
routed AS (SELECT * FROM ranked WHERE (score > 0 AND slot <= 3) OR (top = 0 AND slot <= 2))""",
    "fill": f"""
valued AS (SELECT cells.* FROM cells JOIN plan USING (run_id, field) WHERE {_has("value")}),
populated AS (SELECT run_id, count(DISTINCT ent_ord) AS n FROM valued GROUP BY run_id),
everyone AS (SELECT run_id, count(*) AS n FROM entities GROUP BY run_id),
fill AS (
  SELECT plan.run_id, plan.ord, plan.field, count(DISTINCT valued.ent_ord) AS n_filled, max(coalesce(populated.n, everyone.n)) AS n_rows,
         count(DISTINCT valued.ent_ord) / max(coalesce(populated.n, everyone.n)) AS fill
  FROM plan JOIN everyone USING (run_id) LEFT JOIN populated USING (run_id) LEFT JOIN valued ON valued.run_id = plan.run_id AND valued.field = plan.field
  GROUP BY ALL),
audited AS (
  SELECT *, CASE WHEN count(*) FILTER (fill >= 0.5) OVER (PARTITION BY run_id) >= 3 THEN fill >= 0.5
                 ELSE row_number() OVER (PARTITION BY run_id ORDER BY fill DESC, ord) <= 3 END AS kept
  FROM fill)""",
    "scored_cells": f"""
valued AS (SELECT cells.*, {_norm("value")} AS norm, {_norm("snippet")} AS quote, lower({_domain("source_url")}) AS domain FROM cells JOIN plan USING (run_id, field) WHERE {_has("value")}),
agree AS (SELECT run_id, field, norm, greatest(count(DISTINCT domain), 1) AS agreement_count FROM valued GROUP BY ALL),
points AS (
  SELECT valued.*, agreement_count, quote <> '' AND norm <> '' AND contains(quote, norm) AS grounded,
         least(100, 35 + CASE WHEN quote <> '' AND norm <> '' AND contains(quote, norm) THEN 35 WHEN quote <> '' THEN 10 ELSE 0 END
           + CASE WHEN agreement_count > 1 THEN least(10 * (agreement_count - 1), 20) ELSE 0 END + CASE WHEN {_any(TRUSTED_DOMAINS, "contains(domain, {x})")} THEN 10 ELSE 0 END) AS points
  FROM valued JOIN agree USING (run_id, field, norm)),
scored AS (
  SELECT run_id, ent_ord, field, value, source_url, snippet, agreement_count, points / 100.0::DOUBLE AS confidence,
         CASE WHEN points < 55 THEN concat_ws('; ', CASE WHEN grounded THEN NULL WHEN quote <> '' THEN '{UNGROUNDED_REASON}' ELSE '{UNQUOTED_REASON}' END,
           CASE WHEN agreement_count > 1 THEN NULL ELSE '{SINGLE_REASON}' END) ELSE '' END AS confidence_reason
  FROM points),
row_scores AS (
  SELECT e.run_id, e.ent_ord, e.name, coalesce(CAST(format('{{:.2f}}', list_sum(list(s.confidence ORDER BY plan.ord)) / count(s.confidence)) AS DOUBLE), 0) AS confidence
  FROM entities e LEFT JOIN scored s ON s.run_id = e.run_id AND s.ent_ord = e.ent_ord LEFT JOIN plan ON plan.run_id = s.run_id AND plan.field = s.field
  GROUP BY ALL)""",
    "rungs": f"""
have AS (SELECT DISTINCT cells.run_id, ent_ord, cells.field FROM cells JOIN plan USING (run_id, field) JOIN entities USING (run_id, ent_ord) WHERE {_has("value")}),
dropping AS (
  SELECT plan.run_id, plan.ord, plan.field, row_number() OVER (PARTITION BY plan.run_id ORDER BY count(have.ent_ord), plan.ord) AS drop_rank
  FROM plan LEFT JOIN have ON have.run_id = plan.run_id AND have.field = plan.field GROUP BY plan.run_id, plan.ord, plan.field),
lacking AS (
  SELECT e.run_id, e.ent_ord, coalesce(max(d.drop_rank) FILTER (h.field IS NULL), 0) AS missing
  FROM entities e JOIN dropping d ON d.run_id = e.run_id LEFT JOIN have h ON h.run_id = e.run_id AND h.ent_ord = e.ent_ord AND h.field = d.field GROUP BY e.run_id, e.ent_ord),
rungs AS (
  SELECT k.run_id, k.dropped, k.n_fields - k.dropped AS n_columns, count(l.ent_ord) FILTER (l.missing <= k.dropped) AS n_rows
  FROM (SELECT run_id, count(*) AS n_fields, unnest(range(count(*))) AS dropped FROM dropping GROUP BY run_id) k JOIN lacking l ON l.run_id = k.run_id GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_rows >= 3 DESC, CASE WHEN n_rows >= 3 THEN n_rows * n_columns ELSE n_rows END DESC, n_columns DESC) = 1 AS best FROM rungs)""",
    "groups": """
named AS (SELECT run_id, ent_ord, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm FROM (SELECT DISTINCT run_id, ent_ord, name FROM cells)),
classes AS (SELECT run_id, norm, min(ent_ord) AS ord FROM named WHERE norm <> '' GROUP BY ALL),
edges AS (
  SELECT a.run_id, a.norm AS norm_a, a.ord AS ord_a, b.norm AS norm_b, b.ord AS ord_b
  FROM classes a JOIN classes b ON a.run_id = b.run_id AND length(a.norm) > length(b.norm) AND contains(a.norm, b.norm) AND length(b.norm) / length(a.norm) >= 0.7),
before AS (SELECT run_id, greatest(ord_a, ord_b) AS ord, least(ord_a, ord_b) AS prev FROM edges),
nodes AS (SELECT DISTINCT run_id, ord FROM classes),
p1 AS (SELECT * FROM nodes ANTI JOIN before USING (run_id, ord)),
m1 AS (SELECT DISTINCT run_id, ord FROM before WHERE (run_id, prev) IN (SELECT (run_id, ord) FROM p1)),
p2 AS (SELECT n.* FROM nodes n WHERE (n.run_id, n.ord) NOT IN (SELECT (run_id, ord) FROM p1 UNION ALL SELECT (run_id, ord) FROM m1)
       AND NOT EXISTS (SELECT 1 FROM before b WHERE b.run_id = n.run_id AND b.ord = n.ord AND (b.run_id, b.prev) NOT IN (SELECT (run_id, ord) FROM m1))),
m2 AS (SELECT * FROM m1 UNION SELECT DISTINCT run_id, ord FROM before WHERE (run_id, prev) IN (SELECT (run_id, ord) FROM p2)),
p3 AS (SELECT n.* FROM nodes n WHERE (n.run_id, n.ord) NOT IN (SELECT (run_id, ord) FROM p1 UNION ALL SELECT (run_id, ord) FROM p2 UNION ALL SELECT (run_id, ord) FROM m2)
       AND NOT EXISTS (SELECT 1 FROM before b WHERE b.run_id = n.run_id AND b.ord = n.ord AND (b.run_id, b.prev) NOT IN (SELECT (run_id, ord) FROM m2))),
pivots AS (SELECT * FROM p1 UNION SELECT * FROM p2 UNION SELECT * FROM p3),
of_class AS (
  SELECT c.run_id, c.norm, coalesce(CASE WHEN (c.run_id, c.ord) IN (SELECT (run_id, ord) FROM pivots) THEN c.ord END,
         (SELECT min(b.prev) FROM before b JOIN pivots p ON p.run_id = b.run_id AND p.ord = b.prev WHERE b.run_id = c.run_id AND b.ord = c.ord)) AS "pivot"
  FROM classes c),
grouped AS (SELECT n.run_id, n.ent_ord, n.name, coalesce(o."pivot", n.ent_ord) AS "pivot" FROM named n LEFT JOIN of_class o ON o.run_id = n.run_id AND o.norm = n.norm)""",
    "merged": f"""
attributes AS (SELECT run_id, ent_ord, count(value) AS n FROM cells GROUP BY ALL),
merged_entities AS (SELECT g.run_id, g."pivot" AS ent_ord, arg_max(g.name, (a.n, -g.ent_ord)) AS name FROM grouped g JOIN attributes a USING (run_id, ent_ord) GROUP BY ALL),
best_cells AS (
  SELECT run_id, "pivot" AS ent_ord, field, value, source_url, snippet
  FROM (SELECT g."pivot", c.*, row_number() OVER (PARTITION BY c.run_id, g."pivot", c.field
          ORDER BY CASE WHEN c.snippet <> '' AND contains(lower(c.snippet), lower(c.value)) THEN 0 ELSE 1 END, CASE WHEN c.snippet = '' THEN 1 ELSE 0 END, length(c.value), c.ent_ord) AS rn
        FROM cells c JOIN grouped g USING (run_id, ent_ord) JOIN plan USING (run_id, field) WHERE {_has("c.value")})
  WHERE rn = 1)""",
}


def _sql(names: str, select: str) -> str:
    return "WITH " + ",".join(CTE[n] for n in names.split()) + "\n" + select


FIRST = "SELECT run_id, query_ord, rank, url, title, snippet FROM (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY query_ord, rank) AS rn FROM {t} WHERE url <> '') WHERE rn = 1"

ORACLE_SQL = {
    "search_dedup": _sql("results", FIRST.format(t="results")),
    "search_top": _sql("results", "SELECT run_id, query_ord, rank, url, title, snippet FROM results QUALIFY row_number() OVER (PARTITION BY run_id, query_ord ORDER BY rank) <= 5"),
    "extra_results_anti": _sql("results", "SELECT run_id, query_ord, rank, url, title, snippet FROM results r WHERE query_ord <> 1 AND url <> '' AND NOT EXISTS (SELECT 1 FROM results s WHERE s.query_ord = 1 AND s.run_id = r.run_id AND s.url = r.url) QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY query_ord, rank) = 1"),
}
ORACLE_SQL["second_round_gate"] = (
    "WITH "
    + CTE["results"]
    + """,
seed AS (SELECT * FROM results WHERE query_ord = 1 AND url <> ''),
enough AS (SELECT run_id FROM seed GROUP BY run_id HAVING count(*) >= 5)
SELECT run_id, query_ord, rank, url, title, snippet FROM seed
UNION ALL
SELECT run_id, query_ord, rank, url, title, snippet FROM results r
WHERE query_ord = 0 AND url <> '' AND run_id NOT IN (SELECT run_id FROM enough) AND NOT EXISTS (SELECT 1 FROM seed s WHERE s.run_id = r.run_id AND s.url = r.url)
"""
)
ORACLE_SQL |= {
    "url_domain": f"SELECT page_id, {_domain('url')} AS domain, {_any(TRUSTED_DOMAINS, f'contains(lower({_domain(chr(117) + chr(114) + chr(108))}), {{x}})')} AS trusted FROM pages",
    "blocked_domain": _sql("odd_urls", f"SELECT page_id, {_any(BLOCKED_DOMAINS, 'ends_with(' + _domain('url') + ', {x})')} AS blocked, {_any(TRUSTED_DOMAINS, 'contains(lower(' + _domain('url') + '), {x})')} AS trusted FROM odd"),
    "binary_url": _sql("odd_urls", f"SELECT page_id, {_any(BINARY_SUFFIXES, 'ends_with(lower(url), {x})')} AS is_binary FROM odd"),
    "redirects": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://a.example/x+y z' WHEN 1 THEN CASE WHEN starts_with(url, 'http') THEN url ELSE '' END ELSE '' END AS target FROM pages",
    "schema_trim": """
SELECT doc_id, array_to_string(list_filter(list_concat(['Name'], f)[1:6], lambda x: lower(x) <> 'name'), ',') AS fields, CAST(len(list_filter(list_concat(['Name'], f)[1:6], lambda x: lower(x) <> 'name')) AS BIGINT) AS n_fields
FROM (SELECT doc_id, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: list_position(ws, x[1]) = x[2]), lambda x: x[1])[1:9] AS f
      FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM documents))""",
    "query_checks": """
SELECT conv_id, turn, length(trim(text)) BETWEEN 3 AND 500 AS accepted,
       array_to_string(list_filter([' ' || text, text || ' list', upper(role), 'best of'], lambda q: lower(trim(q)) <> lower(text))[1:3], '|') AS extra
FROM conversations WHERE text IS NOT NULL""",
    "fetch_ladder": _sql("raw_pages", "SELECT page_id, error FROM ladder"),
    "usable_pages": _sql("raw_pages", "SELECT page_id, length(content) AS chars FROM (SELECT *, CASE WHEN error IS NULL THEN left(html, 12000) ELSE snippet END AS content FROM ladder) WHERE elapsed_ms <= 5000 AND length(content) > 50"),
    "jsonld_records": "SELECT p_partkey, concat('name: ', p_name, ' | cuisine: ', p_type, ', ', p_brand, ' | category: ', p_type, ' | brand: ', p_brand) AS record FROM part",
    "keywords": "SELECT DISTINCT source AS run_id, unnest(['the', 'and', 'tion', 'of', 'que', 'der', 'les', 'text of any kind']) AS keyword FROM documents",
    "section_scores": _sql("sections scores", "SELECT run_id, page_ord, sec_ord, score FROM scored"),
    "route_top3": _sql("sections scores", "SELECT run_id, page_ord, sec_ord, score, slot FROM routed"),
    "page_prompts": _sql("sections scores", "SELECT run_id, page_ord, concat(chr(10), '--- PAGE: ', url, ' ---', chr(10), string_agg(left(text, 700) || chr(10), '' ORDER BY slot)) AS prompt FROM routed GROUP BY run_id, page_ord, url"),
    "page_batches": "SELECT run_id, page_ord, n // 4 AS batch FROM (SELECT source AS run_id, doc_id AS page_ord, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) WHERE n < 8",
    "gap_route_budget": _sql(
        "sections",
        """, ranked AS (
  SELECT s.*, dense_rank() OVER (PARTITION BY run_id ORDER BY page_ord) AS pr, CAST(contains(lower(text), 'the')::INT + contains(lower(text), 'and th')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'qu')::INT AS BIGINT) AS hits FROM sections s),
near AS (SELECT *, length(concat('--- PAGE: ', url, ' | ', ' ---', chr(10), left(text, 900), chr(10))) AS n, row_number() OVER (PARTITION BY run_id ORDER BY hits DESC, page_ord, sec_ord) AS slot FROM ranked WHERE pr <= 8 AND hits > 0)
SELECT run_id, page_ord, sec_ord, hits, slot, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY slot) AS used FROM near) WHERE used <= 5000""",
    ),
    "parse_responses": _sql("replies", "SELECT run_id, batch, lost AS failed, CAST(has_one AS BIGINT) AS n_entities FROM replies"),
    "build_cells": _sql(
        "replies",
        f""", v AS (SELECT *, concat('https://first.example/', batch) AS source_url, {_has("v", EXTRACTION_BLANK_TOKENS)} AS ok FROM replies WHERE has_one)
SELECT run_id, batch, CAST(0 AS BIGINT) AS ord, p_name AS name, 'type' AS field, v AS value, source_url, concat('seen as ', v) AS snippet FROM v WHERE ok
UNION ALL SELECT run_id, batch, 0, p_name, 'size', CAST(p_size AS VARCHAR), source_url, '' FROM v""",
    ),
    "topup_anti": """
WITH e AS (SELECT p_brand AS run_id, p_name AS name, p_partkey AS k, CASE WHEN ascii(right(p_brand, 1)) % 2 = 0 THEN p_partkey % 2 = 0 ELSE p_partkey % 2000 = 1 END AS first FROM part),
a AS (SELECT run_id, name, k FROM e WHERE first), b AS (SELECT run_id, upper(name) AS name, k FROM e WHERE NOT first)
SELECT * FROM a UNION ALL
SELECT * FROM b WHERE run_id NOT IN (SELECT run_id FROM a GROUP BY run_id HAVING count(*) >= 5) AND NOT EXISTS (SELECT 1 FROM a WHERE a.run_id = b.run_id AND lower(a.name) = lower(b.name))""",
    "topup_plan": """
WITH s AS (
  SELECT concat(p_brand, '-', (p_partkey // 3) % 400) AS run_id, (p_partkey // 3) % 400 % 5 = 0 OR p_partkey % 7 = 0 AS failed, CAST(p_size % 3 AS BIGINT) AS n FROM part),
r AS (SELECT run_id, count(*) AS n_batches, count(*) FILTER (failed) AS n_failures, CAST(coalesce(sum(n) FILTER (NOT failed), 0) AS BIGINT) AS n_entities FROM s GROUP BY run_id)
SELECT *, n_entities < 4 AS tops_up, n_entities < 4 AND n_failures >= n_batches AS falls_back, n_entities = 0 AND n_failures > 0 AS unavailable FROM r""",
    "retry_outcomes": _sql("events", """
SELECT run_id, batch, NOT ok1 AND NOT ok2 AS failed, CASE WHEN ok1 THEN 'reply 1' WHEN ok2 THEN 'reply 2' END AS body, CAST(CASE WHEN ok1 THEN 1 ELSE 2 END AS BIGINT) AS n_attempts,
       CAST(CASE WHEN ok1 THEN 0 WHEN a1 % 4 = 0 THEN 2000 ELSE 1000 END AS BIGINT) AS waited_ms, NOT ok1 AND a1 % 4 = 1 AS plain
FROM (SELECT *, a1 % 4 NOT IN (0, 1) AND a1 % 8 <> 2 AS ok1, a2 % 4 NOT IN (0, 1) AND a2 % 8 <> 2 AS ok2
      FROM (SELECT CAST(run_id AS VARCHAR) AS run_id, event_id AS batch, event_id + 3 AS a1, event_id + 6 AS a2 FROM source_events))"""),
    "search_backend": _sql("results", """
SELECT run_id, query_ord, rank, url, title, snippet FROM (
  SELECT * FROM results WHERE url <> '' AND (CAST(substr(run_id, 4) AS INTEGER) % 2 = 0 OR query_ord = 1))
QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY query_ord, rank) = 1"""),
    "run_events": """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS run_id, s_suppkey AS k, s_name, s_suppkey % 7 = 0 AS cached, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 11 = 3 THEN s_suppkey % 5 + 1 END AS stage FROM supplier),
src AS (SELECT s.run_id, p_partkey AS own, concat('https://p.org/', p_partkey) AS url FROM part JOIN s ON s.k = p_partkey % (SELECT count(*) FROM supplier) + 1 WHERE NOT cached),
ev AS (
  SELECT run_id, 0 AS step, 0 AS own, 'status' AS event, '{"stage":0,"message":"Checking the cache"}' AS data FROM s
  UNION ALL SELECT run_id, 1, 0, 'status', CASE WHEN cached THEN '{"stage":1,"message":"Found in the cache"}' ELSE '{"stage":1,"message":"Planning"}' END FROM s
  UNION ALL SELECT run_id, 2, 0, 'plan', concat('{"entity_type":"thing","schema_fields":["name","size"],"search_queries":["', s_name, '"]}') FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 3, 0, 'status', '{"stage":2,"message":"Searching"}' FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 4, 0, 'status', concat('{"stage":2,"message":"Found ', k % 9, ' addresses"}') FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 5, 0, 'status', '{"stage":3,"message":"Reading pages"}' FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 6, own, 'source', concat('{"url":"', url, '"}') FROM src
  UNION ALL SELECT run_id, 7, 0, 'status', concat('{"stage":3,"message":"Read ', k % 6, ' pages"}') FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 8, 0, 'status', '{"stage":4,"message":"Extracting"}' FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 9, 0, 'status', concat('{"stage":4,"message":"Extracted ', k % 5, ' records"}') FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 10, 0, 'status', '{"stage":5,"message":"Merging and scoring"}' FROM s WHERE NOT cached
  UNION ALL SELECT run_id, 11, 0, 'status', '{"stage":5,"message":"Dropped 2 columns: size, color"}' FROM s WHERE NOT cached AND k % 2 = 0
  UNION ALL SELECT run_id, 12, 0, 'results', concat('{"table":"table of ', s_name, '","entity_count":', k % 4, '}') FROM s
  UNION ALL SELECT run_id, 13, 0, 'done', '{"message":"Done"}' FROM s),
told AS (
  SELECT ev.* FROM ev JOIN s USING (run_id) WHERE stage IS NULL OR step <= CASE stage WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 8 ELSE 10 END
  UNION ALL SELECT run_id, 99, 0, 'error', concat('{"message":"failed ', s_name, '"}') FROM s WHERE stage IS NOT NULL)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step, own) - 1 AS seq, event, data FROM told""",
    "frames_stream": _sql("events", "SELECT run_id, frame AS value FROM frames"),
    "embed_texts": "SELECT doc_id AS id, " + ", ".join(f"length(t) - length(replace(t, '{v}', '')) AS n_{v}" for v in "aeiou") + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "html_cells": _sql("cells", """SELECT run_id, ent_ord, concat(field, ' of it') AS heading, concat('&lt;b&gt;', replace(replace(name, '&', '&amp;'), chr(39), '&#39;'), '&lt;/b&gt; &amp; &quot;it&#39;s&quot;') AS shown,
       coalesce(replace(value, '&', '&amp;'), '') AS value FROM cells"""),
    "cache_append": "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END * count(*) AS n, concat('query ', vec_id) AS query_text FROM embeddings GROUP BY vec_id",
    "cache_clear": "SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after, count(*) FILTER (vec_id % 2 = 0) AS n_last FROM embeddings",
    "shard_deadline": _sql("events", "SELECT event_id, cutoff AS cutoff_ms, elapsed_ms <= cutoff AS accepted FROM (SELECT *, least(min(elapsed_ms) OVER (PARTITION BY substr(url, 1, 30)), 6500) + 2000 AS cutoff FROM source_events)"),
    "name_norm": _sql("cells groups", "SELECT run_id, ent_ord, name, norm FROM named"),
    "match_edges": _sql("cells groups", "SELECT * FROM edges"),
    "greedy_groups": _sql("cells groups", 'SELECT run_id, ent_ord, "pivot" FROM grouped'),
    "best_value": _sql("cells", f"""SELECT run_id, field, value, source_url, snippet FROM cells WHERE {_has("value")}
QUALIFY row_number() OVER (PARTITION BY run_id, field ORDER BY CASE WHEN snippet <> '' AND contains(lower(snippet), lower(value)) THEN 0 ELSE 1 END, CASE WHEN snippet = '' THEN 1 ELSE 0 END, length(value), ent_ord) = 1"""),
    "merged_entities": _sql("cells plan groups merged", "SELECT e.run_id, e.ent_ord, e.name, b.field, b.value, b.source_url, b.snippet FROM merged_entities e LEFT JOIN best_cells b ON b.run_id = e.run_id AND b.ent_ord = e.ent_ord"),
    "fill_ratio": _sql("cells plan fill", "SELECT run_id, CAST(ord AS BIGINT) AS ord, field, n_filled, n_rows, fill FROM fill"),
    "audit_columns": _sql("cells plan fill", "SELECT run_id, field, fill, kept FROM audited"),
    "drop_empty": _sql("cells", f"SELECT DISTINCT run_id, ent_ord, name FROM cells WHERE field IN ('size', 'price') AND {_has('value')}"),
    "gap_apply": _sql(
        "cells plan",
        f""", last AS (SELECT run_id, name, max(ent_ord) AS ent_ord FROM entities GROUP BY ALL),
have AS (SELECT * FROM cells WHERE {_has("value")}),
offers AS (SELECT run_id, name, field, concat('filled ', field) AS value, source_url FROM cells WHERE ent_ord % 2 = 0 AND ent_ord % 10 <> 0 AND field <> 'price')
SELECT run_id, ent_ord, field, value, source_url, snippet, false AS was_filled FROM have
UNION ALL
SELECT l.run_id, l.ent_ord, o.field, min(o.value), min(o.source_url), 'from a gap', true FROM offers o JOIN last l ON l.run_id = o.run_id AND l.name = o.name
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.run_id = l.run_id AND h.ent_ord = l.ent_ord AND h.field = o.field) GROUP BY l.run_id, l.ent_ord, o.field""",
    ),
    "agreement": _sql("cells plan scored_cells", "SELECT * FROM agree"),
    "cell_confidence": _sql("cells plan scored_cells", "SELECT run_id, ent_ord, field, agreement_count, confidence, confidence_reason FROM scored"),
    "row_confidence": _sql("cells plan scored_cells", "SELECT * FROM row_scores"),
    "ladder": _sql("cells plan rungs", "SELECT run_id, CAST(dropped AS BIGINT) AS dropped, n_columns, n_rows, best FROM best"),
    "cacheable": _sql("cells plan", f"""SELECT run_id, n AS n_rows, filled / (n * 3) AS mean_fill, filled / (n * 3) >= 0.7 AS cacheable
FROM (SELECT run_id, count(DISTINCT ent_ord) AS n, count(*) FILTER (field <> 'price' AND {_has("value")}) AS filled FROM cells GROUP BY run_id)"""),
    "sse_frames": _sql("events", "SELECT f.run_id, seq, frame FROM frames f LEFT JOIN (SELECT run_id, min(seq) AS last FROM run_events WHERE event = 'error' GROUP BY run_id) e USING (run_id) WHERE last IS NULL OR seq <= last"),
    "sse_parse": _sql("events", "SELECT seq, event, data FROM run_events UNION ALL SELECT seq, event, data FROM run_events"),
    "source_feed": _sql("events", """SELECT run_id, count(*) AS n_fetching, count(*) FILTER (elapsed_ms <= 5000 AND settle_status = 'ok') AS n_ok, count(*) FILTER (elapsed_ms <= 5000 AND settle_status = 'error') AS n_error,
       count(*) FILTER (elapsed_ms > 5000) AS n_timeout FROM source_events GROUP BY run_id"""),
    "settle_join": _sql("events", "SELECT run_id, url, CASE WHEN elapsed_ms <= 5000 THEN settle_status ELSE 'timeout' END AS status FROM source_events"),
    "source_rows": _sql("raw_pages", f"SELECT url, {_domain('url')} AS domain, left(concat(url, ' ', snippet), 90) AS title, length(snippet) AS chars, CAST(1 AS BIGINT) AS n_sections, page_id % 3 = 0 AS structured, coalesce(error, '') AS detail FROM ladder"),
    "cache_list": "SELECT p_partkey AS id, p_name AS query_text, CAST(p_size % 4 AS BIGINT) AS n_entities FROM part",
    "value_norms": _sql("cells", f"SELECT run_id, ent_ord, field, {_norm('concat(chr(32), chr(40), snippet, chr(41), chr(33), chr(32))')} AS norm, CAST(format('{{:.2f}}', ent_ord * 1.005::DOUBLE) AS DOUBLE) AS rounded FROM cells"),
    "conf_band": "SELECT p_brand AS run_id, CASE WHEN p_partkey % 100 / 100.0::DOUBLE >= 0.75 THEN 'hi' WHEN p_partkey % 100 / 100.0::DOUBLE >= 0.55 THEN 'mid' ELSE 'lo' END AS band, count(*) AS n FROM part GROUP BY ALL",
    "grounding_docs": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
}

_HOLES = f"""
last AS (SELECT run_id, name, max(ent_ord) AS ent_ord FROM entities GROUP BY ALL),
found AS (
  SELECT l.run_id, l.name, l.ent_ord, string_agg(p.field, ', ' ORDER BY p.ord) AS missing, count(*) AS n_missing
  FROM last l JOIN plan p ON p.run_id = l.run_id LEFT JOIN (SELECT * FROM cells WHERE {_has("value")}) c ON c.run_id = l.run_id AND c.ent_ord = l.ent_ord AND c.field = p.field
  WHERE c.field IS NULL GROUP BY ALL)"""
ORACLE_SQL["holes"] = _sql("cells plan", "," + _HOLES + " SELECT run_id, name, ent_ord, missing, n_missing FROM found")
ORACLE_SQL["holes_text"] = _sql(
    "cells plan",
    "," + _HOLES + """, sliced AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY ent_ord) - 1) // 5 AS worker FROM found)
SELECT run_id, worker, string_agg(concat('- ', name, ': missing ', missing), chr(10) ORDER BY ent_ord) AS holes_text FROM sliced WHERE worker < 2 GROUP BY ALL""",
)

#: Rows that are complete on the best rung of their run. Every run here has such rows.
_FINAL = """
final_rows AS (
  SELECT s.run_id, s.ent_ord, s.name, s.confidence, row_number() OVER (PARTITION BY s.run_id ORDER BY s.confidence DESC, s.ent_ord) AS position
  FROM row_scores s JOIN lacking l ON l.run_id = s.run_id AND l.ent_ord = s.ent_ord JOIN best b ON b.run_id = s.run_id AND b.best WHERE l.missing <= b.dropped)"""
ORACLE_SQL["finalize"] = _sql("cells plan scored_cells rungs", "," + _FINAL + " SELECT * FROM final_rows")
#: The whole core: the same steps over merged entities and audited columns in place of the raw ones.
ORACLE_SQL["final_table"] = (
    "WITH "
    + ",".join(CTE[n] for n in ("cells", "plan", "groups", "merged"))
    + ",m AS (WITH entities AS (SELECT * FROM merged_entities), cells AS (SELECT * FROM best_cells),"
    + CTE["fill"]
    + " SELECT run_id, ord, field FROM audited WHERE kept),"
    + f"t AS (WITH plan AS (SELECT * FROM m), cells AS (SELECT best_cells.* FROM best_cells JOIN m USING (run_id, field) WHERE {_has('value')}),"
    + " entities AS (SELECT * FROM merged_entities WHERE (run_id, ent_ord) IN (SELECT (run_id, ent_ord) FROM cells)),"
    + CTE["scored_cells"] + "," + CTE["rungs"] + "," + _FINAL
    + """
SELECT f.run_id, f.ent_ord, f.name, f.confidence, f.position, s.field, s.value, s.source_url, s.snippet, s.agreement_count, s.confidence AS cell_confidence, s.confidence_reason
FROM final_rows f JOIN scored s ON s.run_id = f.run_id AND s.ent_ord = f.ent_ord JOIN best b ON b.run_id = f.run_id AND b.best
JOIN dropping d ON d.run_id = f.run_id AND d.field = s.field AND d.drop_rank > b.dropped)
SELECT * FROM t
"""
)

_COSINE = """
WITH near AS (
  SELECT p.vec_id AS probe_id, c.vec_id AS best_id, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS s
  FROM embeddings p JOIN embeddings c ON p.vec_id % 50 = 0 AND c.vec_id <> p.vec_id),
top AS (SELECT probe_id, best_id, round(s, 6) AS similarity FROM near QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY s DESC, best_id) = 1)
"""
ORACLE_SQL["knn_top1"] = _COSINE + "SELECT * FROM top"
ORACLE_SQL["cache_hits"] = _COSINE + "SELECT probe_id, best_id, similarity >= 0.4 AS hit FROM top"
ORACLE_SQL["cache_misses"] = _COSINE + "SELECT similarity >= 0.85 AS hit, count(*) AS n FROM top GROUP BY ALL"

_EXPORTED = """,
x AS (SELECT e.*, ent_ord % 100 / 100.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY run_id ORDER BY ent_ord) AS position FROM entities e),
v AS (SELECT run_id, ent_ord, field, value || ' "q"' AS value FROM cells)
"""
ORACLE_SQL["csv_lines"] = _sql(
    "cells",
    _EXPORTED + """
SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS position, '"name","type","size","price","confidence"' AS line FROM entities
UNION ALL
SELECT x.run_id, x.position, concat('"', x.name, '","', max(replace(v.value, '"', '""')) FILTER (v.field = 'type'), '","', max(replace(v.value, '"', '""')) FILTER (v.field = 'size'), '","',
       max(replace(v.value, '"', '""')) FILTER (v.field = 'price'), '","', format('{:.2f}', x.confidence), '"')
FROM x JOIN v USING (run_id, ent_ord) GROUP BY x.run_id, x.position, x.name, x.confidence""",
)
ORACLE_SQL["json_tables"] = _sql("cells", _EXPORTED + "SELECT x.run_id, x.position, x.name, v.field, v.value FROM x JOIN v USING (run_id, ent_ord) WHERE v.field <> 'color'")
ORACLE_SQL["fence_strip"] = """
SELECT p_partkey AS batch, CASE kind WHEN 0 THEN concat('[', e, ']') WHEN 1 THEN concat('{"results": [', e, ']}') WHEN 2 THEN concat('{"entities": [', e, ', {"name": "cut o') WHEN 3 THEN '{"entities": []}'
       WHEN 4 THEN 'I found nothing.' WHEN 5 THEN concat('[', e, ', 7, null]') ELSE concat('{"entities": [', e, ']}') END AS bare
FROM (SELECT p_partkey, p_partkey % 8 AS kind, concat('{"name": "', p_name, '", "attributes": {"type": {"value": "', v, '", "source_snippet": "seen as ', v, '"}, "size": "', p_size, '", "other": "x"}}') AS e
      FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Not stated' ELSE p_type END AS v FROM part))
"""

ORACLE_SQL["json_results"] = """
SELECT 'r' AS run_id, page_id AS query_ord, k AS rank, CASE k WHEN 0 THEN url ELSE url || '#2' END AS url, CASE k WHEN 0 THEN 't' || page_id ELSE '' END AS title, 's' AS snippet
FROM pages CROSS JOIN (SELECT unnest([0::BIGINT, 1::BIGINT]) AS k) WHERE page_id % 6 > 1
"""
ORACLE_SQL["html_results"] = """
SELECT 'r' AS run_id, page_id AS query_ord, CASE WHEN k > 2 THEN k - 1 ELSE k END AS rank, concat('https://s.org/', page_id, '-', k) AS url, 'Title' || k AS title, CASE k WHEN 1 THEN '' ELSE 'some text' END AS snippet
FROM pages CROSS JOIN (SELECT unnest([0::BIGINT, 1::BIGINT, 3::BIGINT, 4::BIGINT]) AS k)
"""
ORACLE_SQL["plan_replies"] = """
SELECT CAST(page_id AS VARCHAR) AS run_id, k AS ord, 'f' || k AS field, CASE k WHEN 1 THEN 'a|b' ELSE '' END AS synonyms FROM pages CROSS JOIN (SELECT unnest(range(6)) AS k) WHERE page_id % 4 <> 3
"""
ORACLE_SQL["filled_replies"] = """
SELECT CAST(p_partkey AS VARCHAR) AS run_id, p_name AS name, 'type' AS field, p_type AS value, 'u' AS source_url, 's' AS snippet FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 'size', CAST(p_size AS VARCHAR), 'u', '' FROM part WHERE p_partkey % 3 <> 0
"""

#: The pages of the test tables hold one article with a header and paragraphs, some of them never closed: those hold all that follows.
ORACLE_SQL["html_sections"] = _sql(
    "raw_pages",
    r"""
, art AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS a FROM ladder WHERE error IS NULL),
body AS (SELECT page_id, regexp_extract(a, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS header, substr(a, strpos(a, '</h1>') + 5) AS rest FROM art),
token AS (SELECT page_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS i FROM (SELECT page_id, regexp_extract_all(rest, '(?s)<[^>]*>|[^<]+') AS ts FROM body)),
deep AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^<p[ >]') THEN 1 WHEN t = '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM token),
block AS (SELECT *, sum(CASE WHEN depth = 1 AND regexp_matches(t, '^<p[ >]') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS b FROM deep),
plain AS (
  SELECT page_id, b, i, trim(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13)) AS t
  FROM block WHERE depth > 0 AND t NOT LIKE '<%'),
line AS (SELECT page_id, b, trim(regexp_replace(string_agg(t, ' ' ORDER BY i), '\s{2,}', ' ', 'g')) AS t FROM plain WHERE t <> '' GROUP BY ALL),
sec AS (SELECT page_id, left(string_agg(t, chr(10) ORDER BY b), 6000) AS text FROM line WHERE length(t) > 2 GROUP BY page_id)
SELECT page_id, CAST(0 AS BIGINT) AS sec_ord, 'sec_1' AS sec_id, CASE WHEN length(text) < 200 THEN '' ELSE concat('H1: ', trim(replace(header, '&amp;', '&'))) END AS heading, text
FROM sec JOIN body USING (page_id) WHERE length(text) > 10""",
)
