"""SQL for the queries of this folder that plain SQL can express over whole tables."""

SQL = {
    "p3_found": """
SELECT DISTINCT request_id FROM ingest_requests
WHERE length(text) > (SELECT coalesce(max(default_chunk_size), 800) FROM app_settings)""",
    "p8_found": """
WITH kept AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}ก-ฺเ-๛]+', '', 'g') AS t FROM documents),
passages AS (
  SELECT item_id, regexp_replace(lower(passage), '[^\\p{L}\\p{N}ก-ฺเ-๛]+', '', 'g') AS p FROM golden_items),
windows AS (
  SELECT item_id, substr(p, i, 60) AS w FROM passages, range(1, length(p) - 58) r(i) WHERE length(p) >= 60),
parts AS (
  SELECT doc_id, substr(t, i, 60) AS w FROM kept, range(1, length(t) - 58) r(i) WHERE length(t) >= 60)
SELECT DISTINCT doc_id, item_id FROM parts JOIN windows USING (w)""",
}
