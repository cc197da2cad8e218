"""DuckDB SQL for the queries that SQL can express, over whole tables."""

SIZED = r"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents)
"""

SQL = {
    "op6_source_mixing": f"""
WITH {SIZED},
weighed AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
leveled AS (
  SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
opened AS (SELECT level AS open_level FROM leveled WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1),
share AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce((SELECT open_level FROM opened) * weight, cap)) END::DOUBLE AS target
  FROM leveled),
split AS (
  SELECT *, floor(least(target / source_size, 3.0)) AS whole, (least(target / source_size, 3.0) - floor(least(target / source_size, 3.0))) * source_size AS missing FROM share)
SELECT d.doc_id, d.size, s.source_size, s.target,
       CAST(d.size * (coalesce(s.whole, 0) + CASE WHEN s.missing > 0 AND sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 <= s.missing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
""",
    "op8_line_dedup": r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
lines AS (
  SELECT r, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM numbered),
spread AS (SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
marked AS (SELECT l.*, s.line IS NOT NULL AS hit FROM lines l LEFT JOIN spread s ON trim(l.line, ' ') = s.line),
cleaned AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit) AS kept,
         count(*) FILTER (WHERE trim(line, ' ') <> '') AS n_lines, count(*) FILTER (WHERE hit) AS hits
  FROM marked GROUP BY r)
SELECT n.doc_id, coalesce(c.n_lines, 0) AS n_lines,
       coalesce(c.hits, 0) AS n_removed, sha256(CASE WHEN c.hits > 0 THEN coalesce(c.kept, '') ELSE n.text END) AS text_sha256
FROM numbered n LEFT JOIN cleaned c USING (r)
""",
    "op9_topk_search": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
lengths AS (SELECT doc_id, len(w) AS dl FROM words),
totals AS (SELECT count(*) AS n, avg(dl) AS mean FROM lengths),
asked AS (
  SELECT DISTINCT doc_id AS query_id, unnest(w) AS term FROM words WHERE doc_id % 20 = 0),
postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (
  SELECT a.query_id, p.doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) ORDER BY a.term), 6) AS score
  FROM asked a JOIN postings p USING (term) JOIN frequency USING (term) JOIN lengths USING (doc_id) CROSS JOIN totals GROUP BY ALL)
SELECT query_id, doc_id, rank, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored) WHERE rank <= 10
""",
}
