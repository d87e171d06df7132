"""DuckDB SQL of the corpus operators that SQL can state."""

from __future__ import annotations

OP1_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND place > 1 THEN last_id END AS refers_to, url
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id,
             row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place FROM pages)
"""

OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
places AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM places),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT r, i FROM twice UNION SELECT r, i + 1 FROM twice UNION SELECT r, i + 2 FROM twice) GROUP BY r),
each_line AS (SELECT r, doc_id, source, t, unnest(lines) AS line FROM w),
normal AS (SELECT r, doc_id, source, t, lower(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM each_line),
above AS (
  SELECT f.source, f.line FROM (SELECT source, line, count(DISTINCT t) AS docs FROM normal GROUP BY source, line) f WHERE f.docs > 20),
removed AS (SELECT r, sum(n) AS n FROM normal JOIN above a ON a.line = normal.line AND a.source IS NOT DISTINCT FROM normal.source GROUP BY r),
base AS (
  SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN covered c ON c.r = w.r LEFT JOIN removed m ON m.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept, n_removed_words FROM base
"""


def _level(name: str, source: str, parent: str, weight: str) -> str:
    """Shares of the nodes of one level: ``source`` has (parent columns, name, capacity, budget)."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_a AS (SELECT *, CAST({weight} AS HUGEINT) AS weight FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(weight) OVER ({part} ORDER BY capacity / weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {name}_a),
{name}_c AS (SELECT *, capacity * weights <= (budget - taken) * weight AS is_full FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({part or 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING'}), 0)) * weight
  // sum(CASE WHEN NOT is_full THEN weight END) OVER ({part or 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING'}) END AS share FROM {name}_c)"""


OP8_SQL = rf"""
WITH rows_ AS (
  SELECT doc_id, 'd' || ((strpos('0123456789abcdef', substring(md5(coalesce(source, '?')), 1, 1)) - 1) % 4) AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS HUGEINT) AS tokens, md5(coalesce(text, '')) AS text_md5 FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * 2 AS capacity FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT least(CAST(floor(sum(tokens) * 0.5) AS HUGEINT), sum(capacity)) AS budget FROM leaves),
in_domain AS (SELECT domain AS name, sum(capacity) AS capacity, any_value(budget) AS budget FROM leaves, root GROUP BY domain),
{_level("by_domain", "in_domain", "", "CASE name WHEN 'd0' THEN 40 WHEN 'd1' THEN 30 WHEN 'd2' THEN 20 ELSE 10 END")},
in_lang AS (SELECT l.domain, l.lang AS name, sum(l.capacity) AS capacity, any_value(d.share) AS budget FROM leaves l JOIN by_domain d ON d.name = l.domain GROUP BY l.domain, l.lang),
{_level("by_lang", "in_lang", "domain", "CASE name WHEN 'en' THEN 3 ELSE 1 END")},
in_source AS (SELECT l.domain, l.lang, l.source AS name, l.tokens, l.capacity, g.share AS budget FROM leaves l JOIN by_lang g ON g.domain = l.domain AND g.name = l.lang),
{_level("by_source", "in_source", "domain, lang", "1")},
plan AS (SELECT domain, lang, name AS source, share // tokens AS whole, share % tokens AS room FROM by_source),
ordered AS (SELECT r.*, whole, room, sum(r.tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY md5('20240229:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '-' || r.text_md5)), doc_id, r.tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ r JOIN plan p ON p.domain = r.domain AND p.lang = r.lang AND p.source = r.source)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(unnest(list_concat(range(CAST(whole AS BIGINT)), CASE WHEN upto <= room THEN [CAST(whole AS BIGINT)] ELSE [] END)) AS INT) AS epoch FROM ordered
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op7_quality": OP7_SQL, "op8_mixing": OP8_SQL}
