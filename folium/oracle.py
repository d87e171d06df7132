"""DuckDB SQL that states the queries' results over the same tables, apart from the operators."""

from __future__ import annotations

from .plans.fixtures import TOC_CODES

_PAGES = r"""doc_pages AS (
  SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS page_no, unnest(l) AS text, CAST(len(regexp_extract_all(unnest(l), '\S+')) AS INT) AS token_count
  FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents)),
counts AS (SELECT doc_id, max(page_no) AS n_pages FROM doc_pages GROUP BY doc_id)"""
_LINES = _PAGES + r""",
md_lines AS (
  SELECT doc_id, page_no AS line_no, CASE WHEN length(text) > 0 AND length(text) < 60 THEN repeat('#', CAST(1 + length(text) % 4 AS INT)) || ' ' || text
    WHEN length(text) >= 60 AND length(text) % 17 = 0 THEN '```' ELSE text END AS line FROM doc_pages),
fenced AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS f FROM md_lines),
heads AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS seq, line_no, CAST(length(regexp_extract(line, '^(#{1,6})', 1)) AS INT) AS level, trim(regexp_extract(trim(line), '^#{1,6}\s+(.+)$', 1)) AS title
  FROM fenced WHERE f % 2 = 0 AND regexp_matches(line, '^#{1,6}\s+\S')),
secs AS (
  SELECT h.doc_id, h.seq, any_value(h.line_no) AS line_no, any_value(h.level) AS level, any_value(h.title) AS title, trim(string_agg(l.line, chr(10) ORDER BY l.line_no), ' ' || chr(9) || chr(10) || chr(13)) AS text
  FROM (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM heads) h JOIN md_lines l ON l.doc_id = h.doc_id AND l.line_no >= h.line_no AND (h.nxt IS NULL OR l.line_no < h.nxt)
  GROUP BY h.doc_id, h.seq),
ends AS (
  SELECT s.*, CAST(coalesce((SELECT min(n.seq) - 1 FROM secs n WHERE n.doc_id = s.doc_id AND n.seq > s.seq AND n.level <= s.level), (SELECT max(n.seq) FROM secs n WHERE n.doc_id = s.doc_id)) AS INT) AS subtree_end FROM secs s),
totals AS (
  SELECT e.*, (SELECT CAST(sum(len(regexp_extract_all(d.text, '\S+'))) AS BIGINT) FROM secs d WHERE d.doc_id = e.doc_id AND d.seq BETWEEN e.seq AND e.subtree_end) AS text_token_count FROM ends e)"""
_CODES = f"toc_codes AS ({TOC_CODES})"
_ITEMS = _PAGES + r""",
toc_items AS (
  SELECT doc_id, item_no, CAST(CAST(floor((item_no + 2) / 3.0) AS INT) AS VARCHAR) || CASE WHEN item_no % 3 = 1 THEN '' WHEN item_no % 3 = 2 THEN '.1' ELSE '.2' END AS structure,
    title, page_no AS true_page, page_no - CAST(doc_id % 5 AS INT) AS page,
    CASE WHEN (doc_id + page_no) % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 OR (doc_id + page_no) % 7 = 0 THEN page_no + 1 ELSE page_no END AS physical_index
  FROM (SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY page_no) AS INT) item_no, substring(text, 1, 40) title, page_no
    FROM doc_pages p JOIN counts c ON p.doc_id = c.doc_id WHERE n_pages >= 6 AND page_no % 2 = 1 AND token_count >= 5)),
pairs AS (
  SELECT a.doc_id, a.title, a.page, b.physical_index FROM toc_items a JOIN toc_items b ON a.doc_id = b.doc_id AND a.title IS NOT DISTINCT FROM b.title
  WHERE b.physical_index >= 1 AND b.true_page <= 20),
offs AS (
  SELECT doc_id, CAST(d AS INT) AS page_offset FROM (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, d) r
    FROM (SELECT doc_id, physical_index - page d, count(*) n FROM pairs WHERE page >= 0 AND physical_index >= 0 GROUP BY ALL)) WHERE r = 1),
answers AS (
  SELECT t.*, CASE WHEN contains(regexp_replace(lower(p.text), '\s+', '', 'g'), regexp_replace(lower(t.title), '\s+', '', 'g')) THEN 'yes' ELSE 'no' END AS answer,
    CASE WHEN starts_with(regexp_replace(lower(p.text), '\s+', '', 'g'), regexp_replace(lower(t.title), '\s+', '', 'g')) THEN 'yes' ELSE 'no' END AS appear_start
  FROM toc_items t LEFT JOIN doc_pages p ON p.doc_id = t.doc_id AND p.page_no = t.physical_index),
acc AS (
  SELECT c.doc_id, count(*) AS checked, CAST(sum(CASE WHEN answer = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS correct,
    round(CASE WHEN arg_max(physical_index, item_no) >= any_value(n_pages) / 2.0 THEN sum(CASE WHEN answer = 'yes' THEN 1.0 ELSE 0.0 END) / count(*) ELSE 0.0 END, 6) AS accuracy
  FROM answers a JOIN counts c ON a.doc_id = c.doc_id WHERE physical_index IS NOT NULL GROUP BY c.doc_id),
ranges AS (
  SELECT w.doc_id, w.item_no, w.structure, w.title, w.physical_index,
    coalesce((SELECT arg_max(g.physical_index, g.item_no) FROM answers g WHERE g.doc_id = w.doc_id AND g.item_no < w.item_no AND g.answer = 'yes' AND g.physical_index IS NOT NULL), 0) AS prev_index,
    coalesce((SELECT arg_min(g.physical_index, g.item_no) FROM answers g WHERE g.doc_id = w.doc_id AND g.item_no > w.item_no AND g.answer = 'yes' AND g.physical_index IS NOT NULL), c.n_pages) AS next_index
  FROM answers w JOIN counts c ON c.doc_id = w.doc_id WHERE w.physical_index IS NOT NULL AND w.answer = 'no'),
found AS (
  SELECT r.doc_id, r.item_no, min(p.page_no) AS found_index FROM ranges r JOIN doc_pages p ON p.doc_id = r.doc_id AND p.page_no BETWEEN r.prev_index AND r.next_index
    AND contains(regexp_replace(lower(p.text), '\s+', '', 'g'), regexp_replace(lower(r.title), '\s+', '', 'g')) GROUP BY ALL)"""
_SECTIONS = _ITEMS + r""",
valid AS (SELECT t.doc_id, item_no, structure, title, physical_index FROM toc_items t JOIN counts c ON c.doc_id = t.doc_id WHERE physical_index <= n_pages),
prefaced AS (
  SELECT * FROM valid UNION ALL
  SELECT doc_id, 0, '0', 'Preface', 1 FROM (SELECT doc_id, arg_min(physical_index, item_no) f FROM valid GROUP BY doc_id) WHERE f > 1),
begun AS (
  SELECT v.*, CASE WHEN starts_with(regexp_replace(lower(p.text), '\s+', '', 'g'), regexp_replace(lower(v.title), '\s+', '', 'g')) THEN 'yes' ELSE 'no' END AS appear_start
  FROM prefaced v LEFT JOIN doc_pages p ON p.doc_id = v.doc_id AND p.page_no = v.physical_index),
ended AS (
  SELECT b.*, b.physical_index AS start_index, CAST(CASE WHEN lead(1) OVER w IS NULL THEN n_pages WHEN lead(appear_start) OVER w = 'yes' THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END AS INT) AS end_index
  FROM begun b JOIN counts c ON c.doc_id = b.doc_id WINDOW w AS (PARTITION BY b.doc_id ORDER BY item_no)),
parented AS (
  SELECT e.*, (SELECT max(p.item_no) FROM ended p WHERE p.doc_id = e.doc_id AND p.item_no < e.item_no AND e.structure LIKE '%.%' AND p.structure = regexp_extract(e.structure, '^(.+)\.[^.]*$', 1)) AS parent_item FROM ended e),
placed AS (
  SELECT p.*, CASE WHEN parent_item IS NULL THEN 0 ELSE 1 END AS depth,
    row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(parent_item, item_no), CASE WHEN parent_item IS NULL THEN 0 ELSE 1 END, item_no) - 1 AS seq FROM parented p),
section_index AS (
  SELECT doc_id, item_no, structure, title, start_index, end_index, parent_item, depth, CAST(seq AS INT) AS seq, printf('%04d', seq) AS node_id FROM placed),
sec_tokens AS (
  SELECT s.doc_id, s.item_no, s.title, s.start_index, s.end_index, CAST(coalesce(sum(p.token_count), 0) AS BIGINT) AS tokens
  FROM section_index s LEFT JOIN doc_pages p ON p.doc_id = s.doc_id AND p.page_no BETWEEN s.start_index AND s.end_index GROUP BY ALL)"""
_CODE_TREE = "recursive " + _CODES + r""",
parented AS (
  SELECT c.*, (SELECT max(p.item_no) FROM toc_codes p WHERE p.doc_id = c.doc_id AND p.item_no < c.item_no AND c.structure LIKE '%.%' AND p.structure = regexp_extract(c.structure, '^(.+)\.[^.]*$', 1)) AS parent_item FROM toc_codes c),
walk AS (
  SELECT doc_id, item_no, structure, title, parent_item, [item_no] AS path FROM parented WHERE parent_item IS NULL
  UNION ALL SELECT p.doc_id, p.item_no, p.structure, p.title, p.parent_item, list_append(w.path, p.item_no) FROM parented p JOIN walk w ON w.doc_id = p.doc_id AND w.item_no = p.parent_item),
code_tree AS (SELECT doc_id, item_no, structure, title, parent_item, CAST(len(path) - 1 AS INT) AS depth, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INT) AS seq FROM walk)"""
_EVENTS = r"""job_events AS (
  SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' ELSE 'RUNNING' END AS status FROM events)"""
_USAGE = "recursive " + r"""ordered AS (SELECT user_id AS client, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
used AS (
  SELECT client, event_id, ts, r, 1 AS uses, ts + INTERVAL 1 DAY AS expires_at FROM ordered WHERE r = 1
  UNION ALL SELECT o.client, o.event_id, o.ts, o.r, CASE WHEN o.ts > u.expires_at THEN 1 ELSE u.uses + 1 END, CASE WHEN o.ts > u.expires_at THEN o.ts + INTERVAL 1 DAY ELSE u.expires_at END
  FROM ordered o JOIN used u ON o.client = u.client AND o.r = u.r + 1)"""
_SELECTED = _SECTIONS + r""",
questions AS (SELECT doc_id AS question_id, doc_id, substring(text, 1, 60) AS question FROM doc_pages WHERE page_no = 3),
shared AS (
  SELECT q.question_id, q.doc_id, s.seq, s.title, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(q.question), '\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(s.title), '\s+'), lambda x: x <> '')))) AS n
  FROM questions q JOIN section_index s ON s.doc_id = q.doc_id),
selected AS (SELECT question_id, doc_id, CAST(r AS INT) AS rank, title FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, seq) AS r FROM shared WHERE n > 0) WHERE r <= 3),
matched AS (
  SELECT question_id, doc_id, rank, seq, node_title, start_index, end_index FROM (
    SELECT x.question_id, x.doc_id, x.rank, s.seq, s.title AS node_title, s.start_index, s.end_index, row_number() OVER (PARTITION BY x.question_id, x.rank ORDER BY s.seq) AS r
    FROM selected x JOIN section_index s ON s.doc_id = x.doc_id AND (lower(s.title) = lower(x.title) OR contains(s.title, x.title))) WHERE r = 1),
bodies AS (
  SELECT m.question_id, m.rank, any_value(m.node_title) AS node_title, coalesce(string_agg(p.text || chr(10), '' ORDER BY p.page_no), '') AS body
  FROM matched m LEFT JOIN doc_pages p ON p.doc_id = m.doc_id AND p.page_no BETWEEN m.start_index AND m.end_index GROUP BY m.question_id, m.rank),
context AS (SELECT question_id, string_agg('=== ' || node_title || ' ===' || chr(10) || body || chr(10), '' ORDER BY rank) AS context, list(node_title ORDER BY rank) AS sources FROM bodies GROUP BY question_id)"""
_REPLIES = r"""replies AS (
  SELECT item_id, CASE item_id % 5 WHEN 0 THEN '```json {"thinking": "x", "answer": "yes"} ```' WHEN 1 THEN '{"thinking": "x", "answer": "no",}' WHEN 2 THEN '{"answer": "yes", "page": None}'
    WHEN 3 THEN '[{"structure": "1", "title": "A", "physical_index": "<physical_index_3>"}]' ELSE 'Error' END AS reply FROM benchmark)"""


def oracle_sql() -> dict[str, str]:
    def q(fixtures: str, select: str) -> str:
        return f"WITH {fixtures}\n{select}"

    found = {
        "page_scan": q(_PAGES, "SELECT * FROM doc_pages"),
        "page_count": q(_PAGES, "SELECT doc_id, n_pages FROM counts"),
        "doc_token_total": q(_PAGES, "SELECT doc_id, CAST(sum(token_count) AS BIGINT) AS tokens FROM doc_pages GROUP BY doc_id"),
        "page_range_text": q(_PAGES, "SELECT doc_id, string_agg(text, '' ORDER BY page_no) AS text FROM doc_pages WHERE page_no BETWEEN 2 AND 4 GROUP BY doc_id"),
        "tagged_pages": q(_PAGES, "SELECT doc_id, page_no, '<physical_index_' || page_no || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_no || '>' || chr(10) || chr(10) AS tagged FROM doc_pages"),
        "md_headings": q(_LINES, "SELECT doc_id, seq, line_no, level, title FROM heads"),
        "md_section_slices": q(_LINES, "SELECT doc_id, seq, line_no, level, title, text FROM secs"),
        "md_section_tree": q(_LINES, """, up AS (SELECT h.*, (SELECT max(p.seq) FROM heads p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level) AS parent_seq FROM heads h),
            deep AS (SELECT u.*, (SELECT count(*) FROM heads p WHERE p.doc_id = u.doc_id AND p.seq < u.seq AND p.level < u.level AND NOT EXISTS (SELECT 1 FROM heads m WHERE m.doc_id = u.doc_id AND m.seq > p.seq AND m.seq < u.seq AND m.level <= p.level)) AS depth FROM up u)
            SELECT doc_id, seq, line_no, level, title, parent_seq, CAST(depth AS INT) AS depth, printf('%04d', seq - 1) AS node_id FROM deep""").replace(")\n, up", "),\n up"),
        "md_parent_lookup": q(_LINES, "SELECT doc_id, seq, (SELECT max(p.seq) FROM heads p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level) AS parent_seq FROM heads h"),
        "md_subtree_interval": q(_LINES, "SELECT doc_id, seq, level, subtree_end FROM ends"),
        "md_subtree_tokens": q(_LINES, "SELECT doc_id, seq, level, subtree_end, text_token_count FROM totals"),
        "md_thinning": q(_LINES, """SELECT t.doc_id, t.seq, t.level, t.title, CASE WHEN t.text_token_count < 40 THEN (SELECT string_agg(d.text, chr(10) || chr(10) ORDER BY d.seq) FROM secs d WHERE d.doc_id = t.doc_id AND d.seq BETWEEN t.seq AND t.subtree_end AND d.text <> '') ELSE t.text END AS text, t.text_token_count
            FROM totals t WHERE NOT EXISTS (SELECT 1 FROM totals a WHERE a.doc_id = t.doc_id AND a.seq < t.seq AND a.subtree_end >= t.seq AND a.text_token_count < 40)"""),
        "md_leaf_summary_key": q(_LINES, r"""SELECT doc_id, seq, is_leaf, CASE WHEN short AND is_leaf THEN text END AS summary, CASE WHEN short AND NOT is_leaf THEN text END AS prefix_summary, NOT short AS ask
            FROM (SELECT *, coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY seq) <= level, true) AS is_leaf, len(regexp_extract_all(text, '\S+')) < 30 AS short FROM secs)"""),
        "code_parent_join": q(_CODE_TREE, "SELECT doc_id, item_no, structure, parent_item FROM parented"),
        "code_tree": q(_CODE_TREE, "SELECT doc_id, item_no, structure, title, parent_item, depth, path FROM code_tree"),
        "code_tree_depths": q(_CODE_TREE, "SELECT doc_id, depth, count(*) AS nodes FROM code_tree GROUP BY doc_id, depth"),
        "nested_json": q(_CODE_TREE + """,
            own AS (SELECT *, '{"title":' || to_json(title) || ',"node_id":"' || printf('%04d', seq) || '"' AS head FROM code_tree),
            two AS (SELECT doc_id, parent_item, string_agg(head || '}', ',' ORDER BY seq) AS kids FROM own WHERE depth = 2 GROUP BY ALL),
            one AS (SELECT o.doc_id, o.parent_item, string_agg(head || coalesce(',"nodes":[' || kids || ']', '') || '}', ',' ORDER BY seq) AS kids FROM own o LEFT JOIN two t ON t.doc_id = o.doc_id AND t.parent_item = o.item_no WHERE depth = 1 GROUP BY ALL)""",
            """SELECT o.doc_id, '[' || string_agg(head || coalesce(',"nodes":[' || kids || ']', '') || '}', ',' ORDER BY seq) || ']' AS structure_json FROM own o LEFT JOIN one t ON t.doc_id = o.doc_id AND t.parent_item = o.item_no WHERE depth = 0 GROUP BY o.doc_id"""),
        "code_preorder_ids": q(_CODE_TREE, "SELECT doc_id, item_no, seq, printf('%04d', seq) AS node_id FROM code_tree"),
        "code_subtree_counts": q(_CODE_TREE, "SELECT a.doc_id, a.item_no, (SELECT count(*) FROM code_tree d WHERE d.doc_id = a.doc_id AND list_contains(d.path, a.item_no)) - 1 AS below FROM code_tree a"),
        "code_leaves": q(_CODE_TREE, "SELECT doc_id, item_no FROM code_tree a WHERE NOT EXISTS (SELECT 1 FROM code_tree c WHERE c.doc_id = a.doc_id AND c.parent_item = a.item_no)"),
        "code_outline": q(_CODE_TREE, "SELECT doc_id, string_agg(repeat('  ', depth) || '- ' || title || chr(10), '' ORDER BY seq) AS outline FROM code_tree GROUP BY doc_id"),
        "toc_first_run": q(_PAGES, """, flags AS (SELECT doc_id, page_no, CASE WHEN token_count % 5 < 2 THEN 'yes' ELSE 'no' END AS a FROM doc_pages),
            starts AS (SELECT doc_id, min(page_no) AS first_page FROM flags WHERE a = 'yes' AND page_no <= 20 GROUP BY doc_id)
            SELECT s.doc_id, s.first_page, CAST(coalesce((SELECT min(f.page_no) - 1 FROM flags f WHERE f.doc_id = s.doc_id AND f.page_no > s.first_page AND f.a = 'no'), (SELECT max(f.page_no) FROM flags f WHERE f.doc_id = s.doc_id)) AS INT) AS last_page FROM starts s""").replace(")\n, flags", "),\n flags"),
        "toc_run_choice": q(_PAGES, r""", flags AS (SELECT doc_id, page_no, text, CASE WHEN token_count % 5 < 2 THEN 'yes' ELSE 'no' END AS a FROM doc_pages),
            islands AS (SELECT *, sum(CASE WHEN a = 'no' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM flags),
            runs AS (SELECT doc_id, min(page_no) AS first_page, max(page_no) AS last_page, string_agg(text, '' ORDER BY page_no) AS t FROM islands WHERE a = 'yes' GROUP BY doc_id, g HAVING min(page_no) <= 20),
            given AS (SELECT *, CASE WHEN regexp_matches(t, '(?m)\d\s*$') THEN 'yes' ELSE 'no' END AS page_index_given FROM runs)
            SELECT doc_id, first_page, last_page, page_index_given FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page_index_given = 'yes' THEN 0 ELSE 1 END, first_page) AS r FROM given) WHERE r = 1""").replace(")\n, flags", "),\n flags"),
        "title_pairs": q(_ITEMS, "SELECT * FROM pairs"),
        "page_offset": q(_ITEMS, "SELECT * FROM offs"),
        "add_offset": q(_ITEMS, """SELECT t.doc_id, item_no, title, CASE WHEN page_offset IS NULL THEN page END AS page, CASE WHEN page_offset IS NULL THEN physical_index ELSE page + page_offset END AS physical_index
            FROM toc_items t LEFT JOIN offs o ON o.doc_id = t.doc_id"""),
        "gap_neighbours": q(_ITEMS, """SELECT t.doc_id, t.item_no,
            coalesce((SELECT arg_max(p.physical_index, p.item_no) FROM toc_items p WHERE p.doc_id = t.doc_id AND p.item_no < t.item_no AND p.physical_index IS NOT NULL), 0) AS prev_index,
            coalesce((SELECT arg_min(p.physical_index, p.item_no) FROM toc_items p WHERE p.doc_id = t.doc_id AND p.item_no > t.item_no AND p.physical_index IS NOT NULL), c.n_pages) AS next_index
            FROM toc_items t JOIN counts c ON c.doc_id = t.doc_id WHERE t.physical_index IS NULL"""),
        "gap_pages": q(_ITEMS, """, gaps AS (SELECT t.doc_id, t.item_no,
            coalesce((SELECT arg_max(p.physical_index, p.item_no) FROM toc_items p WHERE p.doc_id = t.doc_id AND p.item_no < t.item_no AND p.physical_index IS NOT NULL), 0) AS lo,
            coalesce((SELECT arg_min(p.physical_index, p.item_no) FROM toc_items p WHERE p.doc_id = t.doc_id AND p.item_no > t.item_no AND p.physical_index IS NOT NULL), c.n_pages) AS hi
            FROM toc_items t JOIN counts c ON c.doc_id = t.doc_id WHERE t.physical_index IS NULL)
            SELECT g.doc_id, g.item_no, count(*) AS n, string_agg('<physical_index_' || page_no || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_no || '>' || chr(10) || chr(10), '' ORDER BY page_no) AS tagged
            FROM gaps g JOIN doc_pages p ON p.doc_id = g.doc_id AND p.page_no BETWEEN lo AND hi GROUP BY g.doc_id, g.item_no""").replace(")\n, gaps", "),\n gaps"),
        "page_groups": "WITH recursive " + _PAGES + r""",
            budget AS (SELECT doc_id, sum(token_count) AS total, CASE WHEN sum(token_count) <= 120 THEN sum(token_count) ELSE ceil((sum(token_count) / ceil(sum(token_count) / 120.0) + 120) / 2.0) END AS lim FROM doc_pages GROUP BY doc_id),
            fold AS (
              SELECT p.doc_id, p.page_no, CASE WHEN p.token_count > b.lim THEN 1 ELSE 0 END AS g, CAST(p.token_count AS BIGINT) AS s, p.token_count AS t, CASE WHEN p.token_count > b.lim THEN 1 ELSE 0 END AS opened FROM doc_pages p JOIN budget b ON b.doc_id = p.doc_id WHERE p.page_no = 1
              UNION ALL SELECT p.doc_id, p.page_no, CASE WHEN f.s + p.token_count > b.lim THEN f.g + 1 ELSE f.g END, CASE WHEN f.s + p.token_count > b.lim THEN f.t + p.token_count ELSE f.s + p.token_count END, p.token_count, CASE WHEN f.s + p.token_count > b.lim THEN 1 ELSE 0 END
              FROM doc_pages p JOIN fold f ON f.doc_id = p.doc_id AND p.page_no = f.page_no + 1 JOIN budget b ON b.doc_id = p.doc_id),
            members AS (SELECT doc_id, g, page_no FROM fold UNION SELECT doc_id, g, page_no - 1 FROM fold WHERE opened = 1 AND page_no > 1)
            SELECT doc_id, CAST(g AS INT) AS group_no, min(page_no) AS first_page, max(page_no) AS last_page FROM members GROUP BY doc_id, g""",
        "line_classes": q(_PAGES, """SELECT doc_id, page_no, CASE WHEN contains(lower(text), 'error') THEN 'error' WHEN contains(lower(text), 'warning') THEN 'warning' WHEN contains(lower(text), 'done') THEN 'done' ELSE 'info' END AS class, left(text, 20) AS short FROM doc_pages"""),
        "filled_gaps": q(_ITEMS, r""", gaps AS (SELECT t.doc_id, t.item_no, t.title,
            coalesce((SELECT arg_max(p.physical_index, p.item_no) FROM toc_items p WHERE p.doc_id = t.doc_id AND p.item_no < t.item_no AND p.physical_index IS NOT NULL), 0) AS lo,
            coalesce((SELECT arg_min(p.physical_index, p.item_no) FROM toc_items p WHERE p.doc_id = t.doc_id AND p.item_no > t.item_no AND p.physical_index IS NOT NULL), c.n_pages) AS hi
            FROM toc_items t JOIN counts c ON c.doc_id = t.doc_id WHERE t.physical_index IS NULL),
            filled AS (SELECT g.doc_id, g.item_no, min(p.page_no) AS at FROM gaps g JOIN doc_pages p ON p.doc_id = g.doc_id AND p.page_no BETWEEN lo AND hi
              AND contains(regexp_replace(lower(p.text), '\s+', '', 'g'), regexp_replace(lower(g.title), '\s+', '', 'g')) GROUP BY ALL)
            SELECT t.doc_id, t.item_no, t.title, coalesce(t.physical_index, f.at) AS physical_index FROM toc_items t LEFT JOIN filled f ON f.doc_id = t.doc_id AND f.item_no = t.item_no""").replace(")\n, gaps", "),\n gaps"),
        "items_in_pages": q(_ITEMS, "SELECT doc_id, item_no, title, physical_index FROM toc_items WHERE physical_index BETWEEN 2 AND 9"),
        "sampled_items": q(_ITEMS, "SELECT doc_id, item_no, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || doc_id || ':' || item_no)) AS r FROM toc_items) WHERE r <= 2"),
        "repaired_items": q(_ITEMS, r""", ok AS (SELECT a.* FROM answers a JOIN counts c ON c.doc_id = a.doc_id WHERE physical_index <= n_pages),
            bad AS (SELECT w.doc_id, w.item_no, w.title,
              coalesce((SELECT arg_max(g.physical_index, g.item_no) FROM ok g WHERE g.doc_id = w.doc_id AND g.item_no < w.item_no AND g.answer = 'yes'), 0) AS lo,
              coalesce((SELECT arg_min(g.physical_index, g.item_no) FROM ok g WHERE g.doc_id = w.doc_id AND g.item_no > w.item_no AND g.answer = 'yes'), c.n_pages) AS hi
              FROM ok w JOIN counts c ON c.doc_id = w.doc_id WHERE w.answer = 'no'),
            right_ AS (SELECT b.doc_id, b.item_no, min(p.page_no) AS at FROM bad b JOIN doc_pages p ON p.doc_id = b.doc_id AND p.page_no BETWEEN lo AND hi
              AND contains(regexp_replace(lower(p.text), '\s+', '', 'g'), regexp_replace(lower(b.title), '\s+', '', 'g')) GROUP BY ALL)
            SELECT o.doc_id, o.item_no, o.title, coalesce(r.at, o.physical_index) AS physical_index FROM ok o LEFT JOIN right_ r ON r.doc_id = o.doc_id AND r.item_no = o.item_no""").replace(")\n, ok", "),\n ok"),
        "validate_truncate": q(_ITEMS, "SELECT t.doc_id, item_no, title, CASE WHEN physical_index <= n_pages THEN physical_index END AS physical_index FROM toc_items t JOIN counts c ON c.doc_id = t.doc_id"),
        "drop_null_index": q(_ITEMS, "SELECT doc_id, item_no, title, physical_index FROM toc_items WHERE physical_index IS NOT NULL"),
        "title_check": q(_ITEMS, "SELECT doc_id, item_no, answer FROM answers"),
        "title_start_check": q(_ITEMS, "SELECT doc_id, item_no, appear_start FROM answers"),
        "verify_accuracy": q(_ITEMS, "SELECT * FROM acc"),
        "incorrect_items": q(_ITEMS, "SELECT doc_id, item_no, title, physical_index FROM answers WHERE physical_index IS NOT NULL AND answer = 'no'"),
        "correct_neighbours": q(_ITEMS, "SELECT doc_id, item_no, prev_index, next_index FROM ranges"),
        "fix_incorrect": q(_ITEMS, "SELECT * FROM found"),
        "fix_apply": q(_ITEMS, "SELECT t.doc_id, t.item_no, title, coalesce(found_index, physical_index) AS physical_index FROM toc_items t LEFT JOIN found f ON f.doc_id = t.doc_id AND f.item_no = t.item_no"),
        "mode_decision": q(_ITEMS, "SELECT *, CASE WHEN accuracy = 1.0 AND checked = correct THEN 'accept' WHEN accuracy > 0.4 AND checked > correct THEN 'fix' ELSE 'fall back' END AS decision FROM acc"),
        "preface_row": q(_SECTIONS, "SELECT * FROM prefaced"),
        "end_index": q(_SECTIONS, "SELECT doc_id, item_no, start_index, end_index FROM ended"),
        "section_index": q(_SECTIONS, "SELECT * FROM section_index"),
        "section_text": q(_SECTIONS, "SELECT s.doc_id, item_no, string_agg(p.text, '' ORDER BY page_no) AS text FROM section_index s JOIN doc_pages p ON p.doc_id = s.doc_id AND p.page_no BETWEEN start_index AND end_index GROUP BY s.doc_id, item_no"),
        "text_removed": q(_SECTIONS, "SELECT doc_id, item_no, title, node_id FROM section_index"),
        "section_tokens": q(_SECTIONS, "SELECT doc_id, item_no, start_index, end_index, tokens FROM sec_tokens"),
        "large_nodes": q(_SECTIONS, "SELECT doc_id, item_no, tokens FROM sec_tokens WHERE end_index - start_index > 1 AND tokens >= 60"),
        "head_removal": q(_ITEMS, """, first AS (SELECT doc_id, min(item_no) AS item_no FROM toc_items GROUP BY doc_id)
            SELECT t.doc_id, t.item_no, t.title FROM toc_items t JOIN first f ON f.doc_id = t.doc_id LEFT JOIN doc_pages p ON p.doc_id = t.doc_id AND p.page_no = 1
            WHERE NOT (t.item_no = f.item_no AND trim(t.title) = trim(substring(p.text, 1, 40)))""").replace(")\n, first", "),\n first"),
        "outline_text": q(_SECTIONS, "SELECT doc_id, string_agg(repeat('  ', depth) || '- ' || title || ' (pages ' || start_index || '-' || end_index || ')' || chr(10), '' ORDER BY seq) AS outline FROM section_index GROUP BY doc_id"),
        "doc_description": q(_SECTIONS, "SELECT doc_id, string_agg(title, '; ' ORDER BY seq) AS doc_description FROM section_index WHERE depth = 0 GROUP BY doc_id"),
        "html_outline": "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, CAST(len(string_split(html, '<p>')) - 1 AS INT) AS n_p FROM pages",
        "select_sections": q(_SELECTED, "SELECT * FROM selected"),
        "rag_context": q(_SELECTED, """, lined AS (SELECT doc_id, string_agg(repeat('  ', depth) || '- ' || title || ' (pages ' || start_index || '-' || end_index || ')' || chr(10), '' ORDER BY seq) AS outline FROM section_index GROUP BY doc_id)
            SELECT * FROM context UNION ALL SELECT q.question_id, coalesce(l.outline, ''), CAST([] AS VARCHAR[]) FROM questions q LEFT JOIN lined l ON l.doc_id = q.doc_id WHERE q.question_id NOT IN (SELECT question_id FROM context)""").replace(")\n, lined", "),\n lined"),
        "rag_answer": q(_SELECTED, r""", lined AS (SELECT doc_id, string_agg(repeat('  ', depth) || '- ' || title || ' (pages ' || start_index || '-' || end_index || ')' || chr(10), '' ORDER BY seq) AS outline FROM section_index GROUP BY doc_id),
            every AS (SELECT * FROM context UNION ALL SELECT q.question_id, coalesce(l.outline, ''), CAST([] AS VARCHAR[]) FROM questions q LEFT JOIN lined l ON l.doc_id = q.doc_id WHERE q.question_id NOT IN (SELECT question_id FROM context)),
            split AS (SELECT question_id, sources, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT *, string_split(context, chr(10)) AS l FROM every)),
            scored AS (SELECT s.*, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(q.question), '\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(s.line), '\s+'), lambda x: x <> '')))) AS n
              FROM split s JOIN questions q ON q.question_id = s.question_id WHERE line NOT LIKE '=== % ===')
            SELECT question_id, line AS answer, sources FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, pos) AS r FROM scored) WHERE r = 1""").replace(")\n, lined", "),\n lined"),
        "strip_fence": q(_REPLIES, r"SELECT item_id, trim(CASE WHEN reply LIKE '```json%' THEN regexp_extract(reply, '(?s)```json(.*)```', 1) ELSE reply END) AS reply FROM replies"),
        "json_default": q(_REPLIES, "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'no' END AS answer FROM replies"),
        "json_array_rows": q(_REPLIES, "SELECT item_id, '1' AS structure, 'A' AS title, 3 AS physical_index FROM replies WHERE item_id % 5 = 3"),
        "parse_physical_index": "SELECT r_regionkey, v, n FROM region, (VALUES ('<physical_index_5>', 5), ('physical_index_10', 10), ('physical_index_0', 0), (' 7 ', 7), ('invalid_format', NULL), (NULL, NULL)) t(v, n)",
        "to_int_default": "SELECT r_regionkey, v, n FROM region, (VALUES ('12', 12), (' 3 ', 3), ('x', -1), ('', -1), (NULL, -1)) t(v, n)",
        "page_to_int": "SELECT r_regionkey, v, n FROM region, (VALUES ('12', 12), (' 3 ', 3), ('x', NULL), ('', NULL), (NULL, NULL)) t(v, n)",
        "extract_json": q(_REPLIES, """SELECT item_id, CASE WHEN item_id % 5 < 2 THEN 'x' ELSE '-' END AS thinking, CASE WHEN item_id % 5 = 3 THEN 'A' END AS title,
            CASE item_id % 5 WHEN 0 THEN '{"answer":"yes","thinking":"x"}' WHEN 1 THEN '{"answer":"no","thinking":"x"}' WHEN 2 THEN '{"answer":"yes","page":null}'
            WHEN 3 THEN '[{"physical_index":"<physical_index_3>","structure":"1","title":"A"}]' ELSE '{}' END AS json FROM replies"""),
        "string_arrays": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'x'] ELSE CAST([] AS VARCHAR[]) END AS titles FROM nation",
        "dot_leader": r"SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' ........ ' || p_size || '. . . . . . 7', '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS line FROM part",
        "doc_key": r"SELECT page_id, regexp_replace(url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.markdown' ELSE '.PDF' END, '\.(pdf|md|markdown)$', '') AS doc_key FROM pages",
        "sanitize_ip": "SELECT event_id, '10_0_' || (user_id % 7) || '_' || (user_id % 250) AS client FROM events",
        "first_sentence_summary": q(_PAGES, r"""SELECT doc_id, page_no, CASE WHEN trim(text) <> '' THEN array_to_string(list_slice(regexp_extract_all(CASE WHEN regexp_extract(text, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) = '' THEN text ELSE regexp_extract(text, '(?s)^\s*(.*?[.!?])(?:\s|$)', 1) END, '\S+'), 1, 30), ' ') END AS summary FROM doc_pages"""),
        "index_upsert": "SELECT doc_id, source AS filename, n_chars AS page_count, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
        "index_lookup": "SELECT doc_id, source FROM documents WHERE source = 'src3'",
        "cache_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id % 2 <> 0",
        "index_listing": """SELECT CAST(doc_id AS VARCHAR) AS doc_key, CASE WHEN doc_id % 3 <> 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS filename, CASE WHEN doc_id % 5 <> 0 THEN n_chars ELSE 0 END AS page_count, doc_id AS indexed_at FROM documents""",
        "page_store": q(_PAGES, "SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM doc_pages GROUP BY doc_id"),
        "model_lookup": """SELECT r_regionkey, model, CASE model WHEN 'cerebras-llama-3.3-70b' THEN 'llama3.3-70b' ELSE model END AS api_id,
            CASE WHEN model LIKE 'gpt-4%' THEN 'https://api.openai.com/v1/chat/completions' WHEN model LIKE 'gemini-%' THEN 'https://generativelanguage.googleapis.com/v1beta/openai/chat/completions'
            WHEN model LIKE 'cerebras-%' THEN 'https://api.cerebras.ai/v1/chat/completions' WHEN model IN ('mistral-small-latest', 'open-mistral-nemo') THEN 'https://api.mistral.ai/v1/chat/completions'
            WHEN model IN ('llama-3.3-70b-versatile', 'gemma2-9b-it', 'mixtral-8x7b-32768', 'llama-3.1-8b-instant') THEN 'https://api.groq.com/openai/v1/chat/completions' ELSE 'http://localhost:11434/v1/chat/completions' END AS url
            FROM region, unnest(['gemma3:1b', 'qwen2.5:3b', 'qwen2.5:7b', 'llama3.2', 'mistral', 'llama-3.3-70b-versatile', 'gemma2-9b-it', 'mixtral-8x7b-32768', 'llama-3.1-8b-instant', 'gemini-2.0-flash', 'gemini-1.5-flash',
              'cerebras-llama-3.3-70b', 'mistral-small-latest', 'open-mistral-nemo', 'gpt-4o-mini', 'gpt-4o', 'gpt-4-turbo', 'gpt-4o-2024-11-20', 'llama3.1:8b', 'unknown']) t(model)""",
        "audit_append": "SELECT run_id, seq, message FROM (VALUES ('r1', 0, 'started'), ('r1', 1, 'done'), ('r2', 0, 'started'), ('r1', 0, 'again')) t(run_id, seq, message)",
        "usage_ttl": f"WITH {_USAGE} SELECT client, event_id, uses FROM used",
        "usage_remaining": f"WITH {_USAGE} SELECT client, event_id, CAST(greatest(0, 2 - uses) AS INT) AS remaining, uses <= 2 AS allowed FROM used",
        "stream_usage": f"WITH {_USAGE} SELECT client, event_id, uses FROM used",
        "job_latest_status": q(_EVENTS, "SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS events FROM job_events GROUP BY job_id"),
        "job_event_order": q(_EVENTS, "SELECT job_id, event_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS INT) AS place, status FROM job_events"),
        "job_sessions": q(_EVENTS, """, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM job_events),
            numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS g FROM marked)
            SELECT job_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last, count(*) AS events FROM numbered GROUP BY job_id, g""").replace(")\n, marked", "),\n marked"),
        "stream_progress": q(_EVENTS, "SELECT job_id, count(*) AS events, arg_max(status, (ts, event_id)) AS status FROM job_events GROUP BY job_id"),
    }
    groups = found["page_groups"].rindex("SELECT doc_id, CAST(g AS INT)")
    found["page_group_text_stats"] = (
        found["page_groups"][:groups].rstrip() + ", grouped AS (" + found["page_groups"][groups:] + ") SELECT g.doc_id, group_no, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars "
        "FROM grouped g JOIN doc_pages p ON p.doc_id = g.doc_id AND p.page_no BETWEEN first_page AND last_page GROUP BY ALL"
    )
    return found
