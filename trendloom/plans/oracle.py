"""DuckDB twins of the registered queries, written over the same parquet tables."""

from __future__ import annotations

from trendloom.functions import text as T
from trendloom.schema import THRESHOLDS
from trendloom.plans.catalog import BROKEN, TEXT_THRESHOLD, VECTOR_THRESHOLD

ORACLES: dict[str, str] = {}


def _minutes(expr: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({expr} AS BIGINT)))"


CTES: dict[str, str] = {}

CTES["item"] = f"""item AS (
  SELECT doc_id AS content_item_id, doc_id AS content_item_state_id, concat('ws', doc_id % 3) AS workspace_id,
    source AS source_id, concat('q', doc_id % 5) AS query_id, CAST(20240101 + doc_id % 28 AS INTEGER) AS date_id,
    {_minutes('doc_id * 7')} AS raw_created_at, concat('d', doc_id) AS raw_content_id,
    CASE WHEN doc_id % 50 <> 49 THEN {_minutes('doc_id * 37 % 40000')} END AS content_published_date,
    CASE doc_id % 4 WHEN 0 THEN concat('https://t.me/c/', doc_id) WHEN 1 THEN concat('https://twitter.com/x/', doc_id)
      WHEN 2 THEN concat('https://www.youtube.com/watch?v=', doc_id) END AS content_published_url,
    concat(CASE WHEN doc_id % 7 = 0 THEN 'RT @user: ' ELSE '' END, text, ' #', source,
      CASE WHEN doc_id % 3 = 0 THEN concat(' #', lang) ELSE '' END, ' #42',
      CASE WHEN doc_id % 4 = 1 THEN concat(' https://t.co/a', doc_id) ELSE '' END) AS content,
    CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 3) * 1000 + doc_id % 37 END AS content_cluster_id,
    lang AS content_language_code
  FROM documents)"""

CTES["state"] = f"""state AS (
  SELECT *, CASE WHEN current_state IN ('failed', 'completed') THEN transition_end END AS completed_timestamp FROM (
    SELECT doc_id AS state_id, CASE doc_id % 8 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'vectorized'
      WHEN 3 THEN 'clustered' ELSE 'completed' END AS current_state, CAST(doc_id % 211 AS INTEGER) AS transition_num,
      {_minutes('doc_id * 7 + 3')} AS transition_start, {_minutes('doc_id * 7 + 3 + doc_id % 5 - 2')} AS transition_end
    FROM documents))"""

CTES["tagged"] = f"""tagged AS (
  SELECT *, list_filter(regexp_extract_all(content, '{T.HASHTAG}', 1), lambda t: NOT regexp_matches(t, '{T.ALL_DIGITS}')) AS tags
  FROM item)"""

CTES["keyword"] = """keyword AS (
  SELECT content_item_id * 10 + k AS content_keyword_id, workspace_id, 'hashtags' AS keyword_model_name, content_item_id,
    concat('#', tags[k + 1]) AS keyword_text, CAST(1.0 AS DOUBLE) AS keyword_score, content_published_date
  FROM (SELECT *, unnest(range(len(tags))) AS k FROM tagged))"""


def _recount(source: str) -> str:
    return f"""SELECT content_cluster_id, min(workspace_id) AS workspace_id, count(*) AS num_items,
    count(DISTINCT content) + max(CASE WHEN content IS NULL THEN 1 ELSE 0 END) AS num_items_unique,
    first(content_item_id ORDER BY raw_created_at, content_item_id) AS exemplar_item_id,
    min(content_published_date) AS min_pub_date, max(content_published_date) AS max_pub_date
  FROM {source} WHERE content_cluster_id IS NOT NULL GROUP BY content_cluster_id"""


CTES["cluster"] = f"""cluster AS (
  SELECT *, (content_cluster_id % 7) / 10 AS priority_score FROM ({_recount('item')}))"""

CTES["event"] = """event AS (
  SELECT event_id, user_id AS content_item_id, ts AS event_ts, CASE event_type WHEN 'signup' THEN 'ready'
    WHEN 'view' THEN 'vectorized' WHEN 'click' THEN 'clustered' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS to_state,
    CASE WHEN event_type = 'error' THEN 'start' ELSE 'update' END AS kind
  FROM events)"""

CTES["allowed"] = """allowed(from_state, to_state) AS (VALUES ('undefined', 'ready'), ('undefined', 'failed'),
  ('ready', 'vectorized'), ('ready', 'failed'), ('vectorized', 'clustered'), ('vectorized', 'failed'),
  ('clustered', 'completed'), ('clustered', 'failed'), ('failed', 'ready'))"""

CTES["toxic_doc"] = "toxic_doc AS (SELECT doc_id AS content_item_id FROM labels WHERE toxic = 1)"

CTES["vector"] = """vector AS (
  SELECT vec_id AS content_item_id, concat('ws', vec_id % 3) AS workspace_id, label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings)"""

CTES["pair"] = f"""pair AS (
  SELECT a.workspace_id, a.content_item_id AS src_id, b.content_item_id AS dst_id, 1 + list_cosine_similarity(a.v, b.v) AS score
  FROM vector a JOIN vector b ON a.workspace_id = b.workspace_id AND a.content_item_id < b.content_item_id
  WHERE list_cosine_similarity(a.v, b.v) >= {VECTOR_THRESHOLD})"""


def _word_ctes(source: str) -> str:
    """Weights of words and phrases; ``source`` has (workspace_id, content_item_id, content)."""
    return f"""segment AS (
  SELECT workspace_id, content_item_id, regexp_extract_all(s, '{T.TERM}') AS w FROM (
    SELECT workspace_id, content_item_id, unnest(regexp_split_to_array(lower(regexp_replace(content, '[{T.SPACELESS}]+', '|', 'g')), '[^{T.WORD}{T.SPACE}]+')) AS s
    FROM {source})),
spaceless AS (SELECT workspace_id, content_item_id, unnest(regexp_extract_all(content, '[{T.SPACELESS}]+')) AS r FROM {source}),
gram AS (
  SELECT workspace_id, content_item_id, n, array_to_string(w[i:i + n - 1], ' ') AS term, w[i:i + n - 1] AS parts FROM (
    SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM segment, range(1, 4) AS sizes(n) WHERE len(w) >= n)
  UNION ALL
  SELECT workspace_id, content_item_id, n, substr(r, i, n + 1), [substr(r, i + j, 2) for j in range(n)] FROM (
    SELECT *, unnest(range(1, length(r) - n + 1)) AS i FROM spaceless, range(1, 4) AS sizes(n) WHERE length(r) > n)
  UNION ALL
  SELECT workspace_id, content_item_id, 1, r, [r] FROM spaceless WHERE length(r) = 1),
phrase AS (
  SELECT workspace_id, content_item_id, n, term, parts, count(*) AS tf FROM gram GROUP BY ALL HAVING n = 1 OR count(*) > 1),
inner_phrase AS (
  SELECT content_item_id, m, parts[i:i + m - 1] AS parts, max(tf) AS most FROM (
    SELECT *, unnest(range(1, n - m + 2)) AS i FROM phrase, range(1, 3) AS sizes(m) WHERE m < n) GROUP BY ALL),
word AS (
  SELECT p.* FROM phrase p LEFT JOIN inner_phrase q ON p.content_item_id = q.content_item_id AND p.n = q.m AND p.parts = q.parts
  WHERE 4 * coalesce(most, 0) < 3 * tf),
weight AS (
  SELECT workspace_id, content_item_id, term, CAST(tf * (1 + floor(16 * ln(total / df))) AS BIGINT) AS weight
  FROM word JOIN (SELECT workspace_id, term, count(*) AS df FROM word GROUP BY ALL) USING (workspace_id, term)
    JOIN (SELECT workspace_id, count(*) AS total FROM {source} GROUP BY ALL) USING (workspace_id))"""


TEXT_PAIRS = f"""weight AS (
  SELECT DISTINCT workspace_id, content_item_id, unnest(regexp_extract_all(lower(content), '{T.TERM}')) AS term, 1 AS weight FROM txt),
norm AS (SELECT content_item_id, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM weight GROUP BY ALL),
text_pair AS (
  SELECT workspace_id, src_id, dst_id, dot / (a.norm * b.norm) AS cos FROM (
    SELECT a.workspace_id, a.content_item_id AS src_id, b.content_item_id AS dst_id, CAST(sum(a.weight * b.weight) AS DOUBLE) AS dot
    FROM weight a JOIN weight b ON a.term = b.term AND a.workspace_id = b.workspace_id AND a.content_item_id < b.content_item_id
    GROUP BY ALL)
  JOIN norm a ON src_id = a.content_item_id JOIN norm b ON dst_id = b.content_item_id
  WHERE dot / (a.norm * b.norm) >= {TEXT_THRESHOLD})"""

DISTINCT_DOCS = """txt AS (
  SELECT 'all' AS workspace_id, min(doc_id) AS content_item_id, text AS content FROM documents GROUP BY text)"""


def oracle(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    parts = [CTES.get(c, c) for c in ctes]
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    ORACLES[name] = head + body.strip()


ITEM_COLUMNS = """i.content_item_id, i.content_item_state_id, i.workspace_id, i.source_id, i.query_id, i.date_id, i.raw_created_at,
  i.raw_content_id, i.content_published_date, i.content_published_url, i.content, i.content_cluster_id, i.content_language_code"""
CONTENT = f"SELECT {ITEM_COLUMNS}, s.current_state, s.completed_timestamp FROM item i JOIN state s ON i.content_item_state_id = s.state_id"
KEYWORD = ("item", "tagged", "keyword")

ROLLUP = """SELECT k.workspace_id, keyword_model_name, keyword_text, count(DISTINCT content_keyword_id) AS num_items,
  count(DISTINCT content_cluster_id) AS num_clusters, max(i.content_published_date) AS max_published_date
FROM keyword k JOIN item i USING (content_item_id)"""
ROLLUP_GROUP = "GROUP BY k.workspace_id, keyword_model_name, keyword_text"

oracle("keyword_rollup", f"{ROLLUP} {ROLLUP_GROUP} HAVING count(DISTINCT content_keyword_id) >= 2", *KEYWORD)
oracle("keyword_rollup_filtered", f"""{ROLLUP} WHERE keyword_model_name = 'hashtags' AND keyword_text IN ('#en', '#fr', '#src1')
{ROLLUP_GROUP} HAVING min(i.content_published_date) >= '2024-01-01' AND max(i.content_published_date) <= '2024-01-28 12:00:00'""", *KEYWORD)
oracle("keyword_id_lists", """
SELECT k.workspace_id, keyword_model_name, keyword_text, 0 AS part,
  string_agg(CAST(content_keyword_id AS VARCHAR), ',' ORDER BY content_keyword_id) AS content_keyword_ids,
  string_agg(CAST(content_item_id AS VARCHAR), ',' ORDER BY content_keyword_id) AS content_item_ids,
  string_agg(CAST(content_cluster_id AS VARCHAR), ',' ORDER BY content_keyword_id) AS content_cluster_ids
FROM keyword k JOIN item i USING (content_item_id) GROUP BY ALL""", *KEYWORD)
oracle("keyword_id_parts", """
SELECT workspace_id, keyword_text, part, min(content_keyword_id) AS first_id, max(content_keyword_id) AS last_id, CAST(count(*) AS INTEGER) AS num_ids
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY workspace_id, keyword_model_name, keyword_text ORDER BY content_keyword_id) - 1) // 7 AS INTEGER) AS part
  FROM keyword JOIN (SELECT content_item_id FROM item) USING (content_item_id)) GROUP BY ALL""", *KEYWORD)
oracle("items_of_workspace", "SELECT content_item_id, workspace_id FROM item WHERE workspace_id = 'ws1'", "item")
oracle("random_items", "SELECT least(count(*), 20) AS picked, least(count(*), 20) AS different, least(count(*), 20) AS known FROM documents")
oracle("shouted_text", "SELECT content_item_id, substr(replace(content, 'e', '3'), 1, 40) AS shouted FROM item", "item")
oracle("oversize_items", """
SELECT content_item_id, CASE WHEN fits THEN 'ready' ELSE 'failed' END AS current_state, CASE WHEN NOT fits THEN concat('request of ', size, ' bytes') END AS failed_reason
FROM (SELECT doc_id AS content_item_id, octet_length(encode(CAST(to_json({'id': CAST(doc_id AS VARCHAR), 'text': text}) AS VARCHAR))) AS size, size < 20000 AS fits FROM documents)""")
oracle("keyword_rows", "SELECT * FROM keyword", *KEYWORD)
oracle("keyword_rows_filtered", """SELECT * FROM keyword WHERE keyword_model_name = 'hashtags' AND keyword_text IN ('#de', '#src3')
AND content_published_date BETWEEN '2024-01-05' AND '2024-01-20'""", *KEYWORD)
oracle("keyword_models", "SELECT DISTINCT workspace_id, keyword_model_name FROM keyword", *KEYWORD)
oracle("keyword_timeline", """SELECT workspace_id, keyword_text, CAST(date_trunc('day', content_published_date) AS TIMESTAMP) AS day,
  count(*) AS num_items FROM keyword WHERE content_published_date IS NOT NULL GROUP BY ALL""", *KEYWORD)
oracle("keyword_clusters", """SELECT DISTINCT workspace_id, content_cluster_id FROM item WHERE content_cluster_id IS NOT NULL
AND content_item_id IN (SELECT content_item_id FROM keyword WHERE keyword_text IN ('#fr', '#es'))""", *KEYWORD)
oracle("keyword_size_filter", f"""{ROLLUP} {ROLLUP_GROUP}
HAVING count(DISTINCT content_keyword_id) >= 5 AND count(DISTINCT content_cluster_id) >= 3""", *KEYWORD)
oracle("keyword_items", """SELECT keyword_text, content_language_code, count(*) AS num_items, count(content_cluster_id) AS num_clustered
FROM keyword JOIN item USING (content_item_id) GROUP BY ALL""", *KEYWORD)
oracle("tfidf_keyphrases", """
SELECT content_item_id, term AS keyword_text, CAST(r AS INTEGER) AS rank, round(1.0 / weight, 8) AS keyword_score FROM (
  SELECT *, row_number() OVER (PARTITION BY content_item_id ORDER BY weight DESC, encode(term)) AS r FROM weight) WHERE r <= 5""",
       "item", _word_ctes("item"))
oracle("label_keywords", """
SELECT workspace_id, 'classifier:quality' AS keyword_model_name, content_item_id, l AS keyword_text, CAST(1.0 AS DOUBLE) AS keyword_score,
  content_published_date
FROM (SELECT doc_id, 'quality' AS l FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)
JOIN item ON doc_id = content_item_id""", "item")
oracle("classify_items", f"""
SELECT workspace_id, 'classifier:topics' AS keyword_model_name, content_item_id, topic AS keyword_text,
  CAST(1.0 AS DOUBLE) AS keyword_score, content_published_date
FROM (SELECT *, regexp_extract_all(lower(content), '{T.TERM}') AS w FROM item),
  (VALUES ('articles', ['the', 'der', 'el', 'le']), ('links', ['https', 'http']), ('digits', ['42', '7'])) AS t(topic, words)
WHERE list_has_any(w, words)""", "item")

oracle("content_rows", CONTENT, "item", "state")
oracle("content_rows_filtered", f"""{CONTENT} WHERE content_published_date BETWEEN '2024-01-03' AND '2024-01-24'
AND content_language_code = 'en' AND query_id IN ('q1', 'q2', 'q3') AND content LIKE '%the%'""", "item", "state")
oracle("content_rows_by_keyword", f"""{CONTENT} WHERE content_item_id IN
(SELECT content_item_id FROM keyword WHERE keyword_text IN ('#src2', '#es'))""", *KEYWORD, "state")
oracle("content_after", """SELECT content_item_id, content_published_date, current_state FROM item JOIN state ON content_item_state_id = state_id
WHERE content_published_date > '2024-01-10 03:20:00' AND content_published_date <= '2024-01-25' AND regexp_matches(content, 't.e|d.r')""",
       "item", "state")
oracle("content_null_dates", "SELECT count(*) FILTER (content_published_date IS NULL) AS nulls, count(*) AS total FROM item", "item")

CLUSTER_ROWS = """SELECT c.content_cluster_id, c.exemplar_item_id, c.workspace_id, c.num_items, c.num_items_unique, c.priority_score,
  e.content AS exemplar_content, e.content_published_url AS exemplar_published_url, c.min_pub_date, c.max_pub_date
FROM cluster c JOIN item e ON c.exemplar_item_id = e.content_item_id"""
oracle("cluster_rows", CLUSTER_ROWS, "item", "cluster")
oracle("cluster_rows_filtered", f"""{CLUSTER_ROWS} WHERE num_items BETWEEN 2 AND 100000 AND max_pub_date >= '2024-01-20'
AND min_pub_date >= '2024-01-01 01:00:00'""", "item", "cluster")
oracle("cluster_sizes_range", """SELECT workspace_id, coalesce(min(num_items), 0) AS min_num_items, coalesce(max(num_items), 0) AS max_num_items
FROM cluster GROUP BY ALL""", "item", "cluster")
oracle("cluster_timeline", """SELECT content_cluster_id, CAST(date_trunc('day', content_published_date) AS TIMESTAMP) AS day, count(*) AS num_items
FROM item WHERE content_published_date IS NOT NULL AND content_cluster_id IS NOT NULL GROUP BY ALL""", "item")
oracle("cluster_published_range", "SELECT content_cluster_id, min_pub_date, max_pub_date FROM cluster", "item", "cluster")
oracle("cluster_rebuild", "SELECT * EXCLUDE priority_score, num_items AS num_items_added FROM cluster", "item", "cluster")
oracle("cluster_exemplars", "SELECT content_cluster_id, exemplar_item_id FROM cluster", "item", "cluster")
oracle("time_range", """SELECT workspace_id, min(content_published_date) AS min_content_published_date,
  max(content_published_date) AS max_content_published_date FROM item GROUP BY ALL""", "item")
oracle("day_counts", """SELECT workspace_id, CAST(date_trunc('day', content_published_date) AS TIMESTAMP) AS day, count(*) AS num_items
FROM item GROUP BY ALL""", "item")
oracle("hour_counts_filled", """
SELECT b.workspace_id, b.hour, coalesce(n, 0) AS num_items FROM (
  SELECT workspace_id, unnest(generate_series(date_trunc('hour', min(content_published_date)), date_trunc('hour', max(content_published_date)),
    INTERVAL 1 HOUR)) AS hour FROM item GROUP BY workspace_id) b
LEFT JOIN (SELECT workspace_id, date_trunc('hour', content_published_date) AS hour, count(*) AS n FROM item GROUP BY ALL) c
  ON b.workspace_id = c.workspace_id AND b.hour = c.hour""", "item")
oracle("state_summary", """SELECT workspace_id, current_state, count(*) AS num_items FROM item JOIN state ON content_item_state_id = state_id
GROUP BY ALL""", "item", "state")
oracle("date_state_counts", """SELECT workspace_id, date_id, current_state, count(*) AS num_items
FROM item JOIN state ON content_item_state_id = state_id GROUP BY ALL""", "item", "state")
oracle("workspace_size", "SELECT workspace_id, count(*) AS num_items FROM item GROUP BY ALL", "item")
oracle("workspaces", "SELECT DISTINCT workspace_id FROM item", "item")
oracle("languages", "SELECT DISTINCT workspace_id, content_language_code FROM item", "item")
oracle("query_ids", "SELECT DISTINCT workspace_id, query_id FROM item", "item")
oracle("items_in_progress", """SELECT content_item_id, workspace_id, current_state FROM item JOIN state ON content_item_state_id = state_id
WHERE current_state NOT IN ('undefined', 'failed', 'completed')""", "item", "state")
oracle("priority_clusters", """SELECT content_cluster_id, priority_score FROM cluster WHERE priority_score > 0
ORDER BY priority_score DESC, content_cluster_id LIMIT 1000""", "item", "cluster")
oracle("items_before", "SELECT content_item_id, content_published_date FROM item WHERE content_published_date < '2024-01-15'", "item")
oracle("item_cluster_size", """SELECT content_item_id, coalesce(num_items, 0) AS cluster_size
FROM item LEFT JOIN cluster USING (content_cluster_id)""", "item", "cluster")
oracle("authorised_items", """
SELECT session_id, CAST(sum(n) AS BIGINT) AS num_items FROM (
  SELECT DISTINCT user_id AS session_id, w FROM events, (VALUES ('public', 'ws0'), ('dev_public', 'ws2'), ('testing', 'ws1'), ('team-a', 'ws1')) m(slug, w)
  WHERE slug IN ('public', 'dev_public') OR slug = CASE WHEN user_id % 2 = 0 THEN 'team-a' ELSE 'team-b' END)
JOIN (SELECT workspace_id, count(*) AS n FROM item GROUP BY ALL) ON w = workspace_id GROUP BY ALL""", "item")
oracle("workspace_config", """
SELECT workflow, CAST(threshold AS DOUBLE) AS threshold, count(*) AS num_items FROM item
JOIN (VALUES ('ws0', 'default', 0.95), ('ws1', 'tweets', 0.875), ('ws2', 'base', 0.95)) c(workspace_id, workflow, threshold) USING (workspace_id)
GROUP BY ALL""", "item")
oracle("backfill_dates", """
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id FROM (SELECT unnest(generate_series(
  strptime(CAST(min(date_id) AS VARCHAR), '%Y%m%d'), strptime(CAST(max(date_id) AS VARCHAR), '%Y%m%d'), INTERVAL 1 DAY)) AS d FROM item)""", "item")
oracle("payload_guard", r"""
SELECT doc_id AS content_item_id, octet_length(encode(CAST(json_object('id', CAST(doc_id AS VARCHAR), 'text', text) AS VARCHAR))) < 20000 AS fits
FROM documents""")

oracle("hashtag_keywords", """SELECT workspace_id, keyword_model_name, content_item_id, keyword_text, keyword_score, content_published_date
FROM keyword""", *KEYWORD)


def _clean(column: str) -> str:
    out = column
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    for pattern in (T.MENTION, T.URL):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    out = f"regexp_replace({out}, '{T.RETWEET}', ' ')"
    out = f"regexp_replace({out}, '{T.EMOJI_RUN}', ' ', 'g')"
    return f"regexp_replace({out}, '{T.EDGE_SPACE}', '', 'g')"


oracle("clean_text", f"SELECT content_item_id, {_clean('content')} AS content FROM item", "item")
oracle("clean_html", f"SELECT page_id, md5({_clean('html')}) AS digest FROM pages")
oracle("url_platforms", """
SELECT CASE WHEN content_published_url IS NULL THEN NULL WHEN starts_with(content_published_url, 'https://t.me/') THEN 'telegram'
  WHEN starts_with(content_published_url, 'https://twitter.com/') THEN 'twitter'
  WHEN starts_with(content_published_url, 'https://www.youtube.com/') THEN 'youtube' ELSE 'unknown' END AS platform, count(*) AS num_items
FROM item GROUP BY ALL""", "item")
oracle("blank_test", """
SELECT concat('d', doc_id) AS content_id, doc_id % 3 = 0 OR doc_id % 13 = 0 AS title_blank,
  doc_id % 2 = 0 OR doc_id % 13 = 0 AS transcript_blank, doc_id % 13 <> 0 AS has_language_key FROM documents""")
oracle("distinct_sketches", """
SELECT content_language_code, count(*) AS num_items, count(DISTINCT content_item_id) AS exact, true AS is_near
FROM item WHERE CAST(content_published_date AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-14' GROUP BY ALL""", "item")
oracle("date_ids", """
SELECT content_item_id, CAST(strftime(content_published_date, '%Y%m%d') AS INTEGER) AS published_id,
  CAST(strptime(CAST(date_id AS VARCHAR), '%Y%m%d') AS DATE) AS day,
  CAST(content_published_date AS DATE) = CAST(strptime(CAST(date_id AS VARCHAR), '%Y%m%d') AS DATE) AS published_that_day
FROM item""", "item")


def _extract(source: str, content: str, published: str, url: str, language: str, failed: str, field: str = "CAST(NULL AS VARCHAR)",
             failed_published: str = "CAST(NULL AS TIMESTAMP)", frm: str = "documents", where: str = "") -> str:
    return f"""
SELECT concat('ws', doc_id % 3) AS workspace_id, '{source}' AS source_id, concat('q', doc_id % 5) AS query_id,
  CAST(20240101 + doc_id % 28 AS INTEGER) AS date_id, {_minutes('doc_id * 7')} AS raw_created_at, concat('d', doc_id) AS raw_content_id,
  CASE WHEN {failed} THEN '' ELSE {content} END AS content,
  CASE WHEN {failed} THEN {failed_published} ELSE {published} END AS content_published_date,
  CASE WHEN NOT ({failed}) THEN {url} END AS content_published_url, CASE WHEN NOT ({failed}) THEN {language} END AS content_language_code,
  CASE WHEN NOT ({failed}) THEN {field} END AS source_field, {failed} AS is_failed
FROM {frm} {where}"""


PUBLISHED = _minutes("doc_id * 37 % 40000")
POST_URL = "concat('https://t.me/c/', doc_id)"
FIELDS = """(SELECT doc_id, lang, name, body FROM (
  SELECT doc_id, lang, 'description' AS name, text AS body FROM documents UNION ALL
  SELECT doc_id, lang, 'post_title', concat('title ', source) FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 13 <> 0 UNION ALL
  SELECT doc_id, lang, 'transcript_text', lang FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 13 <> 0)
  WHERE doc_id % 13 = 0 OR body NOT IN ('', 'null'))"""
oracle("extract_default", _extract("junkipedia", "text", PUBLISHED, POST_URL, "CAST(NULL AS VARCHAR)", "doc_id % 13 = 0"))
oracle("extract_multi_field", _extract(
    "junkipedia", "body", PUBLISHED, POST_URL, "CASE WHEN doc_id % 5 <> 0 THEN lang END", "doc_id % 13 = 0", "name", frm=FIELDS))
oracle("extract_by_table_function", ORACLES["extract_multi_field"])
oracle("extract_tweets", _extract(
    "tweets", "text", PUBLISHED, "concat('https://twitter.com/twitter/status/', doc_id)", "lang", "false", where="WHERE doc_id % 4 <> 0"))
oracle("extract_tipline", _extract(
    "tipline", "text", PUBLISHED, "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "doc_id % 17 = 0",
    failed_published=_minutes("doc_id * 7"), where="WHERE doc_id % 5 NOT IN (0, 1)"))
STATUS = f"""status AS (SELECT concat('ws', doc_id % 3) AS workspace_id, doc_id % 13 = 0 AS bad FROM {FIELDS})"""
oracle("ingest_status", """SELECT workspace_id, 'junkipedia' AS source_id, count(*) AS items, count(*) FILTER (bad) AS errors,
  count(*) FILTER (NOT bad) AS loaded FROM status GROUP BY ALL""", STATUS)
oracle("error_gate", """
SELECT workspace_id, items, errors, round(errors / items, 6) AS error_rate,
  items > 100 AND errors / items >= 0.25 AS must_stop
FROM (SELECT workspace_id, count(*) AS items, count(*) FILTER (bad) AS errors FROM status GROUP BY ALL)""", STATUS)
oracle("page_flatten", """
SELECT 'ws0' AS workspace_id, 'q0' AS query_id, conv_id * 1000 + turn // 100 AS page_id,
  CAST(row_number() OVER (PARTITION BY conv_id, turn // 100 ORDER BY turn) - 1 AS INTEGER) AS position, concat(conv_id, '-', turn) AS content_id, text
FROM conversations WHERE conv_id % 10 <> 9""")
oracle("page_rejects", """SELECT DISTINCT conv_id * 1000 + turn // 100 AS page_id, 'page reports errors' AS rejected_reason
FROM conversations WHERE conv_id % 10 = 9""")
oracle("parse_callbacks", """
SELECT 'keyphrases' AS model_name, workspace_id, content_item_id, 'keyworded' AS target_state, content_item_id % 9 = 0 AS is_error,
  CASE WHEN content_item_id % 9 = 0 THEN 'model failed' END AS error, CAST(CASE WHEN content_item_id % 9 = 0 THEN 500 END AS INTEGER) AS error_code
FROM item""", "item")
oracle("callback_keywords", """
SELECT workspace_id, 'keyphrases' AS keyword_model_name, content_item_id, keyword_text, CAST(0.5 AS DOUBLE) AS keyword_score,
  content_published_date FROM keyword WHERE content_item_id % 9 <> 0""", *KEYWORD)
oracle("similarity_answers", """SELECT vec_id AS content_item_id, CAST(vec_id AS VARCHAR) AS dst_id,
  round(1 + CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings""")
oracle("row_json", """SELECT content_item_id, workspace_id, date_id, content_published_date, content_published_url, content_cluster_id
FROM item""", "item")

LOADS = """stored AS (
  SELECT doc_id AS content_item_id, concat('ws', doc_id % 3) AS workspace_id, concat('d', doc_id) AS raw_content_id,
    CASE WHEN doc_id % 2 = 0 THEN 'description' END AS source_field, CASE WHEN doc_id % 8 = 1 THEN 'failed' ELSE 'completed' END AS current_state
  FROM documents),
incoming AS (
  SELECT doc_id + 1000000000 AS content_item_id, concat('ws', n % 3) AS workspace_id, concat('d', n) AS raw_content_id,
    CASE WHEN doc_id % 5 <> 0 THEN 'description' END AS source_field, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'ready' END AS current_state,
    doc_id AS arrival FROM (SELECT doc_id, ((doc_id * 2) // 3) * 2 AS n FROM documents))"""


def _upsert(order: str, replaceable: str) -> str:
    same = "s.workspace_id = w.workspace_id AND s.raw_content_id = w.raw_content_id AND s.source_field IS NOT DISTINCT FROM w.source_field"
    return f""", winner AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, raw_content_id, source_field ORDER BY {order}) AS r FROM incoming)
  WHERE r = 1)
SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM winner w WHERE {same} AND {replaceable})
UNION ALL
SELECT w.content_item_id, w.workspace_id, w.raw_content_id, w.source_field, w.current_state FROM winner w
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE {same} AND NOT ({replaceable}))"""


ORACLES["upsert_items"] = f"WITH {LOADS}" + _upsert(
    "current_state = 'failed', CASE WHEN current_state = 'failed' THEN -arrival ELSE arrival END", "s.current_state = 'failed'")
ORACLES["upsert_items_forced"] = f"WITH {LOADS}" + _upsert("arrival DESC", "true")
oracle("upsert_by_table", """
SELECT load, workspace_id, CASE WHEN load = 2 AND (is_there AND NOT was_failed OR NOT is_failed) THEN 'ignored' WHEN load = 2 THEN 'replaced'
  WHEN NOT is_there THEN 'inserted' WHEN was_failed THEN 'replaced' ELSE 'ignored' END AS outcome, count(*) AS num_items
FROM (SELECT w.workspace_id, w.current_state = 'failed' AS is_failed, s.content_item_id IS NOT NULL AS is_there, coalesce(s.current_state = 'failed', false) AS was_failed
  FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, raw_content_id, source_field
    ORDER BY current_state = 'failed', CASE WHEN current_state = 'failed' THEN -arrival ELSE arrival END) AS place FROM incoming) w
  LEFT JOIN stored s ON s.workspace_id = w.workspace_id AND s.raw_content_id = w.raw_content_id AND s.source_field IS NOT DISTINCT FROM w.source_field
  WHERE place = 1), (VALUES (1), (2)) AS loads(load)
GROUP BY ALL""", LOADS)
oracle("insert_absent", """SELECT content_item_id, raw_content_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, raw_content_id, source_field
  ORDER BY current_state = 'failed', CASE WHEN current_state = 'failed' THEN -arrival ELSE arrival END) AS place FROM incoming) w WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM stored s
WHERE s.workspace_id = w.workspace_id AND s.raw_content_id = w.raw_content_id AND s.source_field IS NOT DISTINCT FROM w.source_field)""", LOADS)
oracle("delete_items", """
SELECT 'items' AS name, count(*) AS num_rows FROM item WHERE content_item_id NOT IN (SELECT content_item_id FROM toxic_doc)
UNION ALL SELECT 'states', count(*) FROM state WHERE state_id NOT IN (SELECT content_item_id FROM toxic_doc)
UNION ALL SELECT 'keywords', count(*) FROM keyword WHERE content_item_id NOT IN (SELECT content_item_id FROM toxic_doc)
UNION ALL SELECT 'clusters', count(DISTINCT content_cluster_id) FROM item WHERE content_item_id NOT IN (SELECT content_item_id FROM toxic_doc)""",
       *KEYWORD, "state", "toxic_doc")
oracle("delete_items_clusters", """SELECT content_cluster_id, num_items, num_items_unique, exemplar_item_id,
  (content_cluster_id % 7) / 10 AS priority_score FROM recounted""", "item", "toxic_doc",
       "left_items AS (SELECT * FROM item WHERE content_item_id NOT IN (SELECT content_item_id FROM toxic_doc))",
       f"recounted AS ({_recount('left_items')})")
oracle("expire_items", """SELECT content_item_id FROM item WHERE NOT coalesce(content_published_date <
  CASE workspace_id WHEN 'ws0' THEN TIMESTAMP '2024-01-06' WHEN 'ws1' THEN TIMESTAMP '2024-01-16' END, false)""", "item")
oracle("erase_workspace", """
SELECT 'items' AS name, count(*) AS num_rows FROM kept UNION ALL SELECT 'states', count(*) FROM kept
UNION ALL SELECT 'keywords', count(*) FROM keyword WHERE content_item_id IN (SELECT content_item_id FROM kept)
UNION ALL SELECT 'clusters', count(*) FROM cluster WHERE workspace_id <> 'ws1'""", *KEYWORD, "cluster",
       "kept AS (SELECT * FROM item WHERE NOT (workspace_id = 'ws1' AND source_id = 'src4'))")

oracle("latest_state", """SELECT content_item_id, last(to_state ORDER BY event_ts, event_id) AS current_state, max(event_ts) AS event_ts
FROM event GROUP BY ALL""", "event")
oracle("transition_durations", """
SELECT event_id, content_item_id, previous_ts, date_diff('microsecond', previous_ts, event_ts) AS micros FROM (
  SELECT *, lag(event_ts) OVER (PARTITION BY content_item_id ORDER BY event_ts, event_id) AS previous_ts FROM event)""", "event")
oracle("valid_transitions", """
SELECT p.from_state, p.to_state, a.from_state IS NOT NULL AS is_valid, count(*) AS num_events FROM (
  SELECT to_state, lag(to_state) OVER (PARTITION BY content_item_id ORDER BY event_ts, event_id) AS from_state FROM event) p
LEFT JOIN allowed a ON p.from_state = a.from_state AND p.to_state = a.to_state WHERE p.from_state IS NOT NULL GROUP BY ALL""", "event", "allowed")
oracle("apply_events", """
SELECT content_item_id, current_state, transition_end, completed_timestamp, CAST(starts AS INTEGER) AS transition_num, transition_start FROM (
  SELECT content_item_id, count(*) FILTER (kind = 'start') AS starts, max(event_ts) FILTER (kind = 'start') AS transition_start FROM event GROUP BY ALL)
JOIN (SELECT content_item_id, last(state ORDER BY n) AS current_state, last(end_ts ORDER BY n) AS transition_end,
  last(done_ts ORDER BY n) AS completed_timestamp FROM walk GROUP BY ALL) USING (content_item_id)""", "event", "allowed", """
numbered AS (SELECT *, row_number() OVER (PARTITION BY content_item_id ORDER BY event_ts, event_id) AS n FROM event WHERE kind = 'update'),
walk(content_item_id, n, state, end_ts, done_ts) AS (
  SELECT DISTINCT content_item_id, CAST(0 AS BIGINT), 'undefined', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM event
  UNION ALL
  SELECT w.content_item_id, e.n, CASE WHEN a.to_state IS NULL THEN w.state ELSE e.to_state END,
    CASE WHEN a.to_state IS NULL THEN w.end_ts ELSE e.event_ts END,
    CASE WHEN a.to_state IN ('failed', 'completed') THEN e.event_ts ELSE w.done_ts END
  FROM walk w JOIN numbered e ON e.content_item_id = w.content_item_id AND e.n = w.n + 1
    LEFT JOIN allowed a ON a.from_state = w.state AND a.to_state = e.to_state)""", recursive=True)
oracle("start_transitions", """
SELECT state_id, CAST(transition_num + coalesce(n, 0) AS INTEGER) AS transition_num, coalesce(started, transition_start) AS transition_start
FROM state LEFT JOIN (SELECT content_item_id, count(*) AS n, max(event_ts) AS started FROM event GROUP BY ALL) ON state_id = content_item_id""",
       "state", "event")
oracle("apply_transitions", """
SELECT state_id, CASE WHEN ok THEN u.to_state ELSE current_state END AS current_state,
  CASE WHEN ok THEN event_ts ELSE transition_end END AS transition_end,
  CASE WHEN ok AND u.to_state IN ('failed', 'completed') THEN event_ts ELSE completed_timestamp END AS completed_timestamp
FROM (SELECT s.*, u.to_state, u.event_ts, coalesce((s.current_state, u.to_state) IN (SELECT (from_state, to_state) FROM allowed), false) AS ok
  FROM state s LEFT JOIN (SELECT content_item_id, last(to_state ORDER BY event_ts, event_id) AS to_state, max(event_ts) AS event_ts
    FROM event GROUP BY ALL) u ON s.state_id = u.content_item_id) u""", "state", "event", "allowed")
oracle("in_flight", """
SELECT state_id, current_state FROM state WHERE transition_start > transition_end AND date_diff('second', transition_start, TIMESTAMP '2024-01-04')
  < CASE current_state WHEN 'clustered' THEN 7200 ELSE 3600 END""", "state")
oracle("retry_cap", """SELECT CASE WHEN transition_num > 100 THEN 'failed' ELSE current_state END AS current_state, count(*) AS num_items
FROM state GROUP BY 1""", "state")
oracle("retry_cap_events", """SELECT current_state AS from_state, 'failed' AS to_state, count(*) AS num_events, any_value(n) AS num_ended
FROM state, (SELECT count(*) AS n FROM state WHERE transition_num > 100 AND current_state NOT IN ('failed', 'completed'))
WHERE transition_num > 100 AND current_state NOT IN ('failed', 'completed') GROUP BY ALL""", "state")
oracle("orphan_states", """SELECT state_id, current_state FROM state WHERE state_id NOT IN (SELECT content_item_id FROM toxic_doc)""",
       "state", "toxic_doc")
oracle("states_of_source", """SELECT state_id, current_state FROM state WHERE state_id IN
(SELECT content_item_state_id FROM item WHERE workspace_id = 'ws1' AND source_id = 'src1')""", "state", "item")
oracle("run_attempts", """
SELECT run_id, attempt_num, concat(run_id, ':', attempt_num) AS attempt_id, min(ts) FILTER (s = 'running') AS attempt_start,
  min(ts) FILTER (s IN ('completed', 'failed')) AS attempt_end, last(s ORDER BY ts, event_id) AS current_state,
  CAST(strftime(min(ts) FILTER (s = 'running'), '%Y%m%d') AS INTEGER) AS date_id
FROM (SELECT *, CAST(sum(CASE WHEN s = 'running' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt_num
  FROM (SELECT event_id, concat('run', user_id) AS run_id, ts, CASE WHEN event_type = 'signup' THEN 'ready'
    WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS s FROM events))
WHERE attempt_num > 0 GROUP BY run_id, attempt_num""")

oracle("similar_vectors", "SELECT workspace_id, src_id, dst_id, round(score, 4) AS score FROM pair", "vector", "pair")
BOTH = """both_ways AS (SELECT src_id, dst_id, score FROM pair UNION ALL SELECT dst_id, src_id, score FROM pair)"""
oracle("similar_vectors_top", """
SELECT src_id, dst_id, round(score, 4) AS score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, dst_id) AS r FROM both_ways) WHERE r <= 3""",
       "vector", CTES["pair"].replace(str(VECTOR_THRESHOLD), "0.25"), BOTH)
oracle("find_similar", """
SELECT workspace_id, src_id, dst_id, round(1 + cos, 4) AS score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, src_id ORDER BY cos DESC, dst_id) AS r FROM (
    SELECT q.workspace_id, q.content_item_id AS src_id, s.content_item_id AS dst_id, list_cosine_similarity(q.v, s.v) AS cos
    FROM vector q JOIN vector s ON q.workspace_id = s.workspace_id AND q.label = 0 AND s.label <> 0) WHERE cos >= 0.2) WHERE r <= 5""", "vector")
oracle("similar_vectors_lsh", "SELECT workspace_id, count(*) AS num_pairs, true AS is_enough, 0 AS num_wrong FROM pair GROUP BY ALL", "vector", "pair")
oracle("find_similar_extended", f"""
SELECT q.workspace_id, q.content_item_id AS src_id, s.content_item_id AS dst_id, round(1 + list_cosine_similarity(q.v, s.v), 4) AS score
FROM vector q JOIN vector s ON q.workspace_id = s.workspace_id AND q.content_item_id % 20 = 0
WHERE list_cosine_similarity(q.v, s.v) >= {VECTOR_THRESHOLD}""", "vector")
oracle("similar_texts", "SELECT workspace_id, src_id, dst_id, round(1 + cos, 4) AS score FROM text_pair", DISTINCT_DOCS, TEXT_PAIRS)
oracle("similar_text_links", """
SELECT doc_id AS content_item_id, rep AS rep_id, size - 1 AS num_copies, CAST(coalesce(links, 0) AS BIGINT) AS num_links
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS size FROM documents)
LEFT JOIN (SELECT a, sum(n) AS links FROM (SELECT src_id AS a, dst_id AS b FROM text_pair UNION ALL SELECT dst_id, src_id FROM text_pair)
  JOIN (SELECT min(doc_id) AS b, count(*) AS n FROM documents GROUP BY text) USING (b) GROUP BY a) ON a = rep""", DISTINCT_DOCS, TEXT_PAIRS)
def _two_batches(threshold: float) -> list[str]:
    """Distinct texts of new and of stored documents, with their word sets, and similar pairs by who they join."""
    return [
        "batch_text AS (SELECT doc_id % 10 = 3 AS is_new, min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY ALL)",
        f"batch_word AS (SELECT DISTINCT is_new, id, unnest(regexp_extract_all(lower(text), '{T.TERM}')) AS term FROM batch_text)",
        "batch_size AS (SELECT id, count(*) AS n FROM batch_word GROUP BY ALL)",
        f"""met AS (SELECT a.id AS src_id, b.id AS dst_id, b.is_new, count(*) / (sqrt(any_value(x.n)) * sqrt(any_value(y.n))) AS cos
  FROM batch_word a JOIN batch_word b ON a.term = b.term AND a.is_new AND a.id <> b.id JOIN batch_size x ON x.id = a.id JOIN batch_size y ON y.id = b.id
  GROUP BY a.id, b.id, b.is_new HAVING cos >= {threshold})""",
    ]


oracle("similar_texts_stored", """SELECT src_id, dst_id, round(1 + cos, 4) AS score, dst_id AS content_cluster_id FROM met WHERE NOT is_new""", *_two_batches(TEXT_THRESHOLD))
COPIED = """every AS (
  SELECT *, content_item_id AS origin FROM vector
  UNION ALL SELECT v.* REPLACE (content_item_id + n * 1000000 AS content_item_id), content_item_id FROM vector v, range(1, 4) AS t(n) WHERE content_item_id % 7 = 0)"""
oracle("similar_vector_links", f"""
SELECT workspace_id, content_item_id, origin AS rep_id, CASE WHEN origin % 7 = 0 THEN 3 ELSE 0 END AS num_copies,
  (SELECT count(*) FROM every o WHERE o.workspace_id = e.workspace_id AND o.origin <> e.origin
    AND list_cosine_similarity(o.v, e.v) >= {VECTOR_THRESHOLD}) AS num_links
FROM every e""", "vector", COPIED)
oracle("best_candidate_of_all", f"""
SELECT src_id, dst_id, round(score, 4) AS score, dst_id % 10 AS cluster_size FROM (
  SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, dst_id % 10 DESC, dst_id DESC) AS r FROM (
    SELECT a.content_item_id AS src_id, b.content_item_id AS dst_id,
      CASE WHEN a.origin = b.origin THEN 2.0 ELSE 1 + list_cosine_similarity(a.v, b.v) END AS score
    FROM every a JOIN every b ON a.workspace_id = b.workspace_id AND a.content_item_id <> b.content_item_id
    WHERE a.origin = b.origin OR list_cosine_similarity(a.v, b.v) >= {VECTOR_THRESHOLD})) WHERE r = 1""", "vector", COPIED)
oracle("same_text_clusters", "SELECT doc_id AS content_item_id, min(doc_id) OVER (PARTITION BY text) AS content_cluster_id FROM documents")


def _components(edges: str) -> str:
    """Smallest reachable id from each id over an undirected edge table (a, b)."""
    return f"""reach(id, seen) AS (
  SELECT DISTINCT a, a FROM {edges} UNION SELECT r.id, e.b FROM reach r JOIN {edges} e ON r.seen = e.a),
component AS (SELECT id, min(seen) AS root FROM reach GROUP BY id)"""


TEXT_LINKS = """link AS (SELECT src_id AS a, dst_id AS b FROM text_pair UNION ALL SELECT dst_id, src_id FROM text_pair)"""
oracle("text_clusters", """
SELECT doc_id AS content_item_id, coalesce(root, rep) AS content_cluster_id
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents) LEFT JOIN component ON rep = id""",
       DISTINCT_DOCS, TEXT_PAIRS, TEXT_LINKS, _components("link"), recursive=True)
oracle("top_text_clusters", """
SELECT c.content_cluster_id, c.workspace_id, c.num_items, c.num_items_unique, c.exemplar_item_id, c.min_pub_date, c.max_pub_date,
  e.content AS exemplar_content, e.content_published_url AS exemplar_published_url
FROM recounted c JOIN item e ON c.exemplar_item_id = e.content_item_id WHERE num_items >= 2
ORDER BY num_items DESC, c.content_cluster_id LIMIT 100""", "item",
       f"cleaned AS (SELECT * FROM (SELECT *, {_clean('content')} AS clean FROM item) WHERE clean <> '')",
       "txt AS (SELECT workspace_id, min(content_item_id) AS content_item_id, clean AS content FROM cleaned GROUP BY workspace_id, clean)",
       TEXT_PAIRS, TEXT_LINKS, _components("link"),
       """grouped AS (SELECT i.* EXCLUDE (content_cluster_id, rep), coalesce(root, rep) AS content_cluster_id
  FROM (SELECT *, min(content_item_id) OVER (PARTITION BY workspace_id, clean) AS rep FROM cleaned) i LEFT JOIN component ON rep = id)""",
       f"recounted AS ({_recount('grouped')})", recursive=True)
oracle("best_candidate", """
SELECT src_id, dst_id, round(score, 4) AS score, cluster_size FROM (
  SELECT b.*, cluster_size, row_number() OVER (PARTITION BY src_id ORDER BY score DESC, cluster_size DESC, dst_id DESC) AS r
  FROM both_ways b JOIN vector ON dst_id = content_item_id JOIN (SELECT label, count(*) AS cluster_size FROM embeddings GROUP BY ALL) USING (label))
WHERE r = 1""", "vector", "pair", BOTH)
oracle("cluster_scores", """
SELECT content_cluster_id, count(*) FILTER (kind = 'add' AND n > 2) / 10 AS stress_score, count(*) FILTER (n > 1) / 10 AS priority_score FROM (
  SELECT content_cluster_id, CASE WHEN content_item_id % 6 = 5 THEN 'move' ELSE 'add' END AS kind,
    row_number() OVER (PARTITION BY content_cluster_id ORDER BY raw_created_at, content_item_id) AS n FROM item WHERE content_cluster_id IS NOT NULL)
GROUP BY ALL""", "item")
oracle("merge_clusters", """
SELECT content_cluster_id, r.num_items, r.num_items_unique, c.exemplar_item_id FROM recounted r JOIN cluster c USING (content_cluster_id)""",
       "item", "cluster",
       """target AS (SELECT s.content_cluster_id AS source_id, t.content_cluster_id AS target_id FROM cluster s JOIN cluster t
  ON s.content_cluster_id % 2 = 1 AND t.content_cluster_id = s.content_cluster_id - 1)""",
       """moved AS (SELECT i.* REPLACE (coalesce(target_id, content_cluster_id) AS content_cluster_id)
  FROM item i LEFT JOIN target ON i.content_cluster_id = target.source_id)""",
       f"recounted AS ({_recount('moved')})")

oracle("raw_store_compacted", ORACLES["extract_multi_field"])
oracle("tweet_csv", f"""
SELECT CAST(doc_id AS VARCHAR) AS raw_content_id, md5(text) AS digest, {PUBLISHED} AS content_published_date,
  concat('https://twitter.com/twitter/status/', doc_id) AS content_published_url, lang AS content_language_code
FROM documents WHERE doc_id % 4 <> 0""")
oracle("tipline_csv", """SELECT concat(conv_id, '-', turn) AS raw_content_id, md5(text) AS digest,
  TIMESTAMP '2024-01-02 03:04:05' AS content_published_date FROM conversations WHERE role = 'user'""")
oracle("snapshot_changes", ORACLES["upsert_items"])
oracle("ingest_stream", f"""SELECT * EXCLUDE is_failed, CASE WHEN is_failed THEN 'failed' ELSE 'ready' END AS current_state
FROM ({ORACLES["extract_multi_field"]})""")
oracle("ingest_stream_broken", f"""SELECT 'item' AS kind, raw_content_id AS name, source_field FROM ({ORACLES["extract_multi_field"]})
UNION ALL SELECT 'broken', md5({BROKEN}), NULL FROM documents WHERE doc_id % 10 = 3""")
oracle("ingest_runs", f"""
SELECT 'completed' AS state, 0 AS bad_lines, count(*) AS items, count(*) AS inserted, 0 AS replaced, 0 AS ignored,
  count(*) FILTER (is_failed) AS failed, count(*) FILTER (NOT is_failed) AS dispatched, 0 AS removed FROM ({ORACLES["extract_multi_field"]})
UNION ALL SELECT 'failed', 0, 0, 0, 0, 0, 0, 0, 0""")
oracle("stream_callbacks_broken", f"""SELECT content_item_id, count(*) AS n, NULL AS line FROM ({ORACLES["callback_keywords"]}) GROUP BY ALL
UNION ALL SELECT NULL, 1, md5({BROKEN}) FROM documents WHERE doc_id % 10 = 3""")
oracle("backfill_load", f"""
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, 0 AS bad_lines, coalesce(raw_items, 0) AS raw_items, coalesce(items, 0) AS items,
  coalesce(items, 0) AS inserted, 0 AS replaced, 0 AS ignored, coalesce(failed, 0) AS failed,
  CASE WHEN raw_items IS NULL THEN 'missing' ELSE 'completed' END AS status
FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-28', INTERVAL 1 DAY)) AS d)
LEFT JOIN (SELECT date_id, count(*) AS items, count(*) FILTER (is_failed) AS failed FROM ({ORACLES["extract_multi_field"]}) GROUP BY ALL) e
  ON CAST(strftime(d, '%Y%m%d') AS INTEGER) = e.date_id
LEFT JOIN (SELECT 20240101 + doc_id % 28 AS raw_date, count(*) AS raw_items FROM documents GROUP BY ALL) r ON e.date_id = raw_date""")
oracle("stream_day_counts", """SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS num_items
FROM events GROUP BY ALL""")
oracle("stream_states", ORACLES["apply_events"])
oracle("stream_callbacks", ORACLES["callback_keywords"])
oracle("workflow_tweets", """
SELECT i.workspace_id, CASE WHEN clean = '' THEN 'failed' ELSE 'completed' END AS current_state, count(*) AS num_items,
  count(DISTINCT coalesce(root, rep)) AS num_clusters
FROM (SELECT *, CASE WHEN clean <> '' THEN min(content_item_id) OVER (PARTITION BY workspace_id, clean) END AS rep
  FROM (SELECT *, """ + _clean("content") + """ AS clean FROM item)) i LEFT JOIN component ON rep = id GROUP BY ALL""", "item",
       f"cleaned AS (SELECT * FROM (SELECT *, {_clean('content')} AS clean FROM item) WHERE clean <> '')",
       "txt AS (SELECT workspace_id, min(content_item_id) AS content_item_id, clean AS content FROM cleaned GROUP BY workspace_id, clean)",
       TEXT_PAIRS, TEXT_LINKS, _components("link"), recursive=True)
oracle("workflow_events", """
SELECT a AS from_state, b AS to_state, count(*) AS num_events FROM documents, (VALUES ('ready', 'vectorized'), ('vectorized', 'clustered'),
  ('clustered', 'hashtaged'), ('hashtaged', 'categorized'), ('categorized', 'completed')) t(a, b) GROUP BY ALL""")
oracle("hashed_vectors", f"""SELECT doc_id AS content_item_id,
  CAST(CASE WHEN len(regexp_extract_all(lower(content), '{T.TERM}')) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS norm2
FROM (SELECT *, content_item_id AS doc_id FROM item)""", "item")

oracle("raw_store_read", f"""
SELECT concat('ws', doc_id % 3) AS workspace_id, 'junkipedia' AS source_id, concat('q', doc_id % 5) AS query_id, date_id,
  strftime({_minutes('doc_id * 7')}, '%Y-%m-%d %H:%M:%S.%f') AS created_at, concat('d', doc_id) AS content_id,
  CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS digest
FROM (SELECT *, CAST(20240101 + doc_id % 28 AS INTEGER) AS date_id FROM documents) WHERE date_id IN (20240103, 20240104, 20240120)""")
oracle("external_table", """SELECT CAST(20240101 + doc_id % 28 AS INTEGER) AS date_id, concat('ws', doc_id % 3) AS workspace_id,
  count(*) AS num_items FROM documents GROUP BY ALL""")
oracle("content_page", "SELECT content_item_id, workspace_id FROM item WHERE content_item_id > 57 ORDER BY content_item_id LIMIT 100", "item")
oracle("cluster_members", "SELECT content_item_id, content_cluster_id FROM item WHERE content_cluster_id = 1003", "item")
oracle("move_items", "SELECT * FROM recounted", "item", "toxic_doc",
       """moved AS (SELECT * REPLACE (CASE WHEN content_item_id IN (SELECT content_item_id FROM toxic_doc)
  THEN CAST(substr(workspace_id, 3) AS BIGINT) * 1000 ELSE content_cluster_id END AS content_cluster_id) FROM item)""",
       f"recounted AS ({_recount('moved')})")
oracle("discard_vectors", """SELECT content_item_id, workspace_id FROM vector WHERE workspace_id <> 'ws2'
AND content_item_id NOT IN (SELECT content_item_id FROM toxic_doc)""", "vector", "toxic_doc")
oracle("vector_scores", """SELECT a.content_item_id, round(1 + list_cosine_similarity(a.v, b.v), 4) AS score
FROM vector a JOIN vector b ON b.content_item_id = a.content_item_id + 1""", "vector")
oracle("stream_dedup", "SELECT DISTINCT workspace_id, raw_content_id, source_field FROM incoming", LOADS)
oracle("run_states", """
SELECT run_id, last(state ORDER BY n) AS current_state, last(end_ts ORDER BY n) AS transition_end, last(done_ts ORDER BY n) AS completed_timestamp
FROM walk GROUP BY ALL""", """run_allowed(from_state, to_state) AS (VALUES ('ready', 'running'), ('running', 'failed'),
  ('running', 'completed'), ('failed', 'running'))""", """
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM (
  SELECT event_id, concat('run', user_id) AS run_id, ts, CASE WHEN event_type = 'signup' THEN 'ready'
    WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS to_state FROM events)),
walk(run_id, n, state, end_ts, done_ts) AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT), 'ready', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM numbered
  UNION ALL
  SELECT w.run_id, e.n, CASE WHEN a.to_state IS NULL THEN w.state ELSE e.to_state END,
    CASE WHEN a.to_state IS NULL THEN w.end_ts ELSE e.ts END,
    CASE WHEN a.to_state IN ('failed', 'completed') THEN e.ts ELSE w.done_ts END
  FROM walk w JOIN numbered e ON e.run_id = w.run_id AND e.n = w.n + 1
    LEFT JOIN run_allowed a ON a.from_state = w.state AND a.to_state = e.to_state)""", recursive=True)
oracle("stream_clusters", "SELECT vec_id AS content_item_id, coalesce(root, vec_id) AS content_cluster_id FROM embeddings LEFT JOIN component ON id = vec_id",
       "vector", "pair", "link AS (SELECT src_id AS a, dst_id AS b FROM pair UNION ALL SELECT dst_id, src_id FROM pair)", _components("link"), recursive=True)
oracle("sample_items", """SELECT content_item_id FROM item
WHERE CAST(concat('0x', substr(md5(concat('42:', content_item_id)), 1, 8)) AS BIGINT) % 10000 < 1000""", "item")
oracle("merge_pass", """
SELECT vec_id AS content_item_id, coalesce(target, home) AS content_cluster_id
FROM vec LEFT JOIN component ON component.id = home LEFT JOIN final ON final.root = component.root""",
       "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, ((label % 5) + 5) % 5 * 1000 + vec_id % 97 AS home FROM embeddings)",
       "home_cluster AS (SELECT home, count(*) AS n, min(vec_id) AS exemplar FROM vec GROUP BY home)",
       f"""offer AS (
  SELECT c.home AS source, o.home AS target, o.vec_id AS dst, list_cosine_similarity(e.v, o.v) AS score, t.n
  FROM home_cluster c JOIN vec e ON e.vec_id = c.exemplar JOIN vec o ON o.home <> c.home JOIN home_cluster t ON t.home = o.home
  WHERE c.home % 4 <> 0 AND list_cosine_similarity(e.v, o.v) >= {VECTOR_THRESHOLD})""",
       "best AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, n DESC, dst DESC) AS r FROM offer) WHERE r = 1)",
       "merge_link AS (SELECT source AS a, target AS b FROM best UNION SELECT target, source FROM best)", _components("merge_link"),
       """final AS (SELECT root, id AS target FROM (
  SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY id IN (SELECT source FROM best), n DESC, id) AS r
  FROM component JOIN home_cluster ON home = id WHERE id IN (SELECT target FROM best)) WHERE r = 1)""", recursive=True)
oracle("assign_clusters", """
SELECT content_item_id, coalesce(placed.origin, component.root, content_item_id) AS content_cluster_id
FROM vector LEFT JOIN placed ON placed.id = content_item_id LEFT JOIN component ON component.id = content_item_id""",
       "vector", "pair", BOTH,
       """step(id, k) AS (SELECT content_item_id, 0 FROM vector WHERE label = 0
  UNION SELECT src_id, k + 1 FROM step JOIN both_ways ON dst_id = id WHERE k < 40)""",
       "layer AS (SELECT id, min(k) AS k FROM step GROUP BY id)",
       """parent AS (SELECT id, parent FROM (SELECT l.id, dst_id AS parent, row_number() OVER (PARTITION BY l.id ORDER BY score DESC, dst_id DESC) AS r
  FROM layer l JOIN both_ways ON src_id = l.id JOIN layer m ON m.id = dst_id AND m.k = l.k - 1) WHERE r = 1)""",
       "placed(id, origin) AS (SELECT id, id FROM layer WHERE k = 0 UNION ALL SELECT p.id, origin FROM parent p JOIN placed ON placed.id = p.parent)",
       "rest_link AS (SELECT src_id AS a, dst_id AS b FROM both_ways WHERE src_id NOT IN (SELECT id FROM layer) AND dst_id NOT IN (SELECT id FROM layer))",
       _components("rest_link"), recursive=True)
oracle("workflow_second_run", """
SELECT doc_id AS content_item_id, coalesce(joined, false) AS joined, CASE WHEN NOT coalesce(joined, false) THEN coalesce(component.root, rep) END AS new_cluster_id
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE doc_id % 10 = 3)
LEFT JOIN component ON component.id = rep LEFT JOIN (SELECT c.root, true AS joined FROM component c JOIN met ON met.src_id = c.id AND NOT is_new GROUP BY ALL) j ON j.root = component.root""",
       *_two_batches(THRESHOLDS["tweets"]), "new_link AS (SELECT id AS a, id AS b FROM batch_text WHERE is_new UNION SELECT src_id, dst_id FROM met WHERE is_new)",
       _components("new_link"), recursive=True)
