"""Click-stream shaped queries over events and pages."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("hits_count_filtered", "SELECT count(*) AS n FROM events WHERE event_type <> 'view'")
q("hits_sums", "SELECT CAST(sum(event_id) AS BIGINT) AS s, count(*) AS n, round(avg(value), 6) AS a FROM events")
q("hits_distinct_users", "SELECT count(DISTINCT user_id) AS u FROM events")
q("hits_min_max_time", "SELECT min(ts) AS lo, max(ts) AS hi FROM events")
q("hits_by_type", "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC, event_type")
q("hits_users_by_type", "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10")
q("hits_top_users", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10")
q("hits_by_minute", "SELECT user_id, EXTRACT(minute FROM ts) AS m, count(*) AS n FROM events GROUP BY user_id, m ORDER BY n DESC, user_id, m LIMIT 10")
q("hits_like_count", "SELECT count(*) AS n FROM events WHERE props LIKE '%\"k\": 8%'")
q("hits_page_lengths", "SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host, round(avg(strlen(html)), 4) AS l, count(*) AS n, min(url) AS lo FROM pages WHERE url <> '' GROUP BY host HAVING count(*) > 1")
q("hits_text_search", "SELECT page_id, url FROM pages WHERE html LIKE '%<h1%' AND url LIKE 'http%' ORDER BY page_id LIMIT 10")
q("hits_hourly", "SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY h ORDER BY h LIMIT 24 OFFSET 2")
q("hits_case_source", "SELECT CASE WHEN value > 50 THEN event_type ELSE '' END AS src, user_id % 10 AS u, count(*) AS n FROM events GROUP BY src, u ORDER BY n DESC, src, u LIMIT 20")
q("hits_tumbling_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY day, event_type")
