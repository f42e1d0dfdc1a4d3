"""Views that give the driver tables the shapes of postings, profiles, matches, events and taxonomies.

Each view has two texts, for Spark SQL and for the SQL of the check; {name} stands for a table or another view.
"""

from __future__ import annotations

#: name -> (Spark SQL, check SQL)
VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, spark: str, other: str | None = None) -> None:
    VIEWS[name] = (spark, (other or spark).replace("TIMESTAMP_NTZ", "TIMESTAMP"))


view("v_jobs", """
SELECT p_partkey AS job_id, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS location,
  CASE p_partkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS work_arrangement,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS comp_min,
  CASE WHEN e.vec_id IS NULL THEN NULL ELSE CASE p_size % 5 WHEN 0 THEN 'Junior' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior'
    WHEN 3 THEN 'staff' ELSE 'principal' END END AS seniority,
  TIMESTAMP_NTZ '2024-01-01 00:00:00' + (p_partkey % 30) * INTERVAL '1' DAY AS ingested_at,
  CASE WHEN e.vec_id IS NULL THEN NULL ELSE TIMESTAMP_NTZ '2024-01-02 00:00:00' + (p_partkey % 30) * INTERVAL '1' DAY END AS extracted_at,
  CASE WHEN p_partkey % 11 = 0 THEN TIMESTAMP_NTZ '2024-01-05 00:00:00' + (p_partkey % 30) * INTERVAL '1' DAY END AS expires_at,
  e.embedding AS embedding
FROM {part} LEFT JOIN {embeddings} e ON e.vec_id = p_partkey % (SELECT count(*) FROM {embeddings}) AND p_partkey % 6 <> 0
""")
view("v_users", """
SELECT c_custkey AS user_id,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE split(concat('brand#', c_nationkey + 1, ',', 'Brand#', c_nationkey % 9), ',') END AS locations,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(floor(c_acctbal / 10) AS INT) + 500 END AS comp_floor,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN split('remote', ',') ELSE split('remote,hybrid', ',') END AS work_arrangement,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN split('red/hot,small gizmo', ',') WHEN 2 THEN split('old', ',')
    WHEN 3 THEN split('ring plate,LARGE', ',') ELSE split('blue,widget x', ',') END AS title_families,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'junior,mid' WHEN 2 THEN 'mid,senior,staff' END AS seniority_band, e.embedding AS embedding
FROM {customer} LEFT JOIN {embeddings} e ON e.vec_id = c_custkey % (SELECT count(*) FROM {embeddings})
""")
view("v_job_skills",
     "SELECT l_partkey AS job_id, sort_array(collect_set(concat('skill:', l_suppkey % 20))) AS skill_ids FROM {lineitem} GROUP BY l_partkey",
     "SELECT l_partkey AS job_id, list_sort(list_distinct(list(concat('skill:', l_suppkey % 20)))) AS skill_ids FROM {lineitem} GROUP BY l_partkey")
view("v_profile_skills",
     "SELECT o_custkey AS user_id, sort_array(collect_set(concat('skill:', l_suppkey % 20))) AS skill_ids FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY o_custkey",
     "SELECT o_custkey AS user_id, list_sort(list_distinct(list(concat('skill:', l_suppkey % 20)))) AS skill_ids FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY o_custkey")
view("v_siblings", "SELECT DISTINCT concat('skill:', l_suppkey % 20) AS skill_id, concat('group:', CAST(floor((l_suppkey % 20) / 4) AS INT)) AS group_id FROM {lineitem}")
view("v_matches", """
SELECT o_orderkey AS match_id, o_custkey AS user_id, max(l_partkey) AS job_id, o_orderdate AS cycle_at, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS score,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'clearly_qualified' WHEN '2' THEN 'potentially_qualified' WHEN '3' THEN 'overqualified'
    WHEN '4' THEN 'minimally_qualified' END AS label
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority
""")
view("v_generations", """
SELECT l_orderkey * 10 + l_linenumber AS generation_id, l_orderkey AS match_id, l_linenumber AS attempt,
  CASE min(l_returnflag) WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' END AS verify_status FROM {lineitem} GROUP BY l_orderkey, l_linenumber
""")
view("v_companies", "SELECT s_suppkey AS company_id, s_name AS name, n_name AS country, concat('board', s_suppkey % 7) AS provider FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey")
view("v_job_company", "SELECT p_partkey AS job_id, p_partkey % (SELECT count(*) FROM {supplier}) AS company_id FROM {part}")
view("v_events", """
SELECT event_id, ts, user_id, event_id % 50 AS job_id,
  CASE event_type WHEN 'signup' THEN 'match-batch' WHEN 'error' THEN 'screen-job' ELSE 'ui' END AS stage,
  CASE event_type WHEN 'click' THEN 'viewed' WHEN 'view' THEN 'skipped' WHEN 'purchase' THEN 'marked_applied' WHEN 'signup' THEN 'completed' ELSE 'screened' END AS action,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value
FROM {events}
""")
view("v_taxonomy", """
SELECT concat('skill:', word) AS skill_id, word AS label, concat(word, ' (', kind, ')') AS alt, kind, dense_rank() OVER (ORDER BY kind, word) AS ord
FROM (SELECT DISTINCT split(p_name, ' ')[0] AS word, 'finish' AS kind FROM {part} UNION SELECT DISTINCT split(p_name, ' ')[1] AS word, 'hardware' AS kind FROM {part}) w
""", """
SELECT concat('skill:', word) AS skill_id, word AS label, concat(word, ' (', kind, ')') AS alt, kind, dense_rank() OVER (ORDER BY kind, word) AS ord
FROM (SELECT DISTINCT split(p_name, ' ')[1] AS word, 'finish' AS kind FROM {part} UNION SELECT DISTINCT split(p_name, ' ')[2] AS word, 'hardware' AS kind FROM {part}) w
""")
view("v_terms", """
SELECT concat('term:', t) AS skill_id, t AS term FROM (SELECT DISTINCT lang FROM {documents}) l
JOIN (SELECT 'en' AS lang, 'the' AS t UNION ALL SELECT 'en', 'and' UNION ALL SELECT 'en', 'that' UNION ALL SELECT 'en', 'with' UNION ALL SELECT 'en', 'of the'
  UNION ALL SELECT 'de', 'der' UNION ALL SELECT 'de', 'die' UNION ALL SELECT 'de', 'und' UNION ALL SELECT 'fr', 'que' UNION ALL SELECT 'es', 'que' UNION ALL SELECT 'fr', 'des') x ON x.lang = l.lang
GROUP BY t
""")
view("v_relevance", "SELECT q.vec_id AS q, d.vec_id AS d FROM {embeddings} q JOIN {embeddings} d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0")
