"""Queries of feeds, states, quotas and write-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import match as M
from pairloom.functions import text as X
from pairloom.operators import feed as op
from pairloom.plans.registry import query
from pairloom.plans.runtime import saved

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY cycle_at DESC, match_id DESC) AS rn FROM {v_matches}) WHERE rn = 1)"
_RANK = "CASE label WHEN 'unqualified' THEN 0 WHEN 'minimally_qualified' THEN 1 WHEN 'overqualified' THEN 2 WHEN 'potentially_qualified' THEN 3 WHEN 'clearly_qualified' THEN 4 END"
_GEN = "(SELECT match_id, max(generation_id) AS newest_id, arg_max(generation_id, attempt * 1000000000000 + generation_id) AS last_id, count(*) AS attempts FROM {v_generations} GROUP BY match_id)"


@query("w1_latest_match", f"SELECT user_id, job_id, match_id FROM {_LATEST} x")
def w1(t):
    return op.latest_match(t.v_matches).select("user_id", "job_id", "match_id")


@query("r1_match_feed", f"SELECT user_id, job_id, match_id, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK} DESC NULLS LAST, score DESC NULLS LAST, cycle_at DESC, match_id) AS place FROM {_LATEST} x")
def r1(t):
    return op.feed(t.v_matches).select("user_id", "job_id", "match_id", "place")


@query("w2_latest_generation", f"SELECT * FROM {_GEN} x")
def w2(t):
    return op.latest_generation(t.v_generations)


@query("w2_generation_todo", f"SELECT m.match_id, m.attempt FROM (SELECT match_id, match_id % 4 + 1 AS attempt FROM {{v_matches}}) m LEFT JOIN {_GEN} g USING (match_id) WHERE m.attempt <= 2 AND coalesce(g.attempts, 0) < m.attempt")
def w2todo(t):
    return op.generation_todo(t.v_matches.select("match_id", (F.col("match_id") % 4 + 1).alias("attempt")), t.v_generations.where("match_id % 3 <> 0 or true"))


_UI = "SELECT *, concat('d', k) AS detail FROM {v_events} WHERE stage = 'ui'"


@query("w3_ui_state", f"""SELECT user_id, job_id, bool_or(action = 'viewed') AS viewed, bool_or(action = 'generate_requested') AS generate_requested,
 max_by(detail, (ts, event_id)) FILTER (WHERE action = 'skipped') AS skipped, max_by(detail, (ts, event_id)) FILTER (WHERE action = 'marked_applied') AS applied,
 max_by(detail, (ts, event_id)) FILTER (WHERE action = 'outcome') AS outcome FROM ({_UI}) e GROUP BY user_id, job_id""")
def w3(t):
    return op.ui_state(t.v_events.withColumn("detail", F.concat(F.lit("d"), F.col("k").cast("string"))))


@query("w5_dedupe_views", "SELECT event_id FROM (SELECT event_id, action, row_number() OVER (PARTITION BY user_id, job_id, action ORDER BY ts, event_id) AS rn FROM {v_events}) WHERE action <> 'viewed' OR rn = 1")
def w5(t):
    return op.dedupe_views(t.v_events).select("event_id")


_QUOTA = "(SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 4 END AS quota FROM customer)"


def _users(t):
    return t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 4).alias("quota"))


_TOP = "(SELECT m.*, q.quota, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, match_id) AS rn FROM {v_matches} m LEFT JOIN " + _QUOTA + " q USING (user_id) WHERE label = 'clearly_qualified')"


@query("w7_quota_gate", f"SELECT match_id, CASE WHEN rn <= coalesce(quota, 0) THEN 'generate' ELSE 'quota_exhausted' END AS action FROM {_TOP} x")
def w7(t):
    return op.apply_quota(t.v_matches, _users(t))[0].select("match_id", "action")


@query("w7_quota_balance", f"SELECT user_id, quota - coalesce(n, 0) AS balance FROM {_QUOTA} q LEFT JOIN (SELECT user_id, count(*) AS n FROM {_TOP} x WHERE rn <= coalesce(quota, 0) GROUP BY user_id) u USING (user_id)")
def w7b(t):
    return op.apply_quota(t.v_matches, _users(t))[1].select("user_id", "balance")


_SOMEGEN = "(SELECT match_id, max(generation_id) AS newest_id FROM {v_generations} WHERE match_id % 3 = 0 GROUP BY match_id)"


@query("w17_route_generate", f"""SELECT match_id, user_id, CASE WHEN newest_id IS NOT NULL THEN 'skipped_existing' WHEN rn <= coalesce(quota, 0) THEN 'todo' ELSE 'quota_exhausted' END AS action, newest_id
FROM (SELECT match_id, user_id, newest_id, quota, row_number() OVER (PARTITION BY user_id, newest_id IS NULL ORDER BY score DESC, match_id) AS rn
 FROM {{v_matches}} LEFT JOIN {_SOMEGEN} g USING (match_id) LEFT JOIN {_QUOTA} q USING (user_id)) x""")
def w17(t):
    return op.route_generate(t.v_matches, t.v_generations.where("match_id % 3 = 0"), _users(t))


@query("f17_route_screen", """SELECT match_id, CASE WHEN j.p_partkey IS NULL OR u.c_custkey IS NULL THEN 'not_found' WHEN label IS NOT NULL THEN 'skipped'
 WHEN p_partkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'missing_docs' ELSE 'screen' END AS action
FROM {v_matches} m LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 1) j ON j.p_partkey = m.job_id LEFT JOIN customer u ON u.c_custkey = m.user_id""")
def f17(t):
    jobs = t.part.where("p_partkey % 10 <> 1").select(F.col("p_partkey").alias("job_id"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_name")).alias("doc"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 17 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("doc"))
    return op.route_screen(t.v_matches, jobs, users).select("match_id", "action")


@query("k7_route_verify", """SELECT generation_id, coalesce(verify_status, CASE WHEN generation_id % 3 = 0 THEN 'passed' WHEN attempt = 1 THEN 'failed' ELSE 'needs_review' END) AS verify_status,
 verify_status IS NULL AND generation_id % 3 > 0 AND attempt = 1 AS regenerate FROM {v_generations}""")
def k7(t):
    return op.route_verify(t.v_generations.withColumn("n_failures", F.col("generation_id") % 3)).select("generation_id", "verify_status", "regenerate")


@query("t4_cas_update", """SELECT match_id, coalesce(label, CASE WHEN match_id % 2 = 0 THEN 'overqualified' END) AS label, match_id % 2 = 0 AND label IS NULL AS applied FROM {v_matches}""")
def t4(t):
    matches = saved(t.v_matches.select("match_id", "label"), "matches")  # built once, so that no task sorts for both sides what they are made of
    delta = matches.where("match_id % 2 = 0").select("match_id", F.lit("overqualified").alias("label"))
    return op.cas_update(matches, delta, "match_id", "label").select("match_id", "label", "applied")


@query("t5_idempotent_redelivery", """SELECT 'match' AS step, count(DISTINCT match_id) AS first, CAST(0 AS BIGINT) AS again FROM {v_matches} UNION ALL SELECT 'attempt', count(*), 0 FROM {v_generations}
UNION ALL SELECT 'url_hash', count(DISTINCT url), 0 FROM (SELECT url FROM pages WHERE url IS NOT NULL) UNION ALL SELECT 'label', count(*) FILTER (WHERE label IS NULL), 0 FROM {v_matches}""")
def t5(t):
    def appended(target, rows, key):  # what a delivery adds to rows that are there
        return op.upsert(target, rows, key).join(target.select(*key), key, "left_anti")

    def both(step, rows, key):  # each delivery is written, as a store would, and the next one meets what is there
        rows = saved(rows, step)
        first = appended(rows.limit(0), rows, key)
        again = appended(saved(op.upsert(rows.limit(0), rows, key), step), rows, key)
        return first.agg(F.count("*").alias("first")).crossJoin(again.agg(F.count("*").alias("again"))).select(F.lit(step).alias("step"), "first", "again")

    given = saved(t.v_matches.select("match_id", "user_id", "job_id", "score", "label"), "matches")
    matches = given.drop("label")
    pages = op.last_of_batch(t.pages.where("url is not null").withColumn("url_hash", F.sha2("url", 256)), ["url_hash"], "page_id").select("url_hash", "page_id")
    delta = given.select("match_id", F.lit("overqualified").alias("label"))
    once = saved(op.cas_update(given.select("match_id", "label"), delta, "match_id", "label"), "once")
    twice = op.cas_update(once.select("match_id", "label"), delta, "match_id", "label")
    done = once.agg(F.count(F.when(F.col("applied"), 1)).alias("first")).crossJoin(twice.agg(F.count(F.when(F.col("applied"), 1)).alias("again")))
    out = both("match", matches, ["match_id"]).unionByName(both("attempt", t.v_generations, ["match_id", "attempt"])).unionByName(both("url_hash", pages, ["url_hash"]))
    return out.unionByName(done.select(F.lit("label").alias("step"), "first", "again"))


#: Edits by orders, in the order of their keys; three in four customers have a profile, with some skills.
_EDITS = """SELECT o_custkey AS user_id, o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN 'ingest' ELSE 'edit' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN split(o_orderpriority, '-') END AS skill_ids,
  CASE WHEN o_orderkey % 3 = 0 THEN split(concat(o_orderstatus, ',', o_orderpriority), ',') END AS title_families, CASE WHEN o_orderkey % 5 < 2 THEN split(o_orderpriority, ' ') END AS locations,
  CASE WHEN o_orderkey % 7 = 1 THEN split('remote,onsite', ',') END AS work_arrangement, CASE WHEN o_orderkey % 4 = 1 THEN lower(o_orderpriority) END AS seniority_band,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS comp_floor, o_orderkey % 13 = 0 AS clear_comp_floor FROM {orders}"""
_HAVE = "SELECT u.user_id, CAST(3 AS BIGINT) AS version, u.user_id % 2 = 0 AS rematch_needed, skill_ids, title_families, locations, work_arrangement, seniority_band, CAST(comp_floor AS BIGINT) AS comp_floor FROM {v_users} u LEFT JOIN {v_profile_skills} s ON s.user_id = u.user_id WHERE u.user_id % 4 > 0"
_FOLDED = {"skill_ids": "v", "title_families": "v", "locations": "v", "work_arrangement": "v", "seniority_band": "s", "comp_floor": "s"}


def _last(c: str) -> str:
    clear = "(kind = 'edit' AND clear_comp_floor)" if c == "comp_floor" else "false"
    return f"max_by(struct_pack(v := CASE WHEN NOT {clear} THEN {c} END), ord) FILTER (WHERE kind = 'ingest' OR {c} IS NOT NULL OR {clear}) AS new_{c}"


@query("t6_profile_edits", f"""WITH e AS ({_EDITS.replace("split('remote", "string_split('remote")}), p AS ({_HAVE}), b AS (SELECT user_id, min(ord) AS begun FROM e WHERE kind = 'ingest' GROUP BY user_id),
f AS (SELECT e.user_id, count(*) AS n, {", ".join(map(_last, _FOLDED))} FROM e LEFT JOIN b USING (user_id) WHERE e.user_id IN (SELECT user_id FROM p) OR ord >= begun GROUP BY e.user_id)
SELECT coalesce(p.user_id, f.user_id) AS user_id, coalesce(version, 0) + coalesce(n, 0) AS version, coalesce(rematch_needed, false) OR n IS NOT NULL AS rematch_needed,
 {", ".join((f"array_to_string(CASE WHEN new_{c} IS NOT NULL THEN new_{c}.v ELSE p.{c} END, '|')" if k == "v" else f"CASE WHEN new_{c} IS NOT NULL THEN new_{c}.v ELSE p.{c} END") + f" AS {c}" for c, k in _FOLDED.items())}
FROM p FULL JOIN f ON f.user_id = p.user_id""")
def t6(t):
    out = op.apply_profile_edits(t.sql(_HAVE), t.sql(_EDITS))
    return out.withColumns({c: F.array_join(c, "|") for c, k in _FOLDED.items() if k == "v"})


@query("t7_user_defaults", "SELECT c_custkey AS user_id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 4 END, 20) AS quota, '2024-02-01' AS reset_at FROM customer")
def t7(t):
    return op.init_users(_users(t), 20, F.lit("2024-01-31").cast("date")).withColumn("reset_at", F.col("reset_at").cast("string"))


@query("t9_strip_users", "SELECT event_id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id END AS user_id, action FROM {v_events}")
def t9(t):
    ids = t.v_events.where("user_id % 10 = 3").select("user_id")
    return op.strip_users(t.v_events, ids).select("event_id", "user_id", "action")


@query("f12_disagreement", "SELECT match_id, coalesce((score >= 0.7 AND label IN ('unqualified', 'minimally_qualified')) OR (score <= 0.3 AND label = 'clearly_qualified'), false) AS disagrees FROM {v_matches}")
def f12(t):
    return t.v_matches.select("match_id", M.p_disagree(F.col("score"), F.col("label")).alias("disagrees"))


_RAW = "CASE o_orderkey % 7 WHEN 0 THEN ' Clearly-Qualified ' WHEN 1 THEN 'overqualified' WHEN 2 THEN 'POTENTIALLY qualified' WHEN 3 THEN 'pass' WHEN 4 THEN 'reject' WHEN 5 THEN NULL ELSE 'unqualified' END"


@query("p23_canon_label", f"SELECT o_orderkey, CASE WHEN replace(replace(lower(trim(x)), ' ', '_'), '-', '_') IN ('unqualified', 'minimally_qualified', 'overqualified', 'potentially_qualified', 'clearly_qualified') THEN replace(replace(lower(trim(x)), ' ', '_'), '-', '_') END AS label, least(1.0, greatest(0.0, o_totalprice / 100000 - 1)) AS confidence FROM (SELECT *, {_RAW} AS x FROM orders) o")
def p23(t):
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("o_totalprice") / 100000 - 1))
    return t.orders.select("o_orderkey", M.canon_label(F.expr(_RAW)).alias("label"), c.alias("confidence"))


@query("p24_label_rank", f"SELECT match_id, CAST({_RANK} AS BIGINT) AS label_rank FROM {{v_matches}}")
def p24(t):
    return t.v_matches.select("match_id", M.label_rank(F.col("label")).cast("long").alias("label_rank"))


@query("p25_remap_labels", f"SELECT o_orderkey, CASE x WHEN 'pass' THEN 'potentially_qualified' WHEN 'reject' THEN 'unqualified' ELSE x END AS label, CASE WHEN x IN ('pass') THEN 'pass' WHEN x IN ('reject', 'overqualified', 'unqualified') THEN 'reject' ELSE x END AS back FROM (SELECT *, {_RAW} AS x FROM orders) o")
def p25(t):
    label = M.remap_label(F.expr(_RAW))
    return t.orders.select("o_orderkey", label.alias("label"), M.unmap_label(label).alias("back"))


@query("f11_search_jobs", """SELECT job_id FROM (SELECT j.job_id, title, location, name AS company, ingested_at AS posted_at FROM {v_jobs} j JOIN {v_job_company} USING (job_id) LEFT JOIN {v_companies} USING (company_id))
 WHERE title ILIKE '%r_d%' OR company ILIKE '%r_d%' OR location ILIKE '%r_d%' ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 50""")
def f11(t):
    jobs = j2(t, raw=True)
    return op.search_jobs(jobs, "r_d").select("job_id")


@query("r2_search_order", "SELECT job_id FROM {v_jobs} ORDER BY ingested_at DESC NULLS LAST, job_id LIMIT 50")
def r2(t):
    return op.search_jobs(t.v_jobs.withColumn("posted_at", F.col("ingested_at")), " ").select("job_id")


@query("r4_list_users", "SELECT user_id FROM {v_users} ORDER BY user_id")
def r4(t):
    return t.v_users.select("user_id").orderBy("user_id")


@query("j2_jobs_with_company", "SELECT job_id, title, name AS company, country FROM {v_jobs} JOIN {v_job_company} USING (job_id) LEFT JOIN {v_companies} USING (company_id)")
def j2(t, raw=False):
    out = t.v_jobs.join(t.v_job_company, "job_id").join(t.v_companies, "company_id", "left").withColumn("company", F.col("name"))
    return out.withColumn("posted_at", F.col("ingested_at")) if raw else out.select("job_id", "title", "company", "country")


@query("j3_generation_detail", """SELECT g.generation_id, m.match_id, m.user_id, j.job_id, j.title, name AS company FROM {v_generations} g JOIN {v_matches} m USING (match_id) JOIN {v_jobs} j ON j.job_id = m.job_id
 JOIN {v_job_company} jc ON jc.job_id = j.job_id LEFT JOIN {v_companies} c ON c.company_id = jc.company_id WHERE g.match_id = 70""")
def j3(t):
    one = t.v_generations.where("match_id = 70").join(t.v_matches, "match_id")
    return one.join(j2(t), "job_id").select("generation_id", "match_id", "user_id", "job_id", "title", "company")


@query("j3_job_detail", """SELECT j.job_id, j.title, name AS company, country, j.location, j.seniority, j.work_arrangement, j.comp_min, array_to_string(skill_ids, ',') AS hard FROM {v_jobs} j JOIN {v_job_company} USING (job_id)
 LEFT JOIN {v_companies} USING (company_id) LEFT JOIN {v_job_skills} USING (job_id) WHERE j.job_id IN (70, 71, -1)""")
def j3_job(t):
    jobs = j2(t, raw=True).join(t.v_job_skills, "job_id", "left")
    found = [op.job_detail(jobs, k) for k in (70, 71, -1)]  # the last one is missing
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("job_id", "title", "company", "country", "location", "seniority", "work_arrangement", "comp_min", F.array_join("skill_ids", ",").alias("hard"))


@query("j4_resolve_labels", "SELECT job_id, array_to_string(list_transform(skill_ids, lambda x: CASE WHEN CAST(split_part(x, ':', 2) AS INT) < 15 THEN 'Label ' || split_part(x, ':', 2) ELSE x END), ',') AS labels FROM {v_job_skills}")
def j4(t):
    number = F.split_part("skill_id", F.lit(":"), F.lit(2))
    labels = t.v_siblings.select("skill_id").distinct().where(number.cast("int") < 15).withColumn("label", F.concat(F.lit("Label "), number))
    return op.resolve_labels(t.v_job_skills, "job_id", "skill_ids", labels).withColumn("labels", F.array_join("labels", ","))


_POST = "(SELECT page_id, 'board' || (page_id % 5) AS board, url FROM pages)"


@query("j5_new_postings", "SELECT 'board' || (page_id % 5) AS board, count(*) AS listed, count(*) FILTER (WHERE page_id % 4 <> 0) AS new, count(*) FILTER (WHERE page_id % 4 = 0) AS skipped FROM (SELECT *, count(*) OVER (PARTITION BY url) AS c FROM pages) GROUP BY 1")
def j5(t):
    listing = t.pages.select(F.concat(F.lit("board"), (F.col("page_id") % 5).cast("string")).alias("board"), X.url_hash(F.concat("url", F.lit("#"), F.col("page_id").cast("string"))).alias("h"), "page_id").withColumn("url_hash", F.concat("h", F.lit("-"), F.col("page_id").cast("string")))
    return op.new_postings(listing, listing.where("page_id % 4 = 0").select("url_hash"))


@query("w9_limit_to_target", """WITH l AS (SELECT url, min(page_id % 5) AS b FROM pages GROUP BY url), f AS (SELECT url, b, min(page_id) FILTER (WHERE true) AS pos FROM (SELECT p.url, p.page_id, l.b FROM pages p JOIN l ON l.url = p.url AND p.page_id % 5 = l.b) GROUP BY url, b),
known AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 = 0), r AS (SELECT url, b, pos, row_number() OVER (ORDER BY b, pos) AS rn FROM f WHERE url NOT IN (SELECT url FROM known))
SELECT sha256(url) AS url_hash, b AS board_ord, pos FROM r WHERE rn <= 120 - (SELECT count(*) FROM known)""")
def w9(t):
    listing = t.pages.select(F.sha2("url", 256).alias("url_hash"), (F.col("page_id") % 5).alias("board_ord"), F.col("page_id").alias("pos"))
    return op.limit_new_to_target(listing, listing.where("pos % 4 = 0"), 120)


@query("j14_profile_bundle", """WITH l AS (SELECT DISTINCT concat('skill:', l_suppkey % 20) AS skill_id, 'Skill ' || (l_suppkey % 20) AS label FROM lineitem WHERE l_suppkey % 20 % 3 > 0),
e AS (SELECT user_id, unnest(skill_ids) AS skill_id, generate_subscripts(skill_ids, 1) AS k FROM {v_profile_skills})
SELECT u.user_id, array_to_string(locations, '|') AS locations, comp_floor, seniority_band, coalesce(s.skills, '') AS skills FROM {v_users} u
LEFT JOIN (SELECT user_id, string_agg(skill_id || '=' || coalesce(label, skill_id), ',' ORDER BY k) AS skills FROM e LEFT JOIN l USING (skill_id) GROUP BY user_id) s USING (user_id)""")
def j14(t):
    labels = t.lineitem.select((F.col("l_suppkey") % 20).alias("n")).where("n % 3 > 0").distinct().select(F.concat(F.lit("skill:"), F.col("n").cast("string")).alias("skill_id"), F.concat(F.lit("Skill "), F.col("n").cast("string")).alias("label"))
    out = op.profile_bundle(t.v_users, t.v_profile_skills, labels)
    said = F.array_join(F.transform("skills", lambda s: F.concat(s["skill_id"], F.lit("="), s["label"])), ",")
    return out.select("user_id", F.array_join("locations", "|").alias("locations"), "comp_floor", "seniority_band", said.alias("skills"))


@query("f15_validate_events", """SELECT event_id, CASE WHEN action NOT IN ('viewed', 'skipped', 'generate_requested', 'marked_applied', 'outcome') THEN 'unknown action'
 WHEN action = 'skipped' AND k % 5 = 0 THEN 'skipped requires reason_code' WHEN action = 'skipped' AND k % 5 = 1 THEN 'invalid reason_code' WHEN action = 'viewed' AND k % 5 > 0 THEN 'accepts no extra fields' END AS error FROM {v_events}""")
def f15(t):
    code = F.when(F.col("k") % 5 == 1, "weather").when(F.col("k") % 5 > 1, "wrong_comp")
    none = F.lit(None).cast("string")
    rows = t.v_events.withColumns({"reason_code": code, "reason_text": none, "applied_at": none, "outcome": none})
    return op.validate_ui_events(rows).select("event_id", "error")


@query("p26_clip_reason", "SELECT doc_id, CASE WHEN length(trim(text)) > 240 THEN substr(trim(text), 1, 237) || '...' ELSE trim(text) END AS reason FROM documents")
def p26(t):
    return t.documents.select("doc_id", X.clip(F.col("text"), 240).alias("reason"))


@query("p27_fallback_label", "SELECT url, CASE WHEN contains(url, ':') THEN replace(substr(url, strpos(url, ':') + 1), '-', ' ') ELSE url END AS label FROM pages")
def p27(t):
    return t.pages.select("url", X.fallback_label(F.col("url")).alias("label"))


@query("s8_upsert_companies", """SELECT coalesce(c.provider, n.provider) AS provider, coalesce(c.token, n.token) AS token, coalesce(n.name, c.name) AS name, coalesce(c.discovered_via, n.discovered_via) AS discovered_via
FROM (SELECT provider, 'token' || company_id AS token, name, 'seed' AS discovered_via FROM {v_companies} WHERE company_id % 3 <> 0) c
FULL JOIN (SELECT provider, 'token' || company_id AS token, 'New ' || name AS name, 'feed' AS discovered_via FROM {v_companies} WHERE company_id % 2 = 0) n ON n.provider = c.provider AND n.token = c.token""")
def s8(t):
    rows = t.v_companies.select("company_id", "provider", F.concat(F.lit("token"), F.col("company_id").cast("string")).alias("token"), "name")
    old = rows.where("company_id % 3 <> 0").drop("company_id").withColumn("discovered_via", F.lit("seed"))
    new = rows.where("company_id % 2 = 0").drop("company_id").withColumns({"name": F.concat(F.lit("New "), "name"), "discovered_via": F.lit("feed")})
    return op.upsert(old, new, ["provider", "token"], keep=("discovered_via",))


@query("s11_upsert_postings", """SELECT page_id AS url_hash, CASE WHEN page_id % 10 = 0 THEN 'second' ELSE 'first' END AS title, '2024-01-01' AS ingested_at FROM pages WHERE page_id % 3 <> 1
UNION ALL SELECT page_id, 'second', '2024-02-02' FROM pages WHERE page_id % 3 = 1 AND page_id % 10 = 0""")
def s11(t):
    old = t.pages.where("page_id % 3 <> 1").select(F.col("page_id").alias("url_hash"), F.lit("first").alias("title"), F.lit("2024-01-01").alias("ingested_at"))
    batch = t.pages.where("page_id % 10 = 0").select(F.col("page_id").alias("url_hash"), F.explode(F.array(F.struct(F.lit("early").alias("title"), F.lit(1).alias("seq")), F.struct(F.lit("second").alias("title"), F.lit(2).alias("seq")))).alias("s"))
    batch = op.last_of_batch(batch.select("url_hash", "s.title", "s.seq"), ["url_hash"], "seq").select("url_hash", "title", F.lit("2024-02-02").alias("ingested_at"))
    return op.upsert(old, batch, ["url_hash"], keep=("ingested_at",))


@query("s12_upsert_skills", "SELECT skill_id, CASE WHEN ord % 2 = 0 THEN upper(label) ELSE label END AS label FROM {v_taxonomy}")
def s12(t):
    rows = t.v_taxonomy
    batch = rows.where("ord % 2 = 0").select("skill_id", F.upper("label").alias("label"))
    return rows.select("skill_id", "label").join(batch, "skill_id", "left_anti").unionByName(batch)
