"""Queries of metrics: A1-A17, F14, J11, J12, P21, S13, S15 and evaluation E1-E8."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions import match as M
from pairloom.operators import feed
from pairloom.operators import metrics as op
from pairloom.plans.registry import query
from pairloom.plans.runtime import fresh_path

_STAGED = """(SELECT event_id, CASE k % 6 WHEN 0 THEN 'extract-job' WHEN 1 THEN 'screen-job' WHEN 2 THEN 'generate-resume' ELSE stage END AS stage, action, ts,
  CASE WHEN k % 4 > 0 THEN k END AS prompt_tokens, CASE WHEN k % 4 > 0 THEN k % 7 END AS completion_tokens, CASE WHEN k % 5 > 0 THEN round(value / 1000, 8) END AS cost_usd, round(value * 10, 3) AS latency_ms, k, user_id FROM {v_events})"""


def _staged(t):
    """Events with model stages and usage fields, details as JSON."""
    return op.with_details(t.sql(_STAGED[1:-1]))


@query("a1_corpus_snapshot", """SELECT (SELECT count(*) FROM {v_jobs}) AS jobs, (SELECT count(extracted_at) FROM {v_jobs}) AS extracted, (SELECT round(count(extracted_at) / count(*), 4) FROM {v_jobs}) AS coverage,
 (SELECT count(verify_status) FROM {v_generations}) AS verified, (SELECT count(*) FROM {v_generations} WHERE verify_status = 'passed') AS passed""")
def a1(t):
    jobs = t.v_jobs.agg(F.count("*").alias("jobs"), F.count("extracted_at").alias("extracted")).withColumn("coverage", op.share(F.col("extracted"), F.col("jobs")))
    return jobs.crossJoin(t.v_generations.agg(F.count("verify_status").alias("verified"), F.count(F.when(F.col("verify_status") == "passed", 1)).alias("passed")))


@query("a2_events_by_stage", "SELECT stage, action, count(*) AS n FROM {v_events} GROUP BY stage, action")
def a2(t):
    return t.v_events.groupBy("stage", "action").agg(F.count("*").alias("n"))


@query("s13_event_details", f"SELECT event_id, prompt_tokens, cost_usd, latency_ms FROM {_STAGED} e")
def s13(t):
    path = fresh_path(t.spark, "events")
    _staged(t).select("event_id", "stage", "action", F.col("ts").cast("date").alias("day"), "details").write.mode("append").partitionBy("day", "stage").parquet(path)
    d = t.spark.read.parquet(path).withColumn("d", F.from_json("details", op.USAGE))
    return d.select("event_id", "d.prompt_tokens", "d.cost_usd", "d.latency_ms")


@query("f14_usage_rows", f"SELECT event_id FROM {_STAGED} e WHERE stage IN ('extract-job', 'screen-job', 'generate-resume', 'verify-resume') AND (cost_usd IS NOT NULL OR prompt_tokens IS NOT NULL)")
def f14(t):
    return op.usage_rows(_staged(t)).select("event_id")


_USE = f"(SELECT * FROM {_STAGED} e WHERE cost_usd IS NOT NULL OR prompt_tokens IS NOT NULL)"


@query("a3_usage_by_stage", f"""SELECT s.stage, count(u.event_id) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, round(avg(prompt_tokens), 4) AS mean_prompt, CAST(round(sum(CAST(cost_usd AS DECIMAL(30, 8))), 6) AS DOUBLE) AS cost, round(CAST(sum(CAST(cost_usd AS DECIMAL(30, 8))) AS DOUBLE) / count(cost_usd), 6) AS mean_cost,
 min(cost_usd) AS min_cost, max(cost_usd) AS max_cost FROM (VALUES ('extract-job'), ('screen-job'), ('generate-resume'), ('verify-resume')) s(stage) LEFT JOIN {_USE} u ON u.stage = s.stage GROUP BY s.stage""")
def a3(t):
    return op.usage_by_stage(_staged(t))


@query("a4_latency_by_stage", f"""WITH r AS (SELECT stage, latency_ms, row_number() OVER (PARTITION BY stage ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM {_STAGED} e WHERE latency_ms IS NOT NULL)
SELECT stage, max(n) AS n, round(avg(latency_ms), 4) AS mean, max(latency_ms) FILTER (WHERE i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(latency_ms) FILTER (WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, max(latency_ms) AS max FROM r GROUP BY stage""")
def a4(t):
    return op.latency_by_stage(_staged(t), "stage", "latency_ms")


@query("a5_funnel", """SELECT ingested, extracted, matched, screened, generated, passed, round(extracted / ingested, 4) AS extracted_share, round(screened / matched, 4) AS screened_share, round(passed / generated, 4) AS passed_share
FROM (SELECT count(*) AS ingested, count(extracted_at) AS extracted FROM {v_jobs}), (SELECT count(*) AS matched, count(label) AS screened FROM {v_matches}), (SELECT count(*) AS generated, count(*) FILTER (WHERE verify_status = 'passed') AS passed FROM {v_generations})""")
def a5(t):
    out = t.v_jobs.agg(F.count("*").alias("ingested"), F.count("extracted_at").alias("extracted")).crossJoin(t.v_matches.agg(F.count("*").alias("matched"), F.count("label").alias("screened")))
    out = out.crossJoin(t.v_generations.agg(F.count("*").alias("generated"), F.count(F.when(F.col("verify_status") == "passed", 1)).alias("passed")))
    return out.withColumns({"extracted_share": op.share(F.col("extracted"), F.col("ingested")), "screened_share": op.share(F.col("screened"), F.col("matched")), "passed_share": op.share(F.col("passed"), F.col("generated"))})


_CYCLES = "(SELECT *, CASE WHEN k % 4 > 0 THEN k * 3 END AS pre, k % 17 AS written, CASE WHEN k % 5 > 0 THEN k END AS queued, CASE WHEN stage = 'screen-job' AND k % 3 = 0 THEN 'quota_exhausted' WHEN stage = 'ui' AND k % 2 = 0 THEN 'extracted' ELSE action END AS act, CASE WHEN stage = 'ui' AND k % 2 = 0 THEN 'extract-job' ELSE stage END AS st FROM {v_events})"


@query("a5_funnel_peaks", f"""WITH e AS (SELECT * FROM {_CYCLES} e), p AS (SELECT user_id, count(*) AS n FROM {{v_matches}} GROUP BY user_id),
j AS (SELECT count(*) AS jobs_ingested, count(extracted_at) AS jobs_extracted FROM {{v_jobs}}), n AS (SELECT coalesce(max(n), 0) AS prefilter_pairs_now FROM p),
c AS (SELECT coalesce(max(pre), 0) AS pre, coalesce(max(written), 0) AS matches_written_peak, CAST(coalesce(sum(queued), 0) AS BIGINT) AS extracts_enqueued FROM e WHERE st = 'match-batch' AND act = 'completed'),
d AS (SELECT count(*) FILTER (WHERE st = 'extract-job' AND act IN ('extracted', 'unparseable', 'skipped_cached')) AS extract_events_done, count(*) FILTER (WHERE st = 'screen-job' AND act IN ('screened', 'quota_exhausted', 'skipped_screened')) AS screen_events_done FROM e),
m AS (SELECT count(label) AS screened FROM {{v_matches}}), g AS (SELECT count(*) AS generated, count(*) FILTER (WHERE verify_status = 'passed') AS verify_passed FROM {{v_generations}}),
a AS (SELECT *, greatest(pre, prefilter_pairs_now) AS prefilter_pairs_peak FROM j, n, c, d, m, g)
SELECT * EXCLUDE (pre), round(prefilter_pairs_peak / jobs_ingested, 4) AS prefilter_survival, CASE WHEN prefilter_pairs_peak > 0 THEN round(matches_written_peak / prefilter_pairs_peak, 4) END AS match_survival, round(verify_passed / jobs_ingested, 4) AS end_to_end FROM a""")
def a5_peaks(t):
    details = F.to_json(F.struct(F.col("pre").alias("prefilter_pairs"), F.col("written").alias("matches_written"), F.col("queued").alias("extracts_enqueued")))
    events = t.sql(f"SELECT * FROM {_CYCLES} e").select(F.col("st").alias("stage"), F.col("act").alias("action"), details.alias("details"))
    return op.funnel(t.v_jobs, t.v_matches.groupBy("user_id").agg(F.count("*").alias("n")), events, t.v_matches, t.v_generations)


@query("a6_label_distribution", "SELECT o AS ord, s.label, count(m.label) AS n FROM (VALUES (0, 'unqualified'), (1, 'minimally_qualified'), (2, 'overqualified'), (3, 'potentially_qualified'), (4, 'clearly_qualified')) s(o, label) LEFT JOIN {v_matches} m ON m.label = s.label GROUP BY o, s.label")
def a6(t):
    return op.distribution(t.v_matches, "label", M.LABELS)


@query("a7_prefilter_peak", "SELECT greatest((SELECT max(k) FROM {v_events} WHERE stage = 'match-batch'), (SELECT max(n) FROM (SELECT count(*) AS n FROM {v_matches} GROUP BY user_id))) AS peak")
def a7(t):
    cycles = t.v_events.where("stage = 'match-batch'").agg(F.max("k").alias("a"))
    users = t.v_matches.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("b"))
    return cycles.crossJoin(users).select(F.greatest("a", "b").alias("peak"))


@query("a8_applied_pairs", "SELECT count(*) AS pairs FROM (SELECT DISTINCT user_id, job_id FROM {v_events} WHERE action = 'marked_applied')")
def a8(t):
    return t.v_events.where("action = 'marked_applied'").select("user_id", "job_id").distinct().agg(F.count("*").alias("pairs"))


@query("a9_spend", f"SELECT CAST(round(sum(CAST(cost_usd AS DECIMAL(30, 8))), 5) AS DOUBLE) AS spend, count(*) AS calls FROM {_USE} u WHERE stage IN ('extract-job', 'screen-job', 'generate-resume', 'verify-resume')")
def a9(t):
    d = op.usage_rows(_staged(t)).select(F.from_json("details", op.EXACT).alias("d"))
    return d.agg(F.round(F.sum("d.cost_usd"), 5).cast("double").alias("spend"), F.count("*").alias("calls"))


@query("a12_vectors_trusted", "SELECT label % 2 AS part, coalesce(bool_and(vec_id % 1000 >= 0 AND (CASE WHEN label = 3 AND vec_id % 7 = 0 THEN NULL ELSE 'm1' END) IS NOT DISTINCT FROM 'm1'), true) AS trusted FROM embeddings WHERE embedding IS NOT NULL GROUP BY label % 2")
def a12(t):
    rows = t.embeddings.where("embedding is not null").withColumn("model", F.when(~((F.col("label") == 3) & (F.col("vec_id") % 7 == 0)), "m1"))
    return rows.groupBy((F.col("label") % 2).alias("part")).agg(F.coalesce(F.bool_and(F.col("model").eqNullSafe(F.lit("m1"))), F.lit(True)).alias("trusted"))


@query("a13_mean_not_null", "SELECT label, round(avg(CASE WHEN match_id % 3 > 0 THEN score END), 6) AS mean FROM {v_matches} GROUP BY label")
def a13(t):
    return t.v_matches.groupBy("label").agg(F.round(F.avg(F.when(F.col("match_id") % 3 > 0, F.col("score"))), 6).alias("mean"))


@query("a14_score_distribution", "SELECT label, count(score) AS n, min(score) AS min, median(score) AS median, max(score) AS max FROM {v_matches} GROUP BY label")
def a14(t):
    return op.score_distribution(t.v_matches, "label", "score")


@query("a15_filter_snapshot", "SELECT user_id, coalesce(array_to_string(title_families, '|'), '') AS families, coalesce(array_to_string(locations, '|'), '') AS locations, comp_floor FROM {v_users}")
def a15(t):
    none = F.array().cast("array<string>")
    return t.v_users.select("user_id", F.array_join(F.coalesce("title_families", none), "|").alias("families"), F.array_join(F.coalesce("locations", none), "|").alias("locations"), "comp_floor")


@query("a16_pending_work", "SELECT (SELECT count(*) FROM {v_matches} WHERE label IS NULL) AS unscreened, (SELECT count(*) FROM {v_generations} WHERE verify_status IS NULL) AS unverified, greatest(0, (SELECT count(*) FROM {v_matches} WHERE label = 'clearly_qualified') - (SELECT count(*) FROM {v_generations} WHERE attempt = 7)) AS ungenerated")
def a16(t):
    m = t.v_matches.agg(F.count(F.when(F.col("label").isNull(), 1)).alias("unscreened"), F.count(F.when(F.col("label") == M.TOP_LABEL, 1)).alias("top"))
    g = t.v_generations.agg(F.count(F.when(F.col("verify_status").isNull(), 1)).alias("unverified"), F.count(F.when(F.col("attempt") == 7, 1)).alias("made"))
    return m.crossJoin(g).select("unscreened", "unverified", F.greatest(F.lit(0), F.col("top") - F.col("made")).alias("ungenerated"))


@query("a17_monthly_cost", f"SELECT round(CAST(sum(CAST(cost_usd AS DECIMAL(30, 8))) AS DOUBLE) / count(cost_usd) * 100 * 30, 4) AS monthly FROM {_USE} u WHERE stage = 'screen-job'")
def a17(t):
    d = op.usage_rows(_staged(t), ("screen-job",)).select(F.from_json("details", op.EXACT).alias("d"))
    return d.agg(F.round(op.mean_cost(F.col("d.cost_usd")) * 100 * 30, 4).alias("monthly"))


@query("p21_usage_cost", f"SELECT event_id, round(coalesce(prompt_tokens, 0) / 1000000 * 0.3 + coalesce(completion_tokens, 0) / 1000000 * 2.5, 10) AS cost FROM {_STAGED} e")
def p21(t):
    cost = F.coalesce("prompt_tokens", F.lit(0)) / 1_000_000 * F.lit(0.3) + F.coalesce("completion_tokens", F.lit(0)) / 1_000_000 * F.lit(2.5)
    return _staged(t).select("event_id", F.round(cost, 10).alias("cost"))


@query("j11_disagreements", """SELECT e.event_id, e.user_id, e.job_id, j.title, m.match_id FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY ts, event_id) AS rn FROM {v_events} WHERE action = 'skipped') WHERE rn = 1) e
 LEFT JOIN {v_jobs} j ON j.job_id = e.job_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY cycle_at DESC, match_id DESC) AS rn FROM {v_matches}) WHERE rn = 1) m ON m.user_id = e.user_id AND m.job_id = e.job_id""")
def j11(t):
    w = W.partitionBy("user_id", "job_id").orderBy("ts", "event_id")
    first = t.v_events.where("action = 'skipped'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    newest = feed.latest_match(t.v_matches).select("user_id", "job_id", "match_id")
    return first.join(t.v_jobs.select("job_id", "title"), "job_id", "left").join(newest, ["user_id", "job_id"], "left").select("event_id", "user_id", "job_id", "title", "match_id")


@query("j12_delivered", "SELECT g.generation_id, m.match_id, m.score, j.title, name AS company FROM {v_generations} g JOIN {v_matches} m USING (match_id) JOIN {v_jobs} j ON j.job_id = m.job_id JOIN {v_job_company} jc ON jc.job_id = j.job_id LEFT JOIN {v_companies} c ON c.company_id = jc.company_id WHERE verify_status = 'passed' ORDER BY score DESC NULLS LAST")
def j12(t):
    jobs = t.v_jobs.select("job_id", "title").join(t.v_job_company, "job_id").join(t.v_companies, "company_id", "left").select("job_id", "title", F.col("name").alias("company"))
    out = t.v_generations.where("verify_status = 'passed'").join(t.v_matches, "match_id").join(jobs, "job_id")
    return out.select("generation_id", "match_id", "score", "title", "company").orderBy(F.col("score").desc_nulls_last())


_TRUTH = "(SELECT l.doc_id, l.quality AS gold, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS said, d.lang FROM labels l JOIN documents d USING (doc_id))"


@query("e1_precision_recall", f"SELECT lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM (SELECT lang, count(*) FILTER (WHERE gold = 1 AND said = 1) AS tp, count(*) FILTER (WHERE gold = 0 AND said = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND said = 0) AS fn FROM {_TRUTH} x GROUP BY lang)")
def e1(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", (F.col("n_chars") > 400).alias("said")), "doc_id").withColumn("gold", F.col("quality") == 1)
    def n(c):
        return F.count(F.when(c, 1))
    g, s = F.col("gold"), F.col("said")
    out = rows.groupBy("lang").agg(n(g & s).alias("tp"), n(~g & s).alias("fp"), n(g & ~s).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": F.round(M.ratio(tp, tp + fp), 6), "recall": F.round(M.ratio(tp, tp + fn), 6), "f1": F.round(M.ratio(2 * tp, 2 * tp + fp + fn), 6)})


_HITS = """(SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rk FROM (SELECT a.vec_id AS q, b.vec_id AS d, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id))"""


@query("e2_recall_at_k", f"""SELECT k, round(avg(hits / gold), 6) AS recall FROM (SELECT r.q, ks.k, count(h.d) AS hits, max(r.n) AS gold FROM (SELECT q, count(*) AS n FROM {{v_relevance}} GROUP BY q) r CROSS JOIN (VALUES (1), (3), (5), (10), (1000000000)) ks(k)
 LEFT JOIN (SELECT h.q, h.d, h.rk FROM {_HITS} h JOIN {{v_relevance}} v ON v.q = h.q AND v.d = h.d WHERE rk <= 10) h ON h.q = r.q AND h.rk <= ks.k WHERE ks.k <= (SELECT greatest(count(*), 1) FROM embeddings) GROUP BY r.q, ks.k) GROUP BY k""")
def e2(t):
    from pairloom.operators import linking, metrics

    queries = t.embeddings.where("vec_id % 100 = 0")
    top = linking.top_k(queries.select(F.col("vec_id").alias("q"), "embedding"), t.embeddings.select(F.col("vec_id").alias("d"), "embedding"), 10, skip_self=True)
    sizes = t.embeddings.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    gold = queries.select(F.col("vec_id").alias("q"), "label").join(sizes, "label").where("gold > 0")
    of = t.embeddings.select(F.col("vec_id").alias("d"), F.col("label").alias("dl"))
    hits = gold.join(top, "q").join(of, "d").select("q", "gold", "rank", (F.col("label") == F.col("dl")).alias("hit"))
    return metrics.recall_at_k(hits, t.embeddings.count(), (1, 3, 5, 10, 1_000_000_000)).select("k", F.round("recall", 6).alias("recall"))
