"""Queries of text columns, ingest routing and checks of claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import match as M
from pairloom.functions import text as X
from pairloom.operators import matching
from pairloom.plans.catalog_linking import norm
from pairloom.plans.catalog_matching import PAIR_LISTS, pair_lists
from pairloom.plans.registry import query

URL = r"(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || CASE WHEN rtrim(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') END || CASE WHEN regexp_extract(trim(url), '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(trim(url), '^[^?#]*(\?[^#]*)', 1) END)"


@query("p1_canonical_url", f"SELECT page_id, {URL} AS url FROM pages")
def p1(t):
    return t.pages.select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query("p2_url_hash", f"SELECT page_id, sha256({URL}) AS url_hash FROM pages")
def p2(t):
    return t.pages.select("page_id", X.url_hash(F.col("url")).alias("url_hash"))


@query("p3_board_job_id", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'tok' || page_id END AS token, CASE WHEN page_id % 3 < 2 THEN CAST(page_id * 7 AS VARCHAR) END AS job FROM pages")
def p3(t):
    n, j = F.col("page_id").cast("string"), (F.col("page_id") * 7).cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://job-boards.example.io/tok"), n, F.lit("/jobs/"), j, F.lit("?a=1"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("https://jobs.example.co/tok"), n, F.lit("/"), j, F.lit("/"))).otherwise(F.col("url"))
    both = X.board_job_id(url)
    return t.pages.select("page_id", both["token"].alias("token"), both["job"].alias("job"))


@query("p4_clean_html")
def p4(t):
    return t.pages.select("page_id", X.clean_html(F.col("html")).alias("text"))


@query("p5_drop_boilerplate", "SELECT doc_id, array_to_string(list_filter(list_concat(string_split(text, chr(10)), ['Apply Now', 'powered by Lever ', 'We apply now']), lambda v: NOT regexp_matches(v, '(?i)^(?:apply now|submit application|powered by (?:greenhouse|lever|ashby)|equal opportunity employer\\.?)\\s*$')), chr(10)) AS text FROM documents")
def p5(t):
    lines = F.concat(F.split("text", "\n", -1), F.array(F.lit("Apply Now"), F.lit("powered by Lever "), F.lit("We apply now")))
    return t.documents.select("doc_id", F.array_join(X.drop_boilerplate(lines), "\n").alias("text"))


#: Amounts as JSON of any kind: ranges, texts without one, numbers, objects under several names, with zeros and blanks before what counts.
@query("p6_comp_bounds", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000 WHEN 3 THEN CAST(trunc(p_retailprice) AS BIGINT) WHEN 4 THEN p_size WHEN 5 THEN CAST(trunc(p_retailprice) AS BIGINT) WHEN 6 THEN p_size END AS low,
 CASE p_partkey % 8 WHEN 0 THEN (p_size + 20) * 1000 WHEN 1 THEN (p_size + 20) * 1000 WHEN 3 THEN CAST(trunc(p_retailprice) AS BIGINT) WHEN 4 THEN p_size + 7 WHEN 6 THEN p_partkey END AS high FROM part""")
def p6(t):
    s, e, k, price = (c.cast("string") for c in (F.col("p_size"), F.col("p_size") + 20, F.col("p_partkey"), F.col("p_retailprice")))
    shapes = [
        F.concat(F.lit('"$'), s, F.lit("k - $"), e, F.lit('K a year"')), F.concat(F.lit('"'), s, F.lit(",000 to "), e, F.lit(',000"')), F.lit('"negotiable"'), price,
        F.concat(F.lit('{"min": 0, "minValue": '), s, F.lit(', "max": "'), (F.col("p_size") + 7).cast("string"), F.lit('"}')), F.concat(F.lit('{"low": "'), price, F.lit('", "high": "soon"}')),
        F.concat(F.lit('{"min": "", "minValue": null, "low": '), s, F.lit(', "maxValue": '), k, F.lit("}")), F.lit("[1, 2]"),
    ]
    both = X.comp_of(F.parse_json(F.element_at(F.array(*shapes), (F.col("p_partkey") % 8 + 1).cast("int"))))
    return t.part.select("p_partkey", both["low"].alias("low"), both["high"].alias("high"))


@query("p7_parse_ts", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch_ms(date_trunc('second', ts)) + CASE WHEN event_id % 4 = 1 THEN -7200000 ELSE 0 END END AS millis FROM events")
def p7(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ms = F.unix_seconds(F.col("ts").cast("timestamp")) * 1000
    text = F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(iso, F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, ms.cast("string")).otherwise("soon")
    return t.events.select("event_id", F.unix_millis(X.parse_ts(text)).alias("millis"))


@query("p8_normalize_label", f"SELECT doc_id, {norm('text')} AS label FROM documents")
def p8(t):
    return t.documents.select("doc_id", X.normalize_label(F.col("text")).alias("label"))


@query("p9_est_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def p9(t):
    return t.documents.select("doc_id", X.est_tokens(F.col("text")).alias("tokens"))


@query("p12_skill_text", "SELECT skill_id, label || ' | ' || alt || ' | ' || kind AS text FROM {v_taxonomy}")
def p12(t):
    return t.v_taxonomy.select("skill_id", X.skill_text(F.col("label"), F.array("alt", F.lit(" ")), F.col("kind")).alias("text"))


_TITLE = "(CASE p_partkey % 9 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Mid-Level ' WHEN 3 THEN 'Junior ' WHEN 4 THEN 'Principal ' WHEN 5 THEN 'Lead ' ELSE '' END || p_name || CASE p_partkey % 8 WHEN 0 THEN ' Backend Engineer' WHEN 1 THEN ' Data Scientist' WHEN 2 THEN ' Product Manager' WHEN 3 THEN ' iOS developer' WHEN 4 THEN ' SRE' WHEN 5 THEN ' Front-End Developer' WHEN 6 THEN ' Director' ELSE '' END)"


@query("p14_seniority", f"SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'senior' WHEN 1 THEN 'staff' WHEN 2 THEN 'mid' WHEN 3 THEN 'junior' WHEN 4 THEN 'principal' END AS posting, CASE p_partkey % 9 WHEN 0 THEN 'senior' WHEN 1 THEN 'staff' WHEN 3 THEN 'junior' WHEN 4 THEN 'principal' WHEN 5 THEN 'lead' ELSE 'mid' END AS profile FROM part")
def p14(t):
    rows = t.part.withColumn("title", F.expr(_TITLE))
    return rows.select("p_partkey", X.seniority(F.col("title")).alias("posting"), X.profile_seniority(F.array("title")).alias("profile"))


@query("p15_arrangement", r"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'onsite' END AS arrangement FROM documents")
def p15(t):
    more = F.element_at(F.array(*[F.lit(x) for x in (" Remote-first", " Remote or hybrid", " HYBRID", " in office", " remotely", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", X.arrangement(F.concat("text", more)).alias("arrangement"))


# Postings made of documents: a title line, a location line, an amount in one of several spellings, then the text without dollar signs.
_JD = "(SELECT doc_id, lang, source, n_chars % 900 + 1 AS n FROM documents)"


@query("p16_jd_fields", f"""SELECT doc_id, lang || ' person ' || n AS title, CASE WHEN n % 2 = 0 THEN source || ' ' || n END AS location,
  CASE n % 5 WHEN 0 THEN n * 1000 WHEN 1 THEN n * 1000 WHEN 2 THEN 1000 + n WHEN 3 THEN n END AS low, CASE n % 5 WHEN 1 THEN (n + 20) * 1000 WHEN 2 THEN 2000 + n WHEN 3 THEN n + 7 END AS high FROM {_JD} j""")
def p16(t):
    n = F.col("n_chars") % 900 + 1

    def text(v):
        return v.cast("string")

    place = F.when(n % 2 == 0, F.concat(F.lit("LOCATION :  "), "source", F.lit(" "), text(n), F.lit(", (remote)\n"))).otherwise("")
    pay = (
        F.when(n % 5 == 0, F.concat(F.lit("pay $"), text(n), F.lit("k\n"))).when(n % 5 == 1, F.concat(F.lit("$"), text(n), F.lit("k – $ "), text(n + 20), F.lit("K\n")))
        .when(n % 5 == 2, F.concat(F.lit("$1,"), F.lpad(text(n), 3, "0"), F.lit(" to 2,"), F.lpad(text(n), 3, "0"), F.lit(" a month\n")))
        .when(n % 5 == 3, F.concat(F.lit("$"), text(n), F.lit("-"), text(n + 7), F.lit(" an hour of the usual sort for us\n"))).otherwise("no pay\n")
    )
    jd = F.concat(F.lit("\n"), place, F.lit("  "), "lang", F.lit(" person "), text(n), F.lit(" — at home\n"), pay, F.replace("text", F.lit("$"), F.lit(" ")))
    both = X.comp_range_or_single(jd)
    return t.documents.select("doc_id", X.title_line(jd).alias("title"), X.location_line(jd).alias("location"), both["low"].alias("low"), both["high"].alias("high"))


@query("p17_canon_values", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' WHEN 2 THEN 'lead' WHEN 3 THEN 'wizard' END AS seniority, CASE p_partkey % 2 WHEN 0 THEN 'onsite,remote' ELSE 'hybrid' END AS arrangements FROM part")
def p17(t):
    raw = F.element_at(F.array(F.lit(" JR "), F.lit("Sr"), F.lit("Director"), F.lit("Wizard"), F.lit(" ")), (F.col("p_partkey") % 5 + 1).cast("int"))
    lists = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("On-site"), F.lit("onsite"), F.lit(" REMOTE "), F.lit("moon"))).otherwise(F.array(F.lit("hybrid"), F.lit("Hybrid")))
    return t.part.select("p_partkey", X.canon_seniority(raw).alias("seniority"), F.array_join(X.canon_arrangements(lists), ",").alias("arrangements"))


@query("p18_norm_month", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01' WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN NULL ELSE 'Q1 ' || strftime(o_orderdate, '%Y') END AS month FROM orders")
def p18(t):
    d = F.col("o_orderdate")
    forms = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-M")).when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "yyyy")).when(F.col("o_orderkey") % 5 == 2, F.date_format(d, "MMM yyyy")).when(F.col("o_orderkey") % 5 == 3, F.lit("Present")).otherwise(F.concat(F.lit("Q1 "), F.date_format(d, "yyyy")))
    return t.orders.select("o_orderkey", X.norm_month(forms).alias("month"))


@query("p19_title_family", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Backend Engineering' WHEN 1 THEN 'Data Science' WHEN 2 THEN 'Product Management' WHEN 3 THEN 'Mobile' WHEN 4 THEN 'Platform/SRE' WHEN 5 THEN 'Frontend Engineering' WHEN 6 THEN 'Engineering Management' END AS family FROM part")
def p19(t):
    return t.part.select("p_partkey", X.title_family(F.expr(_TITLE)).alias("family"))


_SAID = "CASE {c} % 6 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'iOS engineer' WHEN 2 THEN 'Plumber' WHEN 3 THEN 'Android Developer' WHEN 4 THEN 'Senior Security Manager' ELSE 'Machine learning lead' END"
_FAMILY = "CASE {c} % 6 WHEN 0 THEN 'Data Science' WHEN 1 THEN 'Mobile' WHEN 3 THEN 'Mobile' WHEN 4 THEN 'Security' WHEN 5 THEN 'Machine Learning' END"
_FOUND = "list_filter([{a}, {b}, {c}], lambda x: x IS NOT NULL)".format(a=_FAMILY.replace("{c}", "c_custkey"), b=_FAMILY.replace("{c}", "c_nationkey"), c=_FAMILY.replace("{c}", "(c_custkey // 6)"))
_DISTINCT = "list_filter({l}, lambda x, i: list_position({l}, x) = i)".replace("{l}", _FOUND)


@query("p19_title_families", f"SELECT c_custkey, array_to_string({_DISTINCT}, '|') AS families FROM customer")
def p19_all(t):
    return t.customer.select("c_custkey", F.array_join(X.title_families(_roles()), "|").alias("families"))


def _roles():
    return F.array(*[F.expr(_SAID.replace("{c}", c)) for c in ("c_custkey", "c_nationkey", "CAST(floor(c_custkey / 6) AS INT)")])


@query("p20_default_filters", f"""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE nullif(array_to_string({_DISTINCT}, '|'), '') END AS title_families, CASE WHEN c_custkey % 5 > 0 THEN n_name || '|' || c_mktsegment END AS locations,
 CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS comp_floor, CASE c_custkey % 4 WHEN 0 THEN 'mid,senior,staff' WHEN 1 THEN 'senior,lead' WHEN 2 THEN 'guru' END AS seniority_band,
 CASE c_custkey % 2 WHEN 0 THEN 'remote,hybrid,onsite' ELSE 'remote' END AS work_arrangement FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def p20(t):
    def some(when, *values):
        return F.when(when, F.array(*values)).otherwise(F.array().cast("array<string>"))

    level = F.element_at(F.array(F.lit("senior"), F.lit("lead"), F.lit("guru"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    floor = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal"))
    key = F.col("c_custkey")
    made = X.default_filters(_roles(), some(key % 4 == 0, "c_mktsegment"), some(key % 5 > 0, "n_name", "c_mktsegment"), some(key % 2 == 1, F.lit("remote")), level, floor)
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(key.alias("user_id"), made.alias("f"))
    return rows.select("user_id", F.array_join("f.title_families", "|").alias("title_families"), F.array_join("f.locations", "|").alias("locations"), "f.comp_floor", "f.seniority_band", F.array_join("f.work_arrangement", ",").alias("work_arrangement"))


@query("p22_fill_gaps", "SELECT job_id, coalesce(seniority, CASE WHEN job_id % 2 = 0 THEN 'mid' END) AS seniority, coalesce(comp_min, 5) AS comp_min FROM {v_jobs}")
def p22(t):
    found = F.when(F.col("job_id") % 2 == 0, "mid").otherwise("unknown")
    return t.v_jobs.select("job_id", F.coalesce("seniority", F.nullif(found, F.lit("unknown"))).alias("seniority"), F.coalesce("comp_min", F.lit(5)).alias("comp_min"))


@query("f8_route_postings", "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'unparseable' WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN 'expired' ELSE 'ok' END AS action FROM pages")
def f8(t):
    rows = t.pages.select("page_id", "url", F.when(F.col("page_id") % 11 != 0, F.col("html")).otherwise(" ").alias("raw_jd"), (F.col("page_id") % 7 == 0).alias("expired"), F.when(F.col("page_id") % 5 == 0, "Closed").alias("status"))
    return rows.select("page_id", X.route_postings().alias("action"))


@query("f9_route_extract", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' WHEN length(trim(d.text)) < 40 THEN 'unparseable' ELSE 'extract' END AS action FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def f9(t):
    done = t.labels.select("doc_id").distinct().withColumn("done", F.lit(True))
    return t.documents.join(done, "doc_id", "left").select("doc_id", X.route_extract(F.col("text"), F.col("done")).alias("action"))


@query("f10_usable_extraction", """SELECT doc_id, length(trim(text)) >= 40 AND (lang = 'en' OR contains(text, '$') OR contains(text, chr(10) || '- ') OR contains(text, '#')) AS usable FROM documents""")
def f10(t):
    money, none = F.contains("text", F.lit("$")), F.array().cast("array<string>")
    bullets = F.filter(F.split("text", "\n", -1), lambda v: v.startswith("- "))
    bullets = F.when(F.contains("text", F.lit("\n- ")), bullets).otherwise(none)
    seniority = F.when(F.col("lang") == "en", "senior").when(F.col("lang") == "de", "unknown").when(F.col("lang") == "fr", " ")
    tags = F.when(F.contains("text", F.lit("#")), F.array(F.lit("tag"))).otherwise(none)
    found = X.usable(F.length(F.trim("text")) >= 40, seniority, F.when(money & (F.col("doc_id") % 2 == 0), 1), F.when(money & (F.col("doc_id") % 2 > 0), 2), bullets, none, tags)
    return t.documents.select("doc_id", found.alias("usable"))


@query("f16_needs_html", "SELECT page_id FROM pages WHERE page_id % 4 = 0 AND page_id % 3 <> 0")
def f16(t):
    have = t.pages.where("page_id % 3 = 0").select("page_id")
    return t.pages.where("page_id % 4 = 0").join(have, "page_id", "left_anti").select("page_id")


@query("f18_nonempty_taxonomy", "SELECT skill_id FROM {v_taxonomy}")
def f18(t):
    rows = t.v_taxonomy
    if rows.isEmpty():
        raise ValueError("the taxonomy is empty")
    return rows.select("skill_id")


_A, _B = norm("a.text"), norm("b.text")
_TOK = "(SELECT a.doc_id, list_distinct(list_filter(string_split({a}, ' '), lambda v: v <> '')) AS x, list_distinct(list_filter(string_split({b}, ' '), lambda v: v <> '')) AS y, {a} AS na, {b} AS nb FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2)".replace("{a}", _A).replace("{b}", _B)


def _doc_pairs(t):
    b = t.documents.select(F.col("doc_id").alias("b_id"), X.normalize_label(F.col("text")).alias("nb"))
    return t.documents.select("doc_id", X.normalize_label(F.col("text")).alias("na")).join(b, F.floor(F.col("doc_id") / 2) == F.col("b_id"))


@query("x7_token_jaccard", f"SELECT doc_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM {_TOK} p")
def x7(t):
    return _doc_pairs(t).select("doc_id", F.round(M.token_jaccard(F.col("na"), F.col("nb")), 6).alias("jaccard"))


@query("e4_texts_match", f"SELECT doc_id, na = nb OR contains(na, nb) OR contains(nb, na) OR len(list_intersect(x, y)) >= 0.3 * len(list_distinct(list_concat(x, y))) AS same FROM {_TOK} p")
def e4(t):
    return _doc_pairs(t).select("doc_id", M.texts_match(F.col("na"), F.col("nb"), 0.3).alias("same"))


@query("k6_forbidden_phrases", f"SELECT doc_id, contains(' ' || {norm('text')} || ' ', ' of the ') AS found FROM documents")
def k6(t):
    return t.documents.select("doc_id", F.contains(F.concat(F.lit(" "), X.normalize_label(F.col("text")), F.lit(" ")), F.lit(" of the ")).alias("found"))


@query("k4_fabricated_numbers", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id + 1000000 AS VARCHAR) END AS fabricated FROM documents")
def k4(t):
    n = (F.col("doc_id") + 1000000).cast("string")
    claimed = F.concat("text", F.lit(" saved "), n, F.lit(" hours"))
    source = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" "), n, F.lit(" ."))).otherwise(F.concat("text", F.lit(" .")))
    return t.documents.select("doc_id", F.array_join(F.array_except(X.numbers(claimed), X.numbers(source)), ",").alias("fabricated"))


@query("k5_out_of_set_skills", "SELECT job_id, user_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n " + PAIR_LISTS + " WHERE len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0")
def k5(t):
    return pair_lists(t, matching.by_outside, "n long").select("job_id", "user_id", "n").where("n > 0")
