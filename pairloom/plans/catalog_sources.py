"""Queries of sources, sinks and streams; their files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.plans.catalog_linking import norm
from pairloom.plans.catalog_matching import ALL_FILTERS
from pairloom.plans.catalog_text import URL
from pairloom.operators import matching
from pairloom.plans.registry import query
from pairloom.plans.runtime import fresh_path
from pairloom.sources import boards
from pairloom.streaming import streams


FILE = 50  # rows of one document


def _documents(df, t, tag):
    """One file per row of ``df`` (value: a whole JSON document), however many there are; a document holds a bounded number of rows."""
    path = fresh_path(t.spark, tag)
    df.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _in_files(rows, ident):
    """Rows dealt to documents of about ``FILE`` rows, by hash of the id."""
    return rows.withColumn("f", F.pmod(F.xxhash64(ident), F.lit(max(1, -(-rows.count() // FILE)))))


def _board_a(t):
    k = F.col("page_id")
    pay = F.when(k % 3 == 0, '"$100k - $150k"').when(k % 3 == 1, F.concat(F.lit('{"min": '), k * 10 + 1, F.lit(', "high": "'), k * 20 + 1, F.lit('"}'))).otherwise((k * 1000 + 0.5).cast("string"))
    job = F.struct(
        F.col("page_id").alias("id"), F.col("url").alias("absolute_url"), F.concat(F.lit("Job "), F.col("page_id").cast("string")).alias("title"), F.struct(F.lit("Town").alias("name")).alias("location"),
        F.array(F.struct(F.lit("Dept").alias("name"))).alias("departments"), F.array(F.struct(F.lit("Salary range").alias("name"), F.parse_json(pay).alias("value")), F.struct(F.lit("Employment type").alias("name"), F.parse_json(F.concat(F.lit('"type '), k % 2, F.lit('"'))).alias("value"))).alias("metadata"),
        F.lit("2024-01-02T03:04:05Z").alias("updated_at"), F.col("html").alias("content"),
    )
    return _documents(_in_files(t.pages, "page_id").groupBy("f").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("value")), t, "board-a")


def _board_b(t):
    rows = t.pages.select(
        F.col("page_id").cast("string").alias("id"), F.concat(F.lit("Job "), F.col("page_id").cast("string")).alias("text"), F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("hostedUrl"), F.col("url").alias("applyUrl"),
        F.struct(F.when(F.col("page_id") % 2 == 0, "Town").alias("location"), F.array(F.lit("A"), F.lit("B")).alias("allLocations"), F.lit("Team").alias("team")).alias("categories"), F.lit("Remote").alias("workplaceType"),
        (F.col("page_id") * 1000).alias("createdAt"), F.struct(F.col("page_id").alias("minValue"), F.when(F.col("page_id") % 4 > 0, F.lit("7.9")).alias("max")).alias("salaryRange"), F.lit("<p>Hello</p>").alias("description"), F.array(F.struct(F.lit("Must").alias("text"), F.lit("<li>x</li>").alias("content"))).alias("lists"),
    )
    return _documents(_in_files(rows, "id").groupBy("f").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")), t, "board-b")


def _board_c(t):
    job = F.struct(
        F.col("page_id").cast("string").alias("id"), F.concat(F.lit("Job "), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 2 == 0, "Town").alias("location"),
        F.array(F.struct(F.lit("X").alias("location"))).alias("secondaryLocations"), F.when(F.col("page_id") % 5 == 0, False).alias("isListed"), (F.col("page_id") % 3 == 0).alias("isRemote"), F.col("url").alias("jobUrl"), F.lit("plain").alias("descriptionPlain"),
    )
    return _documents(_in_files(t.pages, "page_id").groupBy("f").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("value")), t, "board-c")


_OUT = ["external_id", "title", "location", "department", "work_arrangement", "comp_min", "comp_max"]


@query("s1_board_a", """SELECT CAST(page_id AS VARCHAR) AS external_id, 'Job ' || page_id AS title, 'Town' AS location, 'Dept' AS department, CAST(NULL AS VARCHAR) AS work_arrangement, CASE page_id % 3 WHEN 0 THEN 100000 WHEN 1 THEN page_id * 10 + 1 ELSE page_id * 1000 END AS comp_min,
 CASE page_id % 3 WHEN 0 THEN 150000 WHEN 1 THEN page_id * 20 + 1 ELSE page_id * 1000 END AS comp_max, 'type ' || (page_id % 2) AS employment_type FROM pages""")
def s1(t):
    return boards.read_board_a(t.spark, _board_a(t)).select(*_OUT, "employment_type")


@query("s2_board_b", "SELECT CAST(page_id AS VARCHAR) AS external_id, 'Job ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Town' ELSE 'A, B' END AS location, 'Team' AS department, 'remote' AS work_arrangement, nullif(page_id, 0) AS comp_min, CASE WHEN page_id % 4 > 0 THEN 7 END AS comp_max, 'Hello' || chr(10) || 'Must' || chr(10) || 'x' AS raw_jd FROM pages")
def s2(t):
    return boards.read_board_b(t.spark, _board_b(t)).select(*_OUT, "raw_jd")


@query("s3_board_c", "SELECT CAST(page_id AS VARCHAR) AS external_id, 'Job ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Town' ELSE 'X' END AS location, CAST(NULL AS VARCHAR) AS department, CASE WHEN page_id % 3 = 0 THEN 'remote' END AS work_arrangement, CAST(NULL AS BIGINT) AS comp_min, CAST(NULL AS BIGINT) AS comp_max FROM pages WHERE page_id % 5 <> 0")
def s3(t):
    return boards.read_board_c(t.spark, _board_c(t)).select(*_OUT)


@query("s4_all_postings", "SELECT provider, count(*) AS n FROM (SELECT 'a' AS provider FROM pages UNION ALL SELECT 'b' FROM pages UNION ALL SELECT 'c' FROM pages WHERE page_id % 5 <> 0) GROUP BY provider")
def s4(t):
    return boards.read_postings(t.spark, {"a": _board_a(t), "b": _board_b(t), "c": _board_c(t)}).groupBy("provider").agg(F.count("*").alias("n"))


def _skills(t):
    return t.v_taxonomy.select(F.col("skill_id").alias("id"), "label", F.array("alt", F.concat(F.lit("the, "), "label")).alias("alts"), F.concat("kind", F.lit('\n"quoted"')).alias("description"))


@query("s5_taxonomy_csv", "SELECT skill_id AS id, label, alt || '|the, ' || label AS alts, kind || chr(10) || '\"quoted\"' AS description FROM {v_taxonomy}")
def s5(t):
    path = fresh_path(t.spark, "taxonomy")
    boards.write_taxonomy_csv(_skills(t), path)
    return boards.read_taxonomy_csv(t.spark, path).withColumn("alts", F.array_join("alts", "|"))


@query("s14_taxonomy_cache", "SELECT skill_id AS \"conceptUri\", 'SK' AS \"conceptType\", label AS \"preferredLabel\", alt || ' | the, ' || label AS \"altLabels\", kind || chr(10) || '\"quoted\"' AS description FROM {v_taxonomy}")
def s14(t):
    path = fresh_path(t.spark, "taxonomy")
    boards.write_taxonomy_csv(_skills(t), path)
    return t.spark.read.csv(path, header=True, multiLine=True, escape='"')


@query("s6_split_alt_labels", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'c/d' WHEN 2 THEN 'e; f, g' ELSE 'h/i' END AS alts FROM part")
def s6(t):
    raw = F.element_at(F.array(F.lit(" a | b|"), F.lit("c\n d\n"), F.lit("e; f, g"), F.lit("h;i; ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", F.array_join(boards.split_alt_labels(raw), "/").alias("alts"))


@query("s7_alias_overrides", "SELECT skill_id, label || 'x' AS aliases FROM {v_taxonomy}")
def s7(t):
    one = F.struct(F.col("skill_id").alias("uri"), F.array(F.concat("label", F.lit("x")), F.lit(" ")).alias("aliases"))
    rows = _in_files(t.v_taxonomy, "skill_id").groupBy("f").agg(F.to_json(F.struct(F.collect_list(one).alias("overrides"))).alias("value"))
    return boards.read_alias_overrides(t.spark, _documents(rows, t, "overrides")).select("skill_id", F.array_join("aliases", ",").alias("aliases"))


_CALIBRATION = "(SELECT DISTINCT lower(p_brand) AS w FROM part)"


@query("s10_read_labels", f"""SELECT word AS norm, 'skill:' || word AS skill_id, 'explicit' AS mention FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part)
UNION ALL SELECT {norm('w')}, NULL, 'implicit' FROM {_CALIBRATION} c WHERE {norm('w')} NOT IN (SELECT split_part(p_name, ' ', 1) FROM part)""")
def s10(t):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    span = F.struct(F.concat(F.lit(" "), F.upper(word)).alias("text"), F.concat(F.lit("skill:"), word).alias("skill_id"), F.lit("explicit").alias("mention"))
    items = _in_files(t.part, "p_partkey").groupBy("f").agg(F.collect_list(span).alias("spans")).select(F.struct(F.col("f").cast("string").alias("id"), "spans").alias("i"))
    sets = _documents(items.select(F.to_json(F.struct(F.array("i").alias("items"))).alias("value")), t, "labels")
    # a calibration file with spans of its own, some of them known already
    known = t.part.select(F.lower("p_brand").alias("w")).union(t.part.select(word)).distinct()
    more = known.select(F.struct(F.col("w").alias("text"), F.lit(" ").alias("skill_id"), F.lit("implicit").alias("mention")).alias("s"), "w")
    more = _in_files(more, "w").groupBy("f").agg(F.to_json(F.struct(F.collect_list("s").alias("spans"))).alias("value"))
    return boards.read_labels(t.spark, sets, _documents(more, t, "calibration")).select("norm", "skill_id", "mention")


@query("s10_corpus_labels", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS synthesized_doc, lang AS location, coalesce(quality = 1, false) AS relevant, 5 AS k FROM documents LEFT JOIN labels USING (doc_id)")
def s10_corpus(t):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    job = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("synthesized_doc"), F.col("lang").alias("location"), (F.col("quality") == 1).alias("relevant"))
    docs = _in_files(rows, "doc_id").groupBy("f").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.lit(5).alias("k"), F.collect_list(job).alias("jobs"))).alias("value"))
    return boards.read_label_file(t.spark, _documents(docs, t, "corpus"), "corpus")


@query("s10_pair_labels", "SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, role AS temptation, string_split(coalesce(text, ''), ' ')[1] AS forbidden FROM conversations WHERE role IS NOT NULL")
def s10_pairs(t):
    one = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("temptation"), F.slice(F.split(F.coalesce("text", F.lit("")), " ", -1), 1, 2).alias("forbidden_claims"))
    rows = t.conversations.where("role is not null").withColumn("k", F.struct("conv_id", "turn"))
    docs = _in_files(rows, "k").groupBy("f").agg(F.to_json(F.struct(F.collect_list(one).alias("pairs"))).alias("value"))
    return boards.read_label_file(t.spark, _documents(docs, t, "pairs"), "pairs").select("id", "temptation", F.get("forbidden_claims", F.lit(0)).alias("forbidden"))


@query("s9_read_documents", "SELECT sha256(trim(replace(replace(text, chr(10), ' '), chr(13), ' '))) AS digest FROM pages p JOIN (SELECT page_id AS id, 'page ' || page_id AS text FROM pages) x ON x.id = p.page_id WHERE page_id % 6 > 0")
def s9(t):
    path = fresh_path(t.spark, "files")
    text = F.when(F.col("page_id") % 6 > 0, F.concat(F.lit(" page "), F.col("page_id").cast("string"), F.lit(" "))).otherwise(" ")
    t.pages.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path, lineSep=" ")
    return boards.read_documents(t.spark, path)[0].select(F.sha2("text", 256).alias("digest"))


_SUITES = "(SELECT lang AS name, bool_and(n_chars > 3) AS passed, count(*) AS n, sum(n_chars / 8.0::DOUBLE) AS latency_ms, CAST(sum(n_chars // 4) AS BIGINT) AS prompt_tokens, count(*) * 2 AS completion_tokens, round(count(*) / 1000.0::DOUBLE, 6) AS cost_usd FROM documents GROUP BY lang)"


@query("s15_report_sink", f"""SELECT 'v3' AS set_version, 'hashing' AS embedding_provider, bool_and(passed) OVER () AS all_passed, round(sum(cost_usd) OVER (), 6) AS total_cost, round(sum(latency_ms) OVER (), 3) AS total_latency,
  name, passed, n, round(latency_ms, 3) AS latency_ms, prompt_tokens, completion_tokens, cost_usd FROM {_SUITES} s""")
def s15(t):
    rows = t.documents.groupBy(F.col("lang").alias("name")).agg(
        F.bool_and(F.col("n_chars") > 3).alias("passed"), F.count("*").alias("n"), F.sum(F.col("n_chars") / 8).alias("latency_ms"), F.sum(F.floor(F.col("n_chars") / 4)).alias("prompt_tokens"),
        (F.count("*") * 2).alias("completion_tokens"), (F.count("*") / 1000).alias("cost_usd"),
    )
    path = fresh_path(t.spark, "report")
    boards.write_report(rows, path, "v3", "hashing")
    return boards.read_report(t.spark, path)


_LANDED = f"(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE html END AS raw_jd, page_id % 9 = 0 AS expired, {URL} AS canonical FROM pages)"


@query("t10_posting_stream", f"""WITH l AS (SELECT *, page_id % 3 AS late, sha256(canonical) AS url_hash FROM {_LANDED} l WHERE trim(raw_jd) <> '' AND NOT expired),
e AS (SELECT url_hash, page_id, 0 AS batch, page_id AS seq, 'first' AS title FROM l WHERE late < 2 UNION ALL SELECT url_hash, page_id, 1, page_id, 'again' FROM l WHERE late > 0 UNION ALL SELECT url_hash, page_id, 2, -page_id, 'third' FROM l WHERE page_id % 10 = 0)
SELECT url_hash, arg_max(title, (batch, seq)) AS title, arg_max(page_id, (batch, seq)) AS job_id, CAST(DATE '2024-01-01' + CAST(arg_min(batch * 10 + page_id % 5, (batch, seq)) AS INT) AS VARCHAR) AS ingested_at FROM e GROUP BY url_hash""")
def t10(t):
    rows = t.pages.select("page_id", "url", F.when(F.col("page_id") % 7 == 0, " ").otherwise(F.col("html")).alias("raw_jd"), (F.col("page_id") % 9 == 0).alias("expired"), F.lit(None).cast("string").alias("status"))
    target, check = fresh_path(t.spark, "stream"), fresh_path(t.spark, "progress")
    sent = ((rows.where("page_id % 3 < 2"), "first", F.col("page_id")), (rows.where("page_id % 3 > 0"), "again", F.col("page_id")), (rows.where("page_id % 10 = 0"), "third", -F.col("page_id")))
    source = fresh_path(t.spark, "postings")
    for number, (some, title, seq) in enumerate(sent):  # each delivery brings postings that are new and some that are known
        day = F.date_add(F.lit("2024-01-01").cast("date"), (number * 10 + F.col("page_id") % 5).cast("int"))
        landed = some.withColumns({"title": F.lit(title), "seq": seq, "ingested_at": day.cast("string")})
        landed.write.mode("append").parquet(source)
        for _ in range(2):  # a second run over the same files changes nothing
            streams.stream_postings(t.spark, source, streams.columns_of(landed), target, check)
    table = streams.postings_table(t.spark, target)
    table.compact(2)
    return streams.current_postings(t.spark, target).select("url_hash", "title", F.col("page_id").alias("job_id"), "ingested_at")


@query("t11_live_percolation", f"SELECT u.user_id, count(*) AS pairs FROM {{v_jobs}} j, {{v_users}} u WHERE {ALL_FILTERS} GROUP BY u.user_id")
def t11(t):
    source, schema = streams.landed(t.v_jobs.drop("embedding"), "jobs")
    target = fresh_path(t.spark, "cycles")
    streams.stream_percolate(t.spark, source, schema, t.v_users, target, fresh_path(t.spark, "progress"))
    return matching.counts_of_classes(**streams.percolated(t.spark, target), keys=("cycle",))


_USED = "(SELECT *, CASE WHEN value > 10 THEN k END AS prompt, CASE WHEN value > 10 AND k % 3 > 0 THEN k % 11 END AS completion, CASE WHEN value > 10 THEN CAST(round(value / 1000, 6) AS DECIMAL(20, 6)) END AS usd, CAST(round(value * 7, 3) AS DECIMAL(20, 3)) AS ms FROM {v_events})"


@query("t12_usage_stream", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, stage, action, count(*) AS n, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, round(avg(prompt), 4) AS mean_prompt, CAST(CAST(sum(usd) AS DECIMAL(30, 8)) AS VARCHAR) AS cost,
 round(CAST(sum(usd) AS DOUBLE) / count(usd), 8) AS mean_cost, CAST(min(usd) AS DOUBLE) AS min_cost, CAST(max(usd) AS DOUBLE) AS max_cost, round(CAST(sum(ms) AS DOUBLE) / count(ms), 4) AS mean_latency, CAST(max(ms) AS DOUBLE) AS max_latency FROM {_USED} e GROUP BY 1, 2, 3""")
def t12(t):
    usage = F.struct(
        F.when(F.col("value") > 10, F.col("k")).alias("prompt_tokens"), F.when((F.col("value") > 10) & (F.col("k") % 3 > 0), F.col("k") % 11).alias("completion_tokens"),
        F.when(F.col("value") > 10, F.round(F.col("value") / 1000, 6).cast("decimal(20,6)")).alias("cost_usd"), F.round(F.col("value") * 7, 3).cast("decimal(20,3)").alias("latency_ms"),
    )
    rows = t.v_events.select("event_id", "ts", "stage", "action", F.to_json(usage).alias("details"))
    source, target, check = (fresh_path(t.spark, x) for x in ("events", "usage", "progress"))
    for some in ("event_id % 3 = 2", "event_id % 3 = 0", "event_id % 3 = 1"):  # every delivery has rows of all days
        landed = rows.where(some).drop("event_id")
        landed.write.mode("append").parquet(source)
        streams.stream_usage(t.spark, source, streams.columns_of(landed), target, check)
    out = streams.current_usage(t.spark, target)
    ends = [F.col(c).cast("double").alias(c) for c in ("min_cost", "max_cost", "max_latency")]
    return out.select(F.col("day").cast("string").alias("day"), "stage", "action", "n", *[F.col(c).cast("long").alias(c) for c in ("prompt", "completion")], F.round("mean_prompt", 4).alias("mean_prompt"), F.col("cost").cast("string").alias("cost"),
                      F.round("mean_cost", 8).alias("mean_cost"), *ends, F.round("mean_latency", 4).alias("mean_latency"))
