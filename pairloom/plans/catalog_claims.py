"""Queries of claims: resumes made of one order's roles against the work history of another order of the same customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import claims as op
from pairloom.operators import linking
from pairloom.plans.registry import query
from pairloom.plans.runtime import saved

_ROLES = """(SELECT l_orderkey AS o, 'Firm ' || l_suppkey || CASE l_linenumber % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' ELSE '' END AS employer, 'firm ' || l_suppkey AS key, 'Title ' || l_linenumber AS title,
  strftime(l_shipdate, '%Y-%m') AS start, CASE WHEN l_returnflag <> 'N' THEN strftime(l_shipdate + INTERVAL 40 DAY, '%Y-%m') END AS "end", l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
_NEXT = "(SELECT o_orderkey AS o, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"


def _roles(t, name="roles", more=()):
    firm = F.concat(F.lit("Firm "), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, " Inc.").when(F.col("l_linenumber") % 3 == 1, ", LLC").otherwise(""))
    role = F.struct(
        F.col("l_linenumber").alias("nr"), firm.alias("employer"), F.concat(F.lit("Title "), F.col("l_linenumber").cast("string")).alias("title"), F.date_format("l_shipdate", "yyyy-MM").alias("start"),
        F.when(F.col("l_returnflag") != "N", F.date_format(F.date_add("l_shipdate", 40), "yyyy-MM")).alias("end"), (F.col("l_returnflag") == "N").alias("is_current"),
        F.array(F.concat(F.lit("made part "), F.col("l_partkey").cast("string"))).alias("bullets"),
    )
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(role)).alias(name), *more)


def _pairs(t):
    """doc, roles, next (the roles of the customer's next order, null for the last)."""
    from pyspark.sql import Window as W

    following = t.orders.select(F.col("o_orderkey").alias("doc"), F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    roles = _roles(t)
    return following.join(roles, "doc").join(roles.select(F.col("doc").alias("n"), F.col("roles").alias("next")), "n", "left").drop("n")


@query("k1_unknown_employer", f"""WITH keys AS (SELECT o, list(key) AS ks, min(l_suppkey) AS s FROM {_ROLES} r GROUP BY o)
SELECT x.o AS doc, CASE WHEN b.o IS NOT NULL THEN len(list_filter(b.ks, lambda k: NOT list_contains(a.ks, k))) > 0 ELSE NOT list_contains(a.ks, 'firm ' || (a.s + x.o % 2)) END AS unknown
FROM {_NEXT} x JOIN keys a ON a.o = x.o LEFT JOIN keys b ON b.o = x.n""")
def k1(t):
    some = F.transform("next", lambda r: r["employer"])
    claims = F.transform(F.slice(some, 1, 1), lambda v: F.struct(F.lit("employer").alias("kind"), v.alias("text"), F.lit(None).cast("string").alias("skill_id")))
    low = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.min("l_suppkey").alias("s"))
    text = F.concat(F.lit("Years at home. Worked at Firm-"), (F.col("s") + F.col("doc") % 2).cast("string"), F.lit(" Ltd. for long"))
    employers = F.coalesce(F.slice(some, F.lit(2), F.size("next")), op.none())
    claimed = op.claimed_employers(employers, F.coalesce(claims, F.array().cast("array<struct<kind:string,text:string,skill_id:string>>")), text)
    return _pairs(t).join(low, "doc").select("doc", op.unknown_employer(claimed, F.col("roles")).alias("unknown"))


@query("k3_unknown_dates", f"""SELECT x.o AS doc, (SELECT count(*) FROM (VALUES (1), (2)) v(i) WHERE EXISTS (SELECT 1 FROM {_ROLES} a WHERE a.o = x.n AND (i = 1 OR (a.l_linenumber, a.employer, a.title, a.start, coalesce(a."end", '')) = (SELECT min((c.l_linenumber, c.employer, c.title, c.start, coalesce(c."end", ''))) FROM {_ROLES} c WHERE c.o = x.n))
  AND left(a.start, 4) NOT IN (SELECT left(b.start, 4) FROM {_ROLES} b WHERE b.o = x.o UNION ALL SELECT left(coalesce(b."end", b.start), 4) FROM {_ROLES} b WHERE b.o = x.o))) AS failures FROM {_NEXT} x WHERE x.o IN (SELECT l_orderkey FROM lineitem)""")
def k3(t):
    said = F.coalesce(F.transform("next", lambda r: F.concat(r["start"], F.lit(" – "), F.coalesce(r["end"], F.lit("Present")))), op.none())
    tokens = op.date_tokens(F.col("roles"))
    both = op.let(tokens, lambda known: op.unknown_dates(said, known).cast("long") + op.unknown_dates(F.slice(said, 1, 1), known).cast("long"))
    return _pairs(t).select("doc", both.alias("failures"))


#: temptation -> text, employers, titles, date ranges, skill ids, claims: none of it can stand in a history here (keys are whole numbers, so none is 987654.5)
PLANTS = [
    ("missing_skill", "Invented 987654.5 tools in Rust.", [], [], [], ["skill:rust"], [("skill", "Rust", "skill:rust")]),
    ("adjacent_not_equivalent", "Shipped whole stacks of it.", [], [], [], [], [("skill", "Terraforming; other", "skill:terraforming")]),
    ("year_scope_inflation", "Led 987650.5 people for 150000.5 years.", [], [], ["1801 – 1802"], [], [("date_range", "1803 – 1804", None)]),
    ("seniority_inflation", "Grand architect of the whole.", [], ["Grand Architect"], [], [], [("title", "Grand Architect", None)]),
    ("employer_title_drift", "Grand architect at Globex.", ["Globex Inc"], ["Grand Architect"], [], [], [("employer", "Globex", None)]),
]
_TEMPTED = [p[0] for p in PLANTS] + ["none"]


def _resumes(t):
    """One resume per order, made of its own roles and the name of its part with the smallest key; one in seven lacks a skill it names."""
    words = F.split("p_name", " ")
    rows = _roles(t, more=[F.min("l_partkey").alias("p_partkey")]).join(t.part.select("p_partkey", "p_name"), "p_partkey").where(F.size(words) > 1)
    lines = F.transform("roles", lambda r: F.concat(r["title"], F.lit(" with "), r["employer"], F.lit("\n- "), r["bullets"][0]))
    skills = F.transform(words, lambda w: F.concat(F.lit("skill:"), w))
    return rows.select(
        "doc", "roles", F.concat(F.array_join(lines, "\n"), F.lit("\nuses "), F.get(words, F.lit(0)), F.lit(" and "), F.get(words, F.lit(1))).alias("text"),
        F.transform("roles", lambda r: r["employer"]).alias("employers"), F.transform("roles", lambda r: r["title"]).alias("titles"),
        F.transform("roles", lambda r: F.concat(r["start"], F.lit(" to "), F.coalesce(r["end"], F.lit("now")))).alias("date_ranges"), op.none().alias("listed"),
        F.array().cast("array<struct<kind:string,text:string,skill_id:string>>").alias("claims"), F.when(F.col("doc") % 7 == 0, F.slice(skills, 1, 1)).otherwise(skills).alias("user_skills"),
        F.array(F.lit("Grand-Architect of"), F.lit(" ")).alias("forbidden"), F.element_at(F.array(*map(F.lit, _TEMPTED)), (F.col("doc") % 6 + 1).cast("int")).alias("temptation"),
    )


def _checked(t):
    kind = "temptation string, p_text string, p_employers array<string>, p_titles array<string>, p_date_ranges array<string>, p_listed array<string>, p_claims array<struct<kind:string,text:string,skill_id:string>>"
    planted = saved(op.plant(_resumes(t), t.spark.createDataFrame(PLANTS, kind)), "resumes")  # read by the scan, for the spans and for the checks
    terms = t.v_taxonomy.select("skill_id", F.col("label").alias("term"))
    index = linking.alias_index(t.v_taxonomy.select("skill_id", "ord", F.array("label").alias("labels")))
    return op.failures(op.claimed_skills(planted, "doc", terms, index))


_WORDS = "(SELECT l_orderkey AS doc, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY l_orderkey) JOIN part ON p_partkey = k)"
_FOUND = f"""(SELECT doc, (['missing_skill', 'adjacent_not_equivalent', 'year_scope_inflation', 'seniority_inflation', 'employer_title_drift', 'none'])[doc % 6 + 1] AS temptation,
  list_concat(list_concat((['', '', 'unknown_date_range,unknown_date_range,fabricated_number', 'unknown_title', 'unknown_employer,unknown_title', ''])[doc % 6 + 1:doc % 6 + 1], CASE WHEN doc % 6 = 0 THEN ['fabricated_number'] ELSE [] END),
  list_concat(CASE WHEN doc % 6 < 2 OR (doc % 7 = 0 AND a <> b) THEN ['out_of_set_skill'] ELSE [] END, CASE WHEN doc % 6 IN (3) THEN ['forbidden_phrase'] ELSE [] END)) AS codes FROM {_WORDS} w WHERE b <> '')"""
_NAMED = f"(SELECT doc, temptation, list_filter(string_split(array_to_string(codes, ','), ','), lambda c: c <> '') AS codes FROM {_FOUND} f)"


@query("k8_planted_claims", f"SELECT doc, temptation, array_to_string(codes, ',') AS codes, temptation = 'none' OR len(codes) > 0 AS caught FROM {_NAMED} n")
def k8(t):
    return _checked(t).select("doc", "temptation", F.array_join("codes", ",").alias("codes"), ((F.col("temptation") == "none") | (F.size("codes") > 0)).alias("caught"))


@query("e10_fabrication_suite", f"SELECT temptation, count(*) AS pairs, count(*) FILTER (WHERE len(codes) > 0) AS hit, CAST(sum(len(codes)) AS BIGINT) AS claims, sum(len(codes)) = 0 AS passed FROM {_NAMED} n GROUP BY temptation")
def e10(t):
    return op.suite(_checked(t), "temptation")
