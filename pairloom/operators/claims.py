"""Claims of generated texts against the facts of a work history: named failures per document, planted claims, suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.operators import profiles

# Fixed value: endings of company names that don't tell companies apart.
CORPORATE = r"(?i)\b(incorporated|corporation|company|inc|llc|ltd|corp|co)\.?$"
# Fixed value: a name after "at" or "@" in running text.
AT_NAME = r"(?U)\b(?:at|@)\s+([A-Z][\w&.\-]+(?:\s+[A-Z][\w&.\-]+){0,4})"

def none() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: an expression that a lambda names is evaluated anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


CODES = ("unknown_employer", "unknown_title", "unknown_date_range", "unknown_date_range", "fabricated_number", "out_of_set_skill", "forbidden_phrase")


def employer_key(name: Column) -> Column:
    return F.btrim(F.regexp_replace(X.normalize_label(name), CORPORATE, ""), F.lit(" .,"))


def _of(claims: Column, kind: str) -> Column:
    return F.transform(F.filter(claims, lambda c: (c["kind"] == kind) & (F.coalesce(c["text"], F.lit("")) != "")), lambda c: c["text"])


def claimed_employers(employers: Column, claims: Column, text: Column) -> Column:
    """Employers of the claim map, or, without any, names that follow "at" or "@" in the text."""
    listed = F.concat(F.coalesce(employers, none()), _of(claims, "employer"))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AT_NAME), F.lit(1)), lambda v: F.btrim(v, F.lit(" .,;:")))
    return F.when(F.size(listed) > 0, listed).otherwise(F.filter(found, lambda v: v != ""))


def unknown_employer(claimed: Column, roles: Column) -> Column:
    known = F.transform(F.filter(roles, lambda r: F.coalesce(r["employer"], F.lit("")) != ""), lambda r: employer_key(r["employer"]))
    return let(known, lambda names: F.exists(claimed, lambda v: ~F.array_contains(names, employer_key(v))))


def unknown_title(titles: Column, claims: Column, roles: Column) -> Column:
    known = F.transform(F.filter(roles, lambda r: F.coalesce(r["title"], F.lit("")) != ""), lambda r: X.normalize_label(r["title"]))
    return let(known, lambda names: F.exists(F.concat(F.coalesce(titles, none()), _of(claims, "title")), lambda v: ~F.array_contains(names, X.normalize_label(v))))


def date_tokens(roles: Column) -> Column:
    """What a work history says of dates: starts, ends, their years, "present" for open ends, and whole ranges in three spellings."""

    def one(r: Column) -> Column:
        return let(F.struct(F.trim(F.coalesce(r["start"], F.lit(""))).alias("start"), F.trim(F.coalesce(r["end"], F.lit(""))).alias("end"), F.coalesce(r["is_current"], F.lit(False)).alias("now")), said)

    def said(r: Column) -> Column:
        start, end_raw = r["start"], r["end"]
        open_ = r["now"] | (end_raw == "")
        end = F.when(open_, F.lit("present")).otherwise(end_raw)
        parts = F.array(start, end_raw, end)
        years = F.transform(parts, lambda v: F.regexp_extract(v, r"\b((?:19|20)\d{2})\b", 1))
        ranges = F.array(*[F.concat(start, F.lit(s), end) for s in (" – ", "-", " to ")])
        return F.concat(F.transform(F.concat(parts, ranges), X.normalize_label), years, F.when(open_, F.array(F.lit("present"), F.lit("current"), F.lit("now"))).otherwise(none()))

    return F.array_distinct(F.filter(F.flatten(F.transform(roles, one)), lambda v: v != ""))


def unknown_dates(ranges: Column, tokens: Column) -> Column:
    return let(tokens, lambda known: F.exists(F.coalesce(ranges, none()), lambda v: ~profiles.date_in_source(v, known)))


def failures(rows: DataFrame) -> DataFrame:
    """Adds codes: the named failures of each row, in the order of the checks.

    rows: text, roles (array of employer, title, start, end, is_current, bullets), employers, titles, date_ranges, claims (array of
    kind, text, skill_id), skill_ids (all skills the text claims: map, claims and scan), user_skills, forbidden (phrases).
    """
    history = F.array_join(F.transform("roles", lambda r: F.concat_ws("\n", r["employer"], r["title"], r["start"], r["end"], F.array_join(F.coalesce(r["bullets"], none()), "\n"))), "\n")
    norm = F.concat(F.lit(" "), X.normalize_label(F.coalesce("text", F.lit(""))), F.lit(" "))
    phrases = F.filter(F.transform(F.coalesce("forbidden", none()), X.normalize_label), lambda v: v != "")
    rows = rows.withColumn("dates_", let(date_tokens(F.col("roles")), lambda known: F.struct(unknown_dates(F.col("date_ranges"), known).alias("listed"), unknown_dates(_of(F.col("claims"), "date_range"), known).alias("claimed"))))
    dates = F.col("dates_")
    checks = (
        unknown_employer(claimed_employers(F.col("employers"), F.col("claims"), F.col("text")), F.col("roles")), unknown_title(F.col("titles"), F.col("claims"), F.col("roles")),
        dates["listed"], dates["claimed"],
        F.size(F.array_except(X.numbers(F.coalesce("text", F.lit(""))), X.numbers(history))) > 0,
        F.size(F.array_except(F.coalesce("skill_ids", none()), F.coalesce("user_skills", none()))) > 0, let(norm, lambda text: F.exists(phrases, lambda v: F.contains(text, v))),
    )
    return rows.withColumn("codes", F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in zip(checks, CODES, strict=True)]))).drop("dates_")


def claimed_skills(rows: DataFrame, key: str, terms: DataFrame, index: DataFrame) -> DataFrame:
    """Adds skill_ids to rows (key, text, listed, claims): listed ids, ids of claims, skills that skill claims link to, terms found in the text."""
    from pairloom.operators import linking

    found = linking.scan_terms(rows, key, "text", terms).select(key, "skill_id")
    spans = rows.select(key, F.explode_outer(_of(F.col("claims"), "skill")).alias("span")).where("span is not null")
    linked = linking.link_exact(linking.expand_spans(spans.withColumn("id", F.struct(key, "span")), "id", "span"), index).where("skill_id is not null")
    more = found.unionByName(linked.select(F.col(f"id.{key}").alias(key), "skill_id")).groupBy(key).agg(F.collect_set("skill_id").alias("more"))
    own = F.array_compact(F.transform(F.coalesce("claims", F.array().cast("array<struct<kind:string,text:string,skill_id:string>>")), lambda c: c["skill_id"]))
    out = rows.join(more, key, "left")
    return out.withColumn("skill_ids", F.array_distinct(F.concat(F.coalesce("listed", none()), own, F.coalesce("more", none())))).drop("more", "listed")


def plant(rows: DataFrame, plants: DataFrame) -> DataFrame:
    """Rows with the claims of their temptation added; a row without one stays. plants: temptation, p_text, p_employers, p_titles,
    p_date_ranges, p_listed, p_claims (a small fixed table)."""
    out = rows.join(F.broadcast(plants), "temptation", "left")
    lists = {c: F.concat(F.coalesce(c, none()), F.coalesce(f"p_{c}", none())) for c in ("employers", "titles", "date_ranges", "listed")}
    out = out.withColumns(lists | {"text": F.concat_ws("\n\n", F.rtrim("text"), "p_text"), "claims": F.when(F.col("p_claims").isNull(), F.col("claims")).otherwise(F.concat("claims", "p_claims"))})
    return out.drop(*[f"p_{c}" for c in ("text", "employers", "titles", "date_ranges", "listed", "claims")])


def suite(checked: DataFrame, by: str) -> DataFrame:
    """Per group: documents, documents with failures, failures, and whether there is none."""
    out = checked.groupBy(by).agg(F.count("*").alias("pairs"), F.count(F.when(F.size("codes") > 0, 1)).alias("hit"), F.sum(F.size("codes")).cast("long").alias("claims"))
    return out.withColumn("passed", F.col("claims") == 0)
