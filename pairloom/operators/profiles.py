"""Profiles and documents: roles, span ids, compact texts, section lists, greedy matching, plug-in points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import text as X
from pairloom.plans.runtime import ship

MOST_CHARS = 2000  # 500 estimated tokens
TEXTS = 128  # that a model gets at once


def job_doc(title: Column, seniority: Column, skills: Column, reqs: Column, low: Column, high: Column, most: int = MOST_CHARS) -> Column:
    """Lines for title, seniority, skills, hard requirements and compensation within ``most`` characters: requirements go
    from the end, then skills, then only the header is kept, then it is cut."""

    def named(name: str, value: Column) -> Column:
        return F.when(F.trim(value) != "", F.concat(F.lit(f"{name}: "), F.trim(value)))

    comp = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("Compensation: "), low.cast("string"), F.lit("-"), high.cast("string"))).when(
        low.isNotNull(), F.concat(F.lit("Compensation: "), low.cast("string"), F.lit("+"))).when(high.isNotNull(), F.concat(F.lit("Compensation: up to "), high.cast("string")))
    none = F.array().cast("array<string>")

    def clean(values: Column) -> Column:
        return F.filter(F.transform(F.coalesce(values, none), lambda v: F.trim(v)), lambda v: v != "")

    def render(s: Column, r: Column) -> Column:
        lines = F.array(named("Title", title), named("Seniority", seniority), F.when(F.size(s) > 0, F.concat(F.lit("Skills: "), F.array_join(s, "; "))),
                        F.when(F.size(r) > 0, F.concat(F.lit("Hard requirements: "), F.array_join(r, "; "))), comp)
        return F.array_join(F.array_compact(lines), "\n")

    s, r = clean(skills), clean(reqs)
    fewer_r = F.filter(F.transform(F.sequence(F.size(r), F.lit(0)), lambda n: render(s, F.slice(r, F.lit(1), n))), lambda d: F.length(d) <= most)
    fewer_s = F.filter(F.transform(F.sequence(F.size(s), F.lit(0)), lambda n: render(F.slice(s, F.lit(1), n), none)), lambda d: F.length(d) <= most)
    return F.coalesce(F.get(fewer_r, F.lit(0)), F.get(fewer_s, F.lit(0)), F.substring(render(none, none), 1, most))


def assign_span_ids(roles: Column) -> Column:
    """Roles by start, employer, title (nulls as ""), bullets with ids wh:{role}:b:{bullet}; blank bullets go but use up a number.

    ``roles``: array of struct (start, employer, title, is_current, bullets array of string)."""
    keyed = F.transform(roles, lambda r: F.struct(F.coalesce(r["start"], F.lit("")).alias("a"), F.lower(r["employer"]).alias("b"), F.lower(r["title"]).alias("c"), r.alias("r")))

    def numbered(k: Column, i: Column) -> Column:
        bullets = F.transform(k["r"]["bullets"], lambda t, j: F.struct(F.concat(F.lit("wh:"), i.cast("string"), F.lit(":b:"), j.cast("string")).alias("span_id"), F.trim(t).alias("text")))
        return F.struct(k["r"]["employer"].alias("employer"), k["r"]["title"].alias("title"), k["r"]["start"].alias("start"), k["r"]["is_current"].alias("is_current"),
                        F.filter(bullets, lambda b: b["text"] != "").alias("bullets"))

    return F.transform(F.array_sort(keyed), numbered)


def latest_role(roles: Column) -> Column:
    """The last current role, else the one with the largest start (of equal ones the first)."""
    now = F.filter(roles, lambda r: r["is_current"])
    start = F.array_max(F.transform(roles, lambda r: F.coalesce(r["start"], F.lit(""))))
    best = F.filter(roles, lambda r: F.coalesce(r["start"], F.lit("")) == start)
    return F.when(F.size(now) > 0, F.get(now, F.size(now) - 1)).otherwise(F.get(best, F.lit(0)))


# Headings of requirement lists, bullets.
SECTION = r"(?i)^(must have|must-haves|required|requirements|nice to have|nice-to-haves|preferred|bonus)\s*:?\s*$"
BULLET = r"^[-*•]\s+(.+)$"


def requirement_lists(text: Column) -> Column:
    """Struct (hard, nice): bullets under requirement headings; other text ends a list, blank lines don't."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("mode"), none.alias("hard"), none.alias("nice"))

    def step(acc: Column, line: Column) -> Column:
        v = F.trim(line)
        head = F.lower(F.regexp_extract(v, SECTION, 1))
        bullet = F.trim(F.regexp_extract(v, BULLET, 1))
        mode = F.when(head != "", F.when(head.startswith("nice") | head.isin("preferred", "bonus"), "nice").otherwise("hard")).when((v == "") | (bullet != ""), acc["mode"]).otherwise("")
        add = (head == "") & (bullet != "")
        hard = F.when(add & (acc["mode"] == "hard"), F.array_append(acc["hard"], bullet)).otherwise(acc["hard"])
        nice = F.when(add & (acc["mode"] == "nice"), F.array_append(acc["nice"], bullet)).otherwise(acc["nice"])
        return F.struct(mode.alias("mode"), hard.alias("hard"), nice.alias("nice"))

    done = F.aggregate(F.split(text, "\n", -1), start, step)
    return F.struct(done["hard"].alias("hard"), done["nice"].alias("nice"))


def greedy_match(items: DataFrame, threshold: float) -> DataFrame:
    """item, tp, fp, fn: predictions in order take the best unused gold text (token Jaccard at least ``threshold``; of equal ones
    the later). items: item, pred, gold (arrays of normalised strings)."""
    ship(items.sparkSession)

    def one(pred, gold) -> tuple[int, int, int]:
        texts, holders, used, hit = [set(g.split()) for g in gold], {}, set(), 0
        for place, g in enumerate(texts):
            for token in g or {""}:
                holders.setdefault(token, []).append(place)
        for p in pred:
            a, shared, best, score = set(p.split()), {}, None, threshold
            for token in a or {""}:
                for place in holders.get(token, ()):
                    shared[place] = shared.get(place, 0) + 1
            for place in sorted(shared if threshold > 0 else range(len(gold))):
                if place in used:
                    continue
                b = texts[place]
                s = (shared.get(place, 0) if a and b else 0) / len(a | b) if a | b else 1.0
                if s >= score:
                    best, score = place, s
            if best is not None:
                used.add(best)
                hit += 1
        return hit, len(pred) - hit, len(gold) - len(used)

    def run(batches):
        for pdf in batches:
            done = [one(p, g) for p, g in zip(pdf["pred"], pdf["gold"], strict=True)]
            yield pd.DataFrame({"item": pdf["item"], "tp": [d[0] for d in done], "fp": [d[1] for d in done], "fn": [d[2] for d in done]})

    return items.select("item", "pred", "gold").mapInPandas(run, f"item {dict(items.dtypes)['item']}, tp long, fp long, fn long")


def embed(rows: DataFrame, key: str, col: str, model, dim: int, most_chars: int = 8000) -> DataFrame:
    """Plug-in: ``model(list of texts) -> list of vectors`` for up to ``TEXTS`` texts at once; dimensions are checked, over-long texts flagged."""
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                texts = [v or "" for v in some.column(1).to_pylist()]
                vectors = [list(map(float, v)) for v in model(texts)]
                if any(len(v) != dim for v in vectors):
                    raise ValueError(f"the model's vectors don't have {dim} dimensions")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array([len(v) > most_chars for v in texts])], names=["key", "embedding", "too_long"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(col).alias("text")).mapInArrow(run, f"key {kind}, embedding array<double>, too_long boolean").withColumnRenamed("key", key)


def extract(rows: DataFrame, key: str, col: str, model, schema: T.StructType) -> DataFrame:
    """Plug-in: ``model(text) -> dict``; fields of ``schema`` are kept, and a failure or a wrong type becomes ``error``, never a guess."""
    ship(rows.sparkSession)
    names = [f.name for f in schema]

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf["key"], pdf["text"], strict=True):
                try:
                    got = model(text)
                    if not isinstance(got, dict):
                        raise TypeError("not a record")
                    out.append((k, *(got.get(n) for n in names), None))
                except Exception as e:  # malformed output is quarantined
                    out.append((k, *(None for _ in names), type(e).__name__))
            yield pd.DataFrame(out, columns=["key", *names, "error"])

    kind = T.StructType([T.StructField("key", rows.schema[key].dataType), *schema, T.StructField("error", T.StringType())])
    return rows.select(F.col(key).alias("key"), F.col(col).alias("text")).mapInPandas(run, kind).withColumnRenamed("key", key)


def date_in_source(claim: Column, tokens: Column) -> Column:
    """The normalised claim, its first year, or all its parts stand among the source's tokens (parts split at dashes and at t and o)."""
    text = X.normalize_label(claim)
    # Pattern of a year, separators of a range.
    year = F.regexp_extract(claim, r"\b((?:19|20)\d{2})\b", 1)
    parts = F.filter(F.split(text, r"\s*[–—\-to]+\s*", -1), lambda v: v != "")
    return F.array_contains(tokens, text) | ((year != "") & F.array_contains(tokens, year)) | F.forall(parts, lambda v: F.array_contains(tokens, v))


def profile_doc(profiles: DataFrame, most_chars: int = 4 * 2048) -> DataFrame:
    """user_id, doc: header, then roles oldest first, within ``most_chars``: bullets of the oldest role go from the end, then
    the role, and the newest role's heading stays. profiles: user_id, header, roles (array of heading, bullets), oldest first.

    Every line costs its length and a line end; lines are dropped in one fixed order, so those kept are a suffix of it. Where all fit, none is looked at twice.
    """
    n = F.size("roles")

    def lines(r: Column, i: Column) -> Column:
        heading = F.struct(i.alias("i"), F.lit(-1).alias("j"), r["heading"].alias("line"))
        return F.concat(F.array(heading), F.transform(r["bullets"], lambda b, j: F.struct(i.alias("i"), j.alias("j"), F.concat(F.lit("- "), b).alias("line"))))

    every = F.flatten(F.transform("roles", lines))
    room = F.lit(most_chars) - F.length("header") - F.length(F.lit("\n\nExperience:\n\n"))
    # newest role first, within a role the heading, then bullets in order: keep while the running length fits
    ranked = F.array_sort(F.transform(every, lambda v: F.struct((-v["i"]).alias("a"), v["j"].alias("j"), v["i"].alias("i"), v["line"].alias("line"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.array().cast("array<struct<i:int,j:int,line:string>>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        used = acc["used"] + F.length(v["line"]) + 1
        first = (v["i"] == n - 1) & (v["j"] == -1)
        ok = first | (acc["open"] & (used <= room))
        out = F.concat(acc["out"], F.array(F.struct(v["i"].alias("i"), v["j"].alias("j"), v["line"].alias("line"))))
        return F.struct(F.when(ok, used).otherwise(acc["used"]).cast("long").alias("used"), ok.alias("open"), F.when(ok, out).otherwise(acc["out"]).alias("out"))

    kept = F.array_sort(F.aggregate(ranked, start, step)["out"])
    every_line = F.flatten(F.transform("roles", lambda r: F.concat(F.array(r["heading"]), F.transform(r["bullets"], lambda b: F.concat(F.lit("- "), b)))))
    rows = profiles.select("user_id", "header", "roles", every_line.alias("plain")).withColumn("whole", F.array_join("plain", "\n"))
    fits = (F.size("plain") > 0) & ~F.exists("plain", lambda v: v.isNull()) & (F.length("whole") + 1 <= room)
    body = F.when(fits, F.col("whole")).otherwise(F.array_join(F.transform(kept, lambda v: v["line"]), "\n"))
    return rows.select("user_id", F.concat("header", F.lit("\n\nExperience:\n"), body, F.lit("\n")).alias("doc"))


def flatten_history(roles: Column) -> Column:
    """One text of a work history: employer, title and bullet texts of each role. roles as made by assign_span_ids."""
    return F.array_join(F.transform(roles, lambda r: F.concat_ws("\n", r["employer"], r["title"], F.array_join(F.transform(r["bullets"], lambda b: b["text"]), "\n"))), "\n")


def generation_context(roles: Column, matched: Column, adjacent: Column, missing: Column, job: Column, violations: Column | None = None) -> Column:
    """The context of a generated document: history with span ids, the three skill lists, the job and, on a retry, the named
    violations of the try before (null or empty: none)."""

    def block(r: Column) -> Column:
        return F.concat_ws("\n", F.concat(r["title"], F.lit(" at "), r["employer"]), F.array_join(F.transform(r["bullets"], lambda b: F.concat(F.lit("["), b["span_id"], F.lit("] "), b["text"])), "\n"))

    lists = [F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")) for name, c in (("Matched", matched), ("Adjacent", adjacent), ("Missing", missing))]
    base = F.concat_ws("\n", F.array_join(F.transform(roles, block), "\n"), *lists, F.concat(F.lit("Job: "), job))
    if violations is None:
        return base
    asked = F.concat(base, F.lit("\nFix only these failures, and add no new facts:\n"), F.array_join(F.transform(violations, lambda v: F.concat(F.lit("- "), v)), "\n"))
    return F.when(F.coalesce(F.size(violations) > 0, F.lit(False)), asked).otherwise(base)


def prepare_history(bullets: Column, source: Column) -> Column:
    """Edited bullets get ids by place; a missing source is the user's own word."""
    return F.struct(F.coalesce(source, F.lit("user_asserted")).alias("source"), F.transform(bullets, lambda b, j: F.struct(F.concat(F.lit("wh:0:b:"), j.cast("string")).alias("span_id"), b.alias("text"))).alias("bullets"))


# Section headings, role headings and date ranges of resumes.
RESUME_SECTION = r"(?i)^(?:#{1,3}\s*)?(experience|work history|employment|skills|education|summary|about)\s*:?\s*$"
ROLE_HEAD = r"(?i)^(?:#{1,4}\s*|\*\*)?(.+?)\s+(?:—|--|-|at|,)\s+(.+?)(?:\*\*)?\s*$"
DATES = (
    r"(?i)((?:[A-Za-z]{3,9}\.?\s+)?\d{4}(?:\s*[-/]\s*\d{1,2})?|\d{4}[-/]\d{1,2}|\d{1,2}[-/]\d{4})\s*[–—\-to]+\s*"
    r"(present|current|now|today|(?:[A-Za-z]{3,9}\.?\s+)?\d{4}(?:\s*[-/]\s*\d{1,2})?|\d{4}[-/]\d{1,2}|\d{1,2}[-/]\d{4})"
)


def _resume_lines(docs: DataFrame, key: str, col: str) -> DataFrame:
    """key, k, line, section ("header" before the first heading, "experience" from the first role heading there), head (role heading)."""
    from pyspark.sql import Window as W

    lines = docs.select(key, F.posexplode_outer(F.split(col, "\r\n|[\n\r]", -1)).alias("k", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    w = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    named = F.lower(F.regexp_extract("line", RESUME_SECTION, 1))
    lines = lines.withColumns({"named": named, "head": F.regexp_replace("line", r"^#{1,4}\s*", "")}).withColumn("said", F.last(F.nullif("named", F.lit("")), ignorenulls=True).over(w))
    opened = F.max(F.col("said").isNull() & F.col("head").rlike(ROLE_HEAD)).over(w)
    section = F.when(F.col("said").isNull(), F.when(opened, "experience").otherwise("header")).otherwise(F.col("said"))
    return lines.withColumn("section", section).where("named = ''").select(key, "k", "line", "head", "section")


def segment_resume(docs: DataFrame, key: str, col: str) -> DataFrame:
    """Roles of line text: key, role (running number), title, employer, start, end, bullets.

    Headings carry forward. Outside header, summary, skills and education, a line that reads "title - employer" opens a role, the
    first other line of the role with a date range gives its months, and bullets belong to it. Windows run within one document.
    """
    from pyspark.sql import Window as W

    inside = _resume_lines(docs, key, col).where(~F.col("section").isin("header", "summary", "skills", "education"))
    w = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("opens", F.col("head").rlike(ROLE_HEAD)).withColumn("role", F.sum(F.col("opens").cast("int")).over(w)).where("role > 0")
    dated = ~F.col("opens") & F.col("line").rlike(DATES)
    first = F.min(F.when(dated, F.col("k"))).over(W.partitionBy(key, "role"))
    rows = inside.withColumn("dates", F.coalesce(dated & (F.col("k") == first), F.lit(False)))
    bullet = ~F.col("opens") & ~F.col("dates") & F.col("line").rlike(BULLET)
    out = rows.groupBy(key, "role").agg(
        F.min(F.when(F.col("opens"), F.col("head"))).alias("head"), F.min(F.when(F.col("dates"), F.col("line"))).alias("dates"),
        F.array_sort(F.collect_list(F.when(bullet, F.struct("k", F.trim(F.regexp_extract("line", BULLET, 1)).alias("v"))))).alias("b"),
    )
    names = [F.btrim(F.regexp_extract("head", ROLE_HEAD, k), F.lit(" *")).alias(c) for k, c in ((1, "title"), (2, "employer"))]
    return out.select(key, "role", *names, *[X.norm_month(F.regexp_extract("dates", DATES, k)).alias(c) for k, c in ((1, "start"), (2, "end"))], F.transform("b", lambda v: v["v"]).alias("bullets"))


def resume_skills(docs: DataFrame, key: str, col: str, terms: DataFrame) -> DataFrame:
    """key, spans: parts of the lines under "skills" (at commas, semicolons, slashes and bars), in order; a resume without any gets
    the terms that a scan finds in its text, by length, then name. terms: skill_id, term."""
    from pairloom.operators import linking

    lines = _resume_lines(docs, key, col).where("section = 'skills'")
    parts = F.filter(F.transform(F.split("line", r"[,;/|]", -1), lambda v: F.trim(v)), lambda v: v != "")
    listed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", parts.alias("v")))).alias("s")).select(key, F.flatten(F.transform("s", lambda v: v["v"])).alias("listed"))
    both = docs.select(key, col).join(listed.where(F.size("listed") > 0), key, "left")
    found = linking.scan_terms(both.where("listed is null"), key, col, terms).groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.length("term").alias("n"), "term"))).alias("f"))
    scanned = F.coalesce(F.transform("f", lambda v: v["term"]), F.array().cast("array<string>"))
    return both.join(found, key, "left").select(key, F.coalesce("listed", scanned).alias("spans"))
