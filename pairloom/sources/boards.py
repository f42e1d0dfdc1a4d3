"""Posting boards as nested JSON, taxonomies as CSV, whole documents and label sets; all into declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as X

_A = "jobs array<struct<id:long,absolute_url:string,title:string,location:string,departments:array<struct<name:string>>,metadata:array<struct<name:string,value:variant>>,first_published:string,updated_at:string,content:string>>"
_B = "id string, text string, hostedUrl string, applyUrl string, categories struct<location:string,allLocations:array<string>,department:string,team:string,commitment:string>, workplaceType string, createdAt long, salaryRange variant, salary variant, description string, descriptionPlain string, lists array<struct<text:string,content:string>>"
_C = "jobs array<struct<id:string,title:string,department:string,team:string,employmentType:string,location:string,secondaryLocations:array<struct<location:string>>,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string>>"
POSTING = ("url", "title", "location", "department", "employment_type", "work_arrangement", "comp_min", "comp_max", "raw_jd", "raw_jd_html", "posted_at", "external_id")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _posting(df: DataFrame, **cols: Column) -> DataFrame:
    out = df.select(*[cols[c].alias(c) for c in POSTING])
    return out.where(F.col("url").isNotNull() & F.col("title").isNotNull())


def _meta(pattern: str) -> Column:
    """The value of the first metadata entry whose name holds the pattern."""
    return F.get(F.filter("j.metadata", lambda m: F.lower(m["name"]).rlike(pattern) & m["value"].isNotNull() & ~F.is_variant_null(m["value"])), F.lit(0))["value"]


def _meta_text(pattern: str) -> Column:
    return F.try_variant_get(_meta(pattern), "$", "string")


def read_board_a(spark: SparkSession, paths) -> DataFrame:
    """{jobs: [...]}: location as text or {name}, the first department, metadata for type, arrangement and comp."""
    j = spark.read.schema(_A).json(paths, multiLine=True).select(F.explode_outer("jobs").alias("j")).where("j is not null")
    place = F.coalesce(F.get_json_object("j.location", "$.name"), F.when(~F.startswith(F.col("j.location"), F.lit("{")), F.col("j.location")))
    comp = X.comp_of(_meta("comp|salary|pay"))
    return _posting(
        j, url=_blank(F.col("j.absolute_url")), title=_blank(F.col("j.title")), location=_blank(place), department=F.get("j.departments", F.lit(0))["name"],
        employment_type=_meta_text("employment"), work_arrangement=_meta_text("arrangement|workplace|remote"), comp_min=comp["low"], comp_max=comp["high"],
        raw_jd=X.clean_html(F.col("j.content")), raw_jd_html=F.col("j.content"), posted_at=F.coalesce(X.parse_ts(F.col("j.first_published")), X.parse_ts(F.col("j.updated_at"))), external_id=F.col("j.id").cast("string"),
    )


def read_board_b(spark: SparkSession, paths) -> DataFrame:
    """A list of postings: places fall back to all of them joined, the text is the description and every list's heading and items."""
    j = spark.read.schema(_B).json(paths, multiLine=True)
    c = F.col("categories")
    place = F.coalesce(_blank(c["location"]), _blank(F.array_join(c["allLocations"], ", ")))
    lists = F.transform(F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>")), lambda v: F.concat_ws("\n", v["text"], v["content"]))
    pay = F.when(F.col("salaryRange").isNotNull() & ~F.is_variant_null("salaryRange") & (F.schema_of_variant("salaryRange") != "OBJECT<>"), F.col("salaryRange")).otherwise(F.col("salary"))
    comp = X.comp_of(pay)
    html = F.array_join(F.concat(F.array(F.coalesce("description", "descriptionPlain", F.lit(""))), lists), "\n\n")
    return _posting(
        j, url=F.coalesce(_blank(F.col("hostedUrl")), _blank(F.col("applyUrl"))), title=_blank(F.col("text")), location=place, department=F.coalesce(c["department"], c["team"]),
        employment_type=c["commitment"], work_arrangement=F.lower("workplaceType"), comp_min=comp["low"], comp_max=comp["high"],
        raw_jd=X.clean_html(html), raw_jd_html=html, posted_at=F.timestamp_millis("createdAt"), external_id=F.col("id"),
    )


def read_board_c(spark: SparkSession, paths) -> DataFrame:
    """{jobs: [...]} without the unlisted; arrangement in lower case, else remote if so flagged."""
    j = spark.read.schema(_C).json(paths, multiLine=True).select(F.explode_outer("jobs").alias("j")).where("j is not null").where(~F.col("j.isListed").eqNullSafe(F.lit(False)))
    none = F.lit(None).cast("long")
    return _posting(
        j, url=F.coalesce(_blank(F.col("j.jobUrl")), _blank(F.col("j.applyUrl"))), title=_blank(F.col("j.title")),
        location=F.coalesce(_blank(F.col("j.location")), _blank(F.array_join(F.transform("j.secondaryLocations", lambda v: v["location"]), ", "))),
        department=F.coalesce("j.department", "j.team"), employment_type=F.col("j.employmentType"),
        work_arrangement=F.coalesce(F.lower("j.workplaceType"), F.when(F.col("j.isRemote"), "remote")), comp_min=none, comp_max=none,
        raw_jd=F.coalesce(_blank(F.col("j.descriptionPlain")), X.clean_html(F.col("j.descriptionHtml"))), raw_jd_html=F.col("j.descriptionHtml"), posted_at=X.parse_ts(F.col("j.publishedAt")), external_id=F.col("j.id"),
    )


READERS = {"a": read_board_a, "b": read_board_b, "c": read_board_c}


def read_postings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All providers' postings with their provider; an unknown provider is an error."""
    if unknown := set(paths) - set(READERS):
        raise ValueError(f"unknown provider: {', '.join(sorted(unknown))}")
    out = None
    for provider, path in sorted(paths.items()):
        one = READERS[provider](spark, path).withColumn("provider", F.lit(provider))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def split_alt_labels(text: Column) -> Column:
    """Parts at bars, else at line ends, else at semicolons (only without a comma and blank), else one; trimmed, no blanks."""
    parts = F.when(F.contains(text, F.lit("|")), F.split(text, r"\|")).when(F.contains(text, F.lit("\n")), F.split(text, "\n")).when(
        F.contains(text, F.lit(";")) & ~F.contains(text, F.lit(", ")), F.split(text, ";")).otherwise(F.array(text))
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: v != "")


# Names that header columns may have, in lower case without separators.
HEADERS = {"concepturi": "id", "uri": "id", "id": "id", "concepttype": "kind", "preferredlabel": "label", "label": "label", "altlabels": "alts", "altlabel": "alts", "description": "description"}


def read_taxonomy_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, label, alts, description; groups and rows without id or label are dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = {}
    for c in raw.columns:
        name = HEADERS.get("".join(ch for ch in c.lower() if ch.isalnum()))
        if name and name not in named:
            named[name] = F.col(f"`{c}`")
    none = F.lit(None).cast("string")
    rows = raw.select(*[named.get(n, none).alias(n) for n in ("id", "kind", "label", "alts", "description")])
    rows = rows.where(~F.coalesce(F.upper("kind").startswith("SG"), F.lit(False)) & _blank(F.col("id")).isNotNull() & _blank(F.col("label")).isNotNull())
    return rows.select(F.trim("id").alias("id"), F.trim("label").alias("label"), F.coalesce(split_alt_labels(F.col("alts")), F.array().cast("array<string>")).alias("alts"), "description")


def write_taxonomy_csv(skills: DataFrame, path: str) -> None:
    skills.select(F.col("id").alias("conceptUri"), F.lit("SK").alias("conceptType"), F.col("label").alias("preferredLabel"), F.array_join("alts", " | ").alias("altLabels"), "description").write.csv(path, header=True, escape='"')


def read_alias_overrides(spark: SparkSession, path: str) -> DataFrame:
    """skill_id, ord, aliases; an override without uri or without a non-blank alias is an error."""
    doc = spark.read.schema("version string, taxonomy string, overrides array<struct<uri:string,preferred_label:string,aliases:array<string>>>").json(path, multiLine=True)
    rows = doc.select(F.posexplode_outer("overrides").alias("ord", "o")).where("o is not null").select(F.col("o.uri").alias("skill_id"), "ord", F.filter("o.aliases", lambda v: F.trim(v) != "").alias("aliases"))
    bad = rows.where(_blank(F.col("skill_id")).isNull() | (F.coalesce(F.size("aliases"), F.lit(0)) < 1))
    if not bad.isEmpty():
        raise ValueError("an override needs a uri and at least one alias")
    return rows


def read_documents(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Whole files as trimmed texts, and the paths of blank ones."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    return rows.where("text <> ''"), rows.where("text = ''").select("path")


SPAN = "struct<text:string,skill_id:string,mention:string>"
# Fixed shapes of the files of a label set, one per suite.
LABELS = {
    "items": f"version string, items array<struct<id:string,spans:array<{SPAN}>>>, spans array<{SPAN}>",
    "corpus": "version string, k int, profile struct<synthesized_doc:string,locations:array<string>>, jobs array<struct<id:string,synthesized_doc:string,location:string,relevant:boolean>>",
    "pairs": "version string, profile struct<skill_ids:array<string>>, pairs array<struct<id:string,temptation:string,forbidden_claims:array<string>>>",
}


def read_label_file(spark: SparkSession, path: str, suite: str) -> DataFrame:
    """Rows of a label set's files: ``corpus`` (id, synthesized_doc, location, relevant, k) or ``pairs`` (id, temptation, forbidden_claims,
    skill_ids); an unknown suite is an error."""
    if suite not in ("corpus", "pairs"):
        raise ValueError(f"unknown suite: {suite}")
    doc = spark.read.schema(LABELS[suite]).json(path, multiLine=True)
    if suite == "corpus":
        return doc.select("k", F.explode_outer("jobs").alias("j")).where("j is not null").select("j.id", "j.synthesized_doc", "j.location", F.coalesce("j.relevant", F.lit(False)).alias("relevant"), "k")
    return doc.select("profile.skill_ids", F.explode_outer("pairs").alias("p")).where("p is not null").select("p.id", "p.temptation", "p.forbidden_claims", "skill_ids")


def read_labels(spark: SparkSession, *paths: str) -> DataFrame:
    """norm, text, skill_id (null: no link expected), mention: spans of label sets and calibration files, first per normalised text.

    A file holds {items: [{id, spans}]} or {spans}, or both; earlier paths win, then file names, then places in the file.
    """
    out = None
    for order, path in enumerate(paths):
        doc = spark.read.schema(LABELS["items"]).json(path, multiLine=True).withColumn("f", F.col("_metadata.file_path"))
        inner = doc.select("f", F.posexplode_outer("items").alias("i", "item")).select("f", "i", F.posexplode_outer("item.spans").alias("j", "s"))
        outer = doc.select("f", F.lit(1 << 30).alias("i"), F.posexplode_outer("spans").alias("j", "s"))
        one = inner.unionByName(outer).where("s is not null").select(F.struct(F.lit(order).alias("o"), "f", "i", "j").alias("at"), "s")
        out = one if out is None else out.unionByName(one)
    key = X.normalize_label(F.trim("s.text"))
    first = out.select(key.alias("norm"), "at", "s").where("norm <> ''").groupBy("norm").agg(F.min_by("s", "at").alias("s"))
    return first.select("norm", F.trim("s.text").alias("text"), _blank(F.trim("s.skill_id")).alias("skill_id"), "s.mention")


def write_report(suites: DataFrame, path: str, set_version: str, provider: str) -> None:
    """One JSON report: set version, provider, totals, per suite passed, n, latency, tokens and cost, and passed (all of them, and at least one).

    suites: name, passed, n, latency_ms, prompt_tokens, completion_tokens, cost_usd. One row per suite, so one file is right.
    """
    each = suites.select("name", "passed", "n", F.bround("latency_ms", 3).alias("latency_ms"), "prompt_tokens", "completion_tokens", F.bround("cost_usd", 6).alias("cost_usd"))
    totals = F.struct(
        F.bround(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), 3).alias("latency_ms"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.bround(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )
    sums = suites.agg(totals.alias("totals"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
    listed = each.agg(F.array_sort(F.collect_list(F.struct(*each.columns))).alias("suites"))
    sums.crossJoin(listed).select(F.lit(set_version).alias("set_version"), F.lit(provider).alias("embedding_provider"), "passed", "totals", "suites").coalesce(1).write.json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report's suites with the report's version, totals and verdict."""
    numbers = "latency_ms:double,prompt_tokens:long,completion_tokens:long,cost_usd:double"
    doc = spark.read.schema(f"set_version string, embedding_provider string, passed boolean, totals struct<{numbers}>, suites array<struct<name:string,passed:boolean,n:long,{numbers}>>").json(path)
    return doc.select("set_version", "embedding_provider", F.col("passed").alias("all_passed"), F.col("totals.cost_usd").alias("total_cost"), F.col("totals.latency_ms").alias("total_latency"), F.inline_outer("suites"))
