"""Feeds, interface state, quotas and write-backs over matches, generations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions import match as M
from pairloom.operators import ranks

ACTIONS = ("viewed", "skipped", "generate_requested", "marked_applied", "outcome")
REASONS = ("not_interested", "wrong_location", "wrong_comp", "wrong_seniority", "disagree_with_gate", "other")
OUTCOMES = ("interview", "rejected")


def latest_match(matches: DataFrame) -> DataFrame:
    """Per (user, job) the match of the newest cycle, then of the largest id."""
    w = W.partitionBy("user_id", "job_id").orderBy(F.desc("cycle_at"), F.desc("match_id"))
    return matches.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def latest_generation(generations: DataFrame) -> DataFrame:
    """Per match: newest_id (largest id), last_id (of the highest attempt), attempts."""
    return generations.groupBy("match_id").agg(
        F.max("generation_id").alias("newest_id"), F.max_by("generation_id", F.struct("attempt", "generation_id")).alias("last_id"), F.count("*").alias("attempts")
    )


def generation_todo(requests: DataFrame, generations: DataFrame, most: int = 2) -> DataFrame:
    """Requests (match_id, attempt) to run: attempt at most ``most`` and not already made."""
    made = latest_generation(generations).select("match_id", "attempts")
    return requests.where(F.col("attempt") <= most).join(made, "match_id", "left").where(F.coalesce("attempts", F.lit(0)) < F.col("attempt")).select("match_id", "attempt")


def feed(matches: DataFrame) -> DataFrame:
    """Latest matches in feed order, as ``place`` within the user: label rank, score and cycle, each descending, nulls last."""
    rank = M.label_rank(F.col("label"))
    w = W.partitionBy("user_id").orderBy(rank.desc_nulls_last(), F.col("score").desc_nulls_last(), F.desc("cycle_at"), "match_id")
    return latest_match(matches).withColumn("place", F.row_number().over(w).cast("long"))


def ui_state(events: DataFrame) -> DataFrame:
    """Per (user, job): newest value per action by time, then event id; flags for viewed and generate_requested."""
    at = F.struct("ts", "event_id")

    def newest(action: str, col: str) -> Column:
        return F.max_by(F.when(F.col("action") == action, F.col(col)), F.when(F.col("action") == action, at))

    return events.where("stage = 'ui'").groupBy("user_id", "job_id").agg(
        F.bool_or(F.col("action") == "viewed").alias("viewed"), F.bool_or(F.col("action") == "generate_requested").alias("generate_requested"),
        newest("skipped", "detail").alias("skipped"), newest("marked_applied", "detail").alias("applied"), newest("outcome", "detail").alias("outcome"),
    )


def dedupe_views(events: DataFrame) -> DataFrame:
    """"viewed" once per (user, job), the first; all other events."""
    w = W.partitionBy("user_id", "job_id").orderBy("ts", "event_id")
    views = events.where("action = 'viewed'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return views.unionByName(events.where("action <> 'viewed'"))


def apply_quota(screened: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Top-label matches take a unit each, best score first; the rest is quota_exhausted. Also the new balances."""
    w = W.partitionBy("user_id").orderBy(F.desc("score"), "match_id")
    top = screened.where(F.col("label") == M.TOP_LABEL).withColumn("rn", F.row_number().over(w)).join(users.select("user_id", "quota"), "user_id", "left")
    routed = top.withColumn("action", F.when(F.col("rn") <= F.coalesce("quota", F.lit(0)), "generate").otherwise("quota_exhausted")).drop("rn", "quota")
    used = routed.where("action = 'generate'").groupBy("user_id").agg(F.count("*").alias("used"))
    left = users.join(used, "user_id", "left").withColumn("balance", F.col("quota") - F.coalesce("used", F.lit(0))).drop("used")
    return routed, left


def route_generate(requests: DataFrame, generations: DataFrame, users: DataFrame) -> DataFrame:
    """Per requested match: skipped_existing with the newest generation, else todo while the quota lasts, else quota_exhausted."""
    known = requests.join(latest_generation(generations).select("match_id", "newest_id"), "match_id", "left").join(users.select("user_id", "quota"), "user_id", "left")
    w = W.partitionBy("user_id", F.col("newest_id").isNull()).orderBy(F.desc("score"), "match_id")
    ranked = known.withColumn("rn", F.row_number().over(w))
    action = F.when(F.col("newest_id").isNotNull(), "skipped_existing").when(F.col("rn") <= F.coalesce("quota", F.lit(0)), "todo").otherwise("quota_exhausted")
    return ranked.select("match_id", "user_id", action.alias("action"), "newest_id")


def route_screen(matches: DataFrame, jobs: DataFrame, users: DataFrame) -> DataFrame:
    """not_found, skipped (labelled), missing_docs (a blank document), else screen, in that order. jobs: job_id, doc; users: user_id, doc."""
    j, u = jobs.select("job_id", F.col("doc").alias("jd"), F.lit(True).alias("hj")), users.select("user_id", F.col("doc").alias("ud"), F.lit(True).alias("hu"))
    both = matches.join(j, "job_id", "left").join(u, "user_id", "left")
    blank = F.coalesce(F.trim("jd"), F.lit("")) == ""
    blank_u = F.coalesce(F.trim("ud"), F.lit("")) == ""
    action = F.when(F.col("hj").isNull() | F.col("hu").isNull(), "not_found").when(F.col("label").isNotNull(), "skipped").when(blank | blank_u, "missing_docs").otherwise("screen")
    return both.withColumn("action", action).drop("jd", "hj", "ud", "hu")


def route_verify(generations: DataFrame) -> DataFrame:
    """Where the status is null: passed without failures; else failed and regenerate at attempt 1, needs_review later."""
    fails = F.col("n_failures") > 0
    status = F.when(F.col("verify_status").isNotNull(), F.col("verify_status")).when(~fails, "passed").when(F.col("attempt") == 1, "failed").otherwise("needs_review")
    return generations.withColumn("regenerate", F.col("verify_status").isNull() & fails & (F.col("attempt") == 1)).withColumn("verify_status", status)


def cas_update(target: DataFrame, delta: DataFrame, key: str, col: str) -> DataFrame:
    """Write ``delta``'s value only where the target's is null; ``applied`` tells which rows of the delta took effect."""
    new = delta.select(key, F.col(col).alias("new"), F.lit(True).alias("sent"))
    out = target.join(new, key, "left")
    applied = F.coalesce(F.col("sent"), F.lit(False)) & F.col(col).isNull()
    return out.withColumn("applied", applied).withColumn(col, F.coalesce(col, "new")).drop("new", "sent")


def validate_ui_events(events: DataFrame) -> DataFrame:
    """``error`` per event (null: valid): known action; skips need a known reason, outcomes a known value, views take no fields."""
    extra = F.coalesce("reason_code", "reason_text", "applied_at", "outcome").isNotNull()
    error = (
        F.when(~F.col("action").isin(*ACTIONS), "unknown action")
        .when((F.col("action") == "skipped") & F.col("reason_code").isNull(), "skipped requires reason_code")
        .when((F.col("action") == "skipped") & ~F.col("reason_code").isin(*REASONS), "invalid reason_code")
        .when((F.col("action") == "outcome") & F.col("outcome").isNull(), "outcome requires outcome")
        .when((F.col("action") == "outcome") & ~F.col("outcome").isin(*OUTCOMES), "invalid outcome")
        .when(F.col("action").isin("viewed", "generate_requested") & extra, "accepts no extra fields")
    )
    return events.withColumn("error", error)


def search_jobs(jobs: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Jobs whose title, company or location contains the text in any case (its % and _ are wildcards); newest first."""
    if text.strip():
        p = f"%{text}%"
        jobs = jobs.where(F.col("title").ilike(p) | F.col("company").ilike(p) | F.col("location").ilike(p))
    return jobs.orderBy(F.col("posted_at").desc_nulls_last(), "job_id").limit(limit)


def resolve_labels(rows: DataFrame, key: str, ids: str, labels: DataFrame) -> DataFrame:
    """The labels of an id array, in order; ids without a label stay. ``labels``: skill_id, label."""
    each = rows.select(key, F.posexplode_outer(ids).alias("k", "skill_id")).join(labels.select("skill_id", "label"), "skill_id", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("skill_id").isNotNull(), F.struct("k", F.coalesce("label", "skill_id").alias("v")))))
    return each.groupBy(key).agg(F.transform(pairs, lambda s: s["v"]).alias("labels"))


def profile_bundle(users: DataFrame, profile_skills: DataFrame, labels: DataFrame) -> DataFrame:
    """Users with ``skills``: the profile's skills in order, each with its label (the id where there is none); empty without a profile."""
    some = resolve_labels(profile_skills, "user_id", "skill_ids", labels).join(profile_skills.select("user_id", "skill_ids"), "user_id")
    pairs = F.transform(F.arrays_zip(F.col("skill_ids"), F.col("labels")), lambda p: F.struct(p["skill_ids"].alias("skill_id"), p["labels"].alias("label")))
    out = users.join(some.select("user_id", pairs.alias("skills")), "user_id", "left")
    return out.withColumn("skills", F.coalesce("skills", F.array().cast("array<struct<skill_id:string,label:string>>")))


def upsert(target: DataFrame, incoming: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``incoming`` (one per key) replace those of ``target``; columns in ``keep`` stay as first written."""
    t, i = target.select(*target.columns, F.lit(True).alias("in_t")), incoming.select(*incoming.columns, F.lit(True).alias("in_i"))
    cols = [c for c in target.columns if c not in key]
    t = t.withColumnsRenamed({c: f"t_{c}" for c in cols})
    out = t.join(i, key, "full")
    value = [F.when(F.col("in_i"), F.coalesce(f"t_{c}", c) if c in keep else F.col(c)).otherwise(F.col(f"t_{c}")).alias(c) for c in cols]
    return out.select(*key, *value)


def last_of_batch(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return batch.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def strip_users(events: DataFrame, ids: DataFrame) -> DataFrame:
    """user_id set to null for the given users; all rows kept."""
    gone = ids.select("user_id", F.lit(True).alias("gone")).distinct()
    return events.join(gone, "user_id", "left").withColumn("user_id", F.when(F.col("gone").isNull(), F.col("user_id"))).drop("gone")


def limit_new_to_target(listing: DataFrame, known: DataFrame, target: int) -> DataFrame:
    """New postings in board order until the corpus reaches ``target``. listing: url_hash, board_ord, pos. Duplicates don't count."""
    first = listing.groupBy("url_hash").agg(F.min(F.struct("board_ord", "pos")).alias("at")).select("url_hash", "at.*")
    there = known.select("url_hash").distinct()
    room = there.agg((F.lit(target) - F.count("*")).alias("room"))
    return ranks.first_in_order(first.join(there, "url_hash", "left_anti"), ["board_ord", "pos", "url_hash"], room).select("url_hash", "board_ord", "pos")


def new_postings(listing: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per board: listed, new (not stored yet; repeats within a listing all count), skipped."""
    seen = listing.join(jobs.select("url_hash", F.lit(1).alias("known")).distinct(), "url_hash", "left")
    return seen.groupBy("board").agg(F.count("*").alias("listed"), F.count(F.when(F.col("known").isNull(), 1)).alias("new"), F.count("known").alias("skipped"))


PROFILE = ("skill_ids", "title_families", "locations", "work_arrangement", "seniority_band", "comp_floor")


def apply_profile_edits(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Profiles (user_id, version, rematch_needed and the ``PROFILE`` fields) after ``edits``, folded in the order of ``ord``.

    edits: user_id, ord, kind (ingest or edit), the fields, clear_comp_floor. An ingest sets every field, null ones too, and makes a profile where there
    is none; an edit sets the fields that it names (not null), and clears the floor if told to, whatever floor it names. Every one that counts raises the
    version by one and sets the flag; edits before the first ingest of a user without a profile count for nothing.

    Of all that set a field only the last matters, so the fold is one aggregate that combines before the shuffle, however many edits a user has.
    """
    ingest, clear = F.col("kind") == "ingest", F.coalesce(F.col("clear_comp_floor"), F.lit(False))
    begun = edits.where(ingest).groupBy("user_id").agg(F.min("ord").alias("begun"))
    there = profiles.select("user_id", F.lit(True).alias("there"))
    counted = edits.join(there, "user_id", "left").join(begun, "user_id", "left").where("there or ord >= begun")

    def last(c: str) -> Column:
        drop = ~ingest & clear if c == "comp_floor" else F.lit(False)
        return F.max_by(F.struct(F.when(~drop, F.col(c)).alias("v")), F.when(ingest | F.col(c).isNotNull() | drop, F.col("ord"))).alias(f"new_{c}")

    by = counted.groupBy("user_id").agg(F.count("*").alias("n"), *map(last, PROFILE))
    out = profiles.join(by, "user_id", "full")
    fields = [F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.v")).otherwise(F.col(c)).alias(c) for c in PROFILE]
    return out.select("user_id", (F.coalesce("version", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("version"), (F.coalesce("rematch_needed", F.lit(False)) | F.col("n").isNotNull()).alias("rematch_needed"), *fields)


def init_users(users: DataFrame, quota: int, today: Column) -> DataFrame:
    """Quota default and the reset date, the first of next month."""
    return users.withColumns({"quota": F.coalesce("quota", F.lit(quota)), "reset_at": F.add_months(F.trunc(today, "MM"), 1)})


def job_detail(jobs: DataFrame, job_id: int) -> DataFrame:
    """The one posting with all its columns; a missing id gives no row. The filter reaches the scan."""
    return jobs.where(F.col("job_id") == job_id)
