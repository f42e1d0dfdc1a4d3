"""Counts, costs, latencies and funnels from the event log and the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import match as M
from pairloom.functions import text as X
from pairloom.operators import ranks

MODEL_STAGES = ("extract-job", "screen-job", "generate-resume", "verify-resume")
USAGE = "prompt_tokens long, completion_tokens long, cost_usd double, latency_ms double"


EXACT = USAGE.replace("cost_usd double", "cost_usd decimal(38,8)")  # for sums that no order of adding changes


def mean_cost(cost: Column) -> Column:
    return F.sum(cost).cast("double") / F.count(cost)


def with_details(events: DataFrame) -> DataFrame:
    """details: JSON without nulls, cost to 8 and latency to 3 decimals."""
    fields = F.struct("prompt_tokens", "completion_tokens", F.bround("cost_usd", 8).alias("cost_usd"), F.bround("latency_ms", 3).alias("latency_ms"))
    return events.withColumn("details", F.to_json(fields))


def usage_rows(events: DataFrame, stages=MODEL_STAGES) -> DataFrame:
    """Events of model stages whose details hold a cost or tokens."""
    has = F.get_json_object("details", "$.cost_usd").isNotNull() | F.get_json_object("details", "$.prompt_tokens").isNotNull()
    return events.where(F.col("stage").isin(*stages) & has)


def usage_by_stage(events: DataFrame, stages=MODEL_STAGES) -> DataFrame:
    """n, tokens and costs per model stage; stages without rows are there with n = 0."""
    d = usage_rows(events, stages).select("stage", F.from_json("details", EXACT).alias("d"))
    sums = d.groupBy("stage").agg(
        F.count("*").alias("n"), F.sum("d.prompt_tokens").alias("prompt_tokens"), F.round(F.avg("d.prompt_tokens"), 4).alias("mean_prompt"),
        F.round(F.sum("d.cost_usd"), 6).cast("double").alias("cost"), F.round(mean_cost(F.col("d.cost_usd")), 6).alias("mean_cost"), F.min("d.cost_usd").cast("double").alias("min_cost"), F.max("d.cost_usd").cast("double").alias("max_cost"),
    )
    names = events.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    return F.broadcast(names).join(sums, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def latency_by_stage(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, p50, p95, max; a percentile is the value at index round-half-even(q (n - 1))."""

    def place(q: float):
        return lambda n: F.bround(F.lit(q) * (n - 1), 0)

    known = rows.where(F.col(value).isNotNull())
    sums = known.groupBy(F.col(group).alias("g")).agg(F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("max"))
    at = ranks.values_at(known, group, value, {"p50": place(0.5), "p95": place(0.95)})
    return at.join(sums, F.col(group).eqNullSafe(F.col("g"))).select(group, "n", "mean", "p50", "p95", "max")


def score_distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, min, median, max of the known values per group; the median of an even number is the mean of the two in the middle."""
    known = rows.where(F.col(value).isNotNull())
    ends = known.groupBy(F.col(group).alias("g")).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    at = ranks.values_at(known, group, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    return at.join(ends, F.col(group).eqNullSafe(F.col("g"))).select(group, "n", "min", ((F.col("low") + F.col("high")) / 2).alias("median"), "max")


def distribution(rows: DataFrame, col: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of all ``values``, in order, zero where there are none."""
    names = rows.sparkSession.createDataFrame(list(enumerate(values)), f"ord int, {col} string")
    return F.broadcast(names).join(rows.groupBy(col).agg(F.count("*").alias("n")), col, "left").select(F.col("ord").cast("long").alias("ord"), col, F.coalesce("n", F.lit(0)).alias("n"))


def share(a: Column, b: Column) -> Column:
    """Ratio to four decimals, null on nothing."""
    return F.when(b > 0, F.round(a / b, 4))


def _or_else(reranked: DataFrame, ranked: DataFrame, answered: DataFrame) -> DataFrame:
    """A query without answer of the reranker keeps the order by vector."""
    return reranked.unionByName(ranked.join(answered.select("q").distinct(), "q", "left_anti"))


def stage_recall(sizes: DataFrame, ranked: DataFrame, reranked: DataFrame, answered: DataFrame, k: int) -> DataFrame:
    """Per query: relevant, kept by the filters, among the first ``k`` by vector and after reranking; and the three recalls.
    sizes: q, relevant, kept; ranked, reranked: q, d, rank of relevant items; answered: q of the queries that were reranked."""

    def n(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col("rank") <= k).groupBy("q").agg(F.count("*").alias(name))

    out = sizes.join(n(ranked, "found"), "q", "left").join(n(_or_else(reranked, ranked, answered), "refound"), "q", "left")
    out = out.select("q", "relevant", "kept", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "refound")])
    return out.withColumns({f"{c}_recall": share(F.col(c), F.col("relevant")) for c in ("kept", "found", "refound")})


def recall_at_k(ranked: DataFrame, corpus: int, cutoffs: tuple[int, ...]) -> DataFrame:
    """k, recall: mean share of a query's gold items among its first k; cut-offs beyond the corpus are left out.

    ranked: q, gold (number of gold items, at least 1), rank, hit; a row per ranked item.
    """
    ks = ranked.sparkSession.createDataFrame([(k,) for k in cutoffs if k <= max(corpus, 1)], "k long")
    per = ranked.crossJoin(F.broadcast(ks)).groupBy("q", "k", "gold").agg(F.sum(F.when((F.col("rank") <= F.col("k")) & F.col("hit"), 1).otherwise(0)).alias("n"))
    return per.groupBy("k").agg(F.avg(F.col("n") / F.col("gold")).alias("recall"))


def recall_curve(sizes: DataFrame, ranked: DataFrame, reranked: DataFrame, answered: DataFrame, corpus: int, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """q, k, vector, rerank: the shares of a query's relevant items among its first k by vector and after reranking, for every cut-off within the corpus.

    sizes: q, relevant; ranked, reranked: q, d, rank of relevant items, up to the last cut-off; answered: q of the queries that were reranked.
    """
    ks = [k for k in cutoffs if k <= max(corpus, 1)]

    def n(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("q").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"{name}{k}") for k in ks])

    by = sizes.join(n(ranked, "v"), "q", "left").join(n(_or_else(reranked, ranked, answered), "r"), "q", "left").na.fill(0)
    at = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), *[share(F.col(f"{c}{k}"), F.col("relevant")).alias(x) for c, x in (("v", "vector"), ("r", "rerank"))]) for k in ks]))
    return by.select("q", at.alias("x")).select("q", "x.*")


#: Fields whose texts are compared, and how much of their tokens must agree.
TEXT_FIELDS = {"title": 0.45, "seniority": 0.99, "location": 0.45, "work_arrangement": 0.99}


def field_accuracy(rows: DataFrame, predicted: str = "predicted", gold: str = "gold", fields: dict[str, float] = TEXT_FIELDS) -> DataFrame:
    """field, n, hits, accuracy of extracted fields. rows: two structs of the text fields, comp_min and comp_max.

    A text field counts where either side has it, and is hit where the normalised texts match by the field's share; the pair of amounts counts always and is
    hit if both are equal, nulls included.
    """

    def text(side: str, name: str) -> Column:
        return X.normalize_label(F.col(f"{side}.{name}"))

    def same(name: str) -> Column:
        return F.col(f"{predicted}.{name}").eqNullSafe(F.col(f"{gold}.{name}"))

    each = [
        F.struct(F.lit(name).alias("field"), (F.col(f"{predicted}.{name}").isNotNull() | F.col(f"{gold}.{name}").isNotNull()).alias("counts"), M.texts_match(text(predicted, name), text(gold, name), least).alias("hit"))
        for name, least in fields.items()
    ]
    each.append(F.struct(F.lit("comp").alias("field"), F.lit(True).alias("counts"), (same("comp_min") & same("comp_max")).alias("hit")))
    long = rows.select(F.explode(F.array(*each)).alias("f")).select("f.*").where("counts")
    out = long.groupBy("field").agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits"))
    return out.withColumn("accuracy", share(F.col("hits"), F.col("n")))


EXTRACT_DONE, SCREEN_DONE = ("extracted", "unparseable", "skipped_cached"), ("screened", "quota_exhausted", "skipped_screened")


def funnel(jobs: DataFrame, pairs: DataFrame, events: DataFrame, matches: DataFrame, generations: DataFrame) -> DataFrame:
    """One row: what every step let through, its peaks over cycles, and the shares that survive.

    jobs: extracted_at; pairs: user_id, n (pairs that pass a user's filters now); events: stage, action, details (JSON; completed cycles carry prefilter_pairs,
    matches_written, extracts_enqueued); matches: label; generations: verify_status. Each table is aggregated once, without grouping by more than users.
    """
    d = F.from_json("details", "prefilter_pairs long, matches_written long, extracts_enqueued long")
    cycle = (F.col("stage") == "match-batch") & (F.col("action") == "completed")
    done = {"extract_events_done": ("extract-job", EXTRACT_DONE), "screen_events_done": ("screen-job", SCREEN_DONE)}
    seen = events.withColumn("d", F.when(cycle, d)).agg(
        F.max("d.prefilter_pairs").alias("peak"), F.coalesce(F.max("d.matches_written"), F.lit(0)).alias("matches_written_peak"), F.coalesce(F.sum("d.extracts_enqueued"), F.lit(0)).alias("extracts_enqueued"),
        *[F.count(F.when((F.col("stage") == s) & F.col("action").isin(*a), 1)).alias(c) for c, (s, a) in done.items()],
    )
    out = jobs.agg(F.count("*").alias("jobs_ingested"), F.count("extracted_at").alias("jobs_extracted")).crossJoin(seen).crossJoin(pairs.agg(F.max("n").alias("now")))
    out = out.crossJoin(matches.agg(F.count("label").alias("screened"))).crossJoin(generations.agg(F.count("*").alias("generated"), F.count(F.when(F.col("verify_status") == "passed", 1)).alias("verify_passed")))
    out = out.withColumn("prefilter_pairs_peak", F.greatest(F.coalesce("peak", F.lit(0)), F.coalesce("now", F.lit(0)))).withColumn("prefilter_pairs_now", F.coalesce("now", F.lit(0))).drop("peak", "now")
    shares = {"prefilter_survival": ("prefilter_pairs_peak", "jobs_ingested"), "match_survival": ("matches_written_peak", "prefilter_pairs_peak"), "end_to_end": ("verify_passed", "jobs_ingested")}
    return out.withColumns({c: share(F.col(a), F.col(b)) for c, (a, b) in shares.items()})
