"""Planted numbers are found in any history of whole-number keys, and lambdas don't compute a history's tokens per element."""


def test_planted_numbers_are_no_keys(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import claims as op
    from pairloom.plans.catalog_claims import PLANTS

    texts = [p[1] for p in PLANTS if p[0] in ("missing_skill", "year_scope_inflation")]
    roles = "array(named_struct('employer', 'Firm 987650', 'title', 'Title 1', 'start', '1996-01', 'end', '1996-02', 'is_current', false, 'bullets', array('made part 987654', 'made part 987650', 'made part 150000')))"
    none = F.array().cast("array<string>")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({
        "roles": F.expr(roles), "claims": F.array().cast("array<struct<kind:string,text:string,skill_id:string>>"), **{c: none for c in ("employers", "titles", "date_ranges", "skill_ids", "user_skills", "forbidden")}})
    assert [x.codes for x in op.failures(rows).collect()] == [["fabricated_number"]] * 2


def test_tokens_are_computed_once_a_row(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import claims as op

    rows = spark.range(3).select(F.array(F.lit("2001"), F.lit("1999")).alias("said"), F.concat(F.lit("2001,"), "id").alias("known"))
    checked = rows.select(op.unknown_dates(F.col("said"), F.split(F.upper("known"), ",")).alias("bad"))
    assert [x.bad for x in checked.collect()] == [True] * 3
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1  # one place in the plan, and outside the lambda that walks the ranges
