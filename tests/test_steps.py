"""Steps that grow with their input: calls of a scorer from sorted frames, features added up before the shuffle."""


def test_rerank_calls_over_frames(spark):
    from pairloom.operators import matching

    pairs = [(u, j, (u * 7 + j * 3) % 11 / 10) for u in range(9) for j in range(u + 1)]
    df = spark.createDataFrame(pairs, "user_id long, job_id long, score double")

    def scorer(pdf):
        assert pdf["user_id"].nunique() == 1 and list(pdf.columns) == ["user_id", "job_id", "score"] and list(pdf.index) == list(range(len(pdf)))
        if pdf["user_id"].iloc[0] == 4:
            raise RuntimeError
        return [(k, float(len(pdf) - k)) for k in range(len(pdf))][::-1]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = matching.rerank(df, None, scorer)
        got = sorted((r.user_id, r["rank"], r.job_id) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = {u: [j for _, j in sorted((-s, j) for v, j, s in pairs if v == u)] for u in range(9)}
    assert got == [(u, k + 1, j) for u in range(9) for k, j in enumerate(best[u])]


def test_rerank_makes_no_group_per_user(spark, monkeypatch):
    from pairloom.operators import matching

    plans, plain = [], matching.saved
    monkeypatch.setattr(matching, "saved", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, tag))
    matching.rerank(spark.createDataFrame([(1, 2, 0.5)], "user_id long, job_id long, score double"), None, lambda pdf: []).collect()
    assert plans and not any("FlatMapGroupsInPandas" in p for p in plans)


def test_hash_embed_adds_features_up_once(spark):
    from pairloom.operators import linking

    out = linking.hash_embed(spark.createDataFrame([(1, "a b a b abc"), (2, ""), (3, None)], "id long, text string"), "id", "text", 16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
    norms = {}
    for r in out.collect():
        norms[r.id] = norms.get(r.id, 0) + r.value**2
    assert norms.keys() == {1, 2, 3} and all(abs(v - 1) < 1e-9 for v in norms.values())


def test_write_backs_build_matches_once(spark, data):
    """Both sides of a write-back read saved matches; before, every side joined and grouped line items in the same tasks."""
    from pairloom.plans.catalog import QUERIES

    for name in ("t4_cas_update", "t5_idempotent_redelivery"):
        assert "l_orderkey" not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_keep_classes_only(spark, data):
    """Rows that classes were made of are deleted before pairs are put out; before, a row per user and per job stayed on disk to the end."""
    from pathlib import Path

    from pairloom.plans.catalog import QUERIES
    from pairloom.plans.runtime import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("slim-*"))
    for name in ("v5_combined_score", "w4_top_per_user", "x2_jaccard", "x4_hard_requirements"):
        out = QUERIES[name](spark, data)
        assert not set(shared.glob("slim-*")) - before
        assert out.count()


def test_hash_embed_of_texts_in_slices(spark, monkeypatch):
    """Slices that end anywhere, letters beyond the basic plane, texts shorter than a trigram: the sums of plain loops, and no expression per letter."""
    import hashlib
    import random

    from pairloom.operators import linking

    monkeypatch.setattr(linking, "LETTERS", 7)
    monkeypatch.setattr(linking, "FEATURES", 3)
    r = random.Random(4)
    texts = ["", "a", "ab", "abc", "𝒳𝒴z 𝒳𝒴z", "ab ab\tab", "é e", "  ", "!!"] + ["".join(r.choices("ab cdé𝒳+", k=r.randint(0, 30))) for _ in range(40)]
    out = linking.hash_embed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1, "abc")], "id long, text string"), "id", "text", 8)
    assert "lambdafunction" not in out._jdf.queryExecution().analyzed().toString()
    expected = {}
    for k, t in [*enumerate(texts), (1, "abc")]:
        t = " ".join("".join(c if c.isalnum() or c in "_+# " else " " for c in t.lower()).split())
        for f in [w for w in t.split(" ") if w or not t] + [f"#{t[x:x + 3]}" for x in range(len(t) - 2)]:
            h = hashlib.md5(f.encode()).hexdigest()
            at = k, int(h[:8], 16) % 8
            expected[at] = expected.get(at, 0) + (1 if int(h[8], 16) % 2 == 0 else -1)
    sizes = {k: sum(v * v for (x, _), v in expected.items() if x == k) ** 0.5 for k, _ in expected}
    got = {(x.id, x.cell): x.value for x in out.collect()}
    assert got.keys() == expected.keys() and all(abs(got[at] - (v / sizes[at[0]] if v else 0)) < 1e-12 for at, v in expected.items())
