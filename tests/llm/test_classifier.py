"""The classifier's gradients, words that only the lexical part can tell apart, and edge cases."""

import random

import numpy as np


def test_gradients_are_the_slopes_of_the_loss():
    from pairloom.llm import quality_classifier as q

    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "Beta,", "gamma", "x", "delta!!", "77"]) for _ in range(r.randint(1, 300))).encode() for _ in range(12)]
    x, cells, n = q.encode(texts)
    label = np.array([k % 2 for k in range(12)], float)
    model = q.Model(hidden=5, gate=3)
    model.kind = np.float64
    x = x.astype(np.float64)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model.w["L"] = np.random.default_rng(2).normal(0, 0.1, model.w["L"].shape)
    slopes = model.gradients(x, cells, n, label)
    some = np.random.default_rng(3)
    for name, w in model.w.items():
        used = np.flatnonzero(np.abs(slopes[name].ravel()) > 1e-6) if name == "L" else np.arange(w.size)
        for at in some.choice(used, min(6, len(used)), replace=False):
            losses = []
            for step in (1e-5, -1e-5):
                w.ravel()[at] += step
                losses.append(model.loss(x, cells, n, label))
                w.ravel()[at] -= step
            assert abs((losses[0] - losses[1]) / 2e-5 - slopes[name].ravel()[at]) < 1e-6


def test_words_alone_tell_apart(spark):
    """Both kinds have the same letters, lengths and repeats; only the words differ, in one passage of several."""
    from pairloom.llm import quality_classifier as q

    r = random.Random(4)
    letters = "abcdefgh"
    common = ["".join(r.choice(letters) for _ in range(5)) for _ in range(60)]
    marks = {0: ["".join(r.choice(letters) for _ in range(5)) for _ in range(4)], 1: ["".join(r.choice(letters) for _ in range(5)) for _ in range(4)]}
    rows = []
    for k in range(900):
        words = [r.choice(common) for _ in range(200)]
        for _ in range(8):
            words[64 + r.randrange(64)] = r.choice(marks[k % 2])
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(900)], "doc_id long, quality int")
    held = [x for x in q.score(docs, q.fit(docs, labels)).collect() if x.held_out]
    right = sum((x.score >= 0.5) == bool(x.doc_id % 2) for x in held)
    assert len(held) > 100 and right >= 0.9 * len(held)


def test_long_texts_ties_and_clashing_columns(spark):
    from pairloom.llm import quality_classifier as q

    rows = [(k, "good words here. " * 20 if k % 2 else "BAD!!! " * 30) for k in range(60)] + [(1000, "good words here. " * 60000), (1, "good words here. " * 20), (None, None), (1001, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 d", "2 y", "3 x", "4 k", "5 score", "6 k0")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1), (1000, 1)], "doc_id long, quality int")
    out = q.score(docs, q.fit(docs, labels), keep=("score", "k0", "d")).drop("score")
    assert out.count() == len(rows) and [r.predicted for r in out.where("doc_id in (1, 1000)").collect()] == [1, 1, 1]


def test_long_documents_are_learned_from_whole(spark):
    """What tells the labels apart stands far behind the start; the bound leaves documents out, never passages."""
    from pairloom.llm import quality_classifier as q

    r = random.Random(9)
    plain = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    rows = [(k, plain(64 * 40) + (" #### $$$$ |||| " * 21 if k % 2 else plain(63)) + plain(64 * 3)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    out = q.score(docs, q.fit(docs, labels)).collect()
    assert np.mean([x.predicted == 1 - x.doc_id % 2 for x in out if not x.held_out]) > 0.9
    few = q.fit(docs, labels, passages=100)  # two whole documents, or none of a longer one
    assert few.constant is None or few.constant in (0.0, 0.5, 1.0)
    assert q.fit(docs, labels, passages=10).constant == 0.5
