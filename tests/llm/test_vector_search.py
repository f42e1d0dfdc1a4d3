"""Exact top-k against plain sorting, with copies, ties, odd rows and pruning."""

import math
from collections import defaultdict

import numpy as np


def plain(rows, k, every):
    fine = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in fine:
        if i is not None and i % every == 0:
            others = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j or 0) for m, j, x in fine if m != n and len(x) == len(q))
            out += [(i, r + 1, None if no else j, min(-s, 2**63 - 1024)) for r, (s, no, j) in enumerate(others[:k])]
    return sorted(out, key=str)


def test_equals_plain(spark):
    from pyspark.sql import functions as F

    from pairloom.llm import vector_search as v

    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8) + 6 * (i % 7 == np.arange(8))]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(200)]  # copies, queries among them
    rows += [(20, rows[20][1]), (30, rows[31][1]), (None, rows[5][1]), (2000, None), (2010, [1.0, None]), (2020, [math.nan] * 8), (2030, [math.inf] * 8), (2040, []), (2041, []), (2050, [0.5, -0.5]), (2051, [0.5, 1.5]),
             (2060, [1e9] * 3), (2061, [-1e9, 2e9, 3.0]), (2070, [0.0] * 8), (2080, [-3.0] * 8)]
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "vec_id long, embedding array<double>, id int, v string").repartition(5)
    for size in (30, 1 << 14):
        got = v.top_k(df, 5, F.col("vec_id") % 10 == 0, rows=size).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, 5, 10)
    assert v.top_k(df.limit(0), 5, F.col("vec_id") % 10 == 0).count() == 0


def test_far_balls_are_not_visited():
    from pairloom.llm import vector_search as v

    r = np.random.default_rng(2)
    x = np.floor(r.normal(0, 5, (4000, 6)) + 900 * np.eye(6)[np.arange(4000) % 6])
    tree = v.BallTree(np.arange(4000), x, 5, leaf=50)
    seen = defaultdict(int)
    bound = tree.bound
    tree.bound = lambda node, who: (seen.__setitem__(node, seen[node] + len(who)), bound(node, who))[1]
    who, ids, scores = tree.search(x[:60], np.full(60, v.LOWEST), 5)
    every = x[:60] @ x.T
    for q in range(60):
        mine = who == q
        assert scores[mine].tolist() == np.sort(every[q])[::-1][:5].tolist()
    assert sum(seen.values()) < 0.6 * 60 * len(tree.nodes)
