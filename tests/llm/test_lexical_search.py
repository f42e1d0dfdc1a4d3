"""Ranked search against plain scoring of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    own = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c, n in own:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_equals_plain(spark, monkeypatch):
    from pairloom.llm import lexical_search as s

    r = random.Random(4)
    some = [f"w{k}" for k in range(300)] + ["ñandú", "Éa", "x1"]
    text = lambda n: " ".join(r.choice(some[: r.choice((20, 300, 303))]) for _ in range(n))
    docs = [(k, text(r.randint(1, 80))) for k in range(700)]
    docs += [(1000 + k, docs[3][1]) for k in range(200)] + [(5, docs[5][1]), (5, docs[5][1]), (None, docs[3][1]), (None, docs[8][1]), (2000, None), (2001, ""), (2002, " .-! "), (2003, "W1_w2" * 3000), (2004, "İstanbul ſ K")]
    items = [(k, text(r.randint(1, 15))) for k in range(40)] + [(100, docs[3][1].upper()), (100, docs[3][1].upper()), (None, "w1 w2"), (101, None), (102, "absent words"), (103, ""), (104, "i ſ istanbul İSTANBUL")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double")
    expected = plain(docs, items, 7)
    for more in ({}, {"pass_terms": 100, "seed": 50}):
        assert sorted(map(tuple, s.rank(d, q, 7, **more).collect()), key=str) == expected
    assert s.rank(d.limit(0), q, 7).count() == s.rank(d, q.limit(0), 7).count() == 0


def test_pairs_of_nodes_are_left_out():
    from pairloom.llm import lexical_search as s

    r = np.random.default_rng(6)
    topic = lambda k, n: np.unique(r.integers(50 * k, 50 * k + 50, n))
    items = [topic(k % 20, 8) for k in range(64)]
    weight = r.integers(500, 5000, 1000).astype(np.float64)
    tree, best = s.ItemTree(items, weight), s.Best(np.zeros(64, np.int64), 5)
    docs = [topic(k % 20, 30) for k in range(s.BLOCK)]
    of, term = np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate(docs)
    share = r.integers(1, 10**6, len(term)).astype(np.float64)
    at = tree.place[term]
    scored = s.walk(tree, np.arange(len(docs)), of[at >= 0], at[at >= 0], share[at >= 0], best)
    dense = np.zeros((len(docs), len(tree.used)))
    dense[of[at >= 0], at[at >= 0]] = share[at >= 0]
    every = tree.weights @ dense.T
    for k in range(64):
        assert sorted(best.score[best.item == k].tolist()) == np.sort(every[k])[-5:].astype(int).tolist()
    assert scored < 0.2 * every.size
