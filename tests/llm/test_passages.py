"""Passages whose roots other documents lead, and passages far from or repeated beside their roots."""

import random


def words(r, n):
    return [f"v{r.randrange(100000)}" for _ in range(n)]


def found(spark, rows):
    from pairloom.llm import substring_dedup as s

    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    return {r.doc_id: r for r in s.near_duplicates(df).collect()}


def covered(row):
    return {k for v in row.spans.split(",") if v for k in range(*map(int, v.split(":")))}


def test_smaller_document_holds_part_of_the_passage(spark):
    r = random.Random(1)
    rows, groups = [], 30
    for k in range(groups):
        shared = words(r, 50)
        other = shared.copy()
        if k % 3 == 0:
            other[r.randrange(15, 35)] = "changed"  # 41 of 46 shingles stay: similarity 0.8
        rows += [(k, words(r, 40) + shared[:30] + words(r, 40)), (100 + k, words(r, 30) + shared + words(r, 60)), (200 + k, words(r, 70) + other + words(r, 20)), (300 + k, words(r, 20) + shared[20:] + words(r, 20))]
    got = found(spark, rows)
    for k in range(groups):
        assert got[k].n_dup_words == got[300 + k].n_dup_words == 0
        if k % 3:
            assert got[100 + k].component_id == got[200 + k].component_id == 100 + k
            assert covered(got[100 + k]) >= set(range(30, 80)) and covered(got[200 + k]) >= set(range(70, 120))
    near = sum(got[200 + k].component_id == 100 + k for k in range(0, groups, 3))
    assert near >= 7  # of 10; two of four functions agree with probability 0.97 or more


def test_members_of_one_key_in_two_groups(spark):
    r = random.Random(2)
    shared = [words(r, 70) for _ in range(12)]
    rows = []
    for k, s in enumerate(shared):  # overlapping parts: 0-55 of the leader, 15-70 and all of it later
        rows += [(k, s[:35] + words(r, 50)), (100 + k, words(r, 20) + s[15:]), (200 + k, words(r, 33) + s[15:] + words(r, 9))]
    got = found(spark, rows)
    for k in range(len(shared)):
        assert got[k].n_dup_words == 0
        assert got[200 + k].component_id == 100 + k and covered(got[200 + k]) >= set(range(33, 88))


def test_second_passage_far_from_the_roots_met(spark):
    r = random.Random(3)
    rows = []
    for k in range(10):
        one, two = words(r, 60), words(r, 50)
        rows += [(k, words(r, 20) + two[:40] + words(r, 20) + two[10:] + words(r, 9))]
        rows += [(100 + k, one + words(r, 400) + two), (200 + k, words(r, 7) + one + words(r, 300) + two)]
    got = found(spark, rows)
    for k in range(10):
        assert covered(got[100 + k]) >= {*range(60), *range(460, 510)}
        assert covered(got[200 + k]) >= {*range(7, 67), *range(367, 417)}


def edited(r, passage, kind, places):
    """The passage with one or two words put in, left out or changed at each of the places."""
    out = list(passage)
    for at in sorted(places, reverse=True):
        if kind == "insert":
            out[at:at] = words(r, 2)
        elif kind == "delete":
            del out[at]
        else:
            out[at] = "changed" + str(r.randrange(10**6))
    return out


def plain_links(rows, shingle=5, words_=50, percent=80):
    """Pairs of documents with windows of at least ``words_`` words on one side whose shingles reach the similarity with some window of the other."""
    sets = {d: [tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] for d, w in rows}
    width, out = words_ - shingle + 1, set()
    for d, x in sets.items():
        for o, y in sets.items():
            if d >= o or len(set(x) & set(y)) * (100 + percent) < percent * 2 * width * 0.9:
                continue
            for one, two in ((x, y), (y, x)):
                for a in range(len(one) - width + 1):
                    part = set(one[a : a + width])
                    for b in range(len(two)):
                        for n in range(width * percent // 100, width * 100 // percent + 1):
                            if b + n <= len(two):
                                other = set(two[b : b + n])
                                both = len(part & other)
                                if 100 * both >= percent * (len(part) + len(other) - both):
                                    out.add((d, o))
                                    break
                        if (d, o) in out:
                            break
                    if (d, o) in out:
                        break
    return out


def test_edits_on_either_side(spark):
    """Every kind of edit, in the text with the smaller or with the larger id, against a search of all windows of all pairs."""
    r = random.Random(12)
    rows, kinds = [], {}
    for n, (kind, size, places) in enumerate([("insert", 50, [25]), ("insert", 60, [20]), ("insert", 80, [20, 55]), ("delete", 60, [30]), ("delete", 80, [25, 50]), ("change", 50, [24]), ("change", 80, [15, 40, 65])]):
        for side in range(2):
            for k in range(6):
                one, two = (passage := words(r, size)), edited(r, passage, kind, places)
                if side:
                    one, two = two, one
                at = 1000 * n + 100 * side + 2 * k
                rows += [(at, words(r, 12) + one + words(r, 9)), (at + 1, words(r, 5) + two + words(r, 15))]
                kinds[at] = kind, side
    got, links = found(spark, rows), plain_links(rows)
    seen = {}
    for at, kind in kinds.items():
        linked = got[at].component_id == got[at + 1].component_id
        assert not linked or (at, at + 1) in links
        if (at, at + 1) in links:
            seen.setdefault(kind, []).append(linked)
    for kind, hits in seen.items():
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits), len(hits))
    assert {k for k, h in seen.items() if len(h) >= 6} >= {("insert", 0), ("insert", 1), ("delete", 0), ("delete", 1), ("change", 0), ("change", 1)}


def test_passage_whose_start_also_stands_earlier():
    import numpy as np

    from pairloom.llm import substring_dedup as s

    r = np.random.default_rng(4)

    def some(n):
        return r.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")

    licence, more = some(36), some(10)
    x = np.concatenate([some(30), licence, more])
    y = np.concatenate([licence, some(500), licence, more, some(20)])
    assert any(a <= 30 and b >= 76 and c <= 536 and d >= 582 for a, b, c, d in s.passages(x, y, 46, 80))
    y = np.concatenate([x, some(700), x])  # both places count
    places = {k for *_, c, d in s.passages(x, y, 46, 80) for k in range(c, d)}
    assert places >= {*range(76), *range(776, 852)}


def plain_windows(values, width):
    """Nodes of the Cartesian tree, one by one; of equal minima the middle one is the root."""
    out, todo = [], [(0, len(values) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 >= width:
            c = min(range(a, b + 1), key=lambda k: (values[k], abs(k - a - (b - a) // 2), k))
            out.append((a, c, b))
            todo += [(a, c - 1), (c + 1, b)]
    return out


def batch_of(rows):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("key", pa.int64()), ("ac", pa.int64()), ("hb", pa.int64())]))
    lists = [[{"key": k, "ac": a << 32 | c, "hb": h << 32 | b} for k, h, a, c, b in ws] for _, ws in rows]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(lists, kind)], names=["d", "ws"])


def test_pairs_of_windows_against_all_pairs():
    import numpy as np

    from pairloom.llm import substring_dedup as s

    class Rows:
        def mapInArrow(self, run, kind):
            return run

    r, width = np.random.default_rng(6), 7
    for _ in range(15):
        rows = []
        for d in range(int(r.integers(1, 5))):
            n = int(r.integers(5, 150))
            rows.append((d + 5, [(int(r.integers(-1 << 62, 1 << 62)), k, *w) for k in range(4) for w in plain_windows(r.integers(0, n, n).tolist(), width)]))
        want = []
        for d, ws in rows:
            for _, h, a, c, b in ws:
                for _, h2, a2, c2, b2 in ws:
                    lo, hi = max(a, a2, max(c, c2) - width + 1), min(b, b2, min(c, c2) + width - 1) - width + 1
                    if h < h2 and lo <= hi:
                        want.append((d, lo, hi))
        got = [tuple(x.values())[1:] for out in s.combined(Rows(), width)(iter([batch_of(rows)])) for x in out.to_pylist()]
        assert sorted(got) == sorted(want)


def test_windows_of_many_texts_against_single_trees():
    import numpy as np

    from pairloom.llm import substring_dedup as s

    r = np.random.default_rng(9)
    for turn in range(60):
        width = int(r.choice([1, 2, 7, 46]))
        sizes = r.integers(width, width + int(r.integers(1, 200)), int(r.integers(1, 6)))
        h = r.integers(0, int(r.choice([2, 30, 1 << 62])), sizes.sum(), dtype=np.uint64)
        first = np.cumsum(sizes) - sizes
        got = sorted(zip(*(v.tolist() for v in s.many_windows(h, first, first + sizes - 1, width)), strict=True))
        assert got == sorted((a + f, c + f, b + f) for f, n in zip(first.tolist(), sizes.tolist(), strict=True) for a, c, b in plain_windows(h[f : f + n].tolist(), width))


def test_refined_keys_meet_counterparts_only(spark):
    """Passages with one edit share a refined key with their counterpart; copies with several edits of their own, which share sub-keys but don't match, hardly any."""
    from pyspark.sql import functions as F

    from pairloom.llm import substring_dedup as s
    from pairloom.llm.ngram_join import shingle_lists

    def refined(texts):
        tokens = [(d, (next(iter(shingle_lists([" ".join(w).encode()], 5)))[0] >> 32).astype("<u4").tobytes()) for d, w in texts]
        read = spark.createDataFrame([(d, bytearray(t)) for d, t in tokens], "d long, t binary")
        whole = read.selectExpr("d", f"array(named_struct('lo', 0, 'hi', cast(length(t) / 4 as int) - {width})) rs", "t")
        each = s.sub_keys(whole, width, 80)
        rows = each.groupBy("d").agg(F.collect_list(F.struct("sk", "p", F.lit(True).alias("stays"))).alias("rs"))
        return each, s.refined(rows.join(read, "d").select("d", "rs", "t"), width, 80, 5).where("counts")

    def pairs(rows):
        return {(x.a, x.b): x.n for x in rows.selectExpr("sk", "d a").join(rows.selectExpr("sk", "d b"), "sk").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).collect()}

    r, width = random.Random(21), 46
    texts, at = [], 0
    for kind, places in [(k, [p]) for k in ("insert", "delete", "change") for p in range(6, 45, 3)]:
        one = words(r, 50 + (kind == "delete"))
        two = edited(r, one, kind, places)
        del two[places[0] : places[0] + (kind == "insert")]  # one word put in
        texts += [(at, one), (at + 1, two)]
        at += 2
    each, fine = refined(texts)
    assert {(k, k + 1) for k in range(0, at, 2)} <= set(pairs(each)) <= set(pairs(fine))
    base = words(r, 50)
    copies = [(k, edited(r, base, "change", sorted(r.sample(range(8, 42), 3)))) for k in range(60)]
    each, fine = (sum(pairs(x).values()) for x in refined(copies))
    assert each > 5000 and fine < each / 10
    assert refined([(1, ["the"] * 60)])[1].count()  # repeats: the sub-key itself
