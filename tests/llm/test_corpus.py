"""Operators across texts against brute force."""

import hashlib
import random

import pytest

R = random.Random(4)
WORDS = [f"w{k}" for k in range(400)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def near(t, edits):
    w = t.split()
    for _ in range(edits):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = [text(120) for _ in range(6)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(20 + k, near(base[0], e)) for k, e in enumerate((1, 1, 2, 2, 3, 4, 5))]
    out += [(40, base[1]), (41, base[1]), (42, base[1].upper()), (50, None), (51, ""), (52, "one two"), (53, "ONE two"), (54, text(3000)), (None, base[2]), (60, "same same " * 40), (61, "same same " * 40), (62, "lonely")]
    out += [(70, f"{text(80)} {base[3][:400]} {text(60)}"), (70, "other text of the same id")]
    return out


def brute(rows, n, percent):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in parent}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, rows, n, percent):
    from pairloom.llm import ngram_join as j

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = j.join_components(df, n=n, percent=percent).collect()
    assert len(got) == len(rows)
    expected = brute(rows, n, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert j.join_components(df.limit(0)).count() == 0


def test_components(spark):
    from pairloom.llm.common import components

    links = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 70: 50, 100: 50}


def test_passages(spark, rows):
    from pairloom.llm import substring_dedup as s

    shared = text(60)
    more = [(200, f"{text(90)} {shared} {text(40)}"), (201, f"{shared} {text(300)}"), (202, text(200)), (203, f"{text(30)} {text(20)}")]
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    got = {r.doc_id: r for r in s.near_duplicates(df).collect()}
    assert got[200].component_id == got[201].component_id == 200 and got[201].spans.startswith("0:6")
    assert got[202].n_dup_words == got[203].n_dup_words == got[62].n_dup_words == 0
    assert got[41].component_id == 1 and got[60].component_id == got[61].component_id == 60
    assert got[50].n_words == 0 and got[None].spans == ""
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_lines(spark):
    from pairloom.llm import line_dedup as d

    block = "alpha one\nbeta two\n\ngamma three\ndelta four"
    rows = [(1, f"x\n{block}\ny", 0), (2, f"{block}\nz", 0), (3, None, 0), (4, "", 0), (5, "alpha one\nbeta two", 0), (None, "q\nr\ns", 0), (6, "a\na\na\na\na", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = {r.doc_id: r for r in d.dedup_lines(df).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "\nz" and (out[2].n_lines, out[2].n_removed) == (5, 4)
    assert out[3].text is None and out[4].text == "" and out[5].n_removed == 0 and out[None].n_removed == 0
    assert out[6].n_removed == 4 and out[6].text == "a"
    assert d.dedup_lines(df.limit(0)).count() == 0


def test_decontamination(spark):
    from pairloom.llm import decontamination as c

    item = "The quick brown fox jumps over the lazy dog and runs far away"
    docs = [(1, f"so {item.upper()}! end", "k"), (2, "quick brown fox", "k"), (3, None, "k"), (4, "", "k"), (5, "Short, ITEM here", "k"), (None, item, "k"), (1, "clean text", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    items = spark.createDataFrame([(10, item), (9, item + " now"), (8, "short item"), (7, None), (6, "  ")], "item_id long, text string")
    out = {(r.doc_id, r.n_words): r for r in c.report(df, items).collect()}
    assert out[1, 15].n_hit == 13 and out[1, 15].n_items == 2
    assert out[1, 15].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert out[5, 3].n_hit == 2 and not out[2, 3].contaminated and out[3, 0].n_hit == 0 and not out[1, 2].contaminated
    assert sorted(str(r.doc_id) for r in c.remove_documents(df, items).collect()) == ["1", "2", "3", "4"]
    assert c.report(df.limit(0), items).count() == 0 and c.report(df, items.limit(0)).where("n_hit > 0").count() == 0


def test_pipeline_runs(spark, data):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, data)
    assert 0 < out.count() < spark.read.parquet(f"{data}/documents.parquet").count()
