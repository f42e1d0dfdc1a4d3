"""Edge cases: clashing columns, equal ids, repeated rows, and a join that may not broadcast."""

import random

import pytest

R = random.Random(9)
WORDS = [f"w{k}" for k in range(300)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("most", [0, 500_000])
def test_decontamination_without_broadcast(spark, most):
    from pairloom.llm import decontamination as c

    item, short = "one two three four five six seven eight nine ten eleven", "tiny Item"
    long = " ".join([text(3000), item, text(2000), item])
    rows = [(1, f"x {item} y", "a"), (1, f"x {item} y", "b"), (2, "a tiny item here", "c"), (3, long, "d"), (None, item, "e"), (4, None, "f"), (5, "", "g"), (6, "one two three four five six seven eight nine", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").selectExpr("doc_id", "text", "h", "h d", "h x", "1 hash", "2 size", "3 items", "4 n_words")
    items = spark.createDataFrame([(1, item), (2, short), (3, None)], "item_id long, text string")
    got = sorted((str(r.d), r.n_words, r.n_hit, list(r.hit_items)) for r in c.scan(df, items, most_broadcast=most).collect())
    assert got == sorted([("1", 13, 11, ["1"]), ("1", 13, 11, ["1"]), ("2", 4, 2, ["2"]), ("3", 5022, 22, ["1"]), ("None", 11, 11, ["1"]), ("4", 0, 0, []), ("5", 0, 0, []), ("6", 9, 0, [])])


def test_lines_of_long_text_and_clashing_columns(spark):
    from pairloom.llm import line_dedup as d

    block = "\n".join(f"line number {k}" for k in range(2000))
    rows = [(1, block, "u"), (2, block + "\nnew one", "v"), (2, block + "\nnew one", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string").selectExpr("doc_id", "text", "gone", "gone h", "gone d", "gone x", "gone r", "gone stay", "gone l0")
    out = {r.gone: r for r in d.dedup_lines(df).collect()}
    assert out["u"].n_removed == 0 and out["v"].text == out["w"].text == "new one" and out["v"].n_removed == 2000
    assert out["v"].stay == "v" and d.dedup_lines(df).columns[:2] == ["doc_id", "text"]


def test_join_of_an_id_with_several_texts(spark):
    from pairloom.llm import ngram_join as j

    one, two = text(60), text(60)
    rows = [(10, one), (70, one), (70, two), (90, two), (5, text(60)), (None, one), (None, text(9)), (10, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 d", "2 n", "3 digest", "4 rep", "5 component")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in j.join_components(df).collect()}
    assert got[90, 56] == got[70, 56] == got[10, 56] == got[None, 56] == 10 and got[5, 56] == 5 and got[None, 5] is None


def test_passages_inside_one_text_and_clashing_columns(spark):
    from pairloom.llm import substring_dedup as s

    part = text(60)
    rows = [(1, f"{part} {text(90)} {part}"), (2, text(200)), (2, text(10)), (3, None), (4, " ".join(["same"] * 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 d", "2 n", "3 key", "4 lead", "5 spans")
    got = {(r.doc_id, r.n_words): r for r in s.near_duplicates(df).collect()}
    assert len(got) == 5 and all(r.n_dup_words == 0 for r in got.values())
    assert got[1, 210].n_inner_words == 60 and got[2, 200].n_inner_words == 0 and got[4, 300].n_inner_words == 299


def test_stitched_passages(spark):
    """Passages made of sentences that many smaller documents hold: no link and no span may be lost."""
    from pairloom.llm import substring_dedup as s

    r = random.Random(5)
    words = [f"v{k}" for k in range(60000)]

    def some(n):
        return [r.choice(words) for _ in range(n)]

    sentences = [some(20) for _ in range(150)]
    rows = [(k, some(40) + sentences[k % 150] + some(40)) for k in range(450)]
    for k in range(60):
        passage = sum((r.choice(sentences) for _ in range(3)), [])
        rows += [(1000 + k, some(30) + passage + some(20)), (2000 + k, some(50) + passage + some(5))]
    got = {x.doc_id: x for x in s.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert all(got[k].n_dup_words == 0 for k in range(450))
    for k in range(60):
        assert got[2000 + k].component_id == got[1000 + k].component_id <= 1000 + k
        assert got[1000 + k].n_dup_words >= 60 and got[2000 + k].n_dup_words >= 60


def test_clashing_columns_of_single_text_operators(spark):
    import public_tokenizers

    from pairloom.llm import bpe, chat_format, quality_rules, token_output

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "some plain words"), (1, "some plain words"), (None, None)], "doc_id long, text string")
    odd = docs.selectExpr("*", "1 d", "2 ids", "3 n_words", "4 failed", "5 start", "6 shard", "7 block", "8 n_tokens", "9 words", "10 t")

    def same(make):
        return sorted(map(repr, make(docs).collect())) == sorted(map(repr, make(odd).collect()))

    assert same(lambda df: bpe.encode_decode(df, path)) and same(quality_rules.ledger) and same(lambda df: token_output.round_trip(df, path, 2))
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    more = turns.selectExpr("*", "1 segments", "2 turns", "3 k", "4 said", "5 valid", "6 n_turns")
    assert sorted(map(repr, chat_format.digest(chat_format.segments(turns)).collect())) == sorted(map(repr, chat_format.digest(chat_format.segments(more)).collect()))


def test_very_long_texts(spark):
    from pairloom.llm import chat_format, quality_rules

    long = "word " * 400_000 + "x" * 300_000
    rules = quality_rules.ledger(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert rules.n_words == 400_001 and rules.n_repeat_words == 400_000
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat_format.digest(chat_format.segments(turns)).first().loss_chars == len(long)
