"""Small goldens of column functions and of operators without SQL."""

import html

from pyspark.sql import functions as F

from pairloom.functions import match as M
from pairloom.functions import text as X
from pairloom.operators import feed, matching


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if isinstance(v, type(F.lit(1))) else F.lit(v))
    return df.select(col.alias("v")).first()["v"]


def test_clean_html(spark):
    page = "&lt;div&gt;Hello &amp;amp; welcome&lt;script&gt;x &lt; y&lt;/script&gt;&lt;p&gt; a   b&lt;/p&gt;&lt;/div&gt;<br>Apply now<li>last"
    assert one(spark, X.clean_html(F.col("t")), t=page) == "Hello & welcome\na b\nlast"
    assert one(spark, X.clean_html(F.col("t")), t="  ") is None
    coded = "caf&#233; don&#8217;t &copy; &#x20AC; &#X1F642; &notit; &amp;lt; &frac12x &#128; &#0; &#1234567890; &bogus; & &;&#; R&D&nbsp;x&hellip"
    assert one(spark, X.unescape(F.col("t")), t=coded) == html.unescape(coded)
    assert one(spark, X.clean_html(F.col("t")), t=f"<p>{coded}</p>") == " ".join(html.unescape(html.unescape(coded)).split(" "))


def test_amounts(spark):
    def both(text):
        got = one(spark, X.comp_range_or_single(F.col("t")), t=text)
        return got["low"], got["high"]

    assert both("pay $120k - $150k") == (120000, 150000) and both("$120,000 to 150,000") == (120000, 150000) and both("from $90K up") == (90000, None)
    assert both("$40-50 an hour, all") == (40, 50) and both("pay 120k") == (None, None) and both("OK $40-50 per") == (40000, 50000)


def test_employer_claims(spark):
    from pairloom.operators import claims

    roles = F.array(F.struct(F.lit("Globex, Inc.").alias("employer")), F.struct(F.lit(None).cast("string").alias("employer")))
    none = F.array().cast("array<struct<kind:string,text:string,skill_id:string>>")

    def unknown(text, employers=()):
        named = F.array(*map(F.lit, employers)).cast("array<string>")
        return one(spark, claims.unknown_employer(claims.claimed_employers(named, none, F.lit(text)), roles))

    assert not unknown("worked at Globex Corp. then @ Globex") and unknown("worked at Hooli XYZ") and not unknown("at home")
    assert not unknown("at Hooli", ["GLOBEX LLC"]) and unknown("", ["Hooli"])


def test_null_filters_pass(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, M.p_location(F.col("a"), F.col("b")), a=none, b="Paris") is True
    assert one(spark, M.p_title(F.array(F.lit("/x")), F.col("b")), b="anything") is True  # an empty token fits every title
    assert one(spark, M.p_arrangement(F.array(F.lit("Remote")), F.col("b")), b="remote") is False  # case matters


def test_top_per_user_uses_up_places(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7)], "user_id long, job_id long, score double")
    used = spark.createDataFrame([(1, 3)], "user_id long, n long")
    done = spark.createDataFrame([(1, 10)], "user_id long, job_id long")
    assert [r.job_id for r in matching.top_per_user(pairs, used, done, 5, 5).collect()] == [11]
    assert matching.top_per_user(pairs, used, done, 5, 3).count() == 0


def test_rerank_falls_back(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, None)], "user_id long, job_id long, score double")

    def broken(pdf):
        raise RuntimeError

    def odd(pdf):  # a row that isn't there, one twice, one without a number
        return [(7, 1.0), (1, 0.4), (1, 0.1), (0, None)]

    assert [(r.job_id, r.rank) for r in matching.rerank(pairs, scorer=broken).orderBy("rank").collect()] == [(10, 1), (11, 2)]
    assert [(r.job_id, r.rank) for r in matching.rerank(pairs, scorer=odd).orderBy("rank").collect()] == [(11, 1)]


def test_greedy_match(spark):
    from pairloom.operators import profiles

    rows = [(1, ["red green", "red", "blue"], ["red", "green red", "red green x"]), (2, [], ["a"]), (3, ["a", "a"], ["a"]), (4, ["", "b c d e"], ["", "b"])]
    df = spark.createDataFrame(rows, "item long, pred array<string>, gold array<string>")
    got = {r.item: (r.tp, r.fp, r.fn) for r in profiles.greedy_match(df, 0.5).collect()}
    assert got == {1: (2, 1, 1), 2: (0, 0, 1), 3: (1, 1, 0), 4: (1, 1, 1)}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "t0")], "k long, title string, at string")
    new = spark.createDataFrame([(1, "b", "t1"), (2, "c", "t1")], "k long, title string, at string")
    once = feed.upsert(old, new, ["k"], keep=("at",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, feed.upsert(once, new, ["k"], keep=("at",)).collect())) == [(1, "b", "t0"), (2, "c", "t1")]


def test_compatible_letters(spark):
    from pairloom.operators import linking

    df = spark.createDataFrame([(1, "ＦＩＮＥ ﬁsh Straße Ⅷ ① C++"), (2, None), (3, "")], "k long, t string")
    got = {r.k: r.v for r in df.select("k", X.normalize_label(linking.nfkc(F.col("t"), spark)).alias("v")).collect()}
    assert got == {1: "fine fish strasse viii 1 c++", 2: None, 3: ""}


def test_scan_terms_of_every_size(spark, monkeypatch):
    from pairloom.operators import linking

    docs = spark.createDataFrame([(1, "Big data, and the big DATA lake"), (2, "lake"), (3, None), (4, "data lake data lake house")], "k long, t string")
    terms = spark.createDataFrame([("a", "big data"), ("a", "data"), ("b", "Data Lake House"), ("c", "it"), ("d", "lake")], "skill_id string, term string")
    want = [(1, "a", "big data"), (1, "d", "lake"), (2, "d", "lake"), (4, "a", "data"), (4, "b", "data lake house"), (4, "d", "lake")]
    for few, most in ((200, 200), (0, 200), (0, 0)):
        monkeypatch.setattr(linking, "FEW_TERMS", few)
        monkeypatch.setattr(linking, "MOST_TERMS", most)
        assert sorted(map(tuple, linking.scan_terms(docs, "k", "t", terms).collect())) == want


def test_segment_resume(spark):
    from pairloom.operators import profiles

    text = "Jane\n- Cook at Cafe\n01/2019 to present\n* stirred\nSkills: \n## SKILLS\nA, B\nEmployment:\n**Chef — Bistro**\n- 2001 - 2002 x"
    rows = {r.role: r for r in profiles.segment_resume(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()}
    assert (rows[1].title, rows[1].employer, rows[1].start, rows[1].end, rows[1].bullets) == ("- Cook", "Cafe", "01/2019", None, ["stirred"])
    assert (rows[2].title, rows[2].employer) == ("Chef", "Bistro") and len(rows) == 3  # the dated bullet reads like a heading


def test_folding_and_embedding_go_through_a_batch_in_slices(spark):
    """One batch of many texts was one list of Python strings before."""
    from pyspark.sql import functions as F

    from pairloom.operators import linking, profiles

    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("ẞﬁ Ⅷ "), "id")).alias("t"))
    folded = rows.select("id", linking.nfkc(F.col("t"), spark).alias("t")).collect()
    assert len(folded) == 1000 and all(r.t == (f"ssfi viii {r.id}" if r.id % 7 else None) for r in folded)

    def model(texts):
        assert len(texts) <= profiles.TEXTS < 1000
        return [[len(x)] for x in texts]

    got = profiles.embed(rows, "id", "t", model, 1, most_chars=7).collect()
    assert len(got) == 1000 and all((r.embedding, r.too_long) == ([float(len(f"ẞﬁ Ⅷ {r.id}")) if r.id % 7 else 0.0], r.id % 7 > 0 and r.id > 99) for r in got)


def test_profile_text_at_the_edge_of_its_room(spark):
    """The short way for texts that fit gives what dropping lines one by one gives, down to the last letter."""
    from pairloom.operators import profiles

    roles = [("A at B", ["x" * 5, "yy"]), ("C at D", ["z", "w" * 9])]

    def plain(room):
        order = [(k, j, line) for k in (1, 0) for j, line in enumerate([roles[k][0], *("- " + b for b in roles[k][1])])]
        kept, used = [], 0
        for n, (k, j, line) in enumerate(order):
            used += len(line) + 1
            if n and used > room:
                break
            kept.append((k, j, line))
        return "\n".join(v[2] for v in sorted(kept))

    df = spark.createDataFrame([(1, "H", roles), (2, "H", [])], "user_id long, header string, roles array<struct<heading:string,bullets:array<string>>>")
    fixed = len("H" + "\n\nExperience:\n\n")
    for room in (1, 20, 42, 43, 44, 45, 60):
        got = {r.user_id: r.doc for r in profiles.profile_doc(df, fixed + room).collect()}
        assert got == {1: f"H\n\nExperience:\n{plain(room)}\n", 2: "H\n\nExperience:\n\n"}
