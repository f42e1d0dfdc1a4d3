"""Disclosure counts documents on both sides."""


def terms_of(spark, texts):
    from pairloom.llm import pii

    out = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.n_term for r in out}


def test_copies_do_not_hide_a_disclosure(spark):
    plain = [f"filler number{'abcdefgh'[k % 8] * (k // 8 + 1)} of plain text" for k in range(300)]
    told = [f"{w} zorbleck ann@example.org {v}" for w, v in (("first", "one"), ("second", "two"), ("third", "three"))]
    got = terms_of(spark, [*told, *[told[0]] * 20, *plain])
    assert all(got[k] >= 1 for k in range(23)) and not any(got[k] for k in range(23, 323))


def test_contexts_of_one_text_do_not_outweigh_clean_texts(spark):
    plain = [f"filler number{'abcdefgh'[k % 8] * (k // 8 + 1)} of plain text" for k in range(60)]
    far = " ".join(["gap"] * 30)
    one = f"red garden bob@example.org blue {far} green garden bob@example.org white {far} black garden bob@example.org grey"
    clean = [f"a garden with {w} in it" for w in ("roses", "tulips", "apples", "pears", "plums")]
    got = terms_of(spark, [one, *clean, *plain])
    assert not any(got[k] for k in range(1, 6))


SECRET = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def test_terms_against_plain_counts(spark):
    """Planted terms, and all thresholds against counts made in plain Python; planted precision and recall are 1."""
    import math
    import random
    import re
    from collections import defaultdict

    from pyspark.sql import functions as F

    from pairloom.llm import pii

    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120)]

    def some(n):
        return " ".join(r.choice(words) for _ in range(n))

    texts = [some(40) for _ in range(300)]
    for k in range(12):  # a nickname beside one address each, in four contexts; a label beside every secret
        nick = "nick" + chr(97 + k)
        texts += [f"{some(20)} {nick} wrote from user{k}@example.org {some(20)}" for _ in range(4)]
        texts += [f"{some(10)} pass: {SECRET[k:]}{SECRET[:k]} {some(10)}", f"{nick} {some(4)} was here"] if k % 2 else [f"{some(10)} pass: {SECRET[k:]}{SECRET[:k]} {some(10)}"]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, term string").selectExpr("*", "1 d", "2 x", "3 t", "4 email", "5 secret")
    docs = rows.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"), F.col("text").alias("t"))
    spotted = docs.select("d", "x", "t", *[pii.base_spans(k, F.col("t")).alias(k) for k in pii.FOUND])
    got = {(x.term, x.entity): (round(x.p, 6), round(x.information, 6)) for x in pii.revealing_terms(docs, spotted).collect()}

    near, holds, of = defaultdict(set), defaultdict(set), defaultdict(set)
    contexts = defaultdict(set)
    for d, t in enumerate(texts):
        for w in re.findall(r"[a-z]+", t):
            holds[w].add(d)
        for kind, pattern in (("email", r"[a-z0-9]+@example\.org"), ("secret", r"[0-9a-f]{32}")):
            for m in re.finditer(pattern, t):
                left = re.split(r"[^a-z]+", t[max(0, m.start() - 120) : m.start()])[-6:]
                right = re.split(r"[^a-z]+", t[m.end() : m.end() + 120])[:6]
                context = [w for w in left + right if len(w) >= 3]
                for e in (kind, f"{kind}:{m[0]}"):
                    of[e].add(d)
                    for w in set(context):
                        near[e, w].add(d)
                        contexts[e, w].add(tuple(context))
    expected = {}
    for (e, w), ds in near.items():
        p = len(ds) / len(holds[w])
        info = math.log2(p * len(texts) / len(of[e]))
        if len(contexts[e, w]) >= 3 and p >= (0.5 if ":" in e else 0.8) and info >= 3:
            expected[w, e] = (round(p, 6), round(info, 6))
    assert got == expected
    assert {w for w, _ in got if w.startswith("nick") or w == "pass"} == {"pass", *("nick" + chr(97 + k) for k in range(12))}
    out = {x.doc_id: x for x in pii.report(rows).collect()}
    assert all((out[d].n_spans > 0) == bool(re.search(r"nick|@|pass|wrote", t)) for d, t in enumerate(texts))
    clean = {x.doc_id: x.text for x in pii.sanitise(rows).collect()}
    for d, t in enumerate(texts):
        want = re.sub(r"[a-z0-9]+@example\.org", "[EMAIL]", re.sub(r"[0-9a-f]{32}", "[SECRET]", t))
        for w in {w for w, _ in got}:
            want = re.sub(rf"\b{w}\b", "[TERM]", want)
        assert clean[d] == want


def test_secrets_and_base_spans_against_plain_patterns(spark):
    import random
    import re

    from pairloom.llm import pii

    r = random.Random(8)
    parts = ["ann@a.example", "x.y@b.co.uk", "1.2.3.4", "300.1.1.1", "10.0.0.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (327) 555-3642", "+49 30 1234567", "+1 2", SECRET,
             "a" * 40, "internationalisation-of-words", "tok_4hF9xQ2LmZ8sT1vW7yB3", "é", "word", "@", "1234567", ",", "\n", "-", "e@", "9" * 18]
    texts = ["".join(r.choice(parts) + r.choice([" ", "", " ", ", "]) for _ in range(r.randint(0, 14))) for _ in range(600)]

    def luhn(v):
        d = [int(c) for c in reversed(v) if c.isdigit()]
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0

    def size(v):
        return sum(c.isdigit() for c in v)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= size(v) <= 19 and luhn(v)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= size(v) <= 15),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.report(df, support=10**6).collect():
        t = texts[row.doc_id]
        want = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]
        assert [v for v in row.spans.split(",") if v and not v.startswith("secret")] == want
    many = spark.createDataFrame([(1, "key tok_4hF9xQ2LmZ8sT1vW7yB3 x"), (2, "a" * 40 + " internationalisation-of-words 1234567890123456789012"), (3, f"({SECRET})")], "doc_id long, text string")
    assert {x.doc_id: x.n_secret for x in pii.report(many).collect()} == {1: 1, 2: 0, 3: 1}
