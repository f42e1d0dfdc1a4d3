"""Every stage of the pipeline, and the whole of it, against plain versions on a small corpus with odd rows."""

import hashlib
import re

import pytest

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ODD = [
    (100001, None, "en", None, None), (100002, "", "en", "s", 0), (None, "no id here", None, "s", 10), (100003, "one two\nthree\nfour", "en", "s", 18), (100003, "one two\nthree\nfour", "en", "s", 18),
    (100004, "the same id", "en", "s", 11), (100004, "but another text", "en", "s", 16), (None, "no id here", None, "s", 10),
]


@pytest.fixture(scope="module")
def corpus(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*COLUMNS)
    docs.unionByName(spark.createDataFrame(ODD, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def table(spark, rows, like):
    return spark.createDataFrame(rows, like.schema)


def plain_quality(spark, docs, folder, rows):
    from pairloom.llm import quality_classifier as q

    model = q.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [r for r in rows if model.score(*q.encode([(r[1] or "").encode()]))[0] >= 0.3]


def plain_lines(rows):
    seen, first, gone = {}, {}, {}
    for r in rows:
        if r[1] is None:
            continue
        lines = [(k, v) for k, v in enumerate(r[1].split("\n")) if re.search(r"[^\x20\x09-\x0D]", v)]
        for k in range(len(lines) - 2):
            window = tuple(v for _, v in lines[k : k + 3])
            seen.setdefault(window, []).append((r[0], r[1], [i for i, _ in lines[k : k + 3]]))
    for places in seen.values():
        first = min(((d is not None, d or 0, i) for d, _, i in places), key=lambda p: p[:2] + (p[2][0],))
        for d, t, i in places:
            if (d is not None, d or 0, i) != first:
                gone.setdefault((d, t), set()).update(i)
    out = []
    for r in rows:
        lost = gone.get((r[0], r[1]), set())
        n = sum(bool(re.search(r"[^\x20\x09-\x0D]", v)) for v in (r[1] or "").split("\n"))
        if lost and len(lost) == n:
            continue
        text = None if r[1] is None else "\n".join(v for k, v in enumerate(r[1].split("\n")) if k not in lost)
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def plain_near_copies(rows):
    sets, parent = [], {}
    for r in rows:
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), r[1] or "")
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", w) if v]
        sets.append((r[0], frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    left = [r for r in rows if r[0] is None or find(r[0]) == r[0]]
    return list({(r[0], r[1]): r for r in reversed(sorted(left, key=lambda r: tuple(str(v) for v in r[2:])))}.values())


def plain_benchmark(rows, items):
    def words(t):
        return [v for v in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")) if v]

    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[k : k + n]) in windows for w in [words(r[1])] for n in sizes for k in range(len(w) - n + 1))]


def test_stages_against_plain_versions(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    steps = [("quality", lambda rs, df: plain_quality(spark, df, corpus, rs)), ("lines", lambda rs, df: plain_lines(rs)), ("near_copies", lambda rs, df: plain_near_copies(rs)), ("benchmark", lambda rs, df: plain_benchmark(rs, items))]
    now = docs
    for (name, plain), (stage_name, stage) in zip(steps, p.STAGES, strict=False):
        assert name == stage_name
        got = rows_of(stage(spark, now, corpus))
        want = sorted(plain(rows, now), key=repr)
        assert got == want, name
        assert 0 < len(want) < len(rows) and stage(spark, now.limit(0), corpus).count() == 0
        rows, now = want, table(spark, want, docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in rows:
        e = tokenizer.encode(r[1] or "", add_special_tokens=False)
        expected.append((r[0], len(e.ids), hashlib.sha256(tokenizer.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    out = p.run(spark, corpus)
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out.collect()), key=repr) == sorted(expected, key=repr)
