"""Alignment of two tokenizers against whole-text encoding and sets of byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def plain(files, rows):
    """Every document encoded whole; ends as sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    from pairloom.llm.bpe import byte_letters

    a, b = Tokenizer.from_str(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_letters())}
    spell_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx, by = [spell_a(i) for i in x], [spell_b(i) for i in y]
        if not text or b"".join(bx) != whole or b"".join(by) != whole:
            out.append([doc_id, 0, 0, 0, ""])
            links.append([])
            continue
        ex, ey = np.cumsum([len(v) for v in bx]).tolist(), np.cumsum([len(v) for v in by]).tolist()
        both = sorted(set(ex) & set(ey))
        gx, gy = defaultdict(list), defaultdict(list)
        for ids, ends, g in ((x, ex, gx), (y, ey, gy)):
            for i, e in zip(ids, ends, strict=True):
                g[next(c for c in both if c >= e)].append(i)
        said = ";".join(",".join(map(str, gx[c])) + "|" + ",".join(map(str, gy[c])) for c in both)
        out.append([doc_id, len(x), len(y), len(both), hashlib.sha256(said.encode()).hexdigest()])
        links.append([(x[ex.index(c)], y[ey.index(c)]) for c in both])
    count = Counter(p for ls in links for p in ls)
    most = Counter()
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    return [(d, na, nb, g, g, sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), h) for (d, na, nb, g, h), ls in zip(out, links, strict=True)]


def test_align(spark, files, monkeypatch):
    from pairloom.llm import alignment

    r = random.Random(5)
    odd = ["<|endoftext|> in text", "▁ looks like a blank", " lead", "trail ", "  two  blanks  ", "\n\n a\n b \t c", "x  y  z 　 w", "日本語 テキスト🙂", "<s> </s> <unk> <0x41>", "é" * 50, " ", "  a", "\x00 b", "a\x1c b"]
    words = ["the", "running", "ñandú", "re-entry", "12345", "don't", "\n", " ", "\t", "»", " ", "🙂"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100 + k, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for k in range(60)]
    rows += [(None, "no id"), (1, None), (2, ""), (100, rows[20][1]), (100, rows[20][1])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, pairs string").repartition(3)
    got = sorted(map(tuple, alignment.align(docs, *files).collect()), key=str)
    assert got == sorted(plain(files, rows), key=str)
    assert alignment.align(docs.limit(0), *files).count() == 0


def test_long_text_in_parts(files, monkeypatch):
    from pairloom.llm import alignment

    monkeypatch.setattr(alignment, "PART", 200)
    both, text = alignment.Pair(*files), "word after word, and\nlines   too " * 60
    whole, parts = alignment.Text(1), alignment.Text(1)
    whole.add(next(both.group([b" " + text.encode()])))
    cut = both.cut(text.encode())
    for out in both.group(cut):
        parts.add(out)
    assert len(cut) > 5 and b"".join(cut) == b" " + text.encode()
    assert whole.row()[:4] == parts.row()[:4] and (whole.row()[4] == parts.row()[4]).all()
    assert whole.row()[3] == plain(files, [(1, text)])[0][-1]


def test_merge_path():
    from pairloom.llm import alignment

    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 60, r.integers(0, 40))) for _ in range(2))
        for work in (1, 2, 5, 100):
            i, j = alignment.diagonal_cuts(a, b, work)
            assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
            x, y = alignment.common_ends(a, b, work)
            assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()
