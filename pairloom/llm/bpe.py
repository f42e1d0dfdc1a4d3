"""Byte-pair encoding and decoding of whole texts with a public vocabulary file, exact and in linear time.

Encoding. A text is cut at white space and into the vocabulary's pieces. For each distinct piece an Aho-Corasick
automaton lists every token that occurs in it; a backtracking walk takes the longest token at each position and keeps
it only if it is *compatible* with the token before, that is, if merging the two tokens' letters from scratch gives
exactly these two tokens. A prefix has one valid token sequence, so a position that failed once is never tried again.
Compatibility is looked up in a table that fills as pairs are met. Texts are cut in groups, by arrays of code points, so that
a piece is encoded once however often a group holds it; pieces are kept in a bounded cache.

Decoding. All token strings lie in one byte blob; an offset table gives each token's place, and a text is one gather.

Python on the executors (Arrow batches, one row in and one row out): Spark has no sub-word encoder, and the work has
no shuffle, so a lost executor costs only its own tasks.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; repeated rows
give one row each; columns other than the two named ones are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.plans.runtime import ship

#: White space of the vocabulary's own splitting, beyond the six ASCII separators (fixed values of the Unicode standard).
WIDE_SPACE = "\x85\xa0  -     　"
#: Fixed pattern of the vocabulary's pieces.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\t-\r {WIDE_SPACE}\p{{L}}\p{{N}}]+"
END = "\n"  # stands for the end-of-word mark inside this module; the byte alphabet has no line feed
MOST_CACHED = 100_000  # entries of the word cache (texts with special tokens only), and half as many of its piece cache, before they start anew
MOST_CACHED_BYTES = 64  # longer words are encoded each time


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and special tokens of a vocabulary file with an end-of-word mark."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = 1 + max(*self.ids.values(), *self.special.values())
        self.strings = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = token
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.letters: dict[int, str] = {}
        for token, i in self.ids.items():  # tokens that no merge makes
            if len(token) == 1:
                self.letters[i] = token
            elif token.endswith(mark) and len(token) == 1 + len(mark):
                self.letters[i] = token[0] + END
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, x, y = self.ids[a + b], self.ids[a], self.ids[b]
            self.rank[i], self.left[i], self.right[i], self.merged[x, y] = rank, x, y, rank
            self.letters[i] = self.letters[x] + self.letters[y]


class PieceEncoder:
    """Exact merges of one piece by backtracking over Aho-Corasick matches."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v, self.fits = vocabulary, {}
        self.length = {i: len(s) for i, s in vocabulary.letters.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in vocabulary.letters.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """True if the letters of tokens a and b, merged from scratch, give a and b again.

        Undo the younger of the two tokens' merges step by step. If, at some step, the tokens that then touch the
        border would have merged with each other before the merge just undone, the border would not exist.
        """
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        rank, before = self.v.rank, 1 << 60
        while True:
            across = self.v.merged.get((a, b))
            if across is not None and across < before:
                good = False
                break
            if rank[a] < 0 and rank[b] < 0:
                good = True
                break
            if rank[a] > rank[b]:  # equal merges run from the left: the left token's own comes first
                before, a = rank[a], self.v.right[a]
            else:
                before, b = rank[b] + 1, self.v.left[b]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode(self, letters: str) -> list[int]:
        """The longest matches from the left if they fit each other as they are, else with backtracking."""
        n, length, fits = len(letters), self.length, self.fits
        out, covered, last = [], 0, -1
        for _, token in self.automaton.iter_long(letters):
            if last >= 0:
                fit = fits.get((last, token))
                if not (self.compatible(last, token) if fit is None else fit):
                    break
            out.append(token)
            covered += length[token]
            last = token
        return out if covered == n else self.backtrack(letters)

    def backtrack(self, letters: str) -> list[int]:
        n, length = len(letters), self.length
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(letters):
            starts[end + 1 - length[token]].append(token)  # from a start, matches come shortest first
        failed, out, tried = bytearray(n + 1), [], []
        at, k = 0, len(starts[0]) - 1
        while at < n:
            here = starts[at]
            while k >= 0:
                token = here[k]
                if not failed[at + length[token]] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at += length[token]
                k = len(starts[at]) - 1
            else:
                failed[at] = 1
                if not out:
                    raise ValueError("the vocabulary can't spell this piece")
                at -= length[out.pop()]
                k = tried.pop() - 1
        return out


class WordIds(dict):
    """Ids of a word (bytes without ASCII white space) as little-endian unsigned integers; fills itself.

    ``pieces_of`` gives the ids of a piece in byte letters instead of the encoder above; ``code`` is I (32 bits) or H (16).
    """

    def __init__(self, text: str, pieces_of=None, code: str = "I"):
        import regex

        self.code = code

        self.v = Vocabulary(text)
        self.find = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")").split if self.v.special else None
        self.marks = [s[:2] for s in self.v.special]
        self.alphabet = dict(enumerate(byte_letters()))
        self.encoder = PieceEncoder(self.v) if pieces_of is None else None
        self.pieces_of = pieces_of
        self.pieces: dict[str, bytes] = {}

    def ids_of(self, letters: str) -> list[int]:
        return self.pieces_of(letters) if self.pieces_of else self.encoder.encode(letters + END)

    def normal(self, s: str) -> str:
        """Canonical composition, then lower case letter by letter (no final sigma)."""
        if s.isascii():
            return s.lower()
        return unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece.encode().decode("latin-1").translate(self.alphabet)
            found = self.ids_of(letters)
            ids = struct.pack(f"<{len(found)}{self.code}", *found)
            if len(piece) <= MOST_CACHED_BYTES:
                if len(self.pieces) >= MOST_CACHED // 2:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters only: one piece
            ids = self.piece(word.decode().lower())
            if len(word) <= MOST_CACHED_BYTES:
                if len(self) >= MOST_CACHED:
                    self.clear()
                self[word] = ids
            return ids
        s = word.decode("utf-8", "replace")
        if self.cut and any(m in s for m in self.marks):
            parts = self.cut(s)
        else:
            parts = [s]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<" + self.code, self.v.special[part]))
            else:
                out += map(self.piece, self.find(self.normal(part)))
        ids = b"".join(out)
        if len(word) <= MOST_CACHED_BYTES:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


OTHER, SPACE, LETTER, NUMBER = range(4)
ENDINGS = ("stmd", ("re", "ve", "ll"))  # fixed: what an apostrophe at the start of a piece takes along
GROUP = 1 << 20  # characters after which a group of texts ends
MOST_PIECES = 250_000  # pieces a worker keeps before it starts anew


class BatchIds:
    """Ids of many texts at once: pieces are found in an array of code points, and each distinct piece is encoded once.

    Texts are normalised, each code point gets a class, pieces are runs of a class (a number is a piece of its own), and Arrow
    numbers the distinct ones. ``pieces_of`` is as in ``WordIds``; a piece's ids are kept from group to group. Texts that hold
    a special token of the vocabulary go through ``WordIds``.
    """

    def __init__(self, text: str, pieces_of=None, code: str = "I"):
        import regex

        self.words = WordIds(text, pieces_of, code)
        self.type = "<u2" if code == "H" else "<u4"
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        every = "".join(map(chr, points))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, rf"[\t-\r {WIDE_SPACE}]+")):
            for found in regex.finditer(pattern, every):
                self.kind[points[found.start() : found.end()]] = value
        self.special = regex.compile("|".join(map(regex.escape, self.words.v.special))) if self.words.v.special else None

    def cut(self, points: np.ndarray) -> np.ndarray:
        """Starts of the pieces, and of the spaces between them."""
        kind = self.kind[points]
        start = np.ones(len(points), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero((points == ord("'")) & start)
        one, two = (np.concatenate([points, [0, 0]])[quotes + k] for k in (1, 2))
        double = np.zeros(len(quotes), bool)
        for x, y in ENDINGS[1]:
            double |= (one == ord(x)) & (two == ord(y))
        for hits, size in ((quotes[np.isin(one, list(map(ord, ENDINGS[0])))], 2), (quotes[double], 3)):
            start[hits + 1] = False
            start[hits[hits + size < len(points)] + size] = True
        return np.flatnonzero(start)

    def group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (normalised) texts, one after the other, and how many each text has."""
        whole = "\n".join([*texts, ""])
        text_ends = np.cumsum(np.array([len(t) + 1 for t in texts])) - 1
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        raw = np.frombuffer(whole.encode(), np.uint8)
        starts = self.cut(points)
        place = starts if len(raw) == len(points) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        offsets = np.concatenate([place, [len(raw)]]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        used = self.kind[points[starts]] != SPACE
        distinct = pieces.filter(pa.array(used)).dictionary_encode()
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        found = [self.pieces.get(v) or self.learn(v) for v in distinct.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.type, int(size.sum()))
        which = distinct.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n) + np.arange(ends[-1])]
        upto = ends[np.searchsorted(starts[used], text_ends)]
        return ids, np.diff(np.concatenate([[0], upto]))

    def learn(self, piece: bytes) -> tuple[int, ...]:
        ids = tuple(self.words.ids_of(piece.decode("latin-1").translate(self.words.alphabet)))
        if len(piece) <= MOST_CACHED_BYTES:
            self.pieces[piece] = ids
        return ids

    def rows(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers; null texts are empty."""
        out = [b""] * len(texts)
        part: list[tuple[int, str]] = []
        held = 0

        def close() -> None:
            ids, sizes = self.group([t for _, t in part])
            raw, ends = ids.tobytes(), np.cumsum(sizes) * ids.itemsize
            for (k, _), a, b in zip(part, ends - sizes * ids.itemsize, ends, strict=True):
                out[k] = raw[a:b]
            part.clear()

        for k, value in enumerate(texts):
            text = (value or b"").decode("utf-8", "replace")
            if self.special and any(m in text for m in self.words.marks) and self.special.search(text):
                out[k] = self.words.text(value)
                continue
            part.append((k, self.words.normal(text)))
            held += len(text)
            if held >= GROUP:
                close()
                held = 0
        if part:
            close()
        return out


class OffsetDecoder:
    """Token strings joined by blanks, as one gather from a blob by an offset table."""

    def __init__(self, vocabulary: Vocabulary):
        parts = [s.encode() + b" " for s in vocabulary.strings]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def text(self, ids: np.ndarray, block: int = 1 << 17) -> bytes:
        out = []
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(self.start[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


_workers: dict[str, tuple] = {}


def _worker(text: str) -> tuple[BatchIds, OffsetDecoder]:
    """One encoder per Python worker and vocabulary; later tasks of the worker find its caches filled."""
    if text not in _workers:
        batches = BatchIds(text)
        _workers.clear()
        _workers[text] = (batches, OffsetDecoder(batches.words.v))
    return _workers[text]


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encode every text and decode its ids again.

    ``vocabulary`` is the path of a vocabulary file, read once on the driver (its size is fixed) and broadcast.
    Returns ``id_col``, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256; with
    ``keep`` also ids (array of int) and decoded (string).
    """
    ship(docs.sparkSession)
    spec: Broadcast = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if keep else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(spec.value)
        for batch in batches:
            n, one, two, ids_out, texts = [], [], [], [], []
            for raw in encoder.rows(batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4")
                decoded = decoder.text(ids)
                n.append(len(ids))
                one.append(hashlib.sha256(raw).hexdigest())
                two.append(hashlib.sha256(decoded).hexdigest())
                if keep:
                    ids_out.append(ids.astype(np.int32))
                    texts.append(decoded.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            if keep:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(id_col, docs[text_col].cast("binary").alias("text")).mapInArrow(run, schema)
