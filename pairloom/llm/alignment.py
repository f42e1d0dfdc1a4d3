"""Alignment of two tokenizers: byte offsets where tokens of A and B both end, groups between them, and how often ids end together.

Encoding. ``" " + text`` is cut before blanks that follow something else than white space. Neither tokenizer has a token across such a
place, so each distinct piece is encoded once by the libraries, and a long text is worked through part by part. The bytes of a piece's tokens
are held against the piece, so a text that one of the tokenizers can't spell is known before anything of it is counted.

Merging. Token ends of a whole group of texts form two ascending lists. Diagonal binary searches (merge path) divide the merging of both
lists into pieces of equal work, whatever the lengths of the texts; every piece, alone, emits the ends that both lists have in it. Where
the border of two pieces parts two equal ends (A's is the last of a piece, B's the first of the next), the pieces are stitched there.

Counting. Texts are gathered in blocks with a dictionary of the id pairs in them, so that Spark counts one row per pair and block. Counts go
back to the blocks through a join on the pair; the blocks then give every text its sums. Nothing of this passes the driver.

Style: Arrow batches, because the encoders are Python libraries, and DataFrame joins for what is counted over the corpus. A block is
bounded in bytes; blocks and their dictionary are a saved table, so a lost executor repeats its own tasks only.

Defined results: texts that are null, empty or not spelled by both tokenizers have no tokens: zeros and an empty string. Repeated rows are
documents of their own and all count; null ids stay; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bpe import MOST_CACHED_BYTES, byte_letters
from pairloom.llm.common import saved
from pairloom.plans.runtime import ship

PART = 1 << 20  # bytes after which a group of texts ends, and of which a long text is cut at the next place where both tokenizers allow it
BLOCK = 1 << 23  # bytes of text after which a block ends
WORK = 1 << 16  # token ends in a piece of the merge
SLICE = 1 << 17  # tokens written out at once
MOST_KNOWN = 500_000  # pieces a worker keeps before it starts anew
SHIFT = 32  # a pair is a * 2**32 + b

#: Fixed: last two bytes, in UTF-8, of the white space beyond ASCII (the first of three-byte characters doesn't matter here).
WIDE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, x) for x in range(0x80, 0x8B)), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]


def diagonal_cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` lie before every ``work``-th step of their merge (of equal ones, a's first), both ends included.

    On diagonal d the i sought is the first with a[i] > b[d - 1 - i]; all diagonals are searched side by side.
    """
    n = len(a) + len(b)
    d = np.append(np.arange(0, n, work), n)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        before = a[mid] <= b[d[open_] - 1 - mid]
        low[open_[before]] = mid[before] + 1
        high[open_[~before]] = mid[~before]
    return low, d - low


def piece_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of the ends that both have."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit, at[hit]


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ends in both ascending lists: piece by piece, and stitched where a border parts two equal ends."""
    i, j = diagonal_cuts(a, b, work)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(len(i) - 1):
        if 0 < i[p] and j[p] < len(b) and a[i[p] - 1] == b[j[p]]:
            left.append(i[p : p + 1] - 1)
            right.append(j[p : p + 1])
        x, y = piece_ends(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]])
        left.append(x + i[p])
        right.append(y + j[p])
    return np.concatenate(left), np.concatenate(right)


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Positions of blanks after something that is no white space; neither tokenizer has a token across such a place."""
    space = np.zeros(256, bool)
    space[[*range(9, 14), *range(28, 33)]] = True
    at = np.flatnonzero(raw[1:] == 32) + 1
    at = at[~space[raw[at - 1]]]
    last, before = raw[at - 1].astype(np.int32), raw[np.maximum(at - 2, 0)].astype(np.int32)
    return at[~np.isin(before << 8 | last, [x << 8 | y for x, y in WIDE])]


class Pair:
    """Both tokenizers: ids of pieces, kept from group to group, and the bytes of every id."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = {letter: k for k, letter in enumerate(byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.blobs = [np.frombuffer(b"".join(v), np.uint8) for v in (self.bytes_a, self.bytes_b)]
        self.widths = [np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b)]
        self.places = [np.cumsum(w) - w for w in self.widths]
        self.blank = self.b.piece_to_id("▁")
        digits = [b"%d," % i for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_size = np.array([len(x) for x in digits], np.int64)
        self.digits_start = np.cumsum(self.digits_size) - self.digits_size
        self.forget()

    def forget(self) -> None:
        """Of the pieces known: their numbers; for each tokenizer all ids, where those of a piece start and how many it has; whether both spell it."""
        self.slot: dict[bytes, int] = {}
        self.flat, self.start, self.many = ([np.zeros(0, np.int64)] * 2 for _ in range(3))
        self.fine = np.zeros(0, bool)

    def spelled(self, k: int, pieces: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes of a piece's ids (n of them) are the piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        width = self.widths[k][ids]
        fine = np.diff(np.append(0, np.append(0, np.cumsum(width))[np.cumsum(n)])) == size
        mine = np.repeat(fine, n)
        ids, width, size = ids[mine], width[mine], size[fine]
        end = np.cumsum(width)
        made = self.blobs[k][np.repeat(self.places[k][ids] - end + width, width) + np.arange(end[-1] if len(end) else 0)]
        odd = np.flatnonzero(made != np.frombuffer(b"".join(p for p, f in zip(pieces, fine, strict=True) if f), np.uint8))
        fine[np.flatnonzero(fine)[np.searchsorted(np.cumsum(size), odd, "right")]] = False
        return fine

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces (each starts with a blank, which B adds itself), of which new ones are encoded."""
        if len(self.slot) > MOST_KNOWN or len(self.flat[0]) > 32 * MOST_KNOWN:
            self.forget()
        new = [p for p in pieces if p not in self.slot]
        if new:
            texts = [p.decode() for p in new]
            own = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], [x or [self.blank] for x in self.b.encode([t[1:] for t in texts], num_threads=1)]
            fine = np.ones(len(new), bool)
            for k, each in enumerate(own):
                n = np.fromiter(map(len, each), np.int64, len(each))
                ids = np.fromiter(chain.from_iterable(each), np.int64, int(n.sum()))
                fine &= self.spelled(k, new, ids, n)
                self.start[k] = np.append(self.start[k], len(self.flat[k]) + np.cumsum(n) - n)
                self.many[k] = np.append(self.many[k], n)
                self.flat[k] = np.append(self.flat[k], ids)
            self.slot.update(zip(new, range(len(self.fine), len(self.fine) + len(new)), strict=True))
            self.fine = np.append(self.fine, fine)
        out = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        for p in new:
            if len(p) > MOST_CACHED_BYTES:
                del self.slot[p]
        return out

    def group(self, parts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, bytes] | None]:
        """For every part (starts with a blank): tokens of A, tokens of B, linked pairs and the groups written out; None if not spelled by both."""
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(size) - size
        starts = np.union1d(cut_places(raw), begin)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        which = self.learn(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        part = np.searchsorted(begin, starts, "right") - 1
        good = np.bincount(part[~self.fine[which]], minlength=len(parts)) == 0
        keep = good[part]
        which, part = which[keep], part[keep]
        ids, ends, of, many = [], [], [], []
        for k in (0, 1):
            each = self.many[k][which]
            upto = np.cumsum(each)
            ids.append(self.flat[k][np.repeat(self.start[k][which] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)])
            of.append(np.repeat(part, each))
            many.append(np.bincount(of[k], minlength=len(parts)))
            end = np.cumsum(self.widths[k][ids[k]])
            first = np.append(0, end)[np.cumsum(many[k]) - many[k]]
            ends.append(end + (begin - first)[of[k]])
        (a, b), (of_a, _), (n_a, n_b) = ids, of, many
        at_a, at_b = common_ends(*ends)
        links = (a[at_a] << SHIFT) | b[at_b]
        n_links = np.bincount(of_a[at_a], minlength=len(parts))
        # A's tokens of a group come before B's: where each token stands in what is written
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a] = last_b[at_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        place_a, place_b = np.arange(len(a)) + np.append(0, at_b + 1)[group_a], np.arange(len(b)) + (at_a + 1)[group_b]
        order[place_a], order[place_b] = a, b
        mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        written = []
        for k in range(0, len(order), SLICE):
            token = order[k : k + SLICE]
            width = self.digits_size[token]
            end = np.cumsum(width)
            letters = self.digits[np.repeat(self.digits_start[token] - end + width, width) + np.arange(end[-1])]
            letters[end - 1] = mark[k : k + SLICE]
            written.append(letters.tobytes())
        text = b"".join(written)
        letters_upto = np.append(0, np.cumsum(self.digits_size[order]))[np.append(0, np.cumsum(n_a + n_b))]
        links_upto = np.append(0, np.cumsum(n_links))
        for k in range(len(parts)):
            if good[k]:
                yield int(n_a[k]), int(n_b[k]), links[links_upto[k] : links_upto[k + 1]], text[letters_upto[k] : letters_upto[k + 1] - 1]
            else:
                yield None

    def cut(self, text: bytes) -> list[bytes]:
        """`` `` + text, in parts of about PART bytes if it is long."""
        whole = b" " + text
        if len(whole) < 2 * PART:
            return [whole]
        at, places = [0], cut_places(np.frombuffer(whole, np.uint8))
        while (k := np.searchsorted(places, at[-1] + PART)) < len(places):
            at.append(int(places[k]))
        return [whole[x:y] for x, y in zip(at, [*at[1:], len(whole)], strict=True)]


class Text:
    """What is known of a document whose parts are being worked through."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.n_a, self.n_b, self.digest, self.links, self.bad = doc_id, 0, 0, None, [], False

    def add(self, part: tuple[int, int, np.ndarray, bytes] | None) -> None:
        if part is None or self.bad:
            self.bad = True
            return
        self.n_a += part[0]
        self.n_b += part[1]
        self.links.append(part[2])
        if self.digest:
            self.digest.update(b";")
        else:
            self.digest = hashlib.sha256()
        self.digest.update(part[3])

    def row(self) -> tuple[int | None, int, int, str, np.ndarray]:
        if self.bad or not self.digest:
            return self.doc_id, 0, 0, "", np.zeros(0, np.int64)
        return self.doc_id, self.n_a, self.n_b, self.digest.hexdigest(), np.concatenate(self.links)


_pairs: dict[tuple[str, bytes], Pair] = {}
_BLOCK = pa.schema([
    ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string())), ("n_links", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("slots", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])


def _block(rows: list[tuple]) -> pa.RecordBatch:
    """One row: the documents of a block, their pairs as places in the block's dictionary, and the dictionary with its counts."""
    own = [np.unique(r[4], return_counts=True) for r in rows]
    pairs, slots = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
    times = np.concatenate([n for _, n in own])
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, slots, times)
    values = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [len(r[4]) for r in rows], [len(k) for k, _ in own],
              slots.astype("<u4").tobytes(), times.astype("<u4").tobytes(), pairs, counts]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)


def encoded_blocks(docs: DataFrame, a: str, b: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents (see ``_block``)."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if spec.value not in _pairs:
            _pairs.clear()
            _pairs[spec.value] = Pair(*spec.value)
        both = _pairs[spec.value]
        texts: list[Text] = []  # of the block; what they hold lies in parts until a group is full
        parts: list[tuple[Text, bytes]] = []
        waiting = held = 0

        def work() -> None:
            for (text, _), out in zip(parts, both.group([p for _, p in parts]), strict=True):
                text.add(out)
            parts.clear()

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.append(Text(doc_id))
                if value := value.as_py():
                    for part in both.cut(value.decode("utf-8", "replace").encode()):
                        parts.append((texts[-1], part))
                        waiting += len(part)
                        held += len(part)
                        if waiting >= PART:
                            work()
                            waiting = 0
                if held >= BLOCK or len(texts) >= BLOCK >> 8:
                    if parts:
                        work()
                    yield _block([t.row() for t in texts])
                    texts, waiting, held = [], 0, 0
        if parts:
            work()
        if texts:
            yield _block([t.row() for t in texts])

    schema = ("doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, groups_sha256 array<string>, n_links array<bigint>, sizes array<bigint>, slots binary, times binary,"
              " pairs array<bigint>, counts array<bigint>")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, total (links that hold it), best (total is the highest of its B id)."""
    total = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    total = total.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    most = total.groupBy(F.col("b").alias("b0")).agg(F.max("total").alias("most"))
    return total.join(most, F.col("b") == F.col("b0")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` is the text of a byte-level tokenizer's file, ``b`` a sentencepiece model; both are read once on the driver and have fixed sizes.
    A link is a pair of tokens that end at the same byte; every such end closes a group.
    """
    blocks = saved(encoded_blocks(docs, a, b, id_col=id_col, text_col=text_col).withColumn("block", F.expr("uuid()")), "blocks")
    counts = saved(pair_counts(blocks), "pair-counts")
    entries = blocks.select("block", F.posexplode("pairs").alias("slot", "p"))
    scored = entries.join(counts, F.col("p") == F.col("pair")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "total", "best"))).alias("s"))  # as many as the block's dictionary has
    scored = scored.select(F.col("block").alias("k"), F.col("s.total").alias("totals"), F.col("s.best").alias("bests"))
    rows = blocks.drop("pairs", "counts").join(scored, F.col("block") == F.col("k"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r] for name in batch.schema.names}
                slots, times = (np.frombuffer(x[c].as_py(), "<u4").astype(np.int64) for c in ("slots", "times"))
                total, best = ((x[c].values.to_numpy(zero_copy_only=False) if x[c].is_valid else np.zeros(0)).astype(np.int64) for c in ("totals", "bests"))
                upto = np.cumsum(x["sizes"].values.to_numpy())
                sums = [np.diff(np.append(0, np.append(0, np.cumsum(v[slots] * times))[upto])) for v in (best, total)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                columns = [x["doc_id"].values, x["n_a"].values, x["n_b"].values, x["n_links"].values, x["n_links"].values, *(pa.array(v, pa.int64()) for v in sums), x["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.select("doc_id", "n_a", "n_b", "groups_sha256", "n_links", "sizes", "slots", "times", "totals", "bests").mapInArrow(run, schema)
