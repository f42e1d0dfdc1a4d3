"""Exact Jaccard self-join of texts on word n-grams, with adaptive multi-match prefixes, as components.

A text is the set of its distinct word n-grams (64-bit hashes). Two texts link if 100 * |intersection| >= percent * |union|.

1. *Counts.* One pass counts all shingles of all texts in a table of ``cells`` counters (fixed size): each task sends
   its counters, Spark adds them. They only define a total order of shingles, rare ones first, so they needn't be exact.
2. *Adaptive prefixes.* Any text that links to a set of n shingles shares ``least(n) = ceil(percent n / 100)`` of them,
   hence at least l of the first ``n - least(n) + l`` in that order. Each text takes the l (1 to ``most_matches``)
   that minimises the estimated cost: postings to scan, plus candidates to verify, which fall as l grows. A pair is
   verified only if it shares min(l, l') prefix shingles and its first common position leaves room for the overlap.
3. *Stars first.* Texts with equal sets are one class. In each posting list every class is verified against the list's
   leader only (the class with the fewest rarer shingles); links found so join classes into components.
4. *The rest, exactly.* What is left are pairs in one posting list whose components differ. In a list, only members
   outside its largest component are joined with the others, so a list of one component costs nothing; the pairs pass
   the position filter at their first common shingle and the match count, are verified, and the components are joined again. No pair that could
   still join two components is left out, so components are those of the full join.

Posting lists are never gathered: leaders are minima with map-side combine, and lists meet them in equi-joins that
adaptive execution can split. Shingling is numpy on Arrow batches; joins, minima and components are DataFrame work.

Defined results: null texts and texts without words have no shingles, link with nothing and are their own component;
with fewer words than n the whole sequence is the one shingle; rows with equal ids are one node with all their texts;
rows with a null id get the component of the ids whose set they equal (null if there is none) and link nothing; repeated rows
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.llm.common import SPACE, components, discard, saved, small
from pairloom.plans.runtime import ship

CELLS = 1 << 20
BLOCKS = 64  # the counter table travels in so many blocks
MOST_MATCHES = 4
VERIFY = 8  # cost of verifying a candidate, in postings scanned
MOST_BROADCAST = 1_000_000  # ids
MOST_CLASSES = 300_000  # of copies, broadcast
SKETCH = 9  # bits of a hash that tell the ranges apart in which shingles are counted
FULL = (1 << 16) - 1  # the largest count


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True
_TABLE = np.random.default_rng(17).integers(0, 1 << 64, 64 * 256, dtype=np.uint64)  # a random number per place and byte
GROUP_BYTES = 1 << 20  # texts are hashed together in groups of about this size


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, one after the other; and how many each text has.

    A word's hash is the exclusive or of its bytes' numbers by place; words over 64 bytes are hashed one by one.
    """
    raw = b" ".join([b"", *texts, b""]).lower()
    buffer = np.frombuffer(raw, np.uint8)
    gap = _GAP[buffer]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    counts = np.diff(np.append(np.searchsorted(starts, first), len(starts)))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    size = ends - starts
    at = np.flatnonzero(~gap)
    offset = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(offset, size)
    h = np.bitwise_xor.reduceat(_TABLE[(place & 63) << 8 | buffer[at]], offset) + size.astype(np.uint64)
    for k in np.flatnonzero(size > 64):
        import xxhash

        h[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]])
    return spread(h), counts


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(h) - n + 1, n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        out = out * factor + h[k : len(h) - n + 1 + k]
    return spread(out)


def shingle_lists(texts: list[bytes | None], n: int) -> Iterator[tuple[np.ndarray, int]]:
    """Per text: hashes of all word n-grams in order (a shorter text with words has one for its whole sequence), and its number of words."""
    texts = [t or b"" for t in texts]
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= GROUP_BYTES):
            held += len(texts[upto])
            upto += 1
        h, counts = word_hashes(texts[at:upto])
        every = _shingles(h, n) if len(h) >= n else h[:0]
        for first, count in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
            yield (every[first : first + count - n + 1] if count >= n else _shingles(h[first : first + count], count) if count else h[:0]), count
        at = upto


def shingle_sequence(text: bytes, n: int) -> np.ndarray:
    return next(shingle_lists([text], n))[0]


def least_overlap(n, percent: int):
    """Shared shingles that a set of n needs with any partner."""
    return -(-percent * n // 100)


class Order:
    """The total order of shingles: by the logarithm of their cell's count, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.shift = np.uint64(64 - (len(counts) - 1).bit_length())
        self.rank = np.minimum(8 * np.log2(counts + 1.0), 511).astype(np.uint64)
        self.often = np.maximum(counts - np.median(counts), 1.0)

    def prefix(self, shingles: np.ndarray, percent: int, most: int) -> tuple[int, np.ndarray]:
        """l and the l-prefix of a set, in order."""
        n = len(shingles)
        need = least_overlap(n, percent)
        cell = (shingles >> self.shift).astype(np.int64)
        key = (self.rank[cell] << np.uint64(55)) | (shingles >> np.uint64(9))
        most = min(most, need)
        longest = min(n - need + most, n)
        part = np.argpartition(key, longest - 1)[:longest] if longest < n else np.arange(n)
        part = part[np.lexsort((shingles[part], key[part]))]
        others = np.cumsum(self.often[cell[part]] - 1)
        matches = np.arange(1, most + 1)
        length = n - need + matches
        cost = length + others[length - 1] * (1 + VERIFY / matches)
        best = int(np.argmin(cost)) + 1
        return best, shingles[part[: n - need + best]]


def list_array(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def shingle_counts(docs: DataFrame, n: int, cells: int) -> np.ndarray:
    """In how many texts the shingles of each cell occur; ``docs``: d, text (binary). One table of fixed size on the driver."""
    size = cells // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        shift = np.uint64(64 - (cells - 1).bit_length())
        held: list[np.ndarray] = []
        room = 0
        for batch in batches:
            for shingles, _ in shingle_lists(batch.column(0).to_pylist(), n):
                held.append(np.unique(shingles))
                room += len(held[-1])
                if room > 1 << 20:
                    counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=cells)
                    held, room = [], 0
        if held:
            counts += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=cells)
        kinds = [counts[size * k : size * (k + 1)] for k in range(BLOCKS)]
        rows = [zlib.compress(x.astype("<u4" if x.max() < 1 << 32 else "<u8").tobytes(), 1) for x in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(rows, pa.binary())], names=["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for row in pdf["counts"]:
            raw = zlib.decompress(row)
            total += np.frombuffer(raw, "<u4" if len(raw) == 4 * size else "<u8").astype(np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    made = docs.select("text").mapInArrow(run, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros(cells, np.int64)
    for row in made.collect():
        out[size * row["block"] : size * (row["block"] + 1)] = np.frombuffer(bytes(row["counts"]), "<i8")
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, n: int, percent: int, most: int) -> DataFrame:
    """d, n (set size), digest (of the set), l, keys (the prefix, in order)."""
    table = docs.sparkSession.sparkContext.broadcast(counts)
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(table.value)
        for batch in batches:
            size, digest, least, keys = [], [], [], []
            for shingles, _ in shingle_lists(batch.column(1).to_pylist(), n):
                s = np.unique(shingles)
                size.append(len(s))
                digest.append(hashlib.md5(s.tobytes()).digest())
                best, key = order.prefix(s, percent, most) if len(s) else (0, s)
                least.append(best)
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(least, pa.int32()), list_array(keys)],
                names=["d", "n", "digest", "l", "keys"],
            )

    return docs.mapInArrow(run, f"d {kind}, n long, digest binary, l int, keys array<long>")


def fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def enough(overlap, n, m, percent: int):
    """The overlap gives the similarity: 100 o >= percent (n + m - o)."""
    return overlap * (100 + percent) >= (n + m) * percent


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Only the texts of their ids are read into sets.

    First, pairs meet with counts of their shingles by ``1 << SKETCH`` ranges of hashes: the smaller counts add up to a bound of the
    overlap that no real overlap exceeds. Only sets of pairs that it leaves are read again and joined, so false candidates don't move any.
    """
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles) for shingles, _ in shingle_lists(batch.column(1).to_pylist(), n)]
            counts = [np.minimum(np.bincount((s >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH), FULL).astype("<u2").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(sets), pa.array(map(len, sets), pa.int64()), pa.array(counts, pa.binary())], names=["d", "s", "n", "g"])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (4, 5))
            bound = np.minimum(left, right).sum(1, dtype=np.int64)
            full = (np.maximum(left, right) == FULL).any(1)  # a count that may be larger says nothing
            yield batch.select([0, 1]).filter(pa.array(full | enough(bound, size, 0, percent)))

    sets = saved(docs.join(small(ids, MOST_BROADCAST), "d", "left_semi").mapInArrow(run, "d long, s array<long>, n long, g binary"), "sets")
    left = pairs.join(sets.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga")), "a")
    both = left.join(sets.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb")), "b").select("a", "b", "na", "nb", "ga", "gb")
    likely = saved(both.mapInArrow(may, "a long, b long"), "likely")
    ends = {v: saved(likely.select(F.col(v).alias("d")).distinct(), "ends") for v in ("a", "b")}
    held = {v: sets.select("d", "s").join(small(ends[v], MOST_BROADCAST), "d", "left_semi").toDF(v, f"s{v}") for v in ends}
    both = likely.join(held["a"], "a").join(held["b"], "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    links = saved(both.where(enough(overlap, F.size("sa"), F.size("sb"), percent)).select("a", "b").distinct(), "links")
    discard(ids, sets, likely, *ends.values())
    return links


def join_components(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, most_matches: int = MOST_MATCHES) -> DataFrame:
    """``id_col``, n_shingles, component_id: the components of the Jaccard self-join; one row per row of ``docs``."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("binary").alias("text"))
    counts = shingle_counts(texts, n, cells)
    sets = saved(prefixes(texts, counts, n, percent, most_matches), "prefixes")
    # one text of each class stands for it; only ids and digests of copies are moved, not the prefixes
    some = sets.where("n > 0")
    classes = saved(some.groupBy("digest").agg(F.min("d").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    copies = saved(some.select("d", "digest").join(small(classes, MOST_CLASSES), "digest").where("d <> rep").select("d", "digest").distinct(), "copies")
    heads = some.where("d is not null").join(small(copies, MOST_CLASSES), ["d", "digest"], "left_anti").select("d", "n", "l", "keys")
    postings = heads.select(F.col("d").alias("x"), "n", "l", F.posexplode_outer("keys").alias("p", "key"))

    leaders = postings.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("p", F.col("x").alias("x"), F.col("n").alias("n"))).alias("lead"))
    shared = postings.join(leaders.where("c > 1").drop("c"), "key")
    before = F.row_number().over(W.partitionBy("x").orderBy("p")) - 1  # shared keys ahead of this one in x's prefix
    lists = saved(shared.withColumn("r", before).where(F.col("r") + F.col("n") - F.col("p") >= F.ceil(F.col("n") * percent / 100)), "lists")

    star = lists.where(F.col("x") != F.col("lead.x")).where(fits(F.col("n"), F.col("lead.n"), percent))
    star = star.select(F.least("x", "lead.x").alias("a"), F.greatest("x", "lead.x").alias("b")).distinct()
    links = verified(texts, saved(star, "pairs"), n, percent)
    first = saved(components(links), "components")

    # members of lists that still hold several components
    tagged = lists.drop("lead").join(small(first.withColumnRenamed("node", "x"), MOST_CLASSES), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
    tagged = saved(tagged, "tagged")
    discard(lists)
    parts = tagged.groupBy("key", "c").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("most")).where("parts > 1").select("key", F.col("most.c").alias("main"))
    members = saved(tagged.join(small(saved(mixed, "mixed"), MOST_CLASSES), "key"), "members")
    discard(tagged)
    one = members.where("c <> main").select("key", *[F.col(v).alias(f"{v}1") for v in ("x", "n", "p", "c")])
    two = members.select("key", "main", *[F.col(v).alias(f"{v}2") for v in ("x", "n", "p", "c")])
    n1, n2 = F.col("n1"), F.col("n2")
    # a linked pair's first common shingle is one of its rows here, and nothing before it counts: all overlap lies from there on
    room = F.least(n1 - F.col("p1"), n2 - F.col("p2"))
    cross = one.join(two, "key").where(
        (F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("x1") < F.col("x2"))) & fits(n1, n2, percent) & enough(room, n1, n2, percent)
    )
    met = cross.select(F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b")).distinct()
    keys = members.groupBy("x").agg(F.collect_list("key").alias("ks"), F.min("l").alias("l"))
    both = met.join(keys.toDF("a", "ka", "la"), "a").join(keys.toDF("b", "kb", "lb"), "b")
    pairs = both.where(F.size(F.array_intersect("ka", "kb")) >= F.least("la", "lb")).select("a", "b")
    pairs = saved(pairs, "pairs")
    more = verified(texts, pairs, n, percent)
    digests = sets.select("d", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    rows = digests.join(small(classes, MOST_CLASSES), "digest", "left").withColumn("rep", F.coalesce("rep", F.when(F.col("n") > 0, F.col("d"))))
    # an id with several texts joins the classes of all of them
    several = some.where("d is not null").groupBy("d").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("d")
    spread = rows.where("rep is not null").join(several, "d", "left_semi").select(F.col("d").alias("a"), F.col("rep").alias("b"))
    final = saved(components(links.unionByName(more).unionByName(spread)), "components")
    rows = rows.join(small(final.withColumnRenamed("node", "rep"), MOST_CLASSES), "rep", "left")
    return rows.select(
        F.col("d").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "d").alias("component_id"),
    )
