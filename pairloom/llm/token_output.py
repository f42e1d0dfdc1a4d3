"""Token ids as compact files: canonical, length-limited Huffman codes in independent blocks.

Writing. (1) Every text is encoded once; ids go to the shared folder as 16-bit integers (32-bit for vocabularies over 65,536). (2) Each task counts its
ids, Spark adds the counts, and the driver turns the counts (one row per vocabulary entry, a fixed bound) into code
lengths by package-merge. (3) Documents are range-partitioned by id and cut into blocks of about ``BLOCK`` ids. A block is
self-contained but for the code lengths: a header, one entry per document (id, count), a bit offset every ``STEP`` ids
(the checkpoints), and the bit stream.

Reading. Codes are canonical, so lengths alone give the decoding table (one entry per 16-bit prefix). All checkpoint runs
of a block are decoded side by side, one table look-up per id, so any block, and any run of it, can be read alone.

Files are Parquet tables of blocks, because on a cluster only Spark's writers reach the shared store: ``blocks`` (one row
per block) and ``codebook`` (one row). Blocks carry the position of their first id, so that they can be read in any order.

Defined results: null text = empty; an empty text has the end id only; documents with equal ids keep all their rows, in
order of their ids' checksum; null doc_id sorts first; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe
from pairloom.llm.common import saved, shared_dir
from pairloom.plans.runtime import ship

LIMIT = 16  # bits of the longest code
BLOCK = 1 << 18  # ids after which a block ends; a longer document is one block
STEP = 256  # ids between two checkpoints
MAGIC = b"HUF1"
_HEAD = struct.Struct("<4sIQQ")  # magic, documents, ids, bits


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # levels[k]: sorted weights of level k's list, with -1 for a package and the leaf's number else
    merged, kinds = weight, [np.arange(n)]
    for _ in range(limit - 1):
        packs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both, kind = np.concatenate([weight, packs]), np.concatenate([np.arange(n), np.full(len(packs), -1)])
        by = np.argsort(both, kind="stable")
        merged, kind = both[by], kind[by]
        kinds.append(kind)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for kind in reversed(kinds):
        chosen = kind[:take]
        leaves = chosen[chosen >= 0]
        depth[: len(leaves)] += 1  # the leaves taken are always the lightest ones
        take = 2 * int((chosen < 0).sum())
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by symbol; and for each prefix of LIMIT bits the symbol and the length of its code."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = np.int64(1) << (LIMIT - lengths[order].astype(np.int64))
    first = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (first >> (LIMIT - lengths[order].astype(np.int64))).astype(np.uint32)
    symbol, bits = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    filled = int(size.sum())
    symbol[:filled], bits[:filled] = np.repeat(order, size), np.repeat(lengths[order], size)
    return codes, symbol, bits


def pack_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block: header, document ids, sizes, checkpoints, bit stream (32-bit words, most significant bit first)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ids) else 0
    starts = ends - n
    word, room = starts >> 5, 64 - (starts & 31) - n  # room: bits to the right inside the two words from `word` on
    value = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    words = (total + 31 >> 5) + 2
    # codes do not overlap, so sums are unions; float64 holds 32-bit sums exactly
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    stream = (high[:words] + low[:words]).astype(">u4").tobytes()
    return b"".join([
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), total), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(),
        starts[::STEP].astype("<u8").tobytes(), stream,
    ])


def read_block(block: bytes, symbol: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, sizes and all ids of a block; its checkpoint runs are decoded side by side."""
    magic, docs, n, _ = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    sizes = np.frombuffer(block, "<u4", docs, at := at + 8 * docs)
    runs = -(-n // STEP)
    place = np.frombuffer(block, "<u8", runs, at := at + 4 * docs).astype(np.int64)
    words = np.frombuffer(block, ">u4", -1, at + 8 * runs).astype(np.uint64)
    out = np.zeros((STEP, runs), np.uint32)
    last = n - STEP * (runs - 1)
    for k in range(STEP if runs > 1 else last):
        if k == last and runs > 1:
            place = place[:-1]
        w = place >> 5
        pair = (words[w] << np.uint64(32)) | words[w + 1]
        prefix = ((pair >> (64 - LIMIT - (place & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)).astype(np.int64)
        out[k, : len(place)] = symbol[prefix]
        place = place + bits[prefix]
    return doc_ids, sizes, out.T.reshape(-1)[:n]


class LibraryPieces:
    """Ids of one piece by the tokenizers library's model."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(text).model

    def __call__(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]


def width(size: int) -> str:
    """Struct code of ids below ``size``."""
    return "H" if size <= 1 << 16 else "I"


def numbers(raw: bytes, code: str) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if code == "H" else "<u4")


_encoders: dict[tuple[str, str], bpe.BatchIds] = {}


def token_table(docs: DataFrame, vocabulary: str, end_id: int, code: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned; the end id last)."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_text(vocabulary))
    tail = struct.pack("<" + code, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (spec.value, code)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = bpe.BatchIds(spec.value, LibraryPieces(spec.value), code)
        for batch in batches:
            ids = [v + tail for v in _encoders[key].rows(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame, size: int, code: str) -> np.ndarray:
    """How often each id occurs in the whole table; each task sends one row per id it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0):
                counts += np.bincount(numbers(v.as_py(), code), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "c"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():
        out[row["id"]] = row["c"]  # one row per vocabulary entry at most
    return out


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write ``path/blocks`` and ``path/codebook``, in ascending order of document id."""
    spark = docs.sparkSession
    size = max(end_id + 1, len(bpe.Vocabulary(bpe.vocabulary_text(vocabulary)).strings))
    width_code = width(size)
    tokens = saved(token_table(docs, vocabulary, end_id, width_code, id_col=id_col, text_col=text_col), "tokens")
    lengths = code_lengths(count_ids(tokens, size, width_code))
    spark.createDataFrame([(LIMIT, bytearray(lengths.tobytes()))], "code_limit int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    table = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = table.value
        codes = canonical(code)[0]
        step = struct.calcsize(width_code)
        names: list[int] = []
        parts: list[bytes] = []
        held, number = 0, 0

        def close():
            ids = numbers(b"".join(parts), width_code)
            row = pack_block(np.array(names, np.int64), np.array([len(p) // step for p in parts]), ids, codes, code)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (shard, number, len(ids))), pa.array([row], pa.binary())],
                names=["shard", "number", "n", "block"],
            )

        shard = None
        for batch in batches:
            for name, value, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                shard = at
                names.append(NO_ID if name is None else name)
                parts.append(value.as_py())
                held += len(parts[-1]) // step
                if held >= BLOCK:
                    yield close()
                    names, parts, held, number = [], [], 0, number + 1
        if parts:
            yield close()

    ordered = tokens.withColumn("tie", F.crc32("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    blocks = ordered.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("shard")).mapInArrow(
        run, "shard long, number long, n long, block binary"
    )
    blocks.write.parquet(f"{path}/blocks")


NO_ID = -(1 << 63)  # stands for a null document id inside a block


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit), in any order of rows.

    A block's place is the sum of the blocks before it: a running sum over shards (one row each) and, within a shard, over blocks.
    """
    from pyspark.sql import Window as W

    ship(spark)
    book = spark.read.parquet(f"{path}/codebook").first()
    table = spark.sparkContext.broadcast(np.frombuffer(bytes(book["lengths"]), np.uint8))
    blocks = spark.read.schema("shard long, number long, n long, block binary").parquet(f"{path}/blocks")
    per = [(r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()]  # a row per output file
    base = dict(zip((s for s, _ in per), np.concatenate([[0], np.cumsum([n for _, n in per])])[:-1].tolist(), strict=False)) if per else {}
    first = spark.createDataFrame([(s, int(b)) for s, b in base.items()], "shard long, base long")
    inside = F.sum("n").over(W.partitionBy("shard").orderBy("number")) - F.col("n")
    place = blocks.select("shard", "number", "n").withColumn("before", inside).join(F.broadcast(first), "shard").select(
        "shard", "number", (F.col("before") + F.col("base")).alias("start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, symbol, bits = canonical(table.value)
        for batch in batches:
            for start, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, sizes, ids = read_block(block.as_py(), symbol, bits)
                ends = np.cumsum(sizes.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if x == NO_ID else x for x in names.tolist()], pa.int64()), pa.array(start + ends - sizes, pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in pairwise([0, *ends.tolist()])], pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )

    return blocks.join(F.broadcast(place), ["shard", "number"]).select("start", "block").mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, **columns: str) -> DataFrame:
    """Write the files into the shared folder, read them back; doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, vocabulary, end_id, **columns)
    read = read_files(spark, path)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def checksum(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
