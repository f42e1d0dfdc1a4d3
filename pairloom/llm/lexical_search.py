"""Ranked lexical search of many items over all documents: two trees walked together, exact.

Statistics. One pass over the texts counts, per document, all its terms and those that items ask for; numbers of documents and of terms and
document frequencies are sums over what that pass has saved.

Trees. Items, ordered by their weightiest terms, form a tree with ``FAN`` children per node; a node holds, for every term, the largest weight
among its items. Documents form such trees too, one per block of a task, ordered by the terms that weigh most in them; a node holds, for every
term, the largest share that a document below it gets from the term. The product of two such vectors is a bound for every item and document
below the two nodes.

Search. Pairs of nodes are walked from both roots. Where the bound lies under the weakest kth score among the node's items, the whole batch
of items and documents is left out; in two leaves that meet, all scores come from one matrix product (of integers that doubles hold exactly).
A task keeps its best k per item over all its blocks. The first kth scores come from a bounded number of documents (``SEED``): the kth score
over some documents never exceeds that over all, so nothing is lost.

Style: Arrow batches and numpy; documents are not shuffled, only each task's best k per item are. Items are searched in passes of about
``PASS_TERMS`` terms, which is what bounds the broadcast and the trees of items, however many items there are.

Defined results: null texts have no terms; documents or items without terms are in no result; repeated rows are documents and items of their own
(an item's ranks then come once for each of its rows); null ids stay, among equal scores they come last; other columns are not read; without
documents or items there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.llm.common import saved
from pairloom.plans.runtime import ship

FAN = 8
LEAF_DOCS, LEAF_ITEMS = 16, 8
BLOCK = LEAF_DOCS * FAN * FAN * FAN  # documents of a tree
SEED = 4096
PASS_TERMS = 1 << 17
NO_ID = (1 << 63) - 1  # stands for a null id; the largest, so that it comes last

#: Fixed: letters, digits and all bytes beyond ASCII are parts of terms; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def term_rows(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the text), terms and times (numbers in the vocabulary and how often, packed): a row for each document with a term."""
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(told.value)}
        for batch in batches:
            ids, n, terms, times = [], [], [], []
            for doc_id, value in zip(batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(1), strict=True):
                if words := terms_of(value.as_py()):
                    own, often = np.unique(np.array([k for w in words if (k := number.get(w)) is not None], "<u4"), return_counts=True)
                    ids.append(doc_id)
                    n.append(len(words))
                    terms.append(own.tobytes())
                    times.append(often.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, times binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; a task sends a row per term it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["term", "c"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect():  # a row per term of a pass
        out[r["term"]] = r["c"]
    return out


def levels(leaves: np.ndarray) -> list[np.ndarray]:
    """Maxima of the nodes of a tree, the leaves' first, the root's last; node k has the children FAN * k, FAN * k + 1, ... one level below."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN), axis=0))
    return out


class ItemTree:
    """Items by their weightiest terms; weights[i, t] is the term's weight if the item has it."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray):
        first = [tuple(sorted(t.tolist(), key=lambda t: (-weight[t], t))[:4]) for t in items]
        self.order = np.array(sorted(range(len(items)), key=first.__getitem__), np.int64)
        self.used = np.unique(np.concatenate(items)) if items else np.zeros(0, np.int64)
        place = np.full(len(weight), -1, np.int64)
        place[self.used] = np.arange(len(self.used))
        self.place = place
        self.weights = np.zeros((len(items), len(self.used)))
        for row, k in enumerate(self.order):
            self.weights[row, place[items[k]]] = weight[items[k]]
        self.levels = levels(np.maximum.reduceat(self.weights, np.arange(0, len(items), LEAF_ITEMS), axis=0))


class Best:
    """The k best documents of each item so far, and the scores below which nothing counts any more."""

    def __init__(self, floor: np.ndarray, k: int):
        self.kth, self.k = np.maximum(floor, 1), k
        self.item = self.doc = self.score = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.new.append((item, doc, score))
        self.waiting += len(item)
        if self.waiting >= 4 * self.k * max(1, len(self.kth) // 8):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        item, doc, score = (np.concatenate([v, *(n[c] for n in self.new)]) for c, v in enumerate((self.item, self.doc, self.score)))
        self.new, self.waiting = [], 0
        by = np.lexsort((doc, -score, item))
        item, doc, score = item[by], doc[by], score[by]
        start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        rank = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        last = rank == self.k - 1
        self.kth[item[last]] = np.maximum(self.kth[item[last]], score[last])
        keep = rank < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]


def walk(tree: ItemTree, doc_ids: np.ndarray, of: np.ndarray, term: np.ndarray, share: np.ndarray, best: Best) -> int:
    """All pairs of items and documents of a block that can matter; entries (document, term, share) make up the documents. Returns the pairs scored."""
    # documents by the terms that weigh most in them
    most = tree.levels[-1][0][term] * share
    by = np.lexsort((-most, of))
    of, term, share = of[by], term[by], share[by]
    start = np.searchsorted(of, np.arange(len(doc_ids)))
    size = np.diff(np.append(start, len(of)))
    heads = [np.where(size > k, np.append(term, 0)[np.minimum(start + k, len(term))], -1) for k in range(3)]
    order = np.lexsort(heads[::-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc_ids, row = doc_ids[order], place[of]
    leaf_of = row // LEAF_DOCS
    n_leaves = -(-len(doc_ids) // LEAF_DOCS)
    leaves = np.zeros((n_leaves, len(tree.used)), np.float64)
    np.maximum.at(leaves, (leaf_of, term), share)
    docs = levels(leaves)
    by = np.argsort(leaf_of, kind="stable")
    row, term, share = row[by], term[by], share[by]
    upto = np.searchsorted(leaf_of[by], np.arange(n_leaves + 1))
    scored = 0

    def weakest(level: int, nodes: np.ndarray) -> np.ndarray:
        span = LEAF_ITEMS * FAN**level
        return np.array([best.kth[span * k : span * (k + 1)].min() for k in nodes])

    def meet(item_level: int, items: np.ndarray, doc_level: int, node: int) -> None:
        nonlocal scored
        columns = np.flatnonzero(docs[doc_level][node])
        bound = tree.levels[item_level][np.ix_(items, columns)] @ docs[doc_level][node][columns]
        items = items[bound >= weakest(item_level, items)]
        if not len(items):
            return
        if item_level or doc_level:
            if item_level:
                items = (items[:, None] * FAN + np.arange(FAN)).ravel()
                items = items[items < len(tree.levels[item_level - 1])]
            below = [node]
            if doc_level:
                below = np.arange(FAN * node, min(FAN * (node + 1), len(docs[doc_level - 1])))
                reach = docs[doc_level - 1][below] @ tree.levels[-1][0]
                below = below[np.argsort(-reach)].tolist()
            for child in below:
                meet(max(item_level - 1, 0), items, max(doc_level - 1, 0), child)
            return
        a, b = upto[node], upto[node + 1]
        cols, at = np.unique(term[a:b], return_inverse=True)
        first = node * LEAF_DOCS
        part = np.zeros((min(LEAF_DOCS, len(doc_ids) - first), len(cols)))
        part[row[a:b] - first, at] = share[a:b]
        members = (items[:, None] * LEAF_ITEMS + np.arange(LEAF_ITEMS)).ravel()
        members = members[members < len(tree.weights)]
        scores = (tree.weights[np.ix_(members, cols)] @ part.T).astype(np.int64)
        scored += scores.size
        i, d = np.nonzero(scores >= best.kth[members][:, None])
        best.add(members[i], doc_ids[first + d], scores[i, d])

    meet(len(tree.levels) - 1, np.array([0]), len(docs) - 1, 0)
    best.merge()
    return scored


def best_of_tasks(rows: DataFrame, items: list[np.ndarray], weight: np.ndarray, floor: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in ``items``), doc_id, score: at least the k best of each item and task that reach ``floor``."""
    told = rows.sparkSession.sparkContext.broadcast((items, weight, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, floor = told.value
        tree = ItemTree(items, weight)
        best = Best(floor[tree.order], k)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                block = batch.slice(a, BLOCK)
                raw = block.column(2).to_pylist()
                term, times = (np.frombuffer(b"".join(v), "<u4").astype(np.int64) for v in (raw, block.column(3).to_pylist()))
                of = np.repeat(np.arange(len(raw)), [len(v) // 4 for v in raw])
                length = 50 + (50 * block.column(1).to_numpy() * n_docs) // n_terms
                share = (1_000_000_000 * times) // (1000 * times + 20 * length[of])
                at = tree.place[term]
                fine = (at >= 0) & (share > 0)
                if fine.any():
                    walk(tree, block.column(0).to_numpy(), of[fine], at[fine], share[fine].astype(np.float64), best)
        best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(tree.order[best.item], pa.int64()), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "times").mapInArrow(run, "item long, doc_id long, score long")


def asked_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, terms (distinct, in order) of items with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, sorted(set(t))) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (t := terms_of(v))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.binary()))], names=["item_id", "terms"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "item_id long, terms array<binary>")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", pass_terms: int = PASS_TERMS, seed: int = SEED) -> DataFrame:
    """``item_col``, rank, ``id_col``, score: the k best documents of every item, of those with a score above 0."""
    ship(docs.sparkSession)
    asked = saved(asked_terms(items, item_col, text_col), "items")
    passes = -(-(asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) // pass_terms)
    dealt = asked.withColumn("p", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(passes, 1))))
    results = [docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for p in range(passes):
        own = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in dealt.where(F.col("p") == p).select("item_id", "terms").collect()]  # about pass_terms terms
        if own:
            results.append(_one_pass(docs, own, k, id_col, text_col, seed))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def _one_pass(docs: DataFrame, own: list[tuple[int | None, list[bytes]]], k: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    vocabulary = sorted({t for _, terms in own for t in terms})
    number = {t: n for n, t in enumerate(vocabulary)}
    items = [np.array([number[t] for t in terms], np.int64) for _, terms in own]
    rows = saved(term_rows(docs, vocabulary, id_col, text_col), "terms")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    df = document_frequencies(rows, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.float64)
    floor = np.zeros(len(items), np.int64)
    first = best_of_tasks(rows.limit(seed), items, weight, floor, n_docs, n_terms, k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    for r in first.where(F.col("n") == k).collect():  # a row per item of the pass
        floor[r["item"]] = r["least"]
    best = best_of_tasks(rows, items, weight, floor, n_docs, n_terms, k)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(own)], "item long, item_id long")
    known = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", known, "score")
