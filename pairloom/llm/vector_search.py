"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound with the kth score known so far.

Shards. A bounded sample of vectors (``SAMPLE`` rows, the same ones each time) gives the pivots of cells; every row goes to its nearest
pivot. A cell with more than ``rows`` rows is dealt over several shards by a hash of the id, so that copies of one vector, however many,
make no hot shard. The sample decides only where rows lie, never which rows are found.

Search. A shard's task builds a ball tree over its rows (of equal vectors only the k + 1 smallest ids can matter) and lets queries pass in
batches. No row of a ball with centre c and radius r has more than <q, c> + |q| r. Nodes are visited in order of that bound, each query
taking its better child first; a node whose bound lies under a query's kth score is not visited by it.

The kth score is shared: every distinct query vector first visits its best cell, then only those cells whose bound reaches the kth score found
there, and starts there with it. Equal query vectors are searched once, for k + 1 rows, and each query then leaves itself out.

Style: quantised rows and trees in numpy inside Arrow batches; Spark places, shuffles, merges. Per task: one shard, one batch of queries.
What is broadcast: at most ``MOST_CELLS`` pivots per length of vectors. Tables between the steps are saved in the shared folder.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of equal length are compared, empty ones
with score 0; rows of equal ids are rows of their own, and a query leaves out only itself; null ids come last among ties and are no queries
where the condition on the id is null; other columns are not read; an empty table gives no rows. Scores are exact within 64
bits, and the nearest such number beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.llm.common import saved
from pairloom.plans.runtime import ship

SHARD_ROWS = 1 << 14
MOST_CELLS = 1024
SAMPLE = 8192  # rows that give the pivots
LEAF = 256
MOST = 2.0**62  # components beyond it count as it
NO_ID = (1 << 63) - 1  # stands for a null id; the largest, so that it comes last


def packed(values: np.ndarray) -> bytes:
    """A quantised vector: 32-bit floats where they hold it exactly."""
    return values.astype("<f4" if np.abs(values).max(initial=0) <= 1 << 24 else "<f8").tobytes()


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(raw), 0))
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in raw]) if raw else np.zeros((0, dim))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integral vectors: in doubles where all sums fit them, else in 64-bit integers, and beyond those the nearest one."""
    most = np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((x * x).sum(1).max(initial=0))
    if most < 1 << 52:
        return (q @ x.T).astype(np.int64)
    if most < 1 << 62 and max(np.abs(q).max(), np.abs(x).max()) < 1 << 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return np.clip(q @ x.T, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)


class BallTree:
    """Centres, radii and children of nodes over distinct vectors; leaves hold rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF):
        if x.shape[1]:
            _, group = np.unique(x, axis=0, return_inverse=True)
        else:
            group = np.zeros(len(x), np.int64)
        by = np.lexsort((ids, group))
        start = np.flatnonzero(np.append(True, np.diff(group[by]) != 0))
        rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        keep = by[rank < k]
        self.ids, self.x, self.leaf = ids[keep], x[keep], leaf
        self.nodes: list[tuple[np.ndarray, float, object]] = []
        self.root = self.build(np.arange(len(keep)))

    def build(self, rows: np.ndarray) -> int:
        x = self.x[rows]
        centre = x.mean(0)
        away = np.sqrt(((x - centre) ** 2).sum(1))
        radius = float(away.max(initial=0))
        if len(rows) <= self.leaf or radius == 0:
            below: object = rows
        else:
            one = x[away.argmax()]
            two = x[((x - one) ** 2).sum(1).argmax()]
            side = x @ (one - two)
            by = np.argsort(side, kind="stable")
            below = self.build(rows[by[: len(by) // 2]]), self.build(rows[by[len(by) // 2 :]])
        self.nodes.append((centre, radius, below))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of up to k rows per query, of those that reach ``floor``."""
        self.q, self.k = q, k
        self.length = np.sqrt((q * q).sum(1))
        self.kth = floor.astype(np.int64).copy()
        self.found = (np.zeros(0, np.int64),) * 3
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        everyone = np.arange(len(q))
        self.visit(self.root, everyone, self.bound(self.root, everyone))
        self.merge()
        return self.found

    def bound(self, node: int, who: np.ndarray) -> np.ndarray:
        centre, radius, _ = self.nodes[node]
        length = self.length[who]
        slack = 1e-9 * length * (np.sqrt(centre @ centre) + radius) + 1e-6
        return self.q[who] @ centre + length * radius + slack

    def visit(self, node: int, who: np.ndarray, bound: np.ndarray) -> None:
        who = who[bound >= self.kth[who]]
        if not len(who):
            return
        below = self.nodes[node][2]
        if isinstance(below, np.ndarray):
            scores = products(self.q[who], self.x[below])
            row, column = np.nonzero(scores >= self.kth[who][:, None])
            self.held.append((who[row], self.ids[below[column]], scores[row, column]))
            self.merge()
            return
        one, two = below
        at, other = self.bound(one, who), self.bound(two, who)
        first = at >= other
        self.visit(one, who[first], at[first])
        self.visit(two, who[~first], other[~first])
        self.visit(two, who[first], other[first])
        self.visit(one, who[~first], at[~first])

    def merge(self) -> None:
        """Keep the best k of what has been found, and raise the kth scores of those who have k."""
        if not self.held:
            return
        touched = np.zeros(len(self.q), bool)
        for w, *_ in self.held:
            touched[w] = True
        mine = touched[self.found[0]]
        who, ids, scores = (np.concatenate([v[mine], *(h[c] for h in self.held)]) for c, v in enumerate(self.found))
        self.held = []
        by = np.lexsort((ids, ~scores, who))  # ~: descending
        who, ids, scores = who[by], ids[by], scores[by]
        start = np.flatnonzero(np.append(True, np.diff(who) != 0)) if len(who) else np.zeros(0, np.int64)
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        last = rank == self.k - 1
        self.kth[who[last]] = np.maximum(self.kth[who[last]], scores[last])
        keep = rank < self.k
        self.found = tuple(np.concatenate([v[~mine], n[keep]]) for v, n in zip(self.found, (who, ids, scores), strict=True))


def quantised(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id, dim, v (packed), square (product with itself), is_query of all vectors without null or non-finite components."""
    ship(vectors.sparkSession)
    x = F.col(vec_col)
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            upto = column.offsets.to_numpy().astype(np.int64)
            upto -= upto[0]
            flat = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)), -MOST, MOST)
            rows = [flat[a:b] for a, b in pairwise(upto)]
            square = [int(s) if (s := x @ x) < 1 << 52 else int(products(x[None], x[None])[0, 0]) for x in rows]
            columns = [batch.column(0).fill_null(NO_ID), pa.array(np.diff(upto), pa.int32()), pa.array(map(packed, rows), pa.binary()), pa.array(square, pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "v", "square", "is_query"])

    rows = vectors.where(x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), x.cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, dim int, v binary, square long, is_query boolean")


def pivots_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``cells`` parts of the sample, halved along its widest directions."""
    parts = [sample]
    while len(parts) < cells and len(parts[0]) > 1:
        x = parts.pop(0)
        away = ((x - x.mean(0)) ** 2).sum(1)
        one = x[away.argmax()]
        two = x[((x - one) ** 2).sum(1).argmax()]
        by = np.argsort(x @ (one - two), kind="stable")
        parts += [x[by[: len(x) // 2]], x[by[len(x) // 2 :]]]
        parts.sort(key=len, reverse=True)
    return np.stack([x.mean(0) for x in parts])


def placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with cell and away: the number of the nearest pivot and the distance from it; without a pivot, cell 0 and the own length."""
    told = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unpacked([raw[k] for k in at], int(dim))
                p = told.value.get(int(dim), np.zeros((1, int(dim))))
                cell[at] = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
                away[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(run, "id long, dim int, v binary, square long, is_query boolean, cell int, away double")


def searched(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """dim, v, id, score: the best k rows of each shard (dim, cell, salt) for each query row (dim, cell, salt, v, floor) sent there."""
    keys = ["dim", "cell", "salt"]
    both = shards.select(*keys, F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("floor")).unionByName(asked.select(*keys, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), "v", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.to_pydict()
            key = np.array([frame[c] for c in (*keys, "kind")]).T
            cuts = np.flatnonzero(np.append(True, (np.diff(key, axis=0) != 0).any(1)))
            for a, b in pairwise([*cuts.tolist(), len(key)]):
                here, kind = tuple(key[a, :3].tolist()), key[a, 3]
                if here != shard:
                    shard, rows, tree = here, [], None
                if not kind:
                    rows += zip(frame["id"][a:b], frame["v"][a:b], strict=True)
                    continue
                if not rows:
                    continue  # a shard that its hash left without rows
                if tree is None:
                    tree = BallTree(np.array([i for i, _ in rows], np.int64), unpacked([v for _, v in rows], here[0]), k)
                who, ids, scores = tree.search(unpacked(frame["v"][a:b], here[0]), np.array(frame["floor"][a:b], np.int64), k)
                v = [frame["v"][a + w] for w in who]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), here[0], np.int32)), pa.array(v, pa.binary()), pa.array(ids), pa.array(scores)], names=["dim", "v", "id", "score"])

    return both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "dim int, v binary, id long, score long")


LOWEST = -(1 << 63)


def other_cells(known: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """A row (dim, cell, salt, v, floor) for each shard of each cell but ``own`` that may hold rows at or above the floor.

    ``cells``: by length of vectors, the numbers of cells, of their shards, their radii and pivots. Lengths without an entry have one cell.
    """
    told = known.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own, floor = (batch.column(k).to_numpy() for k in (0, 2, 3))
            raw = batch.column(1).to_pylist()
            for dim in set(dims.tolist()) & told.value.keys():
                cell, shards, radius, pivot = told.value[dim]
                mine = np.flatnonzero(dims == dim)
                for some in np.array_split(mine, -(-len(mine) // 1024)):
                    q = unpacked([raw[k] for k in some], dim)
                    length = np.sqrt((q * q).sum(1))[:, None]
                    most = q @ pivot.T + length * radius + 1e-9 * length * (np.sqrt((pivot * pivot).sum(1)) + radius) + 1e-6
                    who, where = np.nonzero((most >= floor[some][:, None]) & (cell[None, :] != own[some][:, None]))
                    n = shards[where]
                    salt = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    who, where = some[np.repeat(who, n)], np.repeat(where, n)
                    columns = [pa.array(np.full(len(who), dim), pa.int32()), pa.array(cell[where], pa.int32()), pa.array(salt, pa.int32()), pa.array([raw[k] for k in who], pa.binary()), pa.array(floor[who], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "salt", "v", "floor"])

    return known.select("dim", "v", "own", "floor").mapInArrow(run, "dim int, cell int, salt int, v binary, floor long")


def top_k(vectors: DataFrame, k: int, is_query: Column, *, scale: int = 256, rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col``, score: the k rows with the highest inner products of floor(scale * component), smaller ids first among equal scores."""
    base = saved(quantised(vectors, is_query, scale, id_col, vec_col), "vectors")
    dims = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}  # other lengths, if any, have one cell each
    sample = base.select("dim", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    own = {dim: [bytes(r["v"]) for r in sample if r["dim"] == dim] for dim in dims}
    pivots = {dim: pivots_of(unpacked(v, dim), min(MOST_CELLS, -(-dims[dim] // rows))) for dim, v in own.items() if v}
    at = saved(placed(base, pivots), "placed")
    cells = saved(at.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("shards"), F.max("away").alias("radius")), "cells")  # a row per cell
    shards = at.join(cells, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("salt"), "id", "v")
    queries = at.where("is_query").select("id", "square", "dim", "v", "cell")
    distinct = queries.groupBy("dim", "v").agg(F.min("cell").alias("cell"))
    salts, lowest = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("salt"), F.lit(LOWEST).cast("long")
    home = saved(searched(shards, distinct.join(cells, ["dim", "cell"]).select("dim", "cell", salts, "v", lowest.alias("floor")), k + 1), "home")
    order = W.partitionBy("dim", "v").orderBy(F.desc("score"), "id")
    kth = home.withColumn("n", F.row_number().over(order)).where(F.col("n") == k + 1).select("dim", "v", F.col("score").alias("floor"))
    known = distinct.join(kth, ["dim", "v"], "left").select("dim", "v", F.col("cell").alias("own"), F.coalesce("floor", lowest).alias("floor"))
    told: dict[int, list] = {}
    for r in cells.where(F.col("dim").isin(*pivots)).collect() if pivots else []:  # at most MOST_CELLS per length
        told.setdefault(r["dim"], []).append((r["cell"], r["shards"], r["radius"]))
    summary = {d: (np.array([c for c, *_ in v]), np.array([s for _, s, _ in v]), np.array([x for *_, x in v]), pivots[d][[c for c, *_ in v]]) for d, v in told.items()}
    rest = searched(shards, other_cells(known, summary), k + 1)
    top = home.unionByName(rest).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    best = saved(top.groupBy("dim", "v").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("best")), "best")  # k + 1 at most
    both = queries.withColumnRenamed("id", "q").join(best, ["dim", "v"])
    itself = F.array_min(F.transform(F.filter("best", lambda b: (b["id"] == F.col("q")) & (b["score"] == F.col("square"))), lambda b: b["n"]))
    others = F.slice(F.filter("best", lambda b: b["n"] != F.coalesce(F.col("itself"), F.lit(0))), 1, k)
    out = both.withColumn("itself", itself).select("q", F.posexplode(others).alias("p", "b"))
    known_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known_id("q").alias("query_id"), (F.col("p") + 1).alias("rank"), known_id("b.id").alias(id_col), F.col("b.score").alias("score"))
