"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; labels belong to documents only. Every passage of the whole text is
encoded: its words and word pairs (A-Z lower-cased, without signs around them) are hashed into ``BUCKETS`` cells, beside fixed
measures of its letters and words. One tanh layer embeds both, passages are weighted by gated attention
(``softmax(w . (tanh(V h) * sigmoid(U h)))``), and the weighted mean is scored by a logistic unit. All weights are learned
together from document labels.

Fitting uses at most ``rows`` labelled documents (a documented bound), whole: those with the smallest hash of their id whose passages together
don't exceed ``passages`` (one that would is left out, and the next is tried). Passages are encoded on the executors, and at most
``passages * 340`` bytes (65 MB) go to the driver, which trains with numpy. Scoring takes all passages of all documents; it broadcasts the weights (some
kilobytes) and is one pass without a shuffle. Both encode in numpy on Arrow batches.

The inputs of a score are the text's own measures; labels, lang, source and ids are not among them.

Defined results: null and empty texts are one passage of zeros and get the model's score for it; null labels are left out of
fitting; with no usable label of either kind every score is the share of label 1 (0.5 with no labels); repeated rows are
scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.plans.runtime import saved, ship

PASSAGE = 64
ROWS = 6000
PASSAGES = 192_000  # of all documents of the fit together
STEP_PASSAGES = 16_384  # of a step of the fit, but for a longer document
BITS = 8
BUCKETS = 1 << BITS  # cells of hashed words, and as many of word pairs
GROUP_BYTES = 1 << 20  # texts are encoded together in groups of about this size

_KINDS = ("lower", "upper", "digit", "space", "line", "stop", "shout", "bar", "symbol", "other", "wide")
_CLASS = np.full(256, 9, np.uint8)
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"|", b"#*$%&<>@~^=+_\\")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
_BREAK = np.zeros(256, bool)
_BREAK[list(b" \t\n\x0b\x0c\r")] = True
_POWERS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = len(_KINDS) + 9


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDLY = np.zeros(256, bool)
_WORDLY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all passages of the texts (float32), their ``2 * PASSAGE`` cells of words and pairs (uint16, ``2 * BUCKETS`` where
    there is none), and the number of passages of each text (1 at least)."""
    buffer = np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    gap = _BREAK[buffer]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    n_words = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
    n_passages = np.maximum(-(-n_words // PASSAGE), 1)
    total = int(n_passages.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    cells = np.full((total, 2 * PASSAGE), 2 * BUCKETS, np.uint16)
    if not len(starts):
        return out, cells, n_passages
    doc = np.repeat(np.arange(len(texts)), n_words)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = (np.cumsum(n_passages) - n_passages)[doc] + within // PASSAGE  # of each word
    segment = np.diff(np.concatenate([starts, [len(buffer)]]))
    of_byte = np.repeat(passage, segment)
    used = buffer[starts[0] :]
    kinds = np.bincount(of_byte * len(_KINDS) + _CLASS[used], minlength=total * len(_KINDS)).reshape(total, -1)
    place = np.arange(len(used)) - np.repeat(starts - starts[0], segment)
    letter = ~gap[starts[0] :]
    value = np.where(letter, used.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWERS[place & 63]
    word = np.add.reduceat(value, starts - starts[0])
    length = np.add.reduceat(letter.astype(np.int64), starts - starts[0])
    plain = np.where(_WORDLY[used], _LOWER[used].astype(np.uint64) + np.uint64(1), np.uint64(0))
    rank = np.cumsum(_WORDLY[used])
    rank -= np.repeat(rank[starts - starts[0]] - _WORDLY[used[starts - starts[0]]], segment)
    bare = np.add.reduceat(plain * _POWERS[rank & 63], starts - starts[0])  # the word without signs
    slot = within % PASSAGE
    cells[passage, slot] = (bare * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    follows = np.flatnonzero(passage[1:] == passage[:-1]) + 1
    pair = (bare[follows - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + bare[follows]) * np.uint64(0x9E3779B97F4A7C15)
    cells[passage[follows], PASSAGE + slot[follows]] = BUCKETS + (pair >> np.uint64(64 - BITS)).astype(np.int64)
    count = np.bincount(passage, minlength=total).astype(np.float64)
    safe = np.maximum(count, 1)

    def per(values) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=total) / safe

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, index = np.unique(keys + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        return np.bincount(of[index], minlength=total)

    mean = per(length)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])])
    triple = (passage[2:] == passage[:-2]) if len(word) > 2 else np.zeros(0, bool)
    three = (word[:-2] + word[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[2:] * np.uint64(0x165667B19E3779F9))[triple] if len(word) > 2 else word[:0]
    n_three = np.bincount(passage[:-2][triple], minlength=total) if len(word) > 2 else np.zeros(total)
    letters = np.maximum(kinds.sum(1) - kinds[:, 3] - kinds[:, 4], 1)
    out[:, : len(_KINDS)] = kinds / letters[:, None]
    out[:, len(_KINDS)] = np.log1p(count)
    out[:, len(_KINDS) + 1] = mean
    out[:, len(_KINDS) + 2] = np.sqrt(np.maximum(per(length.astype(np.float64) ** 2) - mean**2, 0))
    out[:, len(_KINDS) + 3] = distinct(word, passage) / safe
    out[:, len(_KINDS) + 4] = per(again)
    out[:, len(_KINDS) + 5] = (distinct(three, passage[:-2][triple]) if len(three) else np.zeros(total)) / np.maximum(n_three, 1)
    out[:, len(_KINDS) + 6] = per(_CLASS[buffer[starts]] == 1)
    out[:, len(_KINDS) + 7] = kinds[:, 8] / safe
    out[:, len(_KINDS) + 8] = kinds[:, 6] / safe
    return out, cells, n_passages


def spread(cells: np.ndarray, kind=np.float32) -> np.ndarray:
    """Counts of words and pairs per cell, by square root (a passage per row)."""
    size = 2 * BUCKETS + 1
    at = cells.astype(np.int64) + np.arange(len(cells))[:, None] * size
    return np.sqrt(np.bincount(at.ravel(), minlength=len(cells) * size).reshape(len(cells), size)[:, :-1].astype(kind))


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= GROUP_BYTES:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


class Model:
    """Weights of the embedding (``W`` of measures, ``L`` of words and pairs), the gated attention and the score; ``mean`` and ``scale``
    standardise measures."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        d = N_FEATURES
        self.mean, self.scale, self.constant, self.kind = np.zeros(d), np.ones(d), None, np.float32
        self.w = {
            "W": r.normal(0, d**-0.5, (d, hidden)), "L": np.zeros((2 * BUCKETS, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)),
            "U": r.normal(0, hidden**-0.5, (hidden, gate)), "a": r.normal(0, gate**-0.5, gate), "o": r.normal(0, hidden**-0.5, hidden), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, cells: np.ndarray, n: np.ndarray) -> dict:
        w, at = self.w, np.cumsum(n) - n
        x, k = np.clip((x - self.mean) / self.scale, -6, 6), spread(cells, self.kind)
        h = np.tanh(x @ w["W"] + k @ w["L"].astype(self.kind) + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        p = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        p /= np.repeat(np.add.reduceat(p, at), n)
        z = np.add.reduceat(p[:, None] * h, at, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["c"], -30, 30)))
        return {"x": x, "k": k, "h": h, "t": t, "s": s, "p": p, "z": z, "y": y, "at": at}

    def score(self, x: np.ndarray, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.full(len(n), self.constant) if self.constant is not None else self.forward(x, cells, n)["y"]

    def loss(self, x: np.ndarray, cells: np.ndarray, n: np.ndarray, label: np.ndarray) -> float:
        y = self.forward(x, cells, n)["y"]
        return float(-np.mean(label * np.log(y) + (1 - label) * np.log(1 - y)))

    def gradients(self, x: np.ndarray, cells: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by weight."""
        f, w = self.forward(x, cells, n), self.w
        d = (f["y"] - label) / len(label)
        g = {"o": f["z"].T @ d, "c": np.array([d.sum()])}
        dz = np.repeat(d, n)[:, None] * w["o"]
        dp = (dz * f["h"]).sum(1)
        de = f["p"] * (dp - np.repeat(np.add.reduceat(f["p"] * dp, f["at"]), n))
        g["a"] = (f["t"] * f["s"]).T @ de
        dt = de[:, None] * w["a"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * w["a"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["p"][:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["L"], g["b"] = f["x"].T @ dh, f["k"].T @ dh.astype(self.kind), dh.sum(0)
        return g

    def fit(self, x: np.ndarray, cells: np.ndarray, n: np.ndarray, label: np.ndarray, epochs: int = 15, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Model:
        """Adam over mini-batches of documents, in an order fixed by a seed; word weights learn more slowly."""
        if len(label) == 0 or label.min() == label.max():
            self.constant = float(label.mean()) if len(label) else 0.5
            return self
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        ends, order, step = np.cumsum(n), np.random.default_rng(3), 0
        for part in (q for _ in range(epochs) for p in np.array_split(order.permutation(len(n)), -(-len(n) // batch)) for q in _steps(p, n)):
            step += 1
            size = n[part]
            pick = np.repeat(ends[part] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
            for k, g in self.gradients(x[pick], cells[pick], size, label[part]).items():
                g = g + (10 if k == "L" else 1) * decay * self.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.w[k] = self.w[k] - rate * (0.1 if k == "L" else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def _steps(part: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """A batch of documents, cut where its passages are more than a step takes."""
    number = (np.cumsum(n[part]) - 1) // STEP_PASSAGES
    return np.split(part, np.flatnonzero(np.diff(number)) + 1)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, passages: int = PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``rows`` labelled documents that are not held out, of at most ``passages`` passages together."""
    ship(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("d"), F.col(label_col).cast("int").alias("y")).where(F.col("d").isNotNull() & F.col("y").isin(0, 1))
    chosen = usable.where(remainder("d") != 0).orderBy(F.xxhash64(F.lit(4), "d"), "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("binary").alias("text"))
    rows_in = texts.join(F.broadcast(chosen), "d").select("d", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ks = [], []
            for v in batch.column(2):
                x, cells, _ = encode([v.as_py() or b""])
                xs.append(x.tobytes())
                ks.append(cells.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary()), pa.array(ks, pa.binary())], names=["d", "y", "x", "k"])

    kind = docs.schema[id_col].dataType.simpleString()
    encoded = saved(rows_in.mapInArrow(run, f"d {kind}, y int, x binary, k binary"), "passages")
    size, order = (F.length("x") / (4 * N_FEATURES)).cast("long"), F.xxhash64(F.lit(4), "d")
    sizes = sorted((tuple(r) for r in encoded.select(order, F.xxhash64("d", "y", "x", "k"), size).collect()), key=lambda r: r[:2])  # three numbers for each of ``rows`` documents
    taken, left = [], passages
    for _, row, n in sizes:
        if n <= left:
            taken.append((row,))
            left -= n
    some = docs.sparkSession.createDataFrame(taken, "row long").distinct()
    inside = encoded.join(F.broadcast(some), F.xxhash64("d", "y", "x", "k") == F.col("row"), "left_semi")
    got = sorted(inside.collect(), key=lambda r: (str(r["d"]), r["y"], bytes(r["x"]), bytes(r["k"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, N_FEATURES)
    cells = np.frombuffer(b"".join(bytes(r["k"]) for r in got), np.uint16).reshape(-1, 2 * PASSAGE)
    n = np.array([len(r["x"]) // (4 * N_FEATURES) for r in got], np.int64)
    return Model().fit(x, cells, n, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, model: Model, *, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns in ``keep``, held_out, score, predicted; ``keep`` may name any columns of ``docs``."""
    ship(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or b"" for v in batch.column(1)]
            scores = [weights.value.score(*encode(texts[a:b])) for a, b in groups(texts)]
            y = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64()), *batch.columns[2:]], names=names)

    inputs = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("binary").alias("text"), *[c.alias(f"k{i}") for i, c in enumerate(kept)])
    kinds = {f.name: f.dataType.simpleString() for f in inputs.schema}
    names = ["d", "score", *[f"k{i}" for i in range(len(kept))]]
    out = inputs.mapInArrow(run, ", ".join(f"{c} {'double' if c == 'score' else kinds[c]}" for c in names))
    return out.select(
        F.col("d").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce(remainder("d") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
    )
