"""Near-duplicate passages by compact windows of min-hashes.

Tokens are word shingles (five words, A-Z lower-cased). For each of ``hashes`` hash functions, the Cartesian tree over a text's
token hashes groups its passages: the node at c with subtree [a, b] stands for all passages [i, j], a <= i <= c <= j <= b,
and they all have c's hash as min-hash. Only nodes at least as wide as the shortest passage matter: about 2 n / width
per function, instead of n squared passages.

1. Windows of all texts, one row per text, are written to the shared folder. Texts of equal token sequences are one class;
   the one with the smallest id stands for all, so copies cost a row each from here on.
2. A key (function, min-hash) that only one document holds finds nothing. Of the others, the smallest document is the leader and
   meets the members in an equi-join: a row per member, never pairs. A member and a leader are candidates if windows of two
   functions hold a common passage on both sides (of four functions, two or more agree with probability 0.97 at similarity 0.8, and
   always on equal passages). Candidates are verified over whole texts.
3. Members whose root does not lie in a passage shared with the leader may match any other. Of the windows of their keys, those
   count that make a pair of two functions (as above) which another document has as well, unless all that have it are one
   component already and have a span there. A passage of ``width`` tokens lacks at most m = width - need of them on the other side, so of its m + 1 pairs of tokens (p, p + need - 1)
   one has both tokens there, as far apart or (a word put in) one further. All these pairs in passages with the roots left over
   become sub-keys. Texts that only have a sentence in common share no sub-key; texts that share one nearly always match.
   The smallest document of each sub-key meets its members; members that match it there, or are in one component with it by now,
   leave. The sub-keys of those that stay are refined, for all their members: an edit inside a passage costs ``shingle`` - 1 tokens or
   more, so of the m that may lack there is one stretch of m, and what is before and behind it is equal. A refined key is the sub-key, its first tokens and
   its last ones, for some lengths of both of which one fits wherever the stretch is (see ``refined``). Copies with edits of their own
   share sub-keys, but few refined ones. Leaders of refined keys (1, 4, 16, ... by hash) meet their members in rounds until none is left.
   No key is cut off, and two members of different
   components that match no leader meet each other; so no link between components is left out. Inside a component a span can
   be missing where an edited passage is shared with another member than the first leader of its sub-keys.
4. Verification: windows of the document and their counterparts in the leader stand if their Jaccard similarity (of
   shingles with their counts) reaches ``percent``. Spans, links and components follow.

Everything but windows, sub-keys and the test of a pair (numpy on Arrow batches) is DataFrame work.

Defined results: null texts, texts without words and texts shorter than a passage have no spans and are their own
component; rows with a null id likewise (null component); rows with equal ids are one document with all their texts; repeated
rows give a row each; an empty table gives no rows; other columns are not read. Spans and links are between different
documents; what a text repeats of itself counts in n_inner_words only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import components, discard, saved, small
from pairloom.llm.ngram_join import shingle_lists
from pairloom.plans.runtime import ship

SHINGLE = 5
WORDS = 50  # the shortest passage
HASHES = 4
GROUP = 1 << 17  # tokens after which a group of texts ends
MOST_BROADCAST = 500_000  # ids
MOST_KNOWN = 100_000  # documents with their spans
SLOT = 7  # steps between the lengths of runs of a refined key
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _sliding(v: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = best(v[:-step], v[step:])
        have += step
    return v


def many_windows(h: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same nodes, (a, c, b), for many stretches of ``h`` at once, level by level; a stretch has ``width`` values at least, the next one
    begins where it ends.

    Roots of wide nodes are among the minima of some ``width`` values in a row, so minima are looked for among those only, about one value in ``width / 2``.
    """
    low = _sliding(h, width, np.minimum)
    inside = np.ones(len(h), bool)
    inside[(b[:, None] - np.arange(width - 1)).ravel()] = False  # starts whose values would reach into the next stretch
    padded = np.zeros(len(h) + width - 1, h.dtype)
    padded[width - 1 : width - 1 + len(low)] = np.where(inside[: len(low)], low, 0)
    roots = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    held, found = h[roots], []
    while True:
        some = b - a + 1 >= width
        a, b = a[some], b[some]
        if not len(a):
            break
        start = np.searchsorted(roots, a)
        size = np.searchsorted(roots, b, "right") - start
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(size.sum())
        v = held[at]
        least = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, first), size))
        c = roots[at[least]]
        if len(c) > len(a):
            of = np.searchsorted(first, least, "right") - 1
            middle = (a + (b - a) // 2)[of]
            far = np.abs(c - middle) << 1 | (c > middle)
            c = c[far == np.minimum.reduceat(far, np.searchsorted(of, np.arange(len(a))))[of]]
        found.append((a, c, b))
        a, b = np.concatenate([a, c + 1]), np.concatenate([c - 1, b])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def hashed(tokens: np.ndarray, k: int) -> np.ndarray:
    h = tokens * _FACTORS[k]
    return (h ^ (h >> np.uint64(32))) * _FACTORS[k + 32]


def inner_repeats(tokens: np.ndarray, width: int, shingle: int) -> int:
    """Words inside runs of ``width`` tokens that the same text holds earlier as well."""
    f = _FACTORS[0]
    powers = np.cumprod(np.full(len(tokens), f))
    back = np.cumprod(np.full(len(tokens), np.uint64(pow(int(f), -1, 1 << 64))))
    total = np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers)])
    runs = (total[width:] - total[:-width]) * back[: len(tokens) - width + 1]
    _, first = np.unique(runs, return_index=True)
    if len(first) == len(runs):
        return 0
    later = np.ones(len(runs), bool)
    later[first] = False
    edges = np.zeros(len(tokens) + shingle, np.int64)
    at = np.flatnonzero(later)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width + shingle - 1, -1)
    return int((np.cumsum(edges) > 0).sum())


def windows(texts: DataFrame, shingle: int, width: int, hashes: int) -> DataFrame:
    """d, n (words), g (digest of the token sequence), inner (n_inner_words), w (array of key, h, a, c, b); ``texts``: d, text (binary)."""
    kind = pa.struct([("key", pa.int64()), ("h", pa.int32()), ("a", pa.int32()), ("c", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, inner, some_of = [], [], [], []
            sequences: list[np.ndarray] = []
            for row, (s, count) in enumerate(shingle_lists(batch.column(1).to_pylist(), shingle)):
                n.append(count)
                digests.append(hashlib.md5(s.tobytes()).digest())
                again = 0
                if len(s) >= width:
                    some_of.append(row)
                    if len(np.unique(s)) < len(s):
                        again = inner_repeats(s, width, shingle)
                inner.append(again)
                sequences.append(s)
            found = []  # row, key, function, a, c, b
            while some_of:
                held, some = 0, []
                while some_of and held < GROUP:
                    some.append(some_of.pop())
                    held += len(sequences[some[-1]])
                tokens = np.concatenate([sequences[r] for r in some])
                size = np.array([len(sequences[r]) for r in some])
                first = np.cumsum(size) - size
                for k in range(hashes):
                    h = hashed(tokens, k)
                    a, c, b = many_windows(h, first, first + size - 1, width)
                    of = np.searchsorted(first, c, "right") - 1
                    found.append((np.array(some)[of], h[c] * np.uint64(hashes) + np.uint64(k), np.full(len(c), k), a - first[of], c - first[of], b - first[of]))
            row, key, *places = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (int, np.uint64, int, int, int, int))
            order = np.argsort(row, kind="stable")
            columns = [pa.array(key[order].view(np.int64)), *(pa.array(v[order].astype(np.int32)) for v in places)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(inner, pa.int64()), lists], names=["d", "n", "g", "inner", "w"]
            )

    return texts.mapInArrow(run, "d long, n long, g binary, inner long, w array<struct<key:long,h:int,a:int,c:int,b:int>>")


def numbered(tokens: np.ndarray) -> np.ndarray:
    """Each token with its count so far: equal tokens become distinct, first with first, second with second."""
    order = np.argsort(tokens, kind="stable")
    held = tokens[order]
    first = np.concatenate([[True], held[1:] != held[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(held)), 0))
    out = np.empty(len(tokens), np.uint64)
    out[order] = held.astype(np.uint64) << np.uint64(32) | (np.arange(len(held)) - start).astype(np.uint64)
    return out


def need_of(width: int, percent: int) -> int:
    """Tokens that two passages of this width share at the similarity."""
    return -(-2 * percent * width // (100 + percent))


def aligned(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Runs of windows of x whose tokens stand in y close enough together for the similarity."""
    order = np.argsort(y, kind="stable")
    other = order[np.minimum(np.searchsorted(y[order], x), len(y) - 1)]
    return _runs(other, y[other] == x, width, percent)


def _runs(other: np.ndarray, hit: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """``other``: each token's place in y, where ``hit``."""
    total = np.concatenate([[0], np.cumsum(hit)])
    shared = total[width:] - total[:-width]
    starts = np.flatnonzero(shared >= need_of(width, percent))
    if not len(starts):
        return []
    places = np.flatnonzero(hit)
    first, last = places[np.searchsorted(places, starts)], places[np.searchsorted(places, starts + width) - 1]
    size = other[last] - other[first] + 1
    n = shared[starts]
    good = (100 * size >= percent * width) & (100 * n >= percent * (width + np.maximum(size, n) - n))
    first, last, starts = first[good], last[good], starts[good]
    if not len(starts):
        return []
    cuts = np.flatnonzero((np.diff(starts) > 1) | (np.abs(np.diff(other[first])) > width)) + 1
    return [(int(f[0]), int(z.max()) + 1, int(other[f].min()), int(other[z].max()) + 1) for f, z in zip(np.split(first, cuts), np.split(last, cuts), strict=True)]


def repeated(tokens: np.ndarray) -> np.ndarray:
    _, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    return counts[at] > 1


def uncovered(places: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """``places`` (a mask) outside the spans."""
    edges = np.zeros(len(places) + 1, np.int64)
    for s, e in spans:
        edges[s] += 1
        edges[e] -= 1
    return places & (np.cumsum(edges)[:-1] <= 0)


def passages(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(s, e, s2, e2): token spans of x with their counterparts in y, made of windows that reach the similarity."""
    if len(x) < width or len(y) < width:
        return []
    order = np.argsort(y, kind="stable")
    held = y[order]
    at = np.minimum(np.searchsorted(held, x), len(y) - 1)
    hit = held[at] == x
    total = np.concatenate([[0], np.cumsum(hit)])
    starts = np.flatnonzero(total[width:] - total[:-width] >= need_of(width, percent))  # windows that have enough tokens anywhere in y
    if not len(starts):
        return []
    used = np.bincount(at[hit], minlength=len(y))
    again = np.flatnonzero(held[1:] == held[:-1])
    if used.max() < 2 and not used[again].any():  # no shared token stands twice on either side
        return _runs(order[at], hit, width, percent)
    out = []
    cuts = np.flatnonzero(np.diff(starts) > width) + 1
    for a, b in ((int(p[0]), int(p[-1]) + width) for p in np.split(starts, cuts)):
        first, last = reach(y, x[a:b], width)
        out += [(s + a, e + a, s2 + first, e2 + first) for s, e, s2, e2 in _passages(x[a:b], y[first:last], width, percent)]
    return out


def passages_both_ways(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages of x found in y and passages of y found in x: windows have a fixed width on the side they are taken from, so words put in
    on one side show only from the other."""
    out = passages(x, y, width, percent) + [(s, e, s2, e2) for s2, e2, s, e in passages(y, x, width, percent)]
    return list(dict.fromkeys(out))


def reach(y: np.ndarray, part: np.ndarray, width: int) -> tuple[int, int]:
    """From the first to the last token of y that stands in ``part``."""
    at = np.flatnonzero(np.isin(y, part))
    return int(at[0]), int(at[-1]) + 1


def _passages(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    if len(y) < need_of(width, percent):
        return []
    found = aligned(x, y, width, percent)
    twice, again = repeated(x), repeated(y)
    if twice.any() or again.any():  # repeated tokens: also match the k-th with the k-th
        found += aligned(numbered(x), numbered(y), width, percent)
    again = uncovered(again & np.isin(y, x), [v[2:] for v in found])
    if not again.any():
        return found
    # tokens with several places in y: every place left over, by stretches one of which holds any counterpart whole
    far = 100 * width // percent
    twice &= np.isin(x, y)
    for at in range(0, len(y), far):
        if not again[at : at + 2 * far].any():
            continue
        part = y[at : at + 2 * far]
        found += [(s, e, s2 + at, e2 + at) for s, e, s2, e2 in aligned(x, part, width, percent)]
        if not (twice.any() and repeated(part).any()):
            continue
        for on in range(0, len(x), far):
            end, end2 = min(on + 2 * far, len(x)), min(at + 2 * far, len(y))
            if not twice[on:end].any() or any(s <= on and end <= e and s2 <= at and end2 <= e2 for s, e, s2, e2 in found):
                continue
            found += [(s + on, e + on, s2 + at, e2 + at) for s, e, s2, e2 in aligned(numbered(x[on:end]), numbered(part), width, percent)]
    return found


def _two(a: str, b: str) -> Column:
    return F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))


def combined(roots: DataFrame, width: int) -> DataFrame:
    """ck, d, lo, hi: pairs of a document's windows of two functions that hold a common passage; the shortest passages with both roots
    start from lo to hi. ``roots``: d, ws (key, a|c, h|b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << 32) - 1
        for batch in batches:
            ws = batch.column(1)
            key, ac, hb = (ws.values.field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ws.offsets.to_numpy()))
            place = row << 32 | ac & low
            order = np.argsort(place, kind="stable")
            place, k, a, c, h, b = place[order], key.view(np.uint64)[order], (ac >> 32)[order], (ac & low)[order], (hb >> 32)[order], (hb & low)[order]
            d = batch.column(0).to_numpy()[row[order]]
            # both roots lie in a passage of ``width`` tokens, so a window meets only those of its text whose roots follow less than that far behind
            upto = np.searchsorted(place, place + width)
            met = upto - np.arange(len(place)) - 1
            total = np.concatenate([[0], np.cumsum(met)])
            at = 0
            while at < len(place):
                end = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), "right")) - 1)
                n = met[at:end]
                u = np.repeat(np.arange(at, end), n)
                v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
                at = end
                apart = h[u] != h[v]
                u, v = u[apart], v[apart]
                swap = h[u] > h[v]
                u, v = np.where(swap, v, u), np.where(swap, u, v)
                first, last = np.maximum(a[u], a[v]), np.minimum(b[u], b[v])
                near, far = np.minimum(c[u], c[v]), np.maximum(c[u], c[v])
                lo, hi = np.maximum(first, far - width + 1), np.minimum(last - width + 1, near)
                some = (first <= near) & (far <= last) & (lo <= hi)
                u, v, lo, hi = u[some], v[some], lo[some], hi[some]
                mixed = k[u] * _FACTORS[0] ^ (k[v] * _FACTORS[1] >> np.uint64(7)) ^ k[v] * _FACTORS[2]
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(d[u]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["ck", "d", "lo", "hi"])

    return roots.mapInArrow(run, "ck long, d long, lo int, hi int")


def together(pairs: DataFrame, width: int) -> DataFrame:
    """d, lead of the rows of ``pairs`` (d, lead, ws: array of a|c, h|b, a2|c2, h2|b2) of which windows of two functions hold a common passage on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << 32) - 1
        for batch in batches:
            ws = batch.column(2)
            ends = ws.offsets.to_numpy()
            ac, hb, ac2, hb2 = (ws.values.field(k).to_numpy() for k in range(4))
            all_of = (hb >> 32, ac >> 32, ac & low, hb & low, ac2 >> 32, ac2 & low, hb2 & low)
            good = np.zeros(batch.num_rows, bool)
            for row, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                h, *sides = (v[i:j] for v in all_of)
                step = max(1, (1 << 16) // (j - i))
                for at in range(0, j - i, step):
                    fits = h[at : at + step, None] < h
                    for a, c, b in (sides[:3], sides[3:]):
                        u_a, u_c, u_b = (v[at : at + step, None] for v in (a, c, b))
                        first, last = np.maximum(u_a, a), np.minimum(u_b, b)
                        fits &= (first <= np.minimum(u_c, c)) & (np.maximum(u_c, c) <= last) & (last - first + 1 >= width)
                    if fits.any():
                        good[row] = True
                        break
            yield batch.select([0, 1]).filter(pa.array(good))

    return pairs.mapInArrow(run, "d long, lead long")


def _pair(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one * _FACTORS[0] ^ (other * _FACTORS[1] >> np.uint64(7))) * _FACTORS[2] + other


def sub_keys(roots: DataFrame, width: int, percent: int) -> DataFrame:
    """sk, d, p: pairs of tokens of which a shortest passage in one of the ranges shares one with any counterpart; ``roots``: d, rs
    (ranges of starts), t (tokens)."""
    need = need_of(width, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rs, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.frombuffer(raw, "<u4").astype(np.uint64)
                marks = np.zeros(len(t) + 1, np.int64)
                at = np.array([(r["lo"], r["hi"]) for r in rs])
                np.add.at(marks, at[:, 0], 1)
                np.add.at(marks, np.minimum(at[:, 1] + width - need + 1, len(t)), -1)
                near = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                for apart in range(need - 1, need + 1):
                    p = near[near + apart < len(t)]
                    sk = _pair(t[p], t[p + apart])
                    yield pa.RecordBatch.from_arrays([pa.array(sk.view(np.int64)), pa.array(np.full(len(p), d, np.int64)), pa.array(p.astype(np.int32))], names=["sk", "d", "p"])

    return roots.mapInArrow(run, "sk long, d long, p int")


def runs_of(width: int, percent: int, shingle: int) -> list[tuple[int, int]]:
    """Lengths (first, last): of two counterparts whose first and last tokens, need - 1 or need apart, are equal, both have one of them in common. None if
    more than one edit fits into a passage."""
    need = need_of(width, percent)
    lack = width - need
    both = need - lack  # equal before and behind the edit, together
    if both < 2 or lack // max(shingle - 1, 1) > 1:
        return []
    step = min(SLOT, both - 1)
    return [(a, max(both - (a + step - 1), 1)) for a in range(1, both, step)]


def refined(rows: DataFrame, width: int, percent: int, shingle: int) -> DataFrame:
    """sk, d, p, stays, counts: a sub-key with equal runs of tokens at both ends; ``rows``: d, rs (sub-keys: sk, p, stays), t (tokens). Where tokens repeat
    between the ends, their order says nothing: such rows count under the sub-key itself, which all have as well."""
    need, runs = need_of(width, percent), runs_of(width, percent, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _FACTORS[0]
        inverse = np.uint64(pow(int(f), -1, 1 << 64))
        for batch in batches:
            rs = batch.column(1)
            ends = rs.offsets.to_numpy()
            sk, at, stays = (rs.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for d, raw, i, j in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends[:-1], ends[1:], strict=True):
                t = np.frombuffer(raw, "<u4").astype(np.uint64)
                total = np.concatenate([[np.uint64(0)], np.cumsum(t * np.cumprod(np.full(len(t), f)))])
                back = np.cumprod(np.full(len(t), inverse))
                places = np.argsort(t, kind="stable")
                again, same = np.full(len(t), -1), np.flatnonzero(t[places[1:]] == t[places[:-1]])
                again[places[same + 1]] = places[same]
                again = np.maximum.accumulate(again)  # the last place up to here of a token that comes again up to here
                order = np.lexsort((at[i:j], sk[i:j]))
                key, place, left = sk[i:j][order].view(np.uint64), at[i:j][order].astype(np.int64), stays[i:j][order]
                first = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
                key, place, left = key[first], place[first], np.maximum.reduceat(left, np.flatnonzero(first))
                out = []
                for apart in range(need - 1, need + 1):
                    some = np.flatnonzero(place + apart < len(t))
                    some = some[_pair(t[place[some]], t[place[some] + apart]) == key[some]]
                    p, k, end = place[some], key[some], place[some] + apart + 1
                    for n, (a, b) in enumerate(runs):
                        one, other = (total[p + a] - total[p]) * back[p], (total[end] - total[end - b]) * back[end - b]
                        out.append(((k * _FACTORS[3] ^ _pair(one ^ (one >> np.uint64(29)), other ^ (other >> np.uint64(31)))) * _FACTORS[4] + np.uint64(n), p, left[some], np.ones(len(p), bool)))
                    out.append((k, p, left[some], again[end - 1] >= p))
                fine, p, left, counts = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fine.view(np.int64)), pa.array(np.full(len(p), d, np.int64)), pa.array(p.astype(np.int32)), pa.array(left), pa.array(counts)], names=["sk", "d", "p", "stays", "counts"])

    return rows.mapInArrow(run, "sk long, d long, p int, stays boolean, counts boolean")


def _sides(found: DataFrame) -> DataFrame:
    """d, partner, s, e: the spans of both sides."""
    other = found.select(F.col("lead").alias("d"), F.col("d").alias("partner"), F.col("s2").alias("s"), F.col("e2").alias("e"))
    return found.select("d", F.col("lead").alias("partner"), "s", "e").unionByName(other)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, words: int = WORDS, hashes: int = HASHES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_dup_words, spans ("start:end" in words, end exclusive, comma-joined), partner_id, component_id, n_inner_words.

    Both sides of a link get spans. ``partner_id`` is the smallest document directly linked, null if none;
    ``component_id`` the smallest document reachable.
    """
    ship(docs.sparkSession)
    width = words - shingle + 1
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("binary").alias("text"))
    rows = saved(windows(texts, shingle, width, hashes), "windows")
    long_ones = rows.where((F.col("n") >= words) & F.col("d").isNotNull())
    classes = saved(long_ones.groupBy("g").agg(F.min("d").alias("rep"), F.max("d").alias("last")).where("rep < last").select("g", "rep"), "classes")
    copies = saved(long_ones.select("d", "g", "n").join(classes, "g").where("d <> rep").distinct(), "copies")
    each = long_ones.join(small(copies.select("d", "g"), MOST_BROADCAST), ["d", "g"], "left_anti").select("d", F.inline_outer("w")).where("key is not null")
    # two numbers to a column: these rows are the bulk of what is shuffled
    each = each.select("key", "d", _two("a", "c").alias("ac"), _two("h", "b").alias("hb"))
    keys = each.groupBy("key").agg(F.min("d").alias("lead"), F.max("d").alias("last")).where("lead < last").drop("last")
    met = saved(each.join(keys, "key"), "met")
    sizes = saved(rows.select("d", "n", "inner"), "sizes")
    discard(rows)
    lead = met.where("d = lead").groupBy("key").agg(F.min(F.struct(F.col("ac").alias("ac2"), F.col("hb").alias("hb2"))).alias("y"))
    members = saved(met.where("d <> lead").join(lead, "key").select("key", "d", "lead", "ac", "hb", "y.ac2", "y.hb2"), "members")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(s >> np.uint64(32)).astype("<u4").tobytes() for s, _ in shingle_lists(batch.column(1).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["d", "t"])

    ids = saved(met.select("d").distinct(), "ids")
    read = saved(texts.join(small(ids, MOST_BROADCAST), "d", "left_semi").mapInArrow(tokens, "d long, t binary"), "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, lead, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(d, lead, *v) for v in passages_both_ways(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), width, percent)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(columns)], names=["d", "lead", "s", "e", "s2", "e2"])

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(read.withColumnRenamed("t", "x"), "d").join(read.select(F.col("d").alias("lead"), F.col("t").alias("y")), "lead").select("d", "lead", "x", "y")
        return saved(both.mapInArrow(verify, "d long, lead long, s int, e int, s2 int, e2 int"), "found")

    per = members.groupBy("d", "lead").agg(F.collect_list(F.struct("ac", "hb", "ac2", "hb2")).alias("ws")).where(F.size("ws") > 1)
    tested = saved(together(per, width), "pairs")
    found = verified(tested)

    # keys with members whose root lies outside the passages shared with their leader: all windows of all that hold such a key
    shared = found.groupBy("d", "lead").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    c = F.col("ac").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    apart = members.select("key", "d", "lead", "ac").join(shared, ["d", "lead"], "left")
    apart = apart.where(F.col("spans").isNull() | ~F.exists("spans", lambda v: (v["s"] <= c) & (c < v["e"])))
    roots = met.join(apart.select("key").distinct(), "key", "left_semi").groupBy("d").agg(F.collect_list(F.struct("key", "ac", "hb")).alias("ws"))
    twos = saved(combined(roots, width), "twos")
    discard(met, members)

    def learn() -> DataFrame:
        """component, spans of all documents with a passage found so far (a document with a span has a link, and the other way round)."""
        covers = _sides(found).groupBy("d").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        linked = components(found.select(F.col("d").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "d")
        return saved(covers.join(linked, "d"), "known")

    def told(rows: DataFrame, known: DataFrame, inside) -> DataFrame:
        """Adds the component so far, and whether a span found so far covers the row."""
        out = rows.join(small(known, MOST_KNOWN), "d", "left")
        return out.select(*rows.columns, F.coalesce("component", "d").alias("comp"), F.coalesce(F.exists("spans", inside), F.lit(False)).alias("old"))

    def opens(rows: DataFrame, key: str) -> DataFrame:
        """Rows of the groups that hold two documents and not only covered rows of one component."""
        sums = rows.groupBy(key).agg(F.min("d").alias("d1"), F.max("d").alias("d2"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("old").alias("o"))
        return rows.join(sums.where("d1 < d2 and (c1 < c2 or not o)").select(key), key).drop("comp", "old")

    known = learn()
    marked = told(twos, known, lambda v: F.greatest(v["s"], F.col("lo")) <= F.least(F.col("hi"), v["e"] - width))
    both = opens(marked, "ck").groupBy("d").agg(F.collect_set(F.struct("lo", "hi")).alias("rs"))
    subs = saved(sub_keys(both.join(read, "d").select("d", "rs", "t"), width, percent), "subs")
    discard(twos)

    def at_p(v: Column) -> Column:
        return (v["s"] <= F.col("p")) & (F.col("p") < v["e"])

    lists = saved(opens(told(subs, known, at_p), "sk"), "lists")
    discard(subs)

    fine = not runs_of(width, percent, shingle)  # several edits: the sub-keys stay as they are
    active, buckets, condition = lists, 1, "same"
    while True:
        bucket = F.pmod(F.xxhash64("d"), F.lit(buckets)).alias("bucket")
        leaders = saved(active.groupBy("sk", bucket).agg(F.min("d").alias("lead")).drop("bucket"), "leaders")
        if leaders.isEmpty():
            break
        of = leaders.select("sk", F.col("lead").alias("d"))

        def met_by_leaders(rows: DataFrame) -> DataFrame:
            """Rows with each leader of their key: in one component with it, or even (same) both covered there."""
            own = told(active.join(of, ["sk", "d"]), known, at_p).groupBy("sk", F.col("d").alias("lead")).agg(F.max("comp").alias("lcomp"), F.min("old").alias("lold"))
            return told(rows, known, at_p).join(own, "sk").withColumn("one", F.col("comp") == F.col("lcomp")).withColumn("same", F.col("one") & F.col("old") & F.col("lold"))

        # a new leader meets all members of its key, also those that left; after the first round only those of other components
        pairs = met_by_leaders(lists).where("d <> lead").where(~F.col(condition)).select(F.greatest("d", "lead").alias("d"), F.least("d", "lead").alias("lead")).distinct()
        pairs = saved(pairs.join(tested, ["d", "lead"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tested, more = tested.unionByName(pairs), verified(pairs)
            if not more.isEmpty():
                found = found.unionByName(more)
                known = learn()
        stays = active.join(of, ["sk", "d"], "left_anti")
        met_now = met_by_leaders(stays)
        spans = _sides(found).withColumnRenamed("partner", "lead")
        leave = met_now.where("one").select("sk", "d", "p").unionByName(met_now.where("not one").join(spans, ["d", "lead"]).where("s <= p and p < e").select("sk", "d", "p"))
        active = saved(stays.join(leave.distinct(), ["sk", "d", "p"], "left_anti"), "active")
        buckets, condition = buckets * 4, "one"
        if not fine:
            fine, buckets = True, 1
            left = active.distinct().withColumn("stays", F.lit(True))
            rows = lists.join(active.select("sk").distinct(), "sk", "left_semi").join(left, ["sk", "d", "p"], "left")
            each = rows.groupBy("d").agg(F.collect_list(F.struct("sk", "p", F.coalesce("stays", F.lit(False)).alias("stays"))).alias("rs"))
            split = saved(refined(each.join(read, "d").select("d", "rs", "t"), width, percent, shingle), "refined")
            apart = told(split, known, at_p)
            open_ones = apart.groupBy("sk").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.max("stays").alias("stays"), F.max("counts").alias("counts")).where("c1 < c2 and stays and counts").select("sk")
            wide, lists = lists, saved(split.join(open_ones, "sk"), "lists")
            discard(wide, split)
            lists, active = lists.select("sk", "d", "p"), lists.where("stays").select("sk", "d", "p")

    # copies: linked with the text that stands for them, over their whole length
    linked = components(found.select(F.col("d").alias("a"), F.col("lead").alias("b")).unionByName(copies.select(F.col("d").alias("a"), F.col("rep").alias("b"))))
    sides = _sides(found)
    whole = (F.col("n") - shingle + 1).cast("int")
    doubles = copies.groupBy("rep").agg(F.min("d").alias("partner"), F.max(whole).alias("e"))
    sides = sides.unionByName(doubles.select(F.col("rep").alias("d"), "partner", F.lit(0).alias("s"), "e"))
    sides = sides.unionByName(copies.select("d", F.col("rep").alias("partner"), F.lit(0).alias("s"), whole.alias("e")))
    # spans that start and end in the same stretches of 16 words become one first: few per document however many partners
    coarse = sides.groupBy("d", F.floor(F.col("s") / 16), F.floor(F.col("e") / 16)).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("partner").alias("partner"))
    gathered = coarse.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("s", F.expr(f"e + {shingle - 1}").alias("e")))).alias("found"), F.min("partner").alias("partner_id"))

    def merge(acc, v):
        last = F.element_at(acc, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], v["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (v["s"] <= F.get(acc, F.size(acc) - 1)["e"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(v)))

    merged = gathered.withColumn("spans", F.aggregate(F.slice("found", F.lit(2), F.size("found")), F.slice("found", 1, 1), merge)).drop("found")
    every = sizes.join(merged, "d", "left").join(linked.withColumnRenamed("node", "d"), "d", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>"))
    return every.select(
        F.col("d").alias(id_col), F.col("n").alias("n_words"), F.aggregate(spans, F.lit(0), lambda t, v: t + v["e"] - v["s"]).cast("long").alias("n_dup_words"),
        F.array_join(F.transform(spans, lambda v: F.concat(v["s"].cast("string"), F.lit(":"), v["e"].cast("string"))), ",").alias("spans"),
        "partner_id", F.coalesce("component", "d").alias("component_id"), F.col("inner").alias("n_inner_words"),
    )
