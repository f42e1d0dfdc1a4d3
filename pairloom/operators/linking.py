"""Linking spans to a taxonomy: exact and alias keys, similarity, term scan, derived and curated aliases."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf

from pairloom.functions import match as M
from pairloom.functions import text as X
from pairloom.plans.runtime import saved, ship

# Short common words that are no terms of a scan.
AMBIGUOUS = ("can", "lead", "go", "r", "c", "it", "ai")
BLOCK = 1024  # vectors of a block
FEW_TERMS = 16  # looked for in the text by column functions
MOST_TERMS = 200_000  # of a trie
MOST_KEYS = 500_000  # keys or spans that are broadcast
TEXTS = 128  # folded at once
LETTERS = 1 << 20  # of texts hashed at once
FEATURES = 1 << 20  # whose cells a task keeps in mind


def nfkc(col: Column, spark) -> Column:
    """Compatibility-composed, case-folded text; ``TEXTS`` of an Arrow batch are strings of Python at once."""
    import unicodedata

    ship(spark)

    @arrow_udf("string")
    def fold(s: pa.Array) -> pa.Array:
        parts = [pa.array([None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in s.slice(at, TEXTS).to_pylist()], pa.string()) for at in range(0, len(s), TEXTS)]
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    return fold(col)


def alias_index(labels: DataFrame) -> DataFrame:
    """key -> skill_id: the first writer by record order, then label order. labels: skill_id, ord, labels (array, the canonical one first)."""
    each = labels.select("skill_id", "ord", F.posexplode_outer("labels").alias("k", "label")).withColumn("key", X.normalize_label(F.col("label"))).where("key <> ''")
    return each.groupBy("key").agg(F.min(F.struct("ord", "k", "skill_id")).alias("f")).select("key", F.col("f.skill_id").alias("skill_id"))


def derived_aliases(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Bare "X" of "X (qualifier)": real labels win, a form that two concepts claim goes to neither; longer than two letters."""
    pattern = r"^(.+?)\s*\([^)]+\)\s*$"
    each = labels.select("skill_id", F.explode_outer("labels").alias("label"))
    bare = each.select("skill_id", X.normalize_label(F.regexp_extract(F.trim("label"), pattern, 1)).alias("key"))
    bare = bare.where((F.length("key") > 2) & ~F.col("key").isin(*AMBIGUOUS)).join(index.select("key"), "key", "left_anti")
    return bare.groupBy("key").agg(F.countDistinct("skill_id").alias("n"), F.min("skill_id").alias("skill_id")).where("n = 1").drop("n")


def merge_aliases(index: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated aliases that take effect: skill_id, key. overrides: skill_id, ord, aliases. The first override per skill counts,
    unknown skills and keys owned by another skill are skipped, and of two claims the earlier wins."""
    first = overrides.withColumn("rn", F.row_number().over(W.partitionBy("skill_id").orderBy("ord"))).where("rn = 1").drop("rn")
    known = index.select("skill_id").distinct()
    each = first.join(known, "skill_id", "left_semi").select("skill_id", "ord", F.posexplode_outer("aliases").alias("k", "alias")).withColumn("key", X.normalize_label(F.col("alias"))).where("key <> ''")
    owned = each.join(index.select("key", F.col("skill_id").alias("owner")), "key", "left").where(F.col("owner").isNull())
    return owned.groupBy("key").agg(F.min(F.struct("ord", "k", "skill_id")).alias("f")).select("key", F.col("f.skill_id").alias("skill_id"))


def _fragments(spans: DataFrame, key: str, col: str) -> DataFrame:
    """key, k, fragment, norm: the span and its fragments at commas, slashes, semicolons, "and" and "or"."""
    text = F.trim(col)
    # Separators of a span's fragments, a leading conjunction, blanks and full stops around a fragment.
    parts = F.transform(F.split(text, r"(?i)[,/;]|\s+\b(?:and|or)\b\s+", -1), lambda v: F.regexp_replace(F.regexp_replace(v, r"(?i)^(?:and|or)\s+", ""), r"^[ \t.]+|[ \t.]+$", ""))
    rows = spans.where(text != "").select(key, F.posexplode_outer(F.concat(F.array(text), F.filter(parts, lambda v: v != ""))).alias("k", "fragment"))
    return rows.withColumn("norm", F.coalesce(F.nullif(X.normalize_label(F.col("fragment")), F.lit("")), F.lower("fragment"))).where("norm <> ''")


def expand_spans(spans: DataFrame, key: str, col: str) -> DataFrame:
    """The span and its fragments: key, k, fragment, norm; first per norm."""
    first = _fragments(spans, key, col).groupBy(key, "norm").agg(F.min(F.struct("k", "fragment")).alias("f"))
    return first.select(key, F.col("f.k").alias("k"), F.col("f.fragment").alias("fragment"), "norm")


def _few(rows: DataFrame) -> DataFrame:
    """Saved rows, with a broadcast hint if they are at most ``MOST_KEYS``: a norm that most spans have then lands in no single task. Beyond, the join shuffles."""
    rows = saved(rows, "keys")
    return F.broadcast(rows) if rows.count() <= MOST_KEYS else rows


def link_exact(fragments: DataFrame, index: DataFrame) -> DataFrame:
    """Adds skill_id where the fragment's norm is a key."""
    return fragments.join(_few(index.select(F.col("key").alias("norm"), "skill_id")), "norm", "left")


def link_similar(fragments: DataFrame, vectors: DataFrame, concepts: DataFrame, high: float, threshold: float, margin: float) -> DataFrame:
    """Fragments whose skill_id is null get the concept whose vector is closest, if it is close enough. fragments: norm, skill_id;
    vectors: norm, embedding; concepts: d (skill id), embedding. Each distinct text is compared once."""
    open_ = fragments.where("skill_id is null").select("norm").distinct().join(vectors.select(F.col("norm"), "embedding"), "norm")
    top = similarity_top2(open_.select(F.col("norm").alias("q"), "embedding"), concepts)
    near = top.where(M.link_decision(F.col("best"), F.col("second"), high, threshold, margin)).select(F.col("q").alias("norm"), F.col("best_id").alias("near_id"))
    return fragments.join(near, "norm", "left").withColumn("skill_id", F.coalesce("skill_id", "near_id")).drop("near_id")


def link_report(spans: DataFrame, key: str, col: str, index: DataFrame, similar=None) -> DataFrame:
    """Per row: skill_ids in order of first success, and whether the span stayed unlinked. ``similar`` (fragments -> fragments with
    more skill_ids) is the second tier, for fragments without a key of their own.

    Only fragments that link are gathered per key; of those with one skill the first counts."""
    linked = link_exact(_fragments(spans, key, col).select(key, "k", "norm"), index)
    linked = similar(linked) if similar else linked
    ids = linked.where("skill_id is not null").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("k", "skill_id"))).alias("s"))
    out = spans.select(key).join(ids, key, "left")
    return out.select(key, F.coalesce(F.array_distinct(F.transform("s", lambda v: v["skill_id"])), F.array().cast("array<string>")).alias("skill_ids"), F.col("s").isNull().alias("unlinked"))


def link_or_scan(docs: DataFrame, key: str, col: str, spans: DataFrame, span_col: str, index: DataFrame, terms: DataFrame, similar=None) -> DataFrame:
    """key, how, skill_ids: what a document's spans, however many, link to or, if nothing, all terms that a scan of its text finds.

    Each distinct span is linked once, and of the documents' spans only those that link are gathered."""
    texts = spans.select(F.col(span_col).alias("of")).where("of is not null").distinct()
    links = _few(link_report(texts, "of", "of", index, similar).where(~F.col("unlinked")).select("of", "skill_ids"))
    linked = spans.join(links, F.col(span_col) == F.col("of")).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("skill_ids")))).alias("linked"))
    both = docs.select(key, col).join(linked, key, "left")
    found = scan_terms(both.where("linked is null"), key, col, terms).groupBy(key).agg(F.array_sort(F.collect_set("skill_id")).alias("found"))
    how = F.when(F.col("linked").isNotNull(), "linked").when(F.col("found").isNotNull(), "scanned").otherwise("none")
    return both.join(found, key, "left").select(key, how.alias("how"), F.coalesce("linked", "found", F.array().cast("array<string>")).alias("skill_ids"))


def token_trie(terms: list[str]) -> dict:
    """Terms by their tokens: a node maps the next token to a node, and None to the term that ends there."""
    root: dict = {}
    for term in terms:
        node = root
        for token in term.split(" "):
            node = node.setdefault(token, {})
        node[None] = term
    return root


def terms_in(trie: dict, text: str) -> set[str]:
    """The terms that stand in the text, token by token."""
    tokens, found = text.split(" "), set()
    for k, token in enumerate(tokens):
        node = trie.get(token)
        while node is not None:
            if None in node:
                found.add(node[None])
            k += 1
            node = node.get(tokens[k]) if k < len(tokens) else None
    return found


def scan_terms(docs: DataFrame, key: str, col: str, terms: DataFrame) -> DataFrame:
    """Terms (skill_id, term) that stand token-bounded in the normalised text; per (document, skill) the longest.

    Up to ``FEW_TERMS`` terms are looked for by column functions. Else texts are walked along a trie of the terms' tokens; either way only hits become rows,
    however long the terms are. The terms go to the workers in slices of about ``MOST_TERMS``, each with a pass of its own over the texts.
    """
    ship(docs.sparkSession)
    norm = terms.select("skill_id", X.normalize_label(F.col("term")).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*AMBIGUOUS)).distinct()
    n_terms = norm.count()
    slices = max(1, math.ceil(n_terms / max(1, MOST_TERMS)))
    texts = docs.select(key, X.normalize_label(F.col(col)).alias("t"))
    schema = T.StructType([docs.schema[key], T.StructField("term", T.StringType())])
    hits = None
    if n_terms <= FEW_TERMS:
        few = F.array(*[F.lit(r["term"]) for r in norm.select("term").distinct().collect()]).cast("array<string>")
        padded = texts.withColumn("t", F.concat(F.lit(" "), "t", F.lit(" ")))
        inside = F.filter(few, lambda v: F.contains(F.col("t"), F.concat(F.lit(" "), v, F.lit(" "))))
        hits, slices = padded.select(key, F.explode_outer(inside).alias("term")).where("term is not null").join(F.broadcast(norm), "term"), 0
    for k in range(slices):
        some = norm.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == k)
        told = docs.sparkSession.sparkContext.broadcast([r["term"] for r in some.select("term").distinct().collect()])  # about MOST_TERMS

        def run(batches, told=told):
            import pyarrow as pa

            trie = token_trie(told.value)
            for batch in batches:
                found = [(row, term) for row, text in enumerate(batch.column(1).to_pylist()) if text for term in terms_in(trie, text)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in found], pa.int64())), pa.array([t for _, t in found], pa.string())], names=[key, "term"])

        part = texts.mapInArrow(run, schema).join(some, "term")
        hits = part if hits is None else hits.unionByName(part)
    return hits.groupBy(key, "skill_id").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))


def first_form(rows: DataFrame, key: str, text: str, forms: str) -> DataFrame:
    """The first of the forms that stands token-bounded in the text, both normalised; null if none does."""
    hit = F.filter(forms, lambda v: (X.normalize_label(v) != "") & F.contains(F.concat(F.lit(" "), X.normalize_label(F.col(text)), F.lit(" ")), F.concat(F.lit(" "), X.normalize_label(v), F.lit(" "))))
    return rows.select(key, F.get(hit, F.lit(0)).alias("form"))


def partition_for_embed(records: DataFrame, existing: DataFrame, model: str) -> DataFrame:
    """records (skill_id, label) with ``needs``: no vector of this model yet. existing: skill_id, model."""
    has = existing.where(F.col("model") == model).select("skill_id", F.lit(True).alias("has")).distinct()
    return records.join(has, "skill_id", "left").select("skill_id", "label", F.col("has").isNull().alias("needs"))


def _blocks(df: DataFrame, ident: str, tag: str) -> DataFrame:
    n = max(1, math.ceil(df.count() / BLOCK))
    rows = df.where("embedding is not null").groupBy(F.pmod(F.xxhash64(ident), F.lit(n)).alias("b")).agg(F.collect_list(F.struct(F.col(ident).alias("i"), F.col("embedding").alias("v"))).alias("s"))
    return rows.select(F.transform("s", lambda v: v["i"]).alias(f"{tag}i"), F.flatten(F.transform("s", lambda v: v["v"])).alias(f"{tag}v"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """q, d, score (6 decimals), rank: the k best by inner product, ties to the smaller d. queries: q, embedding; corpus: d, embedding.

    Blocks of queries meet blocks of the corpus; each pair of blocks is one matrix product that keeps k per query.
    """
    ship(queries.sparkSession)
    pairs = _blocks(queries, "q", "q").crossJoin(_blocks(corpus, "d", "c"))

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for qi, qv, ci, cv in zip(pdf["qi"], pdf["qv"], pdf["ci"], pdf["cv"], strict=True):
                qi, ci = np.asarray(qi), np.asarray(ci)
                s = np.round(np.asarray(qv, np.float64).reshape(len(qi), -1) @ np.asarray(cv, np.float64).reshape(len(ci), -1).T, 6)
                if skip_self:
                    s[qi[:, None] == ci[None, :]] = -np.inf
                order = np.argsort(ci, kind="stable")
                best = np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]
                d = ci[order][best]
                out.append(pd.DataFrame({"q": np.repeat(qi, d.shape[1]), "d": d.ravel(), "score": np.take_along_axis(s[:, order], best, 1).ravel()}))
            yield pd.concat(out) if out else pd.DataFrame({"q": [], "d": [], "score": []})

    kind = dict(queries.dtypes)["q"], dict(corpus.dtypes)["d"]
    found = pairs.mapInPandas(run, f"q {kind[0]}, d {kind[1]}, score double").where(F.col("score") > float("-inf"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "d"))).where(F.col("rank") <= k)


def similarity_top2(spans: DataFrame, skills: DataFrame) -> DataFrame:
    """q, best_id, best, second: scores of the two best distinct concepts (second null with one concept)."""
    top = top_k(spans, skills, 2)
    return top.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("best_id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))


def hash_embed(docs: DataFrame, key: str, col: str, dim: int) -> DataFrame:
    """Signed feature hashing of words and letter trigrams of the normalised text into ``dim`` cells, unit length: key, cell, value.

    An empty text has the one feature "".
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).alias("k"), X.normalize_label(F.coalesce(F.col(col), F.lit(""))).alias("t"))

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        def hashed(feature: str) -> int:
            """Twice the cell, and 1 more for a negative sign."""
            h = hashlib.md5(feature.encode()).hexdigest()
            return int(h[:8], 16) % dim * 2 + int(h[8], 16) % 2

        known: dict[str, int] = {}

        def hashed_all(features):
            if len(known) > FEATURES:
                known.clear()
            return np.array([known[f] if f in known else known.setdefault(f, hashed(f)) for f in features], np.int64)

        def slices(texts):  # of about LETTERS; a longer text is one of its own
            begin = size = 0
            for end, t in enumerate(texts):
                if size and size + len(t) > LETTERS:
                    yield begin, end
                    begin, size = end, 0
                size += len(t)
            yield begin, len(texts)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in slices(texts) if texts else ():
                some = texts[begin:end]
                words = [[w for w in t.split(" ") if w] or ([""] if not t else []) for t in some]
                rows, cells = [np.repeat(np.arange(len(some)), [len(w) for w in words])], [hashed_all([w for x in words for w in x])]
                row = np.repeat(np.arange(len(some)), [len(t) for t in some])
                letters = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
                whole = np.flatnonzero(row[2:] == row[:-2])  # three letters of one text
                grams, which = np.unique(letters[whole] << 42 | letters[whole + 1] << 21 | letters[whole + 2], return_inverse=True)
                mask = (1 << 21) - 1
                each = hashed_all([f"#{chr(g >> 42)}{chr(g >> 21 & mask)}{chr(g & mask)}" for g in grams.tolist()])
                rows, cells = np.concatenate([*rows, row[whole]]), np.concatenate([*cells, each[which]])
                counts = np.bincount(rows * (2 * dim) + cells, minlength=len(some) * 2 * dim).reshape(-1, dim, 2)
                at, cell = np.nonzero(counts.sum(2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin + at)), pa.array(cell.astype(np.int64)), pa.array(counts[at, cell, 0] - counts[at, cell, 1])], names=["k", "cell", "v"])

    # features add up to cells where their text is read: at most ``dim`` rows of a document are shuffled
    schema = T.StructType([docs.schema["k"], T.StructField("cell", T.LongType()), T.StructField("v", T.LongType())])
    cells = docs.mapInArrow(run, schema).groupBy("k", "cell").agg(F.sum("v").alias("v"))
    z = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("k")))
    return cells.withColumn("z", z).select(F.col("k").alias(key), "cell", F.when(F.col("z") > 0, F.col("v") / F.col("z")).otherwise(0.0).alias("value"))


def ensure_vectors(skills: DataFrame, model: str) -> DataFrame:
    """skills (skill_id, model) with ``embed``: only rows without a vector, or all once any row has another model's."""
    mixed = skills.agg((~F.coalesce(F.bool_and(F.col("model").isNull() | (F.col("model") == model)), F.lit(True))).alias("mixed"))
    return skills.crossJoin(F.broadcast(mixed)).select("skill_id", (F.col("mixed") | F.col("model").isNull()).alias("embed"))


def steps(low: int, high: int) -> list[float]:
    """The hundredths from ``low`` to ``high``."""
    return [v / 100 for v in range(low, high + 1)]


def sweep(scores: DataFrame, threshold: tuple[int, int] = (40, 95), margin: tuple[int, int] = (0, 20), high_max: int = 98) -> DataFrame:
    """Links of every setting of the two-tier rule, the best setting first: threshold, margin, high, true_links, false_links, missed, safety, place.

    scores: gold, best_id (nullable ids), best, second (null: nothing else is near). Ranges are in hundredths; high runs from each threshold to ``high_max``.
    Safety is the smallest distance of a right decision (a true link, or no link where it would be a false one) from being decided otherwise, 0 without one.
    Order: fewest false links, most true ones, largest safety; then threshold, margin and high. Without scores there are no settings.

    Dominance counting: scores fall into cells of the grid (by best, by margin, by second) once, and a cell keeps its counts and its extreme scores, so
    a table bounded by the grid is all that is left of the rows. The rows that a setting links are those that dominate one of two corners, so counts
    are differences of cumulative sums and distances are cumulative extremes of the cells, looked up for all settings at once.
    """
    ship(scores.sparkSession)
    bests, margins, seconds = steps(threshold[0], high_max), steps(*margin), steps(threshold[0] - margin[1], high_max - margin[0])

    def cell(value: Column, grid: list[float]) -> Column:
        """How many of the grid's values don't exceed the value."""
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= value))

    best, second = F.col("best"), F.coalesce(F.col("second"), F.lit(float("-inf")))
    right = F.coalesce(F.col("gold") == F.col("best_id"), F.lit(False))
    rows = scores.select(best.alias("b"), (best - second).alias("m"), right.alias("right"), F.col("gold").isNotNull().alias("known"), cell(best, bests).alias("cb"), cell(best - second, margins).alias("cm"), cell(second, seconds).alias("cs"))
    ends = [f("b" if c == "b" else "m").alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "bm"]
    cells = rows.groupBy("cb", "cm", "cs", "right").agg(F.count("*").alias("n"), F.count(F.when(F.col("known"), 1)).alias("known"), *ends)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        shape = len(bests) + 1, len(margins) + 1, len(seconds) + 1
        at = {side: pdf[pdf["right"] == side] for side in (True, False)}

        def table(side: bool, column: str, empty: float):
            out = np.full(shape, empty)
            out[tuple(at[side][c].to_numpy() for c in ("cb", "cm", "cs"))] = at[side][column].to_numpy()
            return out

        def running(values, op, axes: str):
            """Running sums or extremes over the cells; an axis marked > is taken from its end."""
            for axis, way in enumerate(axes):
                turned = np.flip(values, axis) if way == ">" else values
                turned = op.accumulate(turned, axis)
                values = np.flip(turned, axis) if way == ">" else turned
            return values

        t, m, h = (x.ravel() for x in np.meshgrid(np.arange(threshold[1] - threshold[0] + 1), np.arange(len(margins)), np.arange(len(bests)), indexing="ij"))
        t, m, h = (x[h >= t] for x in (t, m, h))
        vt, vm, vh = np.array(bests)[t], np.array(margins)[m], np.array(bests)[h]
        # places in the tables: at or above the k-th value of the grid is cell k + 1 on; all seconds, or those below or above a difference of cut-offs
        all_m, all_s = shape[1] - 1, shape[2] - 1

        def linked(values, s, op):
            """Over the rows linked: best at or above high, or at or above the threshold with the margin."""
            return op(values[h + 1, 0 * m, s], values[t + 1, m + 1, s])

        def refused(values, s, op):
            """Over the others: best below the threshold, or below high without the margin."""
            return op(values[t, 0 * m + all_m, s], values[h, m, s])

        counts = {}
        for side, column in ((True, "n"), (False, "n"), (False, "known"), (True, "known")):
            up = running(table(side, column, 0.0), np.add, ">><")[:, :, all_s]
            counts[side, column] = up[0, 0], up[h + 1, 0] + up[t + 1, m + 1] - up[h + 1, m + 1]
        missed = sum(counts[side, "known"][0] - counts[side, "known"][1] for side in (True, False))
        inf = np.inf
        # a true link: min(best - threshold, max(best - high, margin - its cut-off)); the larger of the two is the first where second reaches high - margin
        k = h - m + (margin[1] - margin[0])
        near = linked(running(table(True, "low_b", inf), np.minimum, ">><"), all_s, np.minimum) - vt
        above = linked(running(table(True, "low_b", inf), np.minimum, ">>>"), k + 1, np.minimum) - vh
        below = linked(running(table(True, "low_m", inf), np.minimum, ">><"), k, np.minimum) - vm
        safe = np.minimum(near, np.minimum(above, below))
        # a refused false one: min(high - best, max(threshold - best, cut-off - margin)), the first where second lies below threshold - margin
        k = t - m + (margin[1] - margin[0])
        near = vh - refused(running(table(False, "high_b", -inf), np.maximum, "<<<"), all_s, np.maximum)
        below = vt - refused(running(table(False, "high_b", -inf), np.maximum, "<<<"), k, np.maximum)
        above = vm - refused(running(table(False, "high_m", -inf), np.maximum, "<<>"), k + 1, np.maximum)
        safe = np.minimum(safe, np.minimum(near, np.minimum(below, above)))
        out = pd.DataFrame({"threshold": vt, "margin": vm, "high": vh, "true_links": counts[True, "n"][1], "false_links": counts[False, "n"][1], "missed": missed, "safety": np.where(np.isfinite(safe), safe, 0.0).round(6)})
        out["place"] = np.lexsort((vh, vm, vt, -out["safety"], -out["true_links"], out["false_links"])).argsort() + 1
        return out

    schema = "threshold double, margin double, high double, true_links long, false_links long, missed long, safety double, place long"
    return cells.groupBy().applyInPandas(settle, schema)  # one group, of at most a row per cell


def link_prf(spans: DataFrame) -> DataFrame:
    """TP, FP, FN by mention and overall; a wrong id counts as both. spans: mention, gold, said (nullable ids)."""
    g, s = F.col("gold"), F.col("said")

    def n(c):
        return F.count(F.when(c, 1))

    return spans.cube("mention").agg(
        n(s.isNotNull() & s.eqNullSafe(g)).alias("tp"), n(s.isNotNull() & ~s.eqNullSafe(g)).alias("fp"), n(g.isNotNull() & ~s.eqNullSafe(g)).alias("fn")
    ).withColumn("mention", F.coalesce("mention", F.lit("all")))




def phrase_sample(spans: DataFrame, key: str, col: str, size: int, seed: int) -> DataFrame:
    """``size`` distinct normalised phrases (the smallest key of each), the same ones for the same seed."""
    norm = X.normalize_label(F.col(col))
    first = spans.groupBy(norm.alias("n")).agg(F.min(F.struct(key, col)).alias("f")).where("n <> ''")
    return first.orderBy(F.md5(F.concat("n", F.lit(f":{seed}")).cast("binary"))).limit(size).select("f.*")
