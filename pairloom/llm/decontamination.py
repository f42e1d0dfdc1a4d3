"""Benchmark decontamination: windows of ten words against a broadcast hash set, in DataFrame functions only.

Benchmark texts become distinct word windows (an item of fewer words is one window), keyed by hash. Each text of the table
is scanned once: all its window hashes, exploded next to one marker row, meet the windows in a broadcast hash join inside
the scan's stage; hits are verified word for word. Only the marker and the hits are shuffled, to their own document.

The windows are broadcast only if they are at most ``MOST_BROADCAST`` (the benchmark is a fixed set, not the corpus);
beyond that the join shuffles, hashes and positions only: the texts that have a hash in common are gathered once
more, a row each, to be verified.

Defined results: null and empty texts have no words and no hits; items without words never occur; rows that share an id
are told apart by their text, and rows equal in both give a row each; null ids stay; empty tables give no rows, or no hits; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import saved, small

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
MOST_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased and nothing else changed."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def item_windows(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """h, size, w (the window's words joined by blanks), items (ids that hold it): one row per distinct window."""
    worded = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    each = worded.select("item", F.explode_outer(F.transform(at, lambda k: F.slice("words", k, width))).alias("ws"))
    return each.groupBy("ws").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        F.xxhash64("ws").alias("h"), F.size("ws").alias("size"), F.array_join("ws", " ").alias("w"), "items"
    )


def scan(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: d (id), x (hash of its text), n_words, n_hit, hit_items, spans (array of struct s, e).

    ``spans`` are the merged hit intervals in word positions, from 0, end exclusive.
    """
    windows = item_windows(items, width, item_col, item_text)
    known = windows.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()  # at most `width` sizes
    sizes = sorted(known["sizes"]) or [width]
    # Generators here are outer ones (their arrays are never empty): for others, Catalyst infers a filter on the array's
    # size, pushes it below and splits the text again for every window.
    worded = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("x"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")

    def hashes(size: int) -> Column:  # one entry per word position, null where no window starts
        found = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda k: F.xxhash64(F.slice("words", k, size))))
        found = F.coalesce(found, F.array().cast("array<bigint>"))
        return F.concat(found, F.array_repeat(F.lit(None).cast("bigint"), n - F.size(found))) if len(sizes) > 1 else found

    marked = F.concat(F.array(F.lit(None).cast("bigint")), *[hashes(s) for s in sizes])
    index = ((F.col("p") - 1) / F.greatest("n_words", F.lit(1))).cast("int")
    start = F.when(F.lit(len(sizes) > 1), (F.col("p") - 1) % F.greatest("n_words", F.lit(1))).otherwise(F.col("p") - 1)
    size_at = F.get(F.array(*map(F.lit, sizes)), index) if len(sizes) > 1 else F.lit(sizes[0])
    met = (F.col("hash") == F.col("h")) & (F.col("size") == size_at)
    if known["n"] <= most_broadcast:
        rows = worded.select("d", "x", "words", n.alias("n_words"), marked.alias("hs")).select("d", "x", "words", "n_words", F.posexplode_outer("hs").alias("p", "hash"))
        same = met & (F.array_join(F.slice("words", start + 1, F.col("size")), " ") == F.col("w"))
        hits = rows.join(F.broadcast(windows), same, "left").where("p = 0 or h is not null").select(
            "d", "x", "n_words", "p", F.when(F.col("p") > 0, F.struct(start.alias("s"), (start + F.col("size")).alias("e"))).alias("span"), "items"
        )
        per = hits.groupBy("d", "x").agg(
            F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("found"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"), F.count(F.when(F.col("p") == 0, 1)).cast("int").alias("n"),
        )
        per = per.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("again", "n")  # rows equal in id and text
    else:
        rows = worded.select("d", "x", n.alias("n_words"), marked.alias("hs")).select("d", "x", "n_words", F.posexplode_outer("hs").alias("p", "hash")).where("hash is not null")
        near = rows.join(windows, met).select(F.col("d").alias("d1"), F.col("x").alias("x1"), F.struct(start.alias("s"), "size", "w", "items").alias("hit"))
        near = near.groupBy("d1", "x1").agg(F.collect_set("hit").alias("near"))
        both = worded.join(near, F.col("d").eqNullSafe(F.col("d1")) & (F.col("x") == F.col("x1")), "left")
        real = F.coalesce(F.filter("near", lambda v: F.array_join(F.slice("words", v["s"] + 1, v["size"]), " ") == v["w"]), F.array().cast(both.schema["near"].dataType))
        both = both.select("d", "x", F.size("words").cast("long").alias("n_words"), real.alias("real"))
        spans = F.array_sort(F.array_distinct(F.transform("real", lambda v: F.struct(v["s"].alias("s"), (v["s"] + v["size"]).alias("e")))))
        per = both.select("d", "x", "n_words", spans.alias("found"), F.sort_array(F.array_distinct(F.flatten(F.transform("real", lambda v: v["items"])))).alias("hit_items"))
    merged = F.aggregate(
        "found", F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, v: F.when((F.size(acc) > 0) & (v["s"] <= F.element_at(acc, -1)["e"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], v["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(v["s"].alias("s"), v["e"].alias("e"))))),
    )
    found = per.withColumn("spans", merged)
    return found.select("d", "x", "n_words", F.aggregate("spans", F.lit(0), lambda a, v: a + v["e"] - v["s"]).cast("long").alias("n_hit"), "hit_items", "spans")


def report(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs, items, id_col=id_col, **names).select(
        F.col("d").alias(id_col), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_share: float = 0.0, **names) -> DataFrame:
    """``docs`` without the documents of which more than ``most_share`` of the words are hit; its columns, unchanged."""
    bad = scan(docs, items, id_col=id_col, text_col=text_col, **names).where(F.col("n_hit") > F.col("n_words") * most_share).select("d", "x").distinct()
    hit = F.col(id_col).eqNullSafe(F.col("d")) & (F.xxhash64(text_col) == F.col("x"))
    return docs.join(small(saved(bad, "contaminated"), MOST_BROADCAST), hit, "left_anti")
